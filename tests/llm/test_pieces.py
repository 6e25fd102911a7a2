"""Pieces of long texts against a character-by-character version, in ranges so small that texts cross many of them."""

import datetime
import random

import pytest

from graphloom.llm.pieces import Limits, file_pieces, pieces

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, body string, loaded_at timestamp_ntz, part int, size int"


def brute(text, lim):
    if text is None or len(text) <= lim.most:
        return []
    lines, at = [], 0
    for line in text.split("\n")[:-1]:
        at += len(line) + 1
        bare = line.rstrip(" \t\r")
        lines.append((at, 0 if not bare else 1 if bare.endswith(";") else 2))
    out, start = [], 0
    while True:
        if len(text) - start <= lim.most:
            return [*out, (start, len(text))]
        can = [(k, -e) for e, k in lines if lim.least <= e - start <= lim.most] + [(3, -(start + n)) for n in range(lim.least, lim.most + 1) if text[start + n - 1] in " \t"]
        end = -min(can)[1] if can else start + lim.most
        out.append((start, end))
        near = [e for e, _ in lines if end - lim.far <= e <= end - lim.near]
        start = near[0] if near else end - lim.far


def texts():
    rng = random.Random(3)
    made = [None, "", "short"]
    for i in range(25):
        words = ["слово", "x;", "end", "  ", "é😀", "\n", "\n\n", ";\n", " \t\n", "\r\n", "длинноеслово" * rng.choice([1, 1, 30])]
        made.append("".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([20, 200, 900]))))
    return [*made, "x" * 5000, "\n" * 3000, "я" * 2000 + ";\n" + "я" * 3000]


LIMITS = [Limits(), Limits(most=120, least=90, far=40, near=20)]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("range_bytes", [64, 1_000, 256 * 1024])
def test_pieces_equal_brute_force(spark, limits, range_bytes):
    bodies = texts()
    rows = [(f"r{i}", t, AT, 1, 2) for i, t in enumerate(bodies)]
    rows += [(f"r{i}", "old " * 3000, AT - datetime.timedelta(days=1), 1, 2) for i in range(12)]
    rows += [("r7", bodies[7], AT, 1, 2)] * 40 + [("r9", "no time " * 900, None, 1, 2), (None, "no key " * 900, AT, 1, 2)]
    random.Random(5).shuffle(rows)
    found = pieces(spark.createDataFrame(rows, SCHEMA), "id", "body", limits=limits, range_bytes=range_bytes).collect()
    want = [(f"r{i}", k, *p) for i, t in enumerate(bodies) for k, p in enumerate(brute(t, limits))]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_files_are_read_in_ranges(spark, tmp_path):
    limits = LIMITS[1]
    paths = []
    for i, t in enumerate(texts()[1:]):
        paths.append(str(tmp_path / f"{i}.txt"))
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    found = sorted(tuple(r) for r in file_pieces(spark, paths, limits, 100).collect())
    assert found == sorted((paths[i], k, *p) for i, t in enumerate(texts()[1:]) for k, p in enumerate(brute(t, limits)))


def test_empty_table(spark):
    assert pieces(spark.createDataFrame([], SCHEMA), "id", "body").collect() == []
