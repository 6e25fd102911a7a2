"""Changes between snapshots against a row-by-row version."""

import datetime
import json
import random
import unicodedata

import pytest

from graphloom.operators import snapshots
from graphloom.operators.snapshots import IGNORED_KEYS, snapshot_changes

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "project_name string, source_type string, object_qn string, snapshot_no int, object_hash string, object_snapshot_json string, delivered_at timestamp_ntz, k1 string, row int"


def bare(value):
    if isinstance(value, dict):
        return {k: bare(v) for k, v in value.items() if k not in IGNORED_KEYS}
    return [bare(v) for v in value] if isinstance(value, list) else value


def read(text):
    try:
        return (json.dumps(bare(json.loads(text)), sort_keys=True),) if text is not None else None
    except ValueError:
        return None


def name(x):
    return None if x is None else unicodedata.normalize("NFC", x.strip())


def brute(rows):
    latest = {}
    for p, t, q, s, h, j, d, *_ in rows:
        if s is None:
            continue
        key = name(p), name(t), name(q), s
        if key not in latest or (d or datetime.datetime.min) > (latest[key][2] or datetime.datetime.min):
            latest[key] = h, j, d
    out = set()
    for scope in {k[:2] for k in latest}:
        numbers = sorted({k[3] for k in latest if k[:2] == scope})
        for a, b in zip(numbers, numbers[1:]):
            old = {k[2]: v for k, v in latest.items() if k[:2] == scope and k[3] == a}
            new = {k[2]: v for k, v in latest.items() if k[:2] == scope and k[3] == b}
            for q in old.keys() | new.keys():
                if q not in old:
                    out.add((*scope, q, b, "added", None, new[q][1]))
                elif q not in new:
                    out.add((*scope, q, b, "removed", old[q][1], None))
                else:
                    (h0, j0, _), (h1, j1, _) = old[q], new[q]
                    x, y = read(j0), read(j1)
                    differs = x != y if x and y else (h0 and h0.strip().lower()) != (h1 and h1.strip().lower())
                    if differs:
                        out.add((*scope, q, b, "changed", j0, j1))
    return out


def make():
    rng = random.Random(4)
    rows = []
    for p in ("a", "b ", None):
        for s in sorted(rng.sample(range(1, 9), 5)):
            for q in range(25):
                if rng.random() < 0.8:
                    value = {"b": rng.choice([1, 1, 1, "1", True]), "a": [1, 2], "meta_uuid": rng.random(), "n": {"description_embedding": rng.random(), "x": "é"}}
                    text = rng.choice([json.dumps(value), json.dumps(value, indent=1, sort_keys=True), json.dumps(value, ensure_ascii=False), "{broken", None]) if rng.random() < 0.5 else '{"a":1}'
                    qn = rng.choice([f"о/й{q}", unicodedata.normalize("NFD", f"о/й{q}"), f" о/й{q} "])
                    rows.append((p, rng.choice(["txt"] * 9 + [" txt"]), qn, s, rng.choice(["H", "h", "g", None]), text, AT + datetime.timedelta(seconds=len(rows)), "clash", 1))
    rows += [(*r[:5], '{"late":1}', None, "clash", 1) for r in rows[:40]]
    rows += [("a", "txt", "x", None, "h", "{}", AT, None, None), ("a", "txt", None, 3, "h", "{}", AT, None, None), ("big", "txt", "x", 1, "h", json.dumps(["y" * 300_000]), AT, None, None), ("big", "txt", "x", 2, "h", json.dumps(["z" * 300_000]), AT, None, None)]
    rng.shuffle(rows)
    return rows + rows[:30]


@pytest.mark.parametrize("most", [0, 200_000])
def test_changes_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(snapshots, "CHANGES_BROADCAST_ROWS", most)
    monkeypatch.setattr(snapshots, "CALENDAR_BROADCAST_ROWS", most)
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    found = snapshot_changes(df, ["object_qn"], ["project_name", "source_type"], values=True).collect()
    want = brute(rows)
    assert len(want) > 100
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    plain = snapshot_changes(df, ["object_qn"], ["project_name", "source_type"]).collect()
    assert {tuple(r) for r in plain} == {w[:5] for w in want} and len(plain) == len(want)


def test_empty_table(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA), ["object_qn"], ["project_name", "source_type"]).collect() == []
