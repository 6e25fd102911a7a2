"""Paths and descendants of every node of both link tables against brute force."""

import datetime
import random

import pytest

from graphloom.operators import hierarchy
from graphloom.plans import problems

LINKS = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("f", None), ("x", "y"), ("y", "x"), ("z", "y"), *((f"n{i}", f"n{i - 1}") for i in range(1, 40)), *((f"m{i}", f"n{i}") for i in range(0, 40, 3))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("links")
    at = datetime.datetime(2024, 1, 1)
    for name in ("subsystem_edge", "child_rel"):
        spark.createDataFrame([(p, c, at) for c, p in LINKS], "parent_qn string, child_qn string, loaded_at timestamp_ntz").write.parquet(f"{d}/{name}.parquet")
    return str(d)


def lines() -> dict[str, list[str] | None]:
    parent = dict(LINKS)
    out: dict[str, list[str] | None] = {}
    for node in {n for link in LINKS for n in link if n}:
        line = [node]
        while (up := parent.get(line[0])) and len(line) <= len(parent):
            line.insert(0, up)
        out[node] = None if len(line) > len(parent) else line
    return out


@pytest.mark.parametrize("block", [100_000, 8])
@pytest.mark.parametrize(("kind", "table"), [("subsystem", "subsystem_edge"), ("control", "child_rel")])
def test_every_node_has_its_path_and_descendants(spark, folder, monkeypatch, kind, table, block):
    monkeypatch.setattr(hierarchy, "TOUR_BLOCK", block)
    queries = problems.queries()
    found = queries[f"p6_{kind}_paths"](spark, folder).collect()
    want = lines()
    assert len(found) == len(want)
    assert {(r["edge_table"], r["node_qn"], r["path"], r["depth"]) for r in found} == {(table, n, x and " > ".join(x), len(x) - 1 if x else -1) for n, x in want.items()}
    members = [tuple(r) for r in queries[f"p6_{kind}_members"](spark, folder).collect()]
    below = [(table, above, n, len(x) - 1 - i) for n, x in want.items() if x for i, above in enumerate(x[:-1])]
    assert sorted(members) == sorted(below)


def test_intervals_give_all_descendants(spark, folder):
    rows = [r for r in problems.queries()["p6_descendants"](spark, folder).collect()]
    got = {(u["edge_table"], u["node_qn"], v["node_qn"]) for u in rows for v in rows if u["entry"] is not None and v["entry"] is not None and (u["edge_table"], u["root_qn"]) == (v["edge_table"], v["root_qn"]) and u["entry"] < v["entry"] < u["exit"]}
    assert got == {(t, above, n) for t in ("subsystem_edge", "child_rel") for n, x in lines().items() if x for above in x[:-1]}


def many_links(seed):
    """Trees, deep lines, cycles of several lengths with tails, self loops and repeated names over both tables."""
    rng = random.Random(seed)
    rows = [(f"t{i:04d}", f"t{rng.randrange(max(0, i - 30), i):04d}" if i % 97 else None) for i in range(1, 1500)]
    rows += [(f"z{rng.random()}-{i}", None) for i in range(5)]
    deep = [f"d{rng.random():.6f}" for _ in range(600)]
    rows += list(zip(deep[1:], deep))
    for c in range(12):
        ring = [f"r{rng.random():.6f}" for _ in range(rng.choice([1, 1, 2, 3, 40]))]
        rows += [(ring[i], ring[i - 1]) for i in range(len(ring))]
        tail = ring[0]
        for _ in range(rng.choice([0, 1, 25])):
            new = f"q{rng.random():.6f}"
            rows.append((new, tail))
            tail = new
    return rows


@pytest.mark.parametrize("local", [10, 100_000])
def test_roots_depths_and_cycles(spark, monkeypatch, local):
    monkeypatch.setattr(hierarchy, "SIBLING_BITS", 1 if local == 10 else 16)
    rows = many_links(local)
    links = spark.createDataFrame([("e", c, p) for c, p in rows], "edge_table string, name string, parent string").repartition(7)
    parent = dict(rows)
    want = {}
    for node in {*parent, *parent.values()} - {None}:
        seen, at = [node], node
        while parent.get(at) is not None and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        if parent.get(at) is None:
            want[node] = (at, len(seen) - 1)
        else:
            want[node] = (min(seen[seen.index(parent[at]) :]), -1)
    found = hierarchy.hierarchies(links, local_tree=local).collect()
    assert len(found) == len(want)
    assert {r["node_qn"]: (r["root_qn"], r["depth"]) for r in found} == want
    # Tours go down by name: the entry of a node is told by its place among the lines of its tree.
    lines = {}
    for node, (root, depth) in want.items():
        line = [node]
        while depth >= 0 and parent.get(line[0]) is not None:
            line.insert(0, parent[line[0]])
        lines.setdefault(root if depth >= 0 else None, []).append([x.encode() for x in line])
    entries = {line[-1].decode(): 2 * i - len(line) + 1 for root, held in lines.items() if root for i, line in enumerate(sorted(held))}
    assert {r["node_qn"]: r["entry"] for r in found if r["entry"] is not None} == entries


def test_no_links(spark):
    assert hierarchy.hierarchies(spark.createDataFrame([], "edge_table string, name string, parent string")).collect() == []
