"""Traversals on small graphs with loops, diamonds and bridges, against step-by-step versions."""

import random

import pytest

from graphloom.operators import graph

EDGES = [("a", "b", "R"), ("b", "c", "R"), ("a", "c", "S"), ("c", "a", "R"), ("c", "c", "R"), ("c", "d", "R"), ("d", "e", "S"), ("b", "d", "R"), ("x", "y", "R")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src string, dst string, rel string")


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def walks(rows, start, depth, node_simple):
    out, front = set(), [((start,), ())]
    for _ in range(depth):
        front = [
            (nodes + (d,), used + ((s, r, d),)) for nodes, used in front for s, d, r in set(rows) if s == nodes[-1] and (d not in nodes if node_simple else (s, r, d) not in used)
        ]
        out |= {(nodes, tuple(r for _, r, _ in used)) for nodes, used in front}
    return out


@pytest.mark.parametrize("node_simple", [True, False])
@pytest.mark.parametrize("depth", [1, 2, 4])
def test_trails(spark, node_simple, depth):
    found = graph.trails(edges(spark), starts(spark, "a", "x", "none"), depth, node_simple).collect()
    got = [(tuple(r["nodes"]), tuple(r["rels"])) for r in found]
    want = walks(EDGES, "a", depth, node_simple) | walks(EDGES, "x", depth, node_simple)
    assert set(got) == want and len(got) == len(want)


def test_reachable_ends_on_cycles(spark):
    assert {(r["node"], r["depth"]) for r in graph.reachable(edges(spark), starts(spark, "a")).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert {(r["node"], r["depth"]) for r in graph.reachable(edges(spark), starts(spark, "a"), 1).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_depths_are_clamped():
    assert graph.clamp(0) == 1 and graph.clamp(99) == graph.MAX_DEPTH


@pytest.mark.parametrize("direction", ["downstream", "upstream", "both"])
def test_directions_and_relations(spark, direction):
    rows = [(s, d, r) for s, d, r in EDGES if r == "R" and s != d]
    way = {"downstream": rows, "upstream": [(d, s, "^" + r) for s, d, r in rows]}
    way["both"] = way["downstream"] + way["upstream"]
    found = {r["path"] for r in graph.dependency_paths(edges(spark, [e for e in EDGES if e[0] != e[1]]), starts(spark, "c"), direction, ["R"], 3).collect()}
    assert found == {nodes[0] + "".join(f" -[{r}]-> {n}" for r, n in zip(rels, nodes[1:])) for nodes, rels in walks(way[direction], "c", 3, True)}


@pytest.mark.parametrize("seed", range(3))
def test_bridges_cost_no_depth(spark, seed):
    rng = random.Random(seed)
    nodes = [f"o{i}" for i in range(5)] + [f"r{i}" for i in range(8)]
    rows = list({(rng.choice(nodes), rng.choice(nodes), "R") for _ in range(22)})
    owners = {f"r{i}": (f"o{rng.randrange(5)}", rng.random() < 0.6) for i in range(8) if i % 4}
    want, front = set(), [(n, [n], n) for n in ("o0", "r1")]
    for level in (1, 2, 3):
        hops = [(d, seen + [d], f"{path} -[{r}]-> {d}") for end, seen, path in front for s, d, r in rows if s == end and d not in seen]
        want |= {(path.split(" ")[0], d, level, path) for d, _, path in hops}
        front = [h for h in hops if h[0] not in owners or owners[h[0]][1]] + [(owners[d][0], seen + [owners[d][0]], f"{path} => {owners[d][0]}") for d, seen, path in hops if d in owners and owners[d][0] not in seen]
    own = spark.createDataFrame([(e, o, i) for e, (o, i) in owners.items()], "element string, owner string, itself boolean")
    found = graph.bridged_paths(edges(spark, rows), starts(spark, "o0", "r1"), own, 3).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_pages_of_paths_join_to_the_whole(spark):
    paths = graph.dependency_paths(edges(spark), starts(spark, "a"), depth=4)
    whole = [tuple(r) for r in paths.orderBy("depth", "path").collect()]
    pages = [r for offset in range(0, len(whole), 3) for r in graph.page_of_paths(paths, offset, 3).orderBy("path_no").collect()]
    assert [tuple(r)[:4] for r in pages] == whole and [r["path_no"] for r in pages] == list(range(1, len(whole) + 1))
