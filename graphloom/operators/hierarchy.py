"""Parent-child links to full hierarchies.

Method: pointers to parents are first shortened within ranges of names, where most of a tree lies together, then
squared over all ranges until every node that hangs in a tree knows its root. What is left hangs on cycles; its
leaves are peeled until only the cycles stand. The forest becomes Euler tours, ranked by parallel list ranking:
trees up to ``LOCAL_TREE`` nodes whole, many per task, as numpy arrays; larger ones by distributed pointer
doubling. A node's entry and exit positions give depth, root, ancestors and descendants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import composed_name
from graphloom.plans.session import cut, tasks_for

#: Nodes of a tree that one task may hold; larger trees are ranked by distributed doubling.
LOCAL_TREE = 100_000
NODES_PER_TASK = 400_000
#: Children of one parent are chained as siblings in stretches of this many bits of their ids.
SIBLING_BITS = 16
#: Tour positions walked in one piece when lines of names are written, and characters of a batch of them.
TOUR_BLOCK, BATCH_CHARS = 100_000, 8_000_000


def current_links(df: DataFrame, table: str, child: str = "child_qn", parent: str = "parent_qn", loaded: str = "loaded_at") -> DataFrame:
    """(edge_table, name, parent): the latest row of each child.

    Names are trimmed and composed; a blank name is none. Rows without a child are void; a row without a
    parent says that the child has none. Equal times tie by the larger parent name, a null time is earliest.
    """
    named = df.select(composed_name(F.col(child)).alias("name"), composed_name(F.col(parent)).alias("parent"), F.col(loaded).alias("loaded"))
    named = named.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("name", "parent")], "loaded")
    latest = named.where(F.col("name").isNotNull()).groupBy("name").agg(F.max(F.struct("loaded", "parent")).alias("v"))
    return latest.select(F.lit(table).alias("edge_table"), "name", F.col("v.parent").alias("parent"))


#: Bits of an id below the number of its range.
_RANGE_BITS = 33


def _numbered(links: DataFrame) -> DataFrame:
    """(id, pid, edge_table, name): all names of the links; pid null for a root. Written, so ids stay.

    Ids follow the names, in UTF-8 byte order, table by table; their high bits tell the range of names.
    """
    ends = links.select("edge_table", "name", "parent").unionByName(
        links.where(F.col("parent").isNotNull()).select("edge_table", F.col("parent").alias("name"), F.lit(None).cast("string").alias("parent"))
    )
    named = ends.groupBy("edge_table", "name").agg(F.max("parent").alias("parent")).repartitionByRange("edge_table", "name").sortWithinPartitions("edge_table", "name")
    nodes = cut(named.withColumn("id", F.monotonically_increasing_id()))
    up = nodes.select("edge_table", F.col("name").alias("parent"), F.col("id").alias("pid"))
    return cut(nodes.join(up, ["edge_table", "parent"], "left").select("id", "pid", "edge_table", "name"))


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pid) of whole ranges: pointers (id, ptr, ends) to the root if the way to it stays among them, else to the first node outside; on a cycle inside to any node ahead."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, pids = table.column("id").to_numpy(), table.column("pid").fill_null(-1).to_numpy()
    order = np.argsort(ids)
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, pids, sorter=order), n - 1)
    inside = (pids >= 0) & (ids[order[at]] == pids)
    ptr = np.where(inside, order[at], np.arange(n))
    for _ in range(n.bit_length() + 1):
        ahead = ptr[ptr]
        if np.array_equal(ahead, ptr):
            break
        ptr = ahead
    stop = ptr  # the last node of the way that lies inside; itself on a cycle inside
    root = (pids[stop] < 0) & ~inside[stop]
    to = np.where(root, ids[stop], np.where(inside[stop], ids[stop], pids[stop]))
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "ptr": pa.array(to), "ends": pa.array(root)})


def _peel(nodes: DataFrame) -> tuple[DataFrame, int]:
    """((id, ptr, ends), number without an end): ``ends`` if the node hangs in a tree, with its root as ptr; the others hang on cycles.

    A round doubles the reach of all pointers. If it brings no further node to its root, none is left that has one:
    such nodes would stand at every distance up to the largest.
    """
    state = cut(nodes.select("id", "pid").repartition(F.shiftright("id", _RANGE_BITS)).mapInArrow(_shortened, "id long, ptr long, ends boolean"))
    left = state.where(~F.col("ends")).count()
    while left:
        jumps = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("ends").alias("to_ends"))
        moved = state.where(~F.col("ends")).join(jumps, "ptr").select("id", F.col("to").alias("ptr"), F.col("to_ends").alias("ends"))
        state = cut(state.where("ends").unionByName(moved))
        before, left = left, state.where(~F.col("ends")).count()
        if left == before:
            break
    return state, left


def _rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pid, name) of all nodes on and below cycles: (id, cycle_name), by peeling leaves and then going around each cycle."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, names = table.column("id").to_numpy(), table.column("name").to_pylist()
    order = np.argsort(ids)
    parent = order[np.searchsorted(ids, table.column("pid").to_numpy(), sorter=order)]
    children = np.bincount(parent, minlength=len(ids))
    peeled: list[int] = list(np.flatnonzero(children == 0))
    for node in peeled:
        up = parent[node]
        children[up] -= 1
        if children[up] == 0:
            peeled.append(int(up))
    least: list[str | None] = [None] * len(ids)
    for start in np.flatnonzero(children):
        if least[start] is None:
            around, node = [int(start)], int(parent[start])
            while node != start:
                around.append(node)
                node = int(parent[node])
            name = min((names[i] for i in around), key=lambda x: x.encode("utf-8", "surrogatepass"))
            for i in around:
                least[i] = name
    # Peeled last is nearest to the cycle.
    for node in reversed(peeled):
        least[node] = least[parent[node]]
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "cycle_name": pa.array(least, pa.string())})


def _caught(nodes: DataFrame, state: DataFrame, number: int, local: int) -> DataFrame:
    """(id, cycle_name) of the nodes on and below cycles: the smallest name around the cycle; beyond ``local`` of them by squaring."""
    held = nodes.join(state.where(~F.col("ends")).select("id"), "id", "left_semi").select("id", "pid", "name")
    if number <= local:
        return held.repartition(1).mapInArrow(_rings, "id long, cycle_name string")
    held = cut(held)
    # After t peelings the survivors are the image of the t-th power of the parent function, here a power of two.
    powers, survivors = cut(held.select("id", F.col("pid").alias("ptr"))), -1
    while True:
        image = powers.agg(F.count_distinct("ptr")).first()[0]
        if image == survivors:
            break
        survivors = image
        powers = cut(powers.join(powers.select(F.col("id").alias("ptr"), F.col("ptr").alias("to")), "ptr").select("id", F.col("to").alias("ptr")))
    rings = _cycle_names(held, powers.withColumn("ends", F.lit(False)))
    return powers.join(rings.select(F.col("id").alias("ptr"), "cycle_name"), "ptr").select("id", "cycle_name")


def _cycle_names(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """(id, cycle_id, cycle_name) of each node on a cycle: the smallest name around it."""
    on = state.where(~F.col("ends")).select(F.col("ptr").alias("id")).distinct()
    ring = cut(nodes.join(on, "id", "left_semi").select("id", F.col("pid").alias("ptr"), F.struct("name", "id").alias("least")))
    left = ring.count()
    span = 1
    while span < left:
        ahead = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("least").alias("other"))
        ring = cut(ring.join(ahead, "ptr").select("id", F.col("to").alias("ptr"), F.least("least", "other").alias("least")))
        span *= 2
    return ring.select("id", F.col("least.id").alias("cycle_id"), F.col("least.name").alias("cycle_name"))


def rank_lists(succ: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointer doubling over many linked lists: (last element, steps to it, weight of it and all before it from here).

    ``succ`` of a last element is itself. Lists that run in a circle are an error.
    """
    ptr, steps = succ.copy(), (succ != np.arange(len(succ))).astype(np.int64)
    total = np.where(steps > 0, weight, 0).astype(np.int64)
    for _ in range(len(succ).bit_length() + 1):
        ahead = ptr[ptr]
        if np.array_equal(ahead, ptr):
            return ptr, steps, total + weight[ptr]
        total += np.where(ahead != ptr, total[ptr], 0)
        steps += np.where(ahead != ptr, steps[ptr], 0)
        ptr = ahead
    raise ValueError("a list runs in a circle")


def _tours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole trees (id, pid, root) of one task, toured together, siblings by id; arcs 2i enter node i and 2i+1 leave it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, pids = table.column("id").to_numpy(), table.column("pid").fill_null(-1).to_numpy()
    order = np.argsort(ids)
    n = len(ids)
    parent = np.where(pids < 0, -1, order[np.searchsorted(ids, np.where(pids < 0, ids, pids), sorter=order)])
    siblings = np.lexsort((ids, parent))
    siblings = siblings[parent[siblings] >= 0]
    leave = np.arange(n) * 2 + 1
    succ = np.empty(2 * n, np.int64)
    succ[leave - 1] = leave
    succ[leave] = np.where(parent >= 0, parent * 2 + 1, leave)
    if len(siblings):
        p = parent[siblings]
        first = np.r_[True, p[1:] != p[:-1]]
        succ[p[first] * 2] = siblings[first] * 2
        follows = ~first[1:]
        succ[siblings[:-1][follows] * 2 + 1] = siblings[1:][follows] * 2
    weight = np.tile(np.array([1, -1]), n)
    last, steps, total = rank_lists(succ, weight)
    size = steps[(last // 2) * 2] + 1
    at = size - 1 - steps
    yield pa.RecordBatch.from_pydict(
        {"id": pa.array(ids), "root": pa.array(ids[last[::2] // 2]), "depth": pa.array(-total[::2]), "entry": pa.array(at[::2]), "exit": pa.array(at[1::2])}
    )


def _arcs(tree: DataFrame) -> DataFrame:
    """(arc, ptr, w) of the Euler tours of (id, pid); the last arc of a tour has no ptr.

    Siblings are chained by id, within stretches of ids and then stretch by stretch, so no window holds all children
    of one parent.
    """
    kids = tree.where(F.col("pid").isNotNull()).withColumn("part", F.shiftright("id", SIBLING_BITS))
    inner = Window.partitionBy("pid", "part").orderBy("id")
    chained = kids.select("id", "pid", "part", F.lead("id").over(inner).alias("next"), F.row_number().over(inner).alias("k"))
    heads = chained.where("k = 1").select("pid", "part", F.col("id").alias("head"))
    outer = Window.partitionBy("pid").orderBy("part")
    heads = heads.select("pid", "part", "head", F.lead("head").over(outer).alias("next_head"), F.row_number().over(outer).alias("h"))
    tails = chained.join(heads.select("pid", "part", "next_head"), ["pid", "part"])
    up = tails.select("id", "pid", F.coalesce("next", "next_head").alias("next"))
    down = heads.where("h = 1").select(F.col("pid").alias("id"), F.col("head").alias("first"))
    enter = tree.select("id").join(down, "id", "left").select(
        (F.col("id") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("ptr"), F.lit(1).alias("w")
    )
    leave = up.select((F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("next") * 2, F.col("pid") * 2 + 1).alias("ptr"), F.lit(-1).alias("w"))
    final = tree.where(F.col("pid").isNull()).select((F.col("id") * 2 + 1).alias("arc"), F.lit(None).cast("long").alias("ptr"), F.lit(-1).alias("w"))
    return enter.unionByName(leave).unionByName(final)


def _ranked(tree: DataFrame) -> DataFrame:
    """(id, root, depth, entry, exit) of trees too large for one task, by distributed list ranking."""
    arcs = _arcs(tree).select(
        "arc", F.coalesce("ptr", "arc").alias("ptr"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.when(F.col("ptr").isNull(), F.lit(0)).otherwise(F.col("w")).cast("long").alias("total"), F.col("ptr").isNull().alias("done"),
    )
    arcs = cut(arcs)
    while arcs.where(~F.col("done")).limit(1).count():
        ahead = arcs.select(F.col("arc").alias("ptr"), F.col("ptr").alias("to"), F.col("steps").alias("s"), F.col("total").alias("t"), F.col("done").alias("d"))
        moved = arcs.where(~F.col("done")).join(ahead, "ptr").select(
            "arc", F.col("to").alias("ptr"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("total") + F.col("t")).alias("total"), F.col("d").alias("done")
        )
        arcs = cut(arcs.where("done").unionByName(moved))
    one = arcs.select(F.shiftright("arc", 1).alias("id"), (F.col("arc") % 2 == 0).alias("enters"), F.shiftright("ptr", 1).alias("root"), "steps", "total")
    both = one.groupBy("id").agg(
        F.max("root").alias("root"),
        F.max(F.when(F.col("enters"), F.col("steps"))).alias("s0"),
        F.max(F.when(~F.col("enters"), F.col("steps"))).alias("s1"),
        F.max(F.when(F.col("enters"), 1 - F.col("total"))).alias("depth"),
    )
    size = both.where("id = root").select("root", (F.col("s0") + 1).alias("size"))
    return both.join(size, "root").select("id", "root", "depth", (F.col("size") - 1 - F.col("s0")).alias("entry"), (F.col("size") - 1 - F.col("s1")).alias("exit"))


def hierarchies(links: DataFrame, local_tree: int = LOCAL_TREE) -> DataFrame:
    """(edge_table, node_qn, root_qn, depth, entry, exit, descendants) of every name in ``current_links`` rows.

    A root has depth 0 and itself as root. A node on a cycle or below one has depth -1, the cycle's smallest
    name (UTF-8 byte order) as root and no positions. v is below u in a tree exactly if they have the same
    root and entry(u) < entry(v) < exit(u); ``descendants`` counts them. Siblings follow each other by name in UTF-8
    byte order. Several tables may be mixed, each
    is its own forest. No links give no rows.
    """
    spark = links.sparkSession
    nodes = _numbered(links)
    state, bound = _peel(nodes)
    trees = nodes.join(state.where("ends").select("id", F.col("ptr").alias("root")), "id").select("id", "pid", "root")
    sizes = cut(trees.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    total, giants = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size") > local_tree)).first()
    schema = "id long, root long, depth long, entry long, exit long"
    if giants:
        big = sizes.where(F.col("size") > local_tree).select("root")
        small = trees.join(big, "root", "left_anti")
        large = _ranked(cut(trees.join(big, "root", "left_semi")))
    else:
        small, large = trees, None
    toured = small.repartition(tasks_for(spark, total, NODES_PER_TASK), "root").mapInArrow(_tours, schema)
    if large is not None:
        toured = toured.unionByName(large)
    names = nodes.select("id", "edge_table", "name")
    roots = sizes.join(names, sizes["root"] == names["id"]).select("root", F.col("name").alias("root_qn"))
    forest = toured.join(roots, "root").join(names, "id").select(
        "edge_table", F.col("name").alias("node_qn"), "root_qn", F.col("depth").cast("int").alias("depth"), "entry", "exit",
        F.expr("(exit - entry - 1) div 2").alias("descendants"),
    )
    if not bound:
        return forest
    caught = _caught(nodes, state, bound, local_tree).join(names, "id")
    none = F.lit(None).cast("long")
    return forest.unionByName(
        caught.select("edge_table", F.col("name").alias("node_qn"), F.col("cycle_name").alias("root_qn"), F.lit(-1).alias("depth"), none.alias("entry"), none.alias("exit"), none.alias("descendants"))
    )


def _lines(forest: DataFrame, schema: str, make) -> DataFrame:  # noqa: ANN001
    """Rows that ``make(edge_table, root_qn, names, depth)`` gives for every node, ``names`` being those from the root down to it.

    Each tree is cut into blocks of TOUR_BLOCK tour positions. A block has its nodes and those open at its
    start, in the order of their entries, so that one pass with a stack knows the line of every node. A node
    on or below a cycle has no line.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, exits, rows, size = None, [], [], [], 0
        for b in batches:
            for table, root, block, entry, end, depth, name in zip(*(b.column(c).to_pylist() for c in ("edge_table", "root_qn", "block", "entry", "exit", "depth", "node_qn"))):
                if (table, root, block) != at:
                    at, names, exits = (table, root, block), [], []
                while exits and exits[-1] < entry:
                    exits.pop()
                    names.pop()
                names.append(name)
                exits.append(end)
                if entry // TOUR_BLOCK == block:
                    for row in make(table, root, names, depth):
                        rows.append(row)
                        size += 100 + len(row[2])
                        if size > BATCH_CHARS:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=columns)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=columns)

    blocks = F.sequence(F.expr(f"entry div {TOUR_BLOCK}"), F.expr(f"exit div {TOUR_BLOCK}"))
    placed = cut(forest.where("entry is not null").select("edge_table", "root_qn", "node_qn", F.col("depth").cast("long").alias("depth"), "entry", "exit", F.explode(blocks).alias("block")))
    keys = ["edge_table", "root_qn", "block"]
    return placed.repartition(tasks_for(forest, placed.count(), NODES_PER_TASK // 10), *keys).sortWithinPartitions(*keys, "entry").mapInArrow(walk, schema)


def descendants_of(forest: DataFrame) -> DataFrame:
    """(edge_table, ancestor_qn, node_qn, distance): all descendants of every node; nodes on or below cycles have none.

    The rows are as many as the sum of all depths, which is the size of the answer.
    """

    def make(table: str, root: str, names: list[str], depth: int) -> Iterator[tuple]:
        return ((table, above, names[-1], depth - i) for i, above in enumerate(names[:-1]))

    return _lines(forest, "edge_table string, ancestor_qn string, node_qn string, distance long", make).withColumn("distance", F.col("distance").cast("int"))


def ancestor_paths(forest: DataFrame, separator: str = " > ") -> DataFrame:
    """(edge_table, node_qn, path, depth) of every node: the names from the root down, joined by ``separator``.

    On or below a cycle the path is null and the depth -1.
    """

    def make(table: str, root: str, names: list[str], depth: int) -> Iterator[tuple]:
        yield table, names[-1], separator.join(names), depth

    found = _lines(forest, "edge_table string, node_qn string, path string, depth long", make).withColumn("depth", F.col("depth").cast("int"))
    caught = forest.where("entry is null").select("edge_table", "node_qn", F.lit(None).cast("string").alias("path"), "depth")
    return found.unionByName(caught)
