"""Traversals over edge tables (src, dst, rel): bounded trails, closures, dependency paths, depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.session import cut

MAX_DEPTH = 10


def clamp(depth: int) -> int:
    """Depths run from 1 to MAX_DEPTH."""
    return max(1, min(MAX_DEPTH, depth))


def trails(edges: DataFrame, starts: DataFrame, depth: int, node_simple: bool = True) -> DataFrame:
    """(start, end, depth, nodes, rels): all paths of up to ``depth`` edges from the start nodes.

    With ``node_simple`` no node repeats in a path (self loops are skipped), else no edge does. Rows of
    ``edges`` are (src, dst, rel), of ``starts`` (start). Paths come out once; their number is bounded only
    by the depth, which is at most MAX_DEPTH.
    """
    steps = cut(edges.select("src", "dst", "rel").distinct())
    empty = F.array().cast("array<string>")
    front = starts.select("start").distinct().select("start", F.col("start").alias("end"), F.array("start").alias("nodes"), empty.alias("rels"), empty.alias("used"))
    found: DataFrame | None = None
    for level in range(1, clamp(depth) + 1):
        edge = F.concat_ws("\x1f", "src", "rel", "dst")
        free = ~F.array_contains("nodes", F.col("dst")) if node_simple else ~F.array_contains("used", edge)
        front = front.join(steps, F.col("end") == F.col("src")).where(free).select(
            "start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"), F.concat("used", F.array(edge)).alias("used")
        )
        if level > 1:
            front = cut(front)
        rows = front.select("start", "end", F.lit(level).alias("depth"), "nodes", "rels")
        found = rows if found is None else found.unionByName(rows)
    return found


def reachable(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, depth): the nodes reached from each start with the least number of edges, the start itself at 0.

    Level by level with an anti join against what is known, so cycles end; without ``depth`` to the fixpoint.
    """
    steps = cut(edges.select("src", "dst").distinct())
    known = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    front, level = known, 0
    while depth is None or level < depth:
        level += 1
        ahead = front.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if not front.limit(1).count():
            break
        known = known.unionByName(front)
    return known


def signature(nodes: Column, rels: Column) -> Column:
    """A path as one text: node, -[relation]->, node and so on."""
    steps = F.transform(rels, lambda r, i: F.concat(F.lit(" -["), r, F.lit("]-> "), F.element_at(nodes, i + 2)))
    return F.concat(F.element_at(nodes, 1), F.array_join(steps, ""))


def bridged(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges whose source is an element are also edges of its owner: the bridge costs no depth.

    ``owners`` is (element, owner). The owner takes over the outgoing and the incoming edges.
    """
    own = owners.select("element", "owner").distinct()
    out = edges.join(own, F.col("src") == F.col("element")).select(F.col("owner").alias("src"), "dst", "rel")
    into = edges.join(own, F.col("dst") == F.col("element")).select("src", F.col("owner").alias("dst"), "rel")
    return edges.select("src", "dst", "rel").unionByName(out).unionByName(into).where("src <> dst").distinct()


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow downstream, upstream or both ways; a step against its edge keeps the relation's name with ``^``."""
    down = edges.select("src", "dst", "rel")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("^"), "rel").alias("rel"))
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def dependency_paths(edges: DataFrame, starts: DataFrame, direction: str = "downstream", relations: list[str] | None = None, depth: int = 3, owners: DataFrame | None = None) -> DataFrame:
    """(start, end, depth, path): node-simple dependency paths, one row for each signature."""
    kept = edges.where(F.col("rel").isin(*relations)) if relations else edges
    kept = bridged(kept, owners) if owners is not None else kept
    walked = trails(directed(kept, direction), starts, depth)
    return walked.select("start", "end", "depth", signature(F.col("nodes"), F.col("rels")).alias("path")).distinct()


def bridged_paths(edges: DataFrame, starts: DataFrame, owners: DataFrame, depth: int = 3) -> DataFrame:
    """(start, end, depth, path): node-simple paths on which an element may hand over to its owner for free.

    ``owners`` is (element, owner, itself): after a hop to an element the path goes on from its owner and, where
    ``itself`` holds, from the element too. A hand-over adds no depth and ends no path, but its owner counts as
    visited. Paths of the same text come out once.
    """
    steps = cut(edges.select("src", "dst", "rel").distinct())
    own = owners.select(F.col("element").alias("end"), "owner", "itself").distinct()
    front = starts.select("start").distinct().select("start", F.col("start").alias("end"), F.array("start").alias("nodes"), F.col("start").alias("path"))
    found: DataFrame | None = None
    for level in range(1, clamp(depth) + 1):
        hop = front.join(steps, F.col("end") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        hop = cut(hop.select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("path", F.lit(" -["), "rel", F.lit("]-> "), "dst").alias("path")))
        rows = hop.select("start", "end", F.lit(level).alias("depth"), "path").distinct()
        found = rows if found is None else found.unionByName(rows)
        handed = hop.join(own, "end", "left")
        alone = handed.where(F.col("owner").isNull() | F.col("itself")).select("start", "end", "nodes", "path")
        over = handed.where(F.col("owner").isNotNull() & ~F.array_contains("nodes", F.col("owner"))).select("start", F.col("owner").alias("end"), F.concat("nodes", F.array("owner")).alias("nodes"), F.concat("path", F.lit(" => "), "owner").alias("path"))
        front = alone.unionByName(over)
    return found.distinct()


def page_of_paths(paths: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of paths by (depth, path) with its number from 1; a path is the unit of the page.

    Only the rows up to the page's end leave the tasks; the numbers are given to those few.
    """
    head = paths.orderBy("depth", "path").limit(offset + limit)
    ranked = head.withColumn("path_no", F.row_number().over(Window.orderBy("depth", "path")))
    return ranked.where(F.col("path_no") > offset)


def first_by_signature(lists: list[DataFrame], by: list[str], order: list[str]) -> DataFrame:
    """Several lists laid one after another, of rows with the same signature (``by``) the first; ``source`` tells the list."""
    out = None
    for i, rows in enumerate(lists):
        marked = rows.withColumn("source", F.lit(i))
        out = marked if out is None else out.unionByName(marked)
    ranked = out.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("source", *order)))
    return ranked.where("_k = 1").drop("_k")


def recovered_calls(routines: DataFrame, called: Column, scope: list[str]) -> DataFrame:
    """(caller, callee, calls): names called in a body that are the name of exactly one routine of the same scope.

    ``routines`` has id, name and the scope columns; ``called`` is the array of names in its body. Names
    compare without case; self calls are left out.
    """
    unique = routines.groupBy(*scope, F.lower("name").alias("called")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("callee")).where("n = 1").drop("n")
    uses = routines.select(F.col("id").alias("caller"), *scope, F.explode(called).alias("word")).select("caller", *scope, F.lower("word").alias("called"))
    counted = uses.groupBy("caller", *scope, "called").agg(F.count(F.lit(1)).alias("calls"))
    return counted.join(unique, [*scope, "called"]).where("caller <> callee").select("caller", "callee", "calls")
