"""Tools over routines: search, bodies, modules and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.functions import text as X
from graphloom.operators import graph
from graphloom.operators.relations import first_of_each
from graphloom.tools.metadata import page


def search(routines: DataFrame, mode: str, text: str | None = None, match: str = "contains", edges: DataFrame | None = None, handlers: DataFrame | None = None, owner: str | None = None, export: bool | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(id, owner_qn, name): routines by ``name``, ``signature`` (name and parameters), ``description``, ``exported`` or ``unused``.

    Unused routines have no incoming call in ``edges`` (caller, callee) and are no handler in ``handlers`` (id).
    """
    rows = routines if owner is None else routines.where(P.in_subtree(F.col("owner_qn"), owner))
    rows = P.optional_equal(rows, "is_export", export)
    if mode == "name":
        rows = rows.where(P.matches(F.col("name"), text, match))
    elif mode == "signature":
        rows = rows.where(P.matches(F.concat("name", F.lit("("), F.coalesce("params_text", F.lit("")), F.lit(")")), text, match))
    elif mode == "description":
        rows = rows.where(P.matches(F.col("doc_description"), text, match))
    elif mode == "exported":
        rows = rows.where("is_export")
    elif mode == "unused":
        used = edges.select(F.col("callee").alias("id"))
        used = used if handlers is None else used.unionByName(handlers.select("id"))
        rows = rows.join(used.distinct(), "id", "left_anti")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return page(rows.select("id", "owner_qn", "name"), ["owner_qn", "name", "id"], limit, offset)


def with_call_context(found: DataFrame, edges: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """Adds ``callers`` and ``callees``: the names of the first ``most`` by name, and how many there are."""
    out = found
    for side, other, label in (("callee", "caller", "callers"), ("caller", "callee", "callees")):
        rows = edges.select(F.col(side).alias("id"), F.col(other).alias("o")).distinct().join(names.select(F.col("id").alias("o"), F.col("name").alias("n")), "o")
        shown = first_of_each(rows, ["id"], [F.col("n"), F.col("o")], most).groupBy("id").agg(F.array_sort(F.collect_list("n")).alias(label))
        number = rows.groupBy("id").agg(F.count(F.lit(1)).alias(f"{label}_total"))
        out = out.join(shown, "id", "left").join(number, "id", "left")
        out = out.withColumn(label, F.coalesce(label, F.array().cast("array<string>"))).withColumn(f"{label}_total", F.coalesce(f"{label}_total", F.lit(0).cast("long")))
    return out


def bodies(routines: DataFrame, ref_type: str, ref: str, limit: int = 4_000, offset: int = 0) -> DataFrame:
    """(id, name, part, total, next_offset): a slice of the body of the routines that an ``id``, ``name`` or ``signature`` means; no next offset at the end."""
    rule = {"id": F.col("id") == ref, "name": F.lower("name") == ref.lower(), "signature": F.lower(F.concat("name", F.lit("("), F.coalesce("params_text", F.lit("")), F.lit(")"))) == ref.lower()}[ref_type]
    total = F.coalesce(F.length("body"), F.lit(0)).cast("long")
    end = F.lit(offset + limit).cast("long")
    return routines.where(rule).select("id", "name", X.body_slice(F.col("body"), offset, limit).alias("part"), total.alias("total"), F.when(total > end, end).alias("next_offset"))


def modules(routines: DataFrame, mode: str, ref: str | None = None) -> DataFrame:
    """``modules_of_owner``: modules with their numbers of routines; ``module_routines``: the routines of a module; ``common_module_routines``: exported routines of a common module."""
    if mode == "modules_of_owner":
        rows = routines if ref is None else routines.where(P.in_subtree(F.col("owner_qn"), ref))
        return rows.groupBy("owner_qn", "module_type").agg(F.count(F.lit(1)).alias("routines"), F.count_if("is_export").alias("exported"))
    if mode == "modules_by_owner_name":
        rows = routines.where(F.lower(F.get(F.split("owner_qn", "/"), F.lit(3))) == (ref or "").lower())
        return rows.groupBy("owner_qn", "module_type").agg(F.count(F.lit(1)).alias("routines"), F.count_if("is_export").alias("exported"))
    if mode == "module_routines":
        return P.optional_equal(routines, "module_id", ref).select("module_id", "id", "name", "line_no")
    if mode == "common_module_routines":
        rows = routines.where((F.get(F.split("owner_qn", "/"), F.lit(2)) == "ОбщиеМодули") & F.col("is_export"))
        return rows.select("owner_qn", "id", "name")
    raise ValueError(f"unknown mode {mode!r}")


def neighbours(edges: DataFrame, starts: DataFrame, mode: str) -> DataFrame:
    """(start, routine, kind, calls): direct callees or callers of the start routines, with the edge's properties."""
    near, far = ("caller", "callee") if mode == "callees" else ("callee", "caller")
    return starts.select("start").distinct().join(edges, F.col("start") == F.col(near)).select("start", F.col(far).alias("routine"), "kind", "calls")


def between_owners(edges: DataFrame, routines: DataFrame, same_owner: bool = False) -> DataFrame:
    """(from_owner, to_owner, pairs, calls): what routines of one owner call of another."""
    own = routines.select("id", "owner_qn")
    rows = edges.join(own.select(F.col("id").alias("caller"), F.col("owner_qn").alias("from_owner")), "caller").join(own.select(F.col("id").alias("callee"), F.col("owner_qn").alias("to_owner")), "callee")
    rows = rows if same_owner else rows.where("from_owner <> to_owner")
    return rows.groupBy("from_owner", "to_owner").agg(F.count(F.lit(1)).alias("pairs"), F.sum("calls").alias("calls"))


def subtree(edges: DataFrame, starts: DataFrame, direction: str = "both", depth: int = 3, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(start, side, path_no, caller, callee, step): the call edges of one page of paths from each start.

    Paths do not repeat an edge; the page counts paths by length and then by their nodes, per start and side.
    """
    steps = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("rel"))
    sides = [("out", steps)] if direction in ("out", "both") else []
    sides += [("in", steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))] if direction in ("in", "both") else []
    out = None
    for side, way in sides:
        paths = graph.trails(way, starts, depth, node_simple=False).withColumn("side", F.lit(side))
        out = paths if out is None else out.unionByName(paths)
    ranked = out.withColumn("path_no", F.row_number().over(Window.partitionBy("start", "side").orderBy("depth", F.array_join("nodes", ">"))))
    if limit is not None:
        ranked = ranked.where((F.col("path_no") > offset) & (F.col("path_no") <= offset + limit))
    pairs = F.transform(F.slice("nodes", 1, F.size("nodes") - 1), lambda n, i: F.struct(n.alias("a"), F.element_at("nodes", i + 2).alias("b")))
    flat = ranked.select("start", "side", "path_no", F.posexplode(pairs).alias("step", "e"))
    forward = F.col("side") == "out"
    return flat.select("start", "side", "path_no", F.when(forward, F.col("e.a")).otherwise(F.col("e.b")).alias("caller"), F.when(forward, F.col("e.b")).otherwise(F.col("e.a")).alias("callee"), (F.col("step") + 1).alias("step"))
