"""Relational building blocks: current rows, overlays, tiered resolution, rights, snapshots of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, columns: list[str], loaded: str = "loaded_at") -> DataFrame:
    """(key, columns…) of the row loaded last; a null time is the earliest, ties take the larger values."""
    kept = [c for c in columns if c != key]
    if not kept:
        return df.select(key).distinct()
    latest = df.groupBy(key).agg(F.max(F.struct(F.col(loaded).alias("_at"), *[F.col(c) for c in kept])).alias("v"))
    return latest.select(key, *[F.col(f"v.{c}").alias(c) for c in kept])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows and those old ones whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_edges(edges: DataFrame, nodes: DataFrame, key: list[str], first: Column | None = None) -> DataFrame:
    """Edges (src, dst, …) with both ends among ``nodes`` (id), one for each key.

    Edges without an end are left out, as an upsert by end points would. ``first`` orders rows of a key; the least stays.
    """
    known = nodes.select(F.col("id"))
    kept = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if first is None:
        return kept.dropDuplicates(key)
    rest = [c for c in kept.columns if c not in key]
    return kept.groupBy(*key).agg(F.min(F.struct(first.alias("_o"), *rest)).alias("v")).select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])


def delete_scope(df: DataFrame, doomed: Column) -> DataFrame:
    """The rows outside of a scope; rows where the scope is unknown (null) stay."""
    return df.where(~F.coalesce(doomed, F.lit(False)))


def overlay_pairs(base: DataFrame, extension: DataFrame, qn: str, rewritten: Column) -> DataFrame:
    """(extension_qn, base_qn): extension nodes whose rewritten name is a base node's."""
    ext = extension.select(F.col(qn).alias("extension_qn"), rewritten.alias("base_qn"))
    return ext.join(base.select(F.col(qn).alias("base_qn")), "base_qn").select("extension_qn", "base_qn")


def adoption_roles(nodes: DataFrame, pairs: DataFrame, qn: str) -> DataFrame:
    """(qn, role, partners): base with its extensions, extension with its base, or none."""
    as_base = pairs.groupBy(F.col("base_qn").alias(qn)).agg(F.array_sort(F.collect_set("extension_qn")).alias("ext"))
    as_ext = pairs.groupBy(F.col("extension_qn").alias(qn)).agg(F.min("base_qn").alias("base"))
    both = nodes.select(qn).join(as_base, qn, "left").join(as_ext, qn, "left")
    role = F.when(F.col("base").isNotNull(), "extension").when(F.col("ext").isNotNull(), "base").otherwise("none")
    return both.select(qn, role.alias("role"), F.coalesce(F.when(F.col("base").isNotNull(), F.array("base")), F.col("ext"), F.array().cast("array<string>")).alias("partners"))


def best_candidates(candidates: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of the candidates of each item, the first in order: tier first, then the tie-breaks."""
    w = Window.partitionBy(*by).orderBy(*order)
    return candidates.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in order; only n rows of a group leave a task, so hot groups don't pile up."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def unambiguous(candidates: DataFrame, by: list[str], tier: str) -> DataFrame:
    """The candidate of an item's first non-empty tier if that tier holds exactly one, else none."""
    w = Window.partitionBy(*by)
    first = candidates.withColumn("_t", F.min(tier).over(w)).where(F.col(tier) == F.col("_t"))
    return first.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_t", "_n")


def effective_rights(rows: DataFrame, by: list[str], right: str, allowed: str, condition: str) -> DataFrame:
    """(by…, right, allowed, has_condition, condition): a denial wins, conditions add up, the first condition by text is shown."""
    has = F.col(condition).isNotNull() & (F.trim(F.col(condition)) != "")
    return rows.groupBy(*by, right).agg(F.min(F.col(allowed).cast("int")).cast("boolean").alias("allowed"), F.max(has).alias("has_condition"), F.min(F.when(has, F.col(condition))).alias("condition"))


def manifest_changes(old: DataFrame, new: DataFrame, key: str, stamp: list[str], digest: str) -> DataFrame:
    """(key, change): added, removed, changed, touched (stamps differ, content doesn't) or unchanged.

    Stamps are compared for inequality, so a file with an older time is looked at too; null equals null.
    """
    a = old.select(key, *[F.col(c).alias(f"o_{c}") for c in [*stamp, digest]], F.lit(True).alias("o_"))
    b = new.select(key, *[F.col(c).alias(f"n_{c}") for c in [*stamp, digest]], F.lit(True).alias("n_"))
    same = F.lit(True)
    for c in stamp:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    kind = F.when(F.col("o_").isNull(), "added").when(F.col("n_").isNull(), "removed").when(same, "unchanged").when(F.col(f"o_{digest}").eqNullSafe(F.col(f"n_{digest}")), "touched").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def routine_delta(old: DataFrame, new: DataFrame, key: str, signature: str, body: str, doc: str, path: str, line: str) -> DataFrame:
    """(key, change) of routines: added, deleted, signature_changed, body_changed (a move of the file too), doc_changed, line_only or unchanged, the first that holds."""
    cols = [signature, body, doc, path, line]
    a = old.select(key, *[F.col(c).alias(f"o{i}") for i, c in enumerate(cols)], F.lit(1).alias("o"))
    b = new.select(key, *[F.col(c).alias(f"n{i}") for i, c in enumerate(cols)], F.lit(1).alias("n"))
    diff = [~F.col(f"o{i}").eqNullSafe(F.col(f"n{i}")) for i in range(5)]
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(diff[0], "signature_changed").when(diff[1] | diff[3], "body_changed").when(diff[2], "doc_changed").when(diff[4], "line_only").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def map_changes(before: Column, after: Column, excluded: list[str]) -> Column:
    """The keys of two property maps whose values differ, those on one side only included, sorted."""
    both = F.map_zip_with(before, after, lambda k, x, y: ~x.eqNullSafe(y) & ~k.isin(*excluded))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: v)))


#: Numbers of one piece of a group when its runs are looked for.
RUN_PIECE = 4_096


def number_runs(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by…, a, b): the runs of consecutive integers of each group, repeated and null ones aside.

    A group is cut into pieces of RUN_PIECE neighbouring numbers; runs are found piece by piece and then joined
    where one ends next to another's start, so a large group costs a task only its runs.
    """

    def joined(d: DataFrame, within: list[str], a: str, b: str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(a)
        fresh = F.when(F.col(a) > F.lag(b).over(order) + 1, 1).otherwise(0)
        marked = d.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(order))
        return marked.groupBy(*within, "_g").agg(F.min(a).alias("a"), F.max(b).alias("b")).drop("_g")

    n = rows.where(F.col(number).isNotNull()).select(*by, F.col(number).cast("long").alias("n"))
    pieces = n.withColumn("_p", F.floor(F.col("n") / RUN_PIECE)).distinct().withColumn("m", F.col("n"))
    return joined(joined(pieces, [*by, "_p"], "n", "m").drop("_p"), by, "a", "b")


def runs_text(runs: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by…, name): the runs of each group as text in order: ``1..5`` or a single number, joined by ``|``."""
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit(".."), F.col("b").cast("string")))
    return runs.withColumn("_t", one).groupBy(*by).agg(F.expr("listagg(_t, '|') within group (order by a)").alias(name))
