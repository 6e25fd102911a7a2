"""Incremental maintenance: discovery, reconciliation, signed statistics, epochs and the transfer of unchanged work."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.retrieval import cosine


def discover(listing: DataFrame, manifest: DataFrame, key: str = "path", stamps: tuple[str, ...] = ("modified", "length")) -> DataFrame:
    """(key, action): ``new``, ``candidate`` (a stamp differs, so the content must be hashed) or ``skip``.

    Stamps are compared for equality, nulls equal: a file with an older time is looked at too, so late files are
    never lost. Files that are gone are not seen here; ``reconcile`` finds them.
    """
    old = manifest.select(key, *[F.col(s).alias(f"_{s}") for s in stamps], F.lit(True).alias("_known"))
    same = F.lit(True)
    for s in stamps:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    action = F.when(F.col("_known").isNull(), "new").when(same, "skip").otherwise("candidate")
    return listing.join(old, key, "left").select(key, action.alias("action"))


def hashed(found: DataFrame, digests: DataFrame, manifest: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, action) after hashing: of the candidates those with the known hash are ``touch``, the others ``change``."""
    old = manifest.select(key, F.col(digest).alias("_old"))
    rows = found.join(digests.select(key, F.col(digest).alias("_new")), key, "left").join(old, key, "left")
    return rows.select(key, F.when(F.col("action") == "candidate", F.when(F.col("_old").eqNullSafe(F.col("_new")), "touch").otherwise("change")).otherwise(F.col("action")).alias("action"))


def in_window(now: datetime.time, start: datetime.time, end: datetime.time) -> bool:
    """Whether a time of day lies in a window that may run over midnight; the end is outside, equal ends mean always."""
    return start == end or (start <= now < end if start < end else now >= start or now < end)


def reconcile_due(last: datetime.datetime | None, now: datetime.datetime, every: datetime.timedelta, start: datetime.time, end: datetime.time) -> bool:
    """A full comparison is due if one has run before, long enough ago, and the time of day allows it."""
    return last is not None and now - last >= every and in_window(now.time(), start, end)


def deleted(listing: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """(key) of what the manifest has and the full listing hasn't."""
    return manifest.select(key).distinct().join(listing.select(key).distinct(), key, "left_anti")


def confirmed(missing: DataFrame, state: DataFrame, key: str = "scope", needed: int = 1, needed_malformed: int = 2) -> DataFrame:
    """(key, misses, remove): how often in a row a scope was missing; one whose source can't be read must be missing ``needed_malformed`` times.

    ``missing`` is (key, malformed) of this cycle, ``state`` (key, misses) of the last; a scope seen again is forgotten.
    """
    counted = missing.join(state.select(key, "misses"), key, "left").withColumn("misses", F.coalesce("misses", F.lit(0)) + 1)
    return counted.select(key, "misses", (F.col("misses") >= F.when(F.col("malformed"), needed_malformed).otherwise(needed)).alias("remove"))


def contributions(added: DataFrame, removed: DataFrame, token: str = "token") -> DataFrame:
    """(token, df): signed document frequencies of documents that come (+) and go (-), each given as (key, token) postings; zeros left out."""
    both = added.select(token, F.lit(1).alias("sign")).unionByName(removed.select(token, F.lit(-1).alias("sign")))
    return both.groupBy(token).agg(F.sum("sign").alias("df")).where("df <> 0")


def applied(state: DataFrame, delta: DataFrame, token: str = "token") -> DataFrame:
    """(token, df) after a delta; tokens that no document has any more are left out."""
    return state.select(token, "df").unionByName(delta.select(token, "df")).groupBy(token).agg(F.sum("df").alias("df")).where("df <> 0")


def transferable(old: DataFrame, new: DataFrame, key: str, inputs: list[str], done_old: DataFrame, done_new: DataFrame, size: str | None = None) -> DataFrame:
    """(key): units of a new epoch whose vectors the old one's can stand for.

    The unit must be there in both with null-safely equal inputs, done in the old, not yet in the new, and its range
    valid (``start < end <= size`` where a size is given).
    """
    a, b = old.select(key, *[F.col(c).alias(f"_{c}") for c in inputs]), new
    same = F.lit(True)
    for c in inputs:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = b.join(a, key).where(same)
    rows = rows if size is None else rows.where((F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.col(size)))
    return rows.select(key).distinct().join(done_old.select(key), key, "left_semi").join(done_new.select(key), key, "left_anti")


def pending(units: DataFrame, done: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, part): work not done yet, spread evenly over ``parts`` workers by the hash of its key."""
    return units.select(key).distinct().join(done.select(key), key, "left_anti").withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def drifted(old: DataFrame, new: DataFrame, key: str, vector: str, least: float = 0.999) -> DataFrame:
    """(key, cosine, drifted): probes embedded again; a cosine below ``least``, or none, means that stored vectors are no longer comparable."""
    both = old.select(key, F.col(vector).alias("_a")).join(new.select(key, F.col(vector).alias("_b")), key)
    cos = F.when(F.size("_a") == F.size("_b"), cosine(F.col("_a"), F.col("_b")))
    return both.select(key, cos.alias("cosine"), (F.coalesce(cos, F.lit(-1.0)) < least).alias("drifted"))


def recomputed(edges: DataFrame, affected: DataFrame, key: str, again: DataFrame) -> DataFrame:
    """Derived edges after those of the ``affected`` keys were made anew: the others stay as they are."""
    doomed = affected.select(key).distinct()
    return edges.join(doomed, key, "left_anti").unionByName(again.join(doomed, key, "left_semi"))


def stages(items: DataFrame, summaries: DataFrame, vectors: DataFrame, key: str, state: str) -> DataFrame:
    """(key, stage): what each item needs next: ``generate`` (no summary of its present state), ``embed`` (no vector of it), ``done``, or ``remove`` (gone)."""
    s = summaries.select(key, F.col(state).alias("_s"))
    v = vectors.select(key, F.col(state).alias("_v"))
    rows = items.select(key, state, F.lit(True).alias("_there")).join(s, key, "full_outer").join(v, key, "left")
    stage = F.when(F.col("_there").isNull(), "remove").when(~F.col("_s").eqNullSafe(F.col(state)), "generate").when(~F.col("_v").eqNullSafe(F.col(state)), "embed").otherwise("done")
    return rows.select(key, stage.alias("stage"))


def first_matches(rows: DataFrame, by: list[str], protected: Column, priority: Column, most: int, tie: str) -> DataFrame:
    """Protected rows first and all of them, then the others by priority, ``most`` in all; repeated ties count once."""
    once = rows.dropDuplicates([*by, tie])
    guard = F.coalesce(protected, F.lit(False))
    order = Window.partitionBy(*by).orderBy(guard.desc(), priority, tie)
    return once.withColumn("_g", guard).withColumn("_k", F.row_number().over(order)).where(F.col("_g") | (F.col("_k") <= most)).drop("_g", "_k")
