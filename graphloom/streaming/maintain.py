"""Structured Streaming over deliveries: current rows, document frequencies and manifests kept up to date.

Each stream runs over what has arrived (``availableNow``) and goes on from its checkpoint the next time. State is
versioned: a batch writes the next version from the last and its own rows, and a batch that is run again after a
failure finds its version and does nothing, so every delivery counts exactly once. Late and out-of-order rows are
compared by their load time, never dropped by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators import incremental, retrieval


class Versions:
    """Numbered versions of one table in a shared folder; a version exists once its ``_SUCCESS`` does."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def last(self) -> DataFrame | None:
        known = self.numbers()
        return self._spark.read.parquet(f"{self.folder}/v={known[-1]}") if known else None

    def write(self, number: int, df: DataFrame, kept: int = 2) -> None:
        """Writes one version and clears those before the last ``kept``; one that is there already stays as it is."""
        if number in self.numbers():
            return
        df.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        for old in self.numbers()[:-kept]:
            self._fs.delete(self._path(f"{self.folder}/v={old}"), True)


def run(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    """Runs ``step`` on each batch of what has arrived so far."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_rows(stream: DataFrame, key: str, columns: list[str], folder: str, loaded: str = "loaded_at") -> DataFrame:
    """(key, columns…) of the latest delivery of each key; a null time is the earliest, ties take the larger values."""
    spark, versions = stream.sparkSession, Versions(stream.sparkSession, f"{folder}/state")
    best = lambda d: d.groupBy(key).agg(F.max("v").alias("v"))

    def step(batch: DataFrame, number: int) -> None:
        new = best(batch.where(F.col(key).isNotNull()).select(key, F.struct(F.col(loaded).alias("_at"), *columns).alias("v")))
        old = versions.last()
        versions.write(number, new if old is None else best(old.unionByName(new)))

    run(stream, f"{folder}/checkpoint", step)
    held = versions.last()
    if held is None:
        held = spark.createDataFrame([], stream.select(key, F.struct(F.col(loaded).alias("_at"), *columns).alias("v")).schema)
    return held.select(key, *[F.col(f"v.{c}").alias(c) for c in columns])


def document_frequencies(stream: DataFrame, key: str, words: Column, folder: str) -> DataFrame:
    """(token, df) of documents that arrive once each: signed contributions of a batch are added to the state."""
    spark, versions = stream.sparkSession, Versions(stream.sparkSession, f"{folder}/state")

    def step(batch: DataFrame, number: int) -> None:
        posted = retrieval.postings(batch, key, words)
        delta = incremental.contributions(posted, posted.where("false"))
        old = versions.last()
        versions.write(number, delta if old is None else incremental.applied(old, delta))

    run(stream, f"{folder}/checkpoint", step)
    held = versions.last()
    return held if held is not None else spark.createDataFrame([], "token string, df long")


def manifest(stream: DataFrame, folder: str, key: str = "path", stamps: tuple[str, ...] = ("modified", "length"), digest: str = "digest") -> DataFrame:
    """(key, stamps…, digest, changes): the manifest after all listings that have arrived; ``changes`` counts how often the content changed.

    A listing with the known content is a touch: its stamps are taken over, nothing else happens.
    """
    versions = Versions(stream.sparkSession, f"{folder}/state")

    def step(batch: DataFrame, number: int) -> None:
        order = F.struct("seq", *stamps, digest)
        seen = batch.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("seen"))
        old = versions.last()
        rows = seen.withColumn("old_digest", F.lit(None).cast("string")).withColumn("old_changes", F.lit(0)) if old is None else seen.join(old.select(key, F.col(digest).alias("old_digest"), F.col("changes").alias("old_changes")), key, "left")
        line = F.concat(F.array("old_digest"), F.transform("seen", lambda s: s[digest]))
        steps = F.zip_with(F.slice(line, 1, F.size("seen")), F.transform("seen", lambda s: s[digest]), lambda a, b: F.when(a.isNotNull() & (a != b), 1).otherwise(0))
        changed = F.coalesce("old_changes", F.lit(0)) + F.aggregate(steps, F.lit(0), lambda n, x: n + x)
        last = F.element_at("seen", -1)
        fresh = rows.select(key, *[last[s].alias(s) for s in stamps], last[digest].alias(digest), changed.alias("changes"))
        versions.write(number, fresh if old is None else old.join(fresh.select(key), key, "left_anti").unionByName(fresh))

    run(stream, f"{folder}/checkpoint", step)
    return versions.last()


def confirmed_removals(stream: DataFrame, needed: int = 1, needed_malformed: int = 2) -> DataFrame:
    """(scope, cycle, misses, remove) after each batch of (scope, cycle, present, malformed): how often in a row a scope was missing.

    The counter of each scope is the stream's keyed state. A scope seen again starts at 0; one whose source could not be
    read must be missing ``needed_malformed`` times. Cycles of a batch are taken in their order; one that is not later
    than the last is passed over, so a repeated listing counts once.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, misses = state.get if state.exists else (-1, 0)
        remove = False
        for row in pd.concat(list(batches)).sort_values("cycle").itertuples():
            if row.cycle > last:
                last, misses = int(row.cycle), 0 if row.present else misses + 1
                remove = misses >= (needed_malformed if row.malformed else needed)
        state.update((last, misses))
        yield pd.DataFrame({"scope": [key[0]], "cycle": [last], "misses": [misses], "remove": [remove]})

    rows = stream.select("scope", F.col("cycle").cast("long").alias("cycle"), "present", "malformed")
    return rows.groupBy("scope").applyInPandasWithState(count, "scope string, cycle long, misses int, remove boolean", "last long, misses int", "update", GroupStateTimeout.NoTimeout)
