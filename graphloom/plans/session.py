"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of this engine should carry; none is required for right results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "graphloom", **extra: str) -> SparkSession:
    """A session with this engine's settings; ``extra`` overrides them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Python workers then import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(archive)
    context._graphloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose executors share the driver's disk, may do without: it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    Survives the loss of executors, and keeps the plans of iterative operators short.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which shuffle files and checkpoints that nothing refers to any more are deleted.

    Spark itself does so every half hour or when the driver's memory fills; until then their disk stays taken.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks_for(df_or_spark: DataFrame | SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of partitions that holds ``rows`` at ``rows_per_task`` each, at least the session's own."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(least, -(-int(rows) // int(rows_per_task)))
