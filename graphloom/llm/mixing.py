"""Mixing sources to target shares of tokens.

Method: entropy balancing. Of all document rates that meet the token constraint of each source, the ones
closest to one use of each document are exponential in the documents' sizes; their tilts are the solution of
a convex dual, found by Newton iterations over sums that the executors form. Rates are cut at the allowed
repeats and rounded to copies so that every source keeps its sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.session import cut

ITERATIONS = 60
#: Relative error of a source's expected tokens at which its tilt is final.
TOLERANCE = 1e-9
#: For the rounding, documents are ordered by size in bands of this many to a factor of e, each split by hash into
#: at least SPLIT buckets, and so many that a bucket of one size has about PER_BUCKET documents.
BANDS, SPLIT, PER_BUCKET = 32, 64, 20_000


def _rate(tilt: Column, size: Column, most: Column) -> Column:
    """exp(tilt * size), cut at ``most``; the exponent is bounded so that it cannot overflow."""
    return F.least(most, F.exp(F.least(tilt * size, F.lit(60.0))))


def plan_budgets(plans: DataFrame, totals: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, tokens, wanted): the tokens each source must give.

    The total of a plan is the largest at which every source that has any tokens reaches its share of that
    total within its repeats. A source without tokens gives none; its share is then missing from the mix,
    and the others keep their targets relative to each other.
    """
    joined = plans.join(totals, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    can = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    total = F.coalesce(F.min(can).over(Window.partitionBy("plan_id")), F.lit(0.0))
    return joined.withColumn("wanted", F.when(F.col("tokens") > 0, F.col("target_share") * total).otherwise(0.0))


def balance(sizes: DataFrame, budgets: list[dict]) -> list[dict]:
    """The budgets with their ``tilt`` and scale ``mean``: Newton's method on the dual of each (plan, source).

    ``sizes`` (source, tokens, n) counts documents by size. One small aggregation runs per iteration, for all
    plans together; only its sums, one row for each budget, reach the driver.
    """
    spark = sizes.sparkSession
    means = {r["source"]: r["mean"] for r in sizes.groupBy("source").agg((F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    state = []
    for b in budgets:
        full = b["wanted"] >= b["tokens"] * b["max_repeats"] * (1 - 1e-12)
        state.append({**b, "mean": means.get(b["source"]) or 1.0, "low": None, "high": None, "tilt": 0.0, "full": full, "done": full or b["wanted"] <= 0})
    for _ in range(ITERATIONS):
        left = [(i, s["source"], s["tilt"], s["mean"], float(s["max_repeats"])) for i, s in enumerate(state) if not s["done"]]
        if not left:
            break
        tilts = spark.createDataFrame(left, "i int, source string, tilt double, mean double, most double")
        size = F.col("tokens") / F.col("mean")
        rate = _rate(F.col("tilt"), size, F.col("most"))
        sums = sizes.join(F.broadcast(tilts), "source").groupBy("i").agg(
            F.sum(F.col("n") * F.col("tokens") * rate).alias("given"), F.sum(F.when(rate < F.col("most"), F.col("n") * F.col("tokens") * size * rate)).alias("slope")
        )
        for r in sums.collect():
            s = state[r["i"]]
            gap = s["wanted"] - r["given"]
            if abs(gap) <= TOLERANCE * s["wanted"]:
                s["done"] = True
                continue
            s["low" if gap > 0 else "high"] = s["tilt"]
            step = s["tilt"] + gap / r["slope"] if r["slope"] else None
            low, high = s["low"], s["high"]
            # A Newton step outside of the known bracket gives way to its middle, or doubles an open one.
            if step is None or (low is not None and step <= low) or (high is not None and step >= high) or abs(step - s["tilt"]) > 4:
                step = (low + high) / 2 if low is not None and high is not None else s["tilt"] + (2 if gap > 0 else -2)
            s["tilt"] = step
    open_ends = [(s["plan_id"], s["source"]) for s in state if not s["done"]]
    if open_ends:
        raise RuntimeError(f"no tilt within {TOLERANCE} after {ITERATIONS} iterations for {open_ends}")
    return state


def mix(documents: DataFrame, plans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(plan_id, source, key, tokens, copies) of the documents each plan uses.

    ``documents`` has ``key`` (unique), ``source`` in its normal form and ``tokens``; ``plans`` has plan_id,
    source, target_share, max_repeats, a small table (its rows are broadcast and solved on the driver). Documents without tokens or of sources no plan names are not used.
    Copies never exceed max_repeats; null shares or repeats count as 0. Empty tables give no rows. A plan whose
    tilts do not converge is an error, never a silent result.

    Scale: the solver works on counts by size. For the rounding, rates are summed in many buckets of each
    source, then over buckets, so a source with a third of all documents is never in one task.
    """
    spark = documents.sparkSession
    docs = documents.where((F.col("tokens") > 0) & F.col("source").isNotNull()).select(key, "source", F.col("tokens").cast("long").alias("tokens"))
    wanted = plans.select("plan_id", "source", F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"))
    used = cut(docs.join(wanted.select("source").distinct(), "source", "left_semi"))
    sizes = cut(used.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    totals = sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"))
    # One row for each source of a plan; plans are a small fixed table.
    budgets = [r.asDict() for r in plan_budgets(wanted, totals).collect()]
    solved = balance(sizes, budgets)
    rows = [(s["plan_id"], s["source"], float(s["tilt"]), float(s["mean"]), int(s["max_repeats"]), bool(s["full"] and s["tokens"] > 0)) for s in solved if s["wanted"] > 0]
    tilts = spark.createDataFrame(rows, "plan_id string, source string, tilt double, mean double, most int, full boolean")
    rate = F.when(F.col("full"), F.col("most").cast("double")).otherwise(_rate(F.col("tilt"), F.col("tokens") / F.col("mean"), F.col("most").cast("double")))
    band = F.floor(-F.log("tokens") * BANDS).cast("long")
    crowd = sizes.groupBy("source", F.floor(-F.log("tokens") * BANDS)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    split = max(SPLIT, -(-crowd // PER_BUCKET))
    rated = used.join(F.broadcast(tilts), "source").withColumn("rate", rate).withColumn("bucket", band * split + F.pmod(F.xxhash64(key), F.lit(split)))
    whole = F.floor("rate")
    broken = F.col("rate") - whole
    # The broken parts are laid end to end, large documents first; a document is used once more where the
    # running sum passes a half. Neighbours have like sizes, so the errors in tokens cancel.
    within = Window.partitionBy("plan_id", "source", "bucket").orderBy(F.desc("tokens"), F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0)
    sums = rated.groupBy("plan_id", "source", "bucket").agg(F.sum(broken).alias("b"))
    before = Window.partitionBy("plan_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("b").over(before), F.lit(0.0))).drop("b")
    upto = rated.withColumn("upto", F.sum(broken).over(within)).join(offsets, ["plan_id", "source", "bucket"])
    end = F.col("offset") + F.col("upto")
    extra = F.floor(end + 0.5) - F.floor(end - broken + 0.5)
    copies = F.least(whole + extra, F.col("most")).cast("int")
    return upto.select("plan_id", "source", key, "tokens", copies.alias("copies")).where(F.col("copies") > 0)


def shares(mixed: DataFrame, documents: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, documents, used, tokens, actual_share): what each plan reached.

    Sources of a plan without documents stay, with 0 tokens.
    """
    have = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    got = mixed.groupBy("plan_id", "source").agg(F.count(F.lit(1)).alias("used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    zero = F.lit(0).cast("long")
    rows = plans.select("plan_id", "source", "target_share", "max_repeats").join(have, "source", "left").join(got, ["plan_id", "source"], "left")
    total = F.sum(F.coalesce("tokens", zero)).over(Window.partitionBy("plan_id"))
    return rows.select(
        "plan_id", "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("used", zero).alias("used"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", zero).alias("tokens"),
        F.when(total > 0, F.coalesce("tokens", zero) / total).otherwise(0.0).alias("actual_share"),
    )
