"""Mixes: shares, caps and the form of the rates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing
from graphloom.llm.mixing import balance, mix, shares

PLANS = [("a", "big", 0.5, 1), ("a", "small", 0.3, 4), ("a", "mid", 0.2, 2), ("a", "none", 0.1, 2), ("b", "big", 1.0, 3), ("b", "small", None, 2), ("c", "none", 1.0, 1)]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(1)
    rows = [(i, s, int(rng.lognormvariate(4, 1)) + 1) for s, n in (("big", 6_000), ("mid", 1_500), ("small", 500)) for i in range({"big": 0, "mid": 10_000, "small": 20_000}[s], {"big": 0, "mid": 10_000, "small": 20_000}[s] + n)]
    rows += [(90_000, "big", 0), (90_001, None, 5), (90_002, "other", 5)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens int").cache()


def test_shares_and_caps(spark, documents):
    plans = spark.createDataFrame(PLANS, "plan_id string, source string, target_share double, max_repeats int")
    mixed = mix(documents, plans).cache()
    got = {(r["plan_id"], r["source"]): r for r in shares(mixed, documents, plans).collect()}
    assert len(got) == len(PLANS)
    for plan in ("a", "b"):
        live = {s: t for p, s, t, _ in PLANS if p == plan and s != "none" and t}
        for source, target in live.items():
            assert got[plan, source]["actual_share"] == pytest.approx(target / sum(live.values()), abs=2e-3)
    assert got["a", "none"]["tokens"] == 0 and got["b", "small"]["tokens"] == 0
    assert all(r["most_copies"] <= r["max_repeats"] for r in got.values())
    # The mix is the largest: one source of each plan is used up.
    size = {r["source"]: r["n"] for r in documents.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    for plan in ("a", "b"):
        assert max(r["tokens"] / (size[s] * r["max_repeats"]) for (p, s), r in got.items() if p == plan and r["tokens"]) == pytest.approx(1, abs=1e-3)
    assert mixed.groupBy("plan_id", "doc_id").count().where("count > 1").count() == 0


def test_rates_are_exponential_in_size_and_meet_the_budget(spark, documents):
    sizes = documents.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.where("source = 'mid'").agg(F.sum(F.col("tokens") * F.col("n"))).first()[0]
    (solved,) = balance(sizes, [{"plan_id": "a", "source": "mid", "max_repeats": 3, "tokens": total, "wanted": 1.7 * total}])
    rows = sizes.where("source = 'mid'").collect()
    given = sum(r["n"] * r["tokens"] * min(3, math.exp(solved["tilt"] * r["tokens"] / solved["mean"])) for r in rows)
    assert given == pytest.approx(1.7 * total, rel=1e-8)


def test_a_budget_that_is_not_met_is_an_error(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    plans = spark.createDataFrame([("a", "big", 0.5, 1), ("a", "mid", 0.5, 3)], "plan_id string, source string, target_share double, max_repeats int")
    with pytest.raises(RuntimeError):
        mix(documents, plans)


def test_empty_tables(spark, documents):
    plans = spark.createDataFrame(PLANS, "plan_id string, source string, target_share double, max_repeats int")
    assert mix(documents.where("false"), plans).collect() == []
    assert mix(documents, plans.where("false")).collect() == []
