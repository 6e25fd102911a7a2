"""Similar vectors against brute force, with groups of near copies that codes cannot tell apart."""

import datetime

import numpy as np
import pytest

from graphloom.llm import vectors
from graphloom.llm.vectors import VectorTable, similar_pairs


def brute_force(ids: list[str], x: np.ndarray, nearest: int = 5, least: float = 0.90) -> set[tuple[str, str]]:
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, axis=1)[:, :nearest]
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in top[i] if cos[i, j] >= least}


@pytest.mark.parametrize("group", [100, 1_000])
def test_dense_group_of_near_copies(spark, group):
    rng = np.random.default_rng(group)
    near = rng.normal(size=64) + rng.normal(size=(group, 64)) * 0.2
    x = np.vstack([near, rng.normal(size=(1_500, 64))]).astype(np.float32)
    ids = [f"r{i:05d}" for i in range(len(x))]
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, v.tolist(), at) for i, v in zip(ids, x)], "id string, v array<float>, loaded_at timestamp_ntz")
    found = {(r["id_a"], r["id_b"]) for r in similar_pairs([VectorTable(df, "id", ["v"])]).collect()}
    want = brute_force(ids, x)
    assert len(want) > 2 * group
    assert len(found & want) >= 0.999 * len(want)
    assert len(found & want) >= 0.999 * len(found)


def usable(rows: list, key: str, field: str) -> tuple[list[str], np.ndarray]:
    latest: dict = {}
    for r in rows:
        if r[key] not in latest or r["loaded_at"] > latest[r[key]][0]:
            latest[r[key]] = r["loaded_at"], r[field]
    held = {k: v for k, (_, v) in latest.items() if v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    return list(held), np.array(list(held.values()), np.float64)


@pytest.mark.parametrize("first_cells", [vectors.FIRST_CELLS, 32])
def test_recall_on_the_test_tables(spark, monkeypatch, first_cells):
    """All pairs of sf0.01, with one level of cells and with two."""
    monkeypatch.setattr(vectors, "FIRST_CELLS", first_cells)
    folder = "/root/testdata/sf0.01"
    routines = spark.read.parquet(f"{folder}/routine.parquet").select("id", "loaded_at", "code_embedding", "description_embedding")
    rows = routines.collect()
    found = {(r["field_name"], r["id_a"], r["id_b"]) for r in similar_pairs([VectorTable(routines, "id", ["code_embedding", "description_embedding"])]).collect()}
    want = set()
    for field in ("code_embedding", "description_embedding"):
        ids, x = usable(rows, "id", field)
        want |= {(field, *p) for p in brute_force(ids, x)}
    assert len(want) > 100
    print("recall", len(found & want) / len(want), "of", len(want))
    assert len(found & want) >= 0.98 * len(want)
    assert len(found & want) >= 0.98 * len(found)


def test_unusable_vectors_and_copies(spark):
    at = datetime.datetime(2024, 1, 1)
    v = [float(i % 7) for i in range(64)]
    rows = [("a", v, at, 1), ("b", [2 * e for e in v], at, 1), ("c", None, at, 1), ("d", [0.0] * 64, at, 1), ("e", v[:63], at, 1), ("f", [float("nan"), *v[1:]], at, 1), (None, v, at, 1)]
    rows += [("g", v, at, 1), ("g", [-e for e in v], at + datetime.timedelta(days=1), 1)]
    df = spark.createDataFrame(rows, "id string, v array<float>, loaded_at timestamp_ntz, field int")
    assert {(r["id_a"], r["id_b"]) for r in similar_pairs([VectorTable(df, "id", ["v"])]).collect()} == {("a", "b")}
    assert similar_pairs([VectorTable(df.where("false"), "id", ["v"])]).collect() == []


def test_candidates_do_not_grow_with_the_vectors_of_a_topic(spark, monkeypatch):
    """Vectors of a topic are alike, but no neighbours: few are shuffled as candidates or searched for exactly."""
    rng = np.random.default_rng(3)
    topics = rng.normal(size=(20, 64))
    x = np.vstack([t + rng.normal(size=(200, 64)) * 0.68 for t in topics])
    x = np.vstack([x, x[::40] + rng.normal(size=(100, 64)) * 0.25]).astype(np.float32)
    ids = [f"r{i:05d}" for i in range(len(x))]
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, v.tolist(), at) for i, v in zip(ids, x)], "id string, v array<float>, loaded_at timestamp_ntz")
    seen: list = []
    crowded = vectors._crowded

    def spied(hits, *rest):  # noqa: ANN001, ANN002, ANN202
        seen.append((hits.count(), hits.where("b is null").count()))
        return crowded(hits, *rest)

    monkeypatch.setattr(vectors, "_crowded", spied)
    found = {(r["id_a"], r["id_b"]) for r in similar_pairs([VectorTable(df, "id", ["v"])]).collect()}
    want = brute_force(ids, x)
    assert len(want) >= 100
    assert len(found & want) >= 0.99 * len(want)
    assert len(found & want) >= 0.99 * len(found)
    print("candidates and lookups that leave some out", seen, "of", len(x))
    assert seen[0][0] < len(x)
    assert seen[0][1] < 0.02 * len(x)


def test_copies_are_paired_with_the_first_ids_once(spark):
    at = datetime.datetime(2024, 1, 1)
    v = [float(i % 7) for i in range(64)]
    ids = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame([(i, v, at) for i in ids], "id string, v array<float>, loaded_at timestamp_ntz")
    found = [(r["id_a"], r["id_b"]) for r in similar_pairs([VectorTable(df, "id", ["v"])]).collect()]
    want = {tuple(sorted((a, b))) for a in ids for b in [i for i in ids if i != a][:5]}
    assert len(found) == len(want)
    assert set(found) == want
