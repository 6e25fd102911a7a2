"""Call sites and their resolution; fuzzy likeness, routing and selection of search results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import calls as C
from graphloom.operators import retrieval
from graphloom.operators import search as S

BODY = '''Процедура Главная(А) Экспорт
\tПервая(А, Вторая(1, "х,у"), , 3); // Третья()
\tОбщий.Метод();
\tСправочники.Товары.Найти(Новый Структура("К", 1));
\tЕсли (А) Тогда Массив[Четвёртая(А)].Добавить(1); КонецЕсли;
\tОповестить(Новый ОписаниеОповещения("Готово", ЭтотОбъект));
\tЭтотОбъект.Пятая(1); Выполнить("Шестая(1)");
КонецПроцедуры'''


def test_sites():
    assert C.sites_of(BODY) == [
        ("direct", "Первая", None, 4, 2), ("direct", "Вторая", None, 2, 2), ("qualified", "Метод", "Общий", 0, 3), ("qualified", "Найти", "Справочники.Товары", 1, 4), ("direct", "Четвёртая", None, 1, 5),
        ("direct", "Оповестить", None, 1, 6), ("notification", "Готово", None, None, 6), ("qualified", "Пятая", "ЭтотОбъект", 1, 7), ("dynamic", "Шестая", None, None, 7),
    ]
    assert C.sites_of(None) == C.sites_of("") == []
    assert len(C.sites_of("Ф(\n" * 20_000)) == 20_000


ROUTINES = [
    # id, module, owner, module type, params, name, directives, body
    ("main", "m1", "p/c/Документы/Д", "ObjectModule", "", "Главная", ["&НаСервере"], BODY),
    ("a1", "m1", "p/c/Документы/Д", "ObjectModule", "А, Б, В, Г", "Первая", ["&НаКлиенте"], None), ("a2", "m1", "p/c/Документы/Д", "ObjectModule", "А, Б", "ПЕРВАЯ", ["&НаСервере"], None),
    ("b", "m1", "p/c/Документы/Д", "ObjectModule", "А", "Готово", None, None), ("e", "m1", "p/c/Документы/Д", "ObjectModule", "", "Пятая", None, None), ("f", "m1", "p/c/Документы/Д", "ObjectModule", "", "Шестая", None, None),
    ("g1", "m2", "p/c/ОбщиеМодули/Общий", "CommonModule", "А", "Метод", None, None), ("g2", "m2", "p/c/ОбщиеМодули/Общий", "CommonModule", "А = 1", "метод", None, None),
    ("h1", "m3", "p/c/Справочники/Товары", "ManagerModule", "А", "Найти", None, None), ("h2", "m4", "p/ext/Справочники/Товары", "ManagerModule", "А", "Найти", None, None),
    ("far", "m9", "q/c/ОбщиеМодули/Общий", "CommonModule", "", "Метод", None, None), ("other", "m8", "p/c/Документы/Е", "ObjectModule", "", "Вторая", None, None),
]
SCHEMA = "id string, module_id string, owner_qn string, module_type string, params_text string, name string, directives array<string>, body string"


@pytest.fixture(scope="module")
def routines(spark):
    return spark.createDataFrame(ROUTINES, SCHEMA)


def test_resolution(routines):
    found = {(r["callee"], r["kind"], r["line"]) for r in C.resolve_calls(C.call_sites(routines), routines).collect()}
    assert found == {("a2", "direct", 2), ("g2", "qualified", 3), ("h1", "qualified", 4), ("b", "notification", 6), ("e", "method", 7), ("f", "dynamic", 7)}


def test_ambiguous_manager_calls_resolve_to_none(spark):
    twice = [("main", "m1", "p/z/Документы/Д", "ObjectModule", "", "Главная", None, BODY), *[r for r in ROUTINES if r[0] in ("h1", "h2")]]
    rows = spark.createDataFrame(twice, SCHEMA)
    assert C.resolve_calls(C.call_sites(rows), rows).collect() == []


def test_edges_keep_their_first_lines(spark):
    resolved = spark.createDataFrame([("a", "b", "direct", i, 2) for i in range(80, 0, -1)], "caller string, callee string, kind string, line int, n long")
    (edge,) = C.call_edges(resolved).collect()
    assert edge["calls"] == 160 and edge["lines"] == list(range(1, 51))


def test_context_compatibility(spark):
    rows = spark.createDataFrame([(1, ["&НаКлиенте"], ["&НаСервере"]), (2, ["&НаКлиенте"], ["&НаСервереБезКонтекста"]), (3, ["&НаСервере"], None), (4, ["&AtServer"], ["&НаСервере"]), (5, ["&НаКлиенте"], ["&НаКлиенте", "&НаСервере"]), (6, ["&НаСервере"], ["&НаСервере", "&НаКлиенте"])], "i int, a array<string>, b array<string>")
    assert {r["i"]: r["ok"] for r in rows.select("i", C.compatible(C.contexts(F.col("a")), C.contexts(F.col("b"))).alias("ok")).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_invalidated_callers(spark):
    edges = spark.createDataFrame([("x", "gone"), ("y", "kept")], "caller string, callee string")
    sites = spark.createDataFrame([("z", "Новая"), ("w", "Иная")], "id string, name string")
    changes = spark.createDataFrame([("gone", "Ушла", "deleted"), ("n", "новая", "added"), ("kept", "Та", "body_changed")], "id string, name string, change string")
    assert {(r["caller"], r["reason"]) for r in C.invalidated_callers(edges, sites, changes).collect()} == {("n", "body"), ("kept", "body"), ("x", "target"), ("z", "name")}


def test_fuzzy_likeness():
    assert S.similarity("склад", "склад") == 1.0 and S.similarity("склад", "складской") == 0.94 and S.similarity("остаток", "остатки") == pytest.approx(12 / 14)
    assert S.fuzzy_share(["склад"], ["складской", "год"]) == pytest.approx(0.47)
    assert S.fuzzy_share([], ["а"]) == S.fuzzy_share(["а"], None) == 0.0


def test_routes():
    assert S.routes_of("Печать макета") == S.ROUTES["print"][2]
    assert S.routes_of("запрос по остаткам и движения") == {"query_tables": 0.45, "metadata_refs": 0.22, "method_calls": 0.22, "assignments": 0.10}
    assert S.routes_of("ничего") == {}
    assert S.routed_tokens("запрос", ["запрос", "x"], 4) == ["запрос", "x", "выбрать", "из"]


def test_rerank_keeps_the_tail_and_pages_go_on(spark):
    ranked = spark.createDataFrame([(1, f"d{i}", i, "q", "t" * i) for i in range(1, 7)], "qid int, id string, rank int, query string, text string")
    new = {r["id"]: r["rank"] for r in S.reranked(ranked, lambda b: b["text"].str.len(), 3).collect()}
    assert new == {"d3": 1, "d2": 2, "d1": 3, "d4": 4, "d5": 5, "d6": 6}
    rest = S.not_shown(ranked, spark.createDataFrame([(1, "d1"), (1, "d2")], "qid int, id string"), 3)
    assert [(r["id"], r["rank"]) for r in rest.orderBy("rank").collect()] == [("d3", 1), ("d4", 2), ("d5", 3)]


def test_budgets():
    assert S.per_leg_budget(10, 5, 4, 20, 200) == 60 and S.per_leg_budget(1, 0, 4, 20, 200, 3) == 7 and S.per_leg_budget(1000, 0, 4, 20, 200) == 200


def selected(hits, sizes, k, parents_kept, per_hit, top_mean, quota):
    """The parts of one query, step by step: hits are {(parent, part): score}."""
    lo, hi = min(hits.values()), max(hits.values())
    norm = {h: (s - lo) / (hi - lo) if hi > lo else 1.0 for h, s in hits.items()}
    scores = {}
    for p in {p for p, _ in hits}:
        own = sorted((n for (q, _), n in norm.items() if q == p), reverse=True)
        scores[p] = own[0] + per_hit * len(own) + top_mean * sum(own[:3]) / len(own[:3])
    windows = []
    for p in sorted(scores, key=lambda p: (-scores[p], p))[:parents_kept]:
        starts = {max(0, min(sizes[p] - k, i - shift)) for q, i in hits if q == p for shift in range(k)}
        worth = {s: round(sum(norm.get((p, i), 0.0) for i in range(s, min(s + k, sizes[p]))), 9) for s in starts}
        start = min(starts, key=lambda s: (-worth[s], s))
        windows.append((-round(scores[p] + worth[start], 9), p, [(p, i) for i in range(start, min(start + k, sizes[p]))]))
    out = []
    for (_, _, parts), share in zip(sorted(windows), quota or (1,) * k):
        out += parts[:share]
    out += sorted((h for h in hits if h not in out), key=lambda h: (-norm[h], h))
    return out[:k]


@pytest.mark.parametrize("profile", list(retrieval.SELECTIONS))
def test_window_selection(spark, profile):
    rng = random.Random(7)
    sizes = {f"p{i}": rng.randrange(1, 15) for i in range(9)}
    pools = {q: {(p, rng.randrange(sizes[p])): round(rng.random(), 3) for p in rng.choices(list(sizes), k=14)} for q in range(6)}
    rows = [(q, p, i, s) for q, pool in pools.items() for (p, i), s in pool.items()]
    found = retrieval.window_selection(spark.createDataFrame(rows, "qid int, parent string, part int, score double"), spark.createDataFrame(list(sizes.items()), "parent string, total int"), profile, 5).collect()
    kept, per_hit, top_mean, quota = retrieval.SELECTIONS[profile]
    for q, pool in pools.items():
        got = [(r["parent"], r["part"]) for r in sorted(found, key=lambda r: r["slot"]) if r["qid"] == q]
        assert got == selected(pool, sizes, 5, kept, per_hit, top_mean, quota)


def test_legs_fail_alone(spark):
    legs, failed = S.safe_legs({"good": lambda: spark.range(3), "bad": lambda: spark.table("nowhere"), "late": lambda: spark.range(1).select(F.raise_error(F.lit("late")))})
    assert legs["good"].count() == 3 and set(failed) == {"bad", "late"}


def test_dynamic_weights():
    assert retrieval.dynamic_alpha(0.5, 2, 10, 10, 10) == 0.7 and retrieval.dynamic_alpha(0.5, 5, 0, 9, 10) == 1.0 and retrieval.dynamic_alpha(0.5, 5, 9, 0, 10) == 0.0
    assert retrieval.dynamic_alpha(0.75, 5, 1, 9, 10) == 0.8 and retrieval.dynamic_alpha(0.25, 5, 9, 1, 10) == 0.2 and retrieval.dynamic_alpha(0.4, 5, 0, 0, 10) == 0.4


@pytest.mark.parametrize("size", [1, 3])
def test_percentiles_and_blocked_search_at_any_block_size(spark, monkeypatch, size):
    rng = np.random.default_rng(size)
    rows = [(int(q), float(round(s, 2))) for q in range(3) for s in rng.normal(size=[1, 2, 200][q])]
    df = spark.createDataFrame(rows, "qid int, score double")
    got = {r["qid"]: (r["p0"], r["p1"]) for r in retrieval.percentiles(df, ["qid"], "score", [0.5, 0.95], bins=[1, 0, 0, 64][size]).collect()}
    for q in range(3):
        assert got[q] == pytest.approx(tuple(np.percentile([s for i, s in rows if i == q], [50, 95])))
    monkeypatch.setattr(retrieval, "BLOCK", 10 * size)
    x = rng.normal(size=(120, 8))
    x[5] = x[6] = x[7] * 3
    e = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, v array<double>, label int").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 12)
    for most in (1_000, 10):
        monkeypatch.setattr(retrieval, "SMALL_QUERIES", most)
        found = {(r["qid"], r["id"]) for r in retrieval.blocked_topk(e.where("id % 5 = 0").select(F.col("id").alias("qid"), "v"), e, 4, 8).collect()}
        assert found == {(q, j) for q in range(0, 120, 5) for j in sorted((j for j in range(120) if j != q), key=lambda j: (-cos[q, j], j))[:4]}


def test_lease(spark, tmp_path):
    from graphloom.operators.sinks import Lease

    lease = Lease(spark, str(tmp_path))
    assert lease.take("a", 100.0, 30) and not lease.take("b", 110.0, 30) and lease.take("a", 120.0, 30) and not lease.take("b", 145.0, 30) and lease.take("b", 151.0, 30)
    assert lease.holder() == ("b", 151.0) and not lease.release("a") and lease.release("b") and lease.holder() is None


def test_page_prefixes():
    from graphloom.operators.sinks import prefixed

    names, short = prefixed(["project/config/docs/a", "project/config/docs/b", "project/config/x", "y"])
    back = [names[v.split("/")[0]] + v[len(v.split("/")[0]) :] if v.startswith("@") else v for v in short]
    assert back == ["project/config/docs/a", "project/config/docs/b", "project/config/x", "y"] and sum(map(len, short)) < 50


@pytest.mark.parametrize("most", [0, 50_000])
def test_scores_equal_the_formula_on_both_sides_of_the_switch(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "SMALL_SIDE", most)
    rng = random.Random(3)
    docs = {i: [rng.choice("abcdefg") * 3 for _ in range(rng.randrange(9))] for i in range(40)} | {90: []}
    queries = {1: ["aaa", "bbb", "aaa"], 2: ["ggg", "zzz"], 3: ["zzz"]}
    df = spark.createDataFrame(list(docs.items()), "id long, w array<string>")
    asked = spark.createDataFrame([(q, t, ts.count(t)) for q, ts in queries.items() for t in set(ts)], "qid int, token string, qtf long")
    found = {(r["qid"], r["id"]): r["score"] for r in retrieval.bm25(df, F.col("w"), asked, "id").collect()}
    mean = sum(map(len, docs.values())) / len(docs)
    df_of = {t: sum(t in d for d in docs.values()) for t in "aaa bbb ggg zzz".split()}
    want = {}
    for q, ts in queries.items():
        for i, d in docs.items():
            parts = [np.log(1 + (len(docs) - df_of[t] + 0.5) / (df_of[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in ts if t in d]
            if parts:
                want[q, i] = sum(parts)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    normed = {(r["qid"], r["id"]): r["norm"] for r in retrieval.minmax(spark.createDataFrame([(*k, float(v)) for k, v in want.items()], "qid int, id long, score double"), ["qid"], 1.0).collect()}
    for q in (1, 2):
        values = [v for (k, _), v in want.items() if k == q]
        assert all(normed[q, i] == pytest.approx((v - min(values)) / (max(values) - min(values))) for (k, i), v in want.items() if k == q)
