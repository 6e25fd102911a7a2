"""Search of code: legs over fields and structures, routing by intent, boosts, blending, gates, selection and paging.

All rows carry the query (qid): a set of queries is answered in one pass. A leg is (qid, id, score); only its best
candidates go on, so everything after the legs works on a pool bounded by the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as X
from graphloom.operators import retrieval
from graphloom.plans.session import cut

# Intents by parts of words, the tokens they add to a query, and the weights of the structures they look into.
ROUTES = {
    "query": (("запрос", "выбира", "получа", "таблиц", "остат", "срез", "соединен"), ("запрос", "выбрать", "из", "где", "поместить", "соединение"), {"query_tables": 0.45, "metadata_refs": 0.12, "method_calls": 0.06}),
    "assignment": (("заполня", "устанавли", "присва", "переда", "очища", "добавля", "изменя"), ("вставить", "установить", "добавить", "очистить", "заполнить"), {"assignments": 0.42, "method_calls": 0.12, "string_literals": 0.05}),
    "form": (("форма", "форме", "выбор", "отбор", "команда", "открыва", "обработчик"), ("форма", "открытьформу", "получитьформу", "обработать", "выбор"), {"method_calls": 0.30, "string_literals": 0.10, "metadata_refs": 0.06}),
    "posting": (("проведен", "проведение", "движени", "регистр", "запис", "набор запис"), ("движения", "добавить", "записать", "регистр", "наборзаписей"), {"metadata_refs": 0.22, "method_calls": 0.22, "assignments": 0.10}),
    "return": (("возвраща", "получить список", "список", "результат"), ("возврат", "получить", "список", "результат"), {"method_calls": 0.18, "assignments": 0.06, "string_literals": 0.05}),
    "print": (("печать", "печат", "макет", "табличный документ"), ("печать", "макет", "табличныйдокумент", "получитьмакет"), {"method_calls": 0.24, "string_literals": 0.12, "metadata_refs": 0.05}),
    "access": (("доступ", "прав", "роль", "ограничен", "разреш"), ("доступ", "право", "роль", "разрешить", "ограничение"), {"string_literals": 0.20, "method_calls": 0.12, "metadata_refs": 0.05}),
    "exchange": (("обмен", "синхрон", "отправ", "получ", "загруз", "выгруз", "эдо", "сэдо"), ("обмен", "отправить", "получить", "загрузить", "выгрузить", "эдо", "сэдо"), {"method_calls": 0.22, "string_literals": 0.12, "metadata_refs": 0.05}),
}
# The share of a route in the sum, terms of a routed query, weights of the fuzzy fields and their threshold.
ROUTED_SHARE, ROUTED_TERMS = 0.4, 14
FUZZY_WEIGHTS = {"symbol": 2.2, "object": 1.4, "form": 0.4, "metadata_type": 0.4}
FUZZY_LEAST = 0.88
# Weights of the overlap boost and what is left of the first for a name that any form has.
BOOST = {"symbol": 1.0, "object": 0.6, "form": 0.4}
GENERIC_SHARE = 0.25


def routes_of(query: str) -> dict[str, float]:
    """The weights of the structures that a query's intents look into; of several intents the larger stands."""
    low = query.lower()
    out: dict[str, float] = {}
    for needles, _, tables in ROUTES.values():
        if any(n in low for n in needles):
            for name, weight in tables.items():
                out[name] = max(out.get(name, 0.0), weight)
    return out


def routed_tokens(query: str, tokens: list[str], most: int = ROUTED_TERMS) -> list[str]:
    """The query's tokens and those its intents add, distinct and in order, at most ``most``."""
    low = query.lower()
    more = [t for needles, extra, _ in ROUTES.values() if any(n in low for n in needles) for t in extra]
    return list(dict.fromkeys([*tokens, *more]))[:most]


def fields_of(routines: DataFrame, key: str = "id") -> DataFrame:
    """(key, symbol, object, form, metadata_type, body and the structures, each as tokens) of routines with name, owner_qn and body.

    All are made where the body is read; none of the texts is kept.
    """
    own = X.owner_parts(F.col("owner_qn"))
    words = lambda c: F.coalesce(X.tokens(c, stop=X.CODE_STOP_WORDS), F.array().cast("array<string>"))
    joined = lambda found: words(F.array_join(found, " "))
    body = F.coalesce("body", F.lit(""))
    refs = F.regexp_extract_all(body, F.lit(r"((?:Справочник|Документ|Регистр|Перечислени|План|Отчет|Обработк)[\p{L}]*\.[\p{L}_][\p{L}\p{N}_]*)"), F.lit(1))
    tables = F.regexp_extract_all(body, F.lit(r"(?iu)(?:ИЗ|СОЕДИНЕНИЕ|FROM|JOIN)[\s|]+([\p{L}_][\p{L}\p{N}_.]*)"), F.lit(1))
    return routines.select(
        key, words(F.col("name")).alias("symbol"), words(own["object"]).alias("object"), words(own["form"]).alias("form"), words(own["type"]).alias("metadata_type"), words(body).alias("body"),
        joined(F.slice(F.array_distinct(refs), 1, 80)).alias("metadata_refs"), joined(F.slice(F.array_distinct(tables), 1, 80)).alias("query_tables"), joined(F.slice(F.array_distinct(X.called_names(body)), 1, 80)).alias("method_calls"),
        joined(F.slice(F.array_distinct(X.assigned_names(body)), 1, 80)).alias("assignments"), joined(F.slice(F.array_distinct(X.string_literals(body)), 1, 80)).alias("string_literals"),
    )


def fts_bm25(docs: DataFrame, words: Column, queries: DataFrame, key: str) -> DataFrame:
    """(qid, key, score) as an embedded full-text index ranks: negative, the lower the better, with its own inverse frequency, never below 1e-6; repeated query tokens count once."""
    once = queries.select("qid", "token").distinct()
    found = retrieval.matched(docs, key, words, once)
    stats = found.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    flat = found.where(F.size("hits") > 0).select(key, "length", F.inline("hits"))
    df = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms = cut(once.join(df.hint("merge"), "token").crossJoin(F.broadcast(stats)).select("qid", "token", weight.alias("weight"), "mean"))
    part = F.col("weight") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    return flat.join(retrieval.small(terms), "token").groupBy("qid", key).agg((-F.sum(part)).alias("score"))


def overlap_boost(pool: DataFrame, queries: DataFrame, generic: list[list[str]] | None = None) -> DataFrame:
    """Adds ``boost`` to (qid, id, symbol, object, form …): the shares of the query's tokens in the fields, weighted by BOOST; ``queries`` is (qid, tokens)."""
    share = lambda c: F.when(F.size(c) > 0, X.overlap(F.col("tokens"), F.col(c))).otherwise(0.0)
    common = F.lit(False)
    for name in generic or []:
        common = common | (F.col("symbol") == F.array(*[F.lit(t) for t in name]))
    first = F.when(common, BOOST["symbol"] * GENERIC_SHARE).otherwise(F.lit(BOOST["symbol"]))
    joined = pool.join(retrieval.small(queries.select("qid", "tokens")), "qid")
    return joined.withColumn("boost", first * share("symbol") + BOOST["object"] * share("object") + BOOST["form"] * share("form")).drop("tokens")


def similarity(a: str, b: str) -> float:
    """1 for equal words, 0.94 if one begins with the other, else the share of matching blocks."""
    return 1.0 if a == b else 0.94 if a.startswith(b) or b.startswith(a) else SequenceMatcher(None, a, b).ratio()


def fuzzy_share(query: list[str] | None, field: list[str] | None, least: float = FUZZY_LEAST) -> float:
    """The mean over a field's stems of their best likeness to a query's stem, likeness below ``least`` counting nothing."""
    if query is None or field is None or not len(query) or not len(field):
        return 0.0
    best = [max(similarity(f, q) for q in query) for f in field]
    return sum(b for b in best if b >= least) / len(field)


@F.pandas_udf(T.DoubleType())
def _fuzzy(query: pd.Series, field: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_share(q, f) for q, f in zip(query, field)], dtype=float)


def fuzzy_scores(pool: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``fuzzy`` to a pool of candidates: the weighted fuzzy shares of its fields. Matching blocks have no built-in form, so a bounded pool goes through Python in batches."""
    joined = pool.join(retrieval.small(queries.select("qid", "tokens")), "qid")
    stems = lambda c: F.transform(c, lambda t: X.stem(t))
    score = F.lit(0.0)
    for name, weight in (weights or FUZZY_WEIGHTS).items():
        score = score + weight * _fuzzy(stems(F.col("tokens")), stems(F.col(name)))
    return joined.withColumn("fuzzy", score).drop("tokens")


def leg(scored: DataFrame, weight: float, k: int, key: str = "id") -> DataFrame:
    """(qid, key, part): the best k of a leg with a positive score, min-max normalised (1 where all are equal) and weighted."""
    best = cut(retrieval.top_k(scored.where("score > 0"), k, ["qid"], tie=key).select("qid", key, "score"))
    return retrieval.minmax(best, ["qid"], 1.0).select("qid", key, (F.col("norm") * weight).alias("part"))


def safe_legs(makers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(legs, failures): each leg computed and cut by itself, so one that fails leaves the others standing; failures by name with their reason."""
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, make in makers.items():
        try:
            done[name] = cut(make())
        except Exception as problem:  # noqa: BLE001 - whatever stops a leg must not stop the search
            failed[name] = f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"
    return done, failed


def combined(legs: list[DataFrame], k: int, key: str = "id") -> DataFrame:
    """(qid, key, score, rank): the sums over legs, the best k of each query."""
    out = legs[0]
    for more in legs[1:]:
        out = out.unionByName(more)
    return retrieval.top_k(out.groupBy("qid", key).agg(F.sum("part").alias("score")), k, ["qid"], tie=key)


def blended(pool: DataFrame, signals: dict[str, float]) -> DataFrame:
    """Adds ``score``: the weighted mean of the signals, each min-max normalised within its query's pool (0 where all are equal); null signals count 0."""
    out, total = pool, sum(signals.values())
    score = F.lit(0.0)
    for name, weight in signals.items():
        span = Window.partitionBy("qid")
        value = F.coalesce(F.col(name), F.lit(0.0))
        low, high = F.min(value).over(span), F.max(value).over(span)
        out = out.withColumn(f"_{name}", F.when(high > low, (value - low) / (high - low)).otherwise(0.0))
        score = score + weight * F.col(f"_{name}")
    return out.withColumn("score", score / total).drop(*[f"_{n}" for n in signals])


def inverse_rank(ranked: DataFrame, routed: DataFrame | None = None, share: float = ROUTED_SHARE, key: str = "id") -> DataFrame:
    """(qid, key, score): 1 / rank plus ``share`` of the routed parts of the same candidate."""
    base = ranked.select("qid", key, (1.0 / F.col("rank")).alias("score"))
    if routed is None:
        return base
    more = routed.groupBy("qid", key).agg((F.sum("part") * share).alias("more"))
    return base.join(more, ["qid", key], "left").select("qid", key, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def merged(legs: list[DataFrame], key: str = "id") -> DataFrame:
    """(qid, key, score): several stores' results by id, the largest score standing."""
    out = legs[0].select("qid", key, "score")
    for more in legs[1:]:
        out = out.unionByName(more.select("qid", key, "score"))
    return out.groupBy("qid", key).agg(F.max("score").alias("score"))


def confident(ranked: DataFrame, least: float) -> DataFrame:
    """(qid, margin, confident): how far the best stands before the second; a single result is as far as its score."""
    top = ranked.where(F.col("rank") <= 2).groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    margin = F.col("a") - F.coalesce("b", F.lit(0.0))
    return top.select("qid", margin.alias("margin"), (margin >= least).alias("confident"))


def reranked(ranked: DataFrame, rate: Callable[[pd.DataFrame], pd.Series], head: int, key: str = "id", text: str = "text") -> DataFrame:
    """(qid, key, rank): the first ``head`` of each query in the order of ``rate`` (query text and text, in batches), the tail as it was.

    ``rate`` is a plug: a model's or, without one, any function of (query, text) rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], key: b[key], "rate": rate(b).astype(float)})

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    first = ranked.where(F.col("rank") <= head)
    rated = first.select("qid", key, "query", text).mapInPandas(run, f"qid {kinds['qid']}, {key} {kinds[key]}, rate double")
    new = rated.withColumn("new", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rate"), key)))
    return ranked.join(new.select("qid", key, "new"), ["qid", key], "left").select("qid", key, F.coalesce("new", "rank").alias("rank"))


def not_shown(ranked: DataFrame, shown: DataFrame, most: int, key: str = "id") -> DataFrame:
    """The first ``most`` of a pool that were not shown before (qid, key), in their order, with a new rank."""
    rest = ranked.join(shown.select("qid", key).distinct(), ["qid", key], "left_anti")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", key))).where(F.col("rank") <= most)


def topped_up(first: DataFrame, second: DataFrame, most: int, key: str = "id") -> DataFrame:
    """(qid, key, source, rank): the first leg's results, filled up to ``most`` from the second where they are too few."""
    both = first.select("qid", key, F.lit(0).alias("source"), "rank").unionByName(second.join(first.select("qid", key), ["qid", key], "left_anti").select("qid", key, F.lit(1).alias("source"), "rank"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("source", "rank", key))).where(F.col("rank") <= most)


def materialised(fragments: DataFrame, pending: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """(qid, routine, score, parts): fragments (qid, routine, part, score, body_hash) by routine, the best routine first, parts in order.

    Routines that are being changed (``pending``: routine) and fragments whose hash isn't the current body's
    (``current``: routine, body_hash) are hidden.
    """
    rows = fragments if pending is None else fragments.join(pending.select("routine").distinct(), "routine", "left_anti")
    rows = rows if current is None else rows.join(current.select("routine", "body_hash"), ["routine", "body_hash"], "left_semi")
    return rows.groupBy("qid", "routine").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("part")).alias("parts"))


def spread_to_units(modules: DataFrame, units: DataFrame, per_module: int | None = None, modules_kept: int | None = None) -> DataFrame:
    """(qid, id, score): the score of a module (qid, module, score) on each of its units (id, module), the best of several; or on the first few units of the first few modules."""
    kept = modules if modules_kept is None else retrieval.top_k(modules, modules_kept, ["qid"], tie="module").drop("rank")
    mine = units if per_module is None else units.withColumn("_k", F.row_number().over(Window.partitionBy("module").orderBy("id"))).where(F.col("_k") <= per_module).drop("_k")
    return kept.join(mine.select("id", "module"), "module").groupBy("qid", "id").agg(F.max("score").alias("score"))


def per_leg_budget(limit: int, offset: int, oversample: int, least: int, most: int, categories: int = 1) -> int:
    """Candidates each leg looks for: a multiple of the page's end within bounds, shared fairly between categories."""
    whole = max(least, min(most, oversample * (limit + offset)))
    return max(1, -(-whole // max(1, categories)))


def code_search(fields: DataFrame, queries: dict[int, str], k: int = 100) -> DataFrame:
    """(qid, id, score): lexical search of code for several queries.

    Legs over the body (1.0) and, by fuzzy likeness, over names (0.6) give a pool of the best k; intents route the
    query into the structures of the code; the result is 1 / rank plus the routed parts. ``fields`` comes from
    ``fields_of``; it is cut once and read by all legs.
    """
    spark = fields.sparkSession
    fields = cut(fields)
    rows = spark.createDataFrame([(q, t) for q, t in queries.items()], "qid int, text string")
    tokens = cut(rows.select("qid", X.tokens(F.col("text"), stop=X.CODE_STOP_WORDS).alias("tokens")))
    counted = tokens.select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))
    docs = lambda c: fields.select("id", F.col(c).alias("w"))
    body = cut(retrieval.bm25(docs("body"), F.col("w"), counted, "id"))
    pool = retrieval.top_k(body, 2 * k, ["qid"], tie="id").select("qid", "id")
    fuzzy = fuzzy_scores(pool.join(fields.select("id", *FUZZY_WEIGHTS), "id"), tokens).select("qid", "id", F.col("fuzzy").alias("score"))
    ranked = cut(combined([leg(body, 1.0, k), leg(fuzzy, 0.6, k)], k))
    own = {q: routed_tokens(queries[q], r["tokens"]) for r in tokens.collect() for q in [r["qid"]]}
    routed = None
    for name in sorted({t for q in queries.values() for t in routes_of(q)}):
        wanted = [(q, token, 1, routes_of(t)[name]) for q, t in queries.items() if name in routes_of(t) for token in own[q]]
        asked = spark.createDataFrame(wanted, "qid int, token string, qtf int, w double")
        scored = retrieval.bm25(docs(name), F.col("w"), asked.select("qid", "token", "qtf"), "id")
        # Only candidates of the pool are routed.
        part = leg(scored.join(ranked.select("qid", "id"), ["qid", "id"], "left_semi"), 1.0, k).join(F.broadcast(asked.select("qid", "w").distinct()), "qid").select("qid", "id", (F.col("part") * F.col("w")).alias("part"))
        routed = part if routed is None else routed.unionByName(part)
    return inverse_rank(ranked, routed)
