"""Lexical and vector retrieval: postings, BM25, normalisation, fusion, window and slot selection, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.session import cut, tasks_for

# Fixed values.
K1, B = 1.2, 0.75
RRF_K = 60
#: Rows of a side that may be broadcast, and query vectors that are; beyond both a shuffle does the same.
SMALL_SIDE, SMALL_QUERIES = 50_000, 20_000
#: Bins of the histogram that narrows an exact percentile down.
BINS = 4_096
#: Vectors of one block of the blocked search.
BLOCK = 4_096


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows (SMALL_SIDE by default) and for a merge join otherwise; call it on cheap or cut rows."""
    most = SMALL_SIDE if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def postings(docs: DataFrame, key: str, tokens: Column, field: str | None = None) -> DataFrame:
    """(key[, field], token, tf): how often each token occurs."""
    own = [F.lit(field).alias("field")] if field else []
    rows = docs.select(key, *own, F.explode(tokens).alias("token"))
    return rows.groupBy(key, *(["field"] if field else []), "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(posted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(token, df): documents with each token."""
    return posted.groupBy(*(by or []), "token").agg(F.count(F.lit(1)).alias("df"))


def idf(documents: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log1p((documents - df + 0.5) / (df + 0.5))


def matched(docs: DataFrame, key: str, words: Column, wanted: DataFrame) -> DataFrame:
    """(key, length, hits): of every document its number of tokens and [(token, tf)] of the tokens of ``wanted`` (token).

    Texts are tokenised where they are read and never shuffled. The result is cut: it is read for the statistics
    and again for the scores. Beyond SMALL_SIDE wanted tokens the postings are joined to them by shuffle.
    """
    rows = docs.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    tokens = [r["token"] for r in wanted.select("token").distinct().limit(SMALL_SIDE + 1).collect()]
    if len(tokens) <= SMALL_SIDE:
        known = F.filter("words", lambda w: w.isin(*tokens)) if tokens else F.array().cast("array<string>")
        rows = rows.select(key, F.size("words").cast("long").alias("length"), known.alias("known"))
        return cut(rows.select(key, "length", F.transform(F.array_distinct("known"), lambda t: F.struct(t.alias("token"), F.size(F.filter("known", lambda w: w == t)).cast("long").alias("tf"))).alias("hits")))
    flat = rows.select(key, F.size("words").cast("long").alias("length"), F.explode_outer("words").alias("token"))
    counted = flat.groupBy(key, "length", "token").agg(F.count(F.lit(1)).alias("tf")).join(wanted.select("token", F.lit(True).alias("w")).distinct(), "token", "left")
    return cut(counted.groupBy(key, "length").agg(F.collect_list(F.when(F.col("w"), F.struct("token", "tf"))).alias("hits")))


def bm25_parts(found: DataFrame, queries: DataFrame, key: str, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, key, part): what each token adds to the score of the documents of ``matched``; ``queries`` is (qid, token, qtf)."""
    stats = found.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    flat = found.where(F.size("hits") > 0).select(key, "length", F.inline("hits"))
    df = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    terms = queries.join(df.hint("merge"), "token").crossJoin(F.broadcast(stats))
    terms = cut(terms.select("qid", "token", (F.col("qtf") * idf(F.col("docs"), F.col("df"))).alias("weight"), "mean"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return flat.join(small(terms), "token").select("qid", key, part.alias("part"))


def bm25(docs: DataFrame, words: Column, queries: DataFrame, key: str, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, key, score) of every document that shares a token with a query; query tokens count as often as they occur.

    What is shuffled is one number for each matching (query, document, token), after partial sums.
    """
    parts = bm25_parts(matched(docs, key, words, queries), queries, key, k1, b)
    return parts.groupBy("qid", key).agg(F.sum("part").alias("score"))


def field_bm25(docs: DataFrame, fields: dict[str, tuple[Column, float]], queries: DataFrame, key: str) -> DataFrame:
    """(qid, key, score): the weighted sum of the scores of several fields, each with its own statistics; weight 0 leaves a field out."""
    legs = None
    for words, weight in fields.values():
        if weight:
            leg = bm25_parts(matched(docs, key, words, queries), queries, key).withColumn("part", F.col("part") * weight)
            legs = leg if legs is None else legs.unionByName(leg)
    return legs.groupBy("qid", key).agg(F.sum("part").alias("score"))


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each group with their rank from 1; ties by ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def mean_pool(rows: DataFrame, by: str, vector: str, weight: Column, dim: int) -> DataFrame:
    """(by, vector): the weighted mean of the vectors of each group, element by element.

    Whole vectors are summed where they are read; one row for each group and task is shuffled. Vectors of
    another length than ``dim`` and groups without weight are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, dim)
            w = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            groups = b.column(0).dictionary_encode()
            at = groups.indices.to_numpy(zero_copy_only=False)
            part = np.zeros((len(groups.dictionary), dim + 1))
            np.add.at(part, at, np.c_[x * w[:, None], w])
            for g, row in zip(groups.dictionary.to_pylist(), part):
                sums[g] = sums[g] + row if g in sums else row
            if len(sums) > 10_000:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def out(sums: dict[object, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=[by, "sums"])

    field = rows.schema[by]
    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[field.dataType.simpleString()]
    usable = rows.where(F.col(by).isNotNull() & (F.size(vector) == dim)).select(by, F.coalesce(weight.cast("double"), F.lit(0.0)).alias("w"), F.col(vector).cast("array<double>").alias("v"))
    parts = usable.mapInArrow(run, f"{by} {field.dataType.simpleString()}, sums array<double>")
    flat = parts.select(by, F.posexplode("sums").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("x"))
    whole = flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("s"))
    total = F.element_at("s", dim + 1)
    return whole.where(total != 0).select(by, F.transform(F.slice("s", 1, dim), lambda x: x / total).alias(vector))


def blocked_topk(queries: DataFrame, base: DataFrame, k: int, dim: int, by: str | None = None) -> DataFrame:
    """(qid, id, cos[, by]): the k most similar base vectors of each query, for each value of ``by`` if it is given.

    ``queries`` is (qid long, v), ``base`` (id long, v[, by]); an id is not its own neighbour, vectors without
    length have none, ties take the smaller id. Products are formed block by block as matrices and only the best
    k of a block go on, so no pair is ever a row. Up to SMALL_QUERIES queries are broadcast; beyond, queries and
    base meet in a grid of blocks, the base repeated once for each block of queries.
    """
    spark = base.sparkSession
    group = F.coalesce(F.col(by).cast("long"), F.lit(-1)) if by else F.lit(0).cast("long")
    base = base.where(F.size("v") == dim).select(F.col("id").cast("long").alias("id"), group.alias("g"), F.col("v").cast("array<double>").alias("v"))
    queries = queries.where(F.size("v") == dim).select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v"))

    def matrix(column: pa.Array) -> np.ndarray:
        x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(size > 0, size, np.nan)[:, None]

    def best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, groups: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            for lo in range(0, len(qids), BLOCK):
                rows = slice(lo, lo + BLOCK)
                s = q[rows] @ x[at].T
                s[~np.isfinite(s) | (qids[rows][:, None] == ids[at][None, :])] = -3.0
                keep = min(k + 8, len(at))
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if keep < len(at) else np.broadcast_to(np.arange(len(at)), s.shape)
                # All that tie with the last one kept, within rounding, are candidates too.
                least = np.take_along_axis(s, top, 1).min(1)
                r, c = np.nonzero(s >= np.maximum(least - 1e-12, -2.0)[:, None])
                cos = np.einsum("ij,ij->i", q[rows][r], x[at[c]])
                order = np.lexsort((ids[at[c]], -np.round(cos, 12), r))
                r, c, cos = r[order], c[order], cos[order]
                first = np.searchsorted(r, np.arange(len(qids[rows])))
                kept = np.arange(len(r)) - first[r] < k
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows][r[kept]]), pa.array(ids[at[c[kept]]]), pa.array(np.full(int(kept.sum()), g)), pa.array(cos[kept])], names=["qid", "id", "g", "cos"])

    schema = "qid long, id long, g long, cos double"
    known = queries.limit(SMALL_QUERIES + 1).toArrow()
    if known.num_rows <= SMALL_QUERIES:
        sent = spark.sparkContext.broadcast((known.column("qid").to_numpy(), matrix(known.column("v").combine_chunks())))

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    part = b.slice(lo, BLOCK)
                    yield from best(qids, q, part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2)))

        found = base.mapInArrow(against, schema)
    else:
        count = queries.count()
        sides = -(-count // BLOCK)
        asked = queries.select(F.pmod(F.xxhash64("qid"), F.lit(sides)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("bb"), F.lit(0).alias("kind"), F.col("qid").alias("id"), F.lit(0).cast("long").alias("g"), "v")
        there = base.select(F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int").alias("bb"), F.lit(1).alias("kind"), "id", "g", "v")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, qids, q = None, None, None
            for b in batches:
                cell = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
                kind = b.column(2).to_numpy()
                edges = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
                for i, j in zip(np.r_[0, edges], np.r_[edges, b.num_rows]):
                    if i == j:
                        continue
                    part = b.slice(i, j - i)
                    if kind[i] == 0:
                        new, x = part.column(3).to_numpy(), matrix(part.column(5))
                        qids, q = (np.r_[qids, new], np.r_[q, x]) if at == cell[i] else (new, x)
                        at = cell[i]
                    elif at == cell[i]:
                        yield from best(qids, q, part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5)))

        cells = asked.unionByName(there).repartition(tasks_for(spark, sides * sides, 4), "qb", "bb").sortWithinPartitions("qb", "bb", "kind")
        found = cells.mapInArrow(meet, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "g").orderBy(F.round("cos", 12).desc(), "id"))).where(F.col("rank") <= k)
    return ranked.select("qid", "id", "cos", "rank", *([F.col("g").alias(by)] if by else []))


def leg_spans(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by…, low, high, n) of each leg: one row a leg after partial aggregation, cut."""
    return cut(rows.groupBy(*by).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.count(F.lit(1)).alias("n")))


def minmax(rows: DataFrame, by: list[str], flat: float, score: str = "score") -> DataFrame:
    """Adds ``norm``: (x - min) / (max - min); ``flat`` where all are equal (0 in the blended signals, 1 in the lexical legs)."""
    spread = F.when(F.col("high") > F.col("low"), (F.col(score) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(flat))
    return rows.join(small(leg_spans(rows, by, score)), by).withColumn("norm", spread).drop("low", "high", "n")


def max_norm(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Adds ``norm``: x / max, 0 where the maximum is not positive."""
    norm = F.when(F.col("high") > 0, F.col(score) / F.col("high")).otherwise(0.0)
    return rows.join(small(leg_spans(rows, by, score)), by).withColumn("norm", norm).drop("low", "high", "n")


def percentiles(rows: DataFrame, by: list[str], score: str, points: list[float], bins: int = BINS) -> DataFrame:
    """(by…, low, high, n, p0, p1 …): exact percentiles of each group with linear interpolation, cut.

    No task ever holds a group: a first pass gives the spans, a second counts the scores in ``bins`` equal parts
    of each span, a third looks only at the distinct scores of the parts that hold the wanted ranks.
    """
    spans = leg_spans(rows, by, score)
    part = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int"))).otherwise(0)
    binned = rows.select(*by, score).join(small(spans), by).withColumn("bin", part)
    counts = cut(binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c")))
    ahead = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0))).join(spans.select(*by, "n"), by)
    ranks = F.array(*[x for p in points for x in (F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p))])
    holds = F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
    wanted = cut(edges.where(holds).select(*by, "bin", "before"))
    near = binned.join(small(wanted), [*by, "bin"]).groupBy(*by, "bin", "before", score).agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy(*by, "bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("from", F.col("before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).join(spans.select(*by, "n"), by)
    at = lambda r: F.max(F.when((r >= F.col("from")) & (r < F.col("from") + F.col("c")), F.col(score)))
    picked = []
    for i, p in enumerate(points):
        place = (F.col("n") - 1) * F.lit(p)
        picked += [at(F.floor(place)).alias(f"a{i}"), at(F.ceil(place)).alias(f"b{i}"), F.max(place - F.floor(place)).alias(f"f{i}")]
    got = near.groupBy(*by).agg(*picked)
    return cut(spans.join(got, by).select(*by, "low", "high", "n", *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).alias(f"p{i}") for i in range(len(points))]))


def robust_norm(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Adds ``norm``: (x - p50) / (p95 - p50) within 0..1, x / max where the percentiles meet. ``rows`` is read several times: cut it."""
    p = percentiles(rows, by, score, [0.5, 0.95])
    spread = F.when(F.col("p1") > F.col("p0"), (F.col(score) - F.col("p0")) / (F.col("p1") - F.col("p0"))).otherwise(F.when(F.col("high") > 0, F.col(score) / F.col("high")).otherwise(0.0))
    return rows.join(small(p), by).withColumn("norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread))).drop("low", "high", "n", "p0", "p1")


def fuse_weighted(left: DataFrame, right: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """(by, score): alpha times the right leg's norm and the rest times the left's; a missing leg counts 0."""
    legs = left.select(*by, F.col("norm").alias("l")).join(right.select(*by, F.col("norm").alias("r")), by, "full_outer")
    return legs.select(*by, ((1 - alpha) * F.coalesce("l", F.lit(0.0)) + alpha * F.coalesce("r", F.lit(0.0))).alias("score"))


def fuse_rrf(left: DataFrame, right: DataFrame, by: list[str], weights: tuple[float, float], k: int = RRF_K) -> DataFrame:
    """(by, score): weight / (k + rank) of both legs, ranks from 1."""
    legs = left.select(*by, F.col("rank").alias("l")).join(right.select(*by, F.col("rank").alias("r")), by, "full_outer")
    part = lambda w, c: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    return legs.select(*by, (part(weights[0], "l") + part(weights[1], "r")).alias("score"))


def dynamic_alpha(base: float, query_tokens: int, left_rows: int, right_rows: int, wanted: int) -> float:
    """The vector leg's weight: raised for short queries, all or nothing for an empty leg, shifted by a thin one, within 0.2..0.8."""
    if not left_rows and not right_rows:
        return base
    if not left_rows:
        return 1.0
    if not right_rows:
        return 0.0
    alpha = max(base, 0.7) if query_tokens <= 2 else base
    if left_rows < 0.3 * wanted:
        alpha += 0.1
    if right_rows < 0.3 * wanted:
        alpha -= 0.1
    return min(0.8, max(0.2, alpha))


def parent_scores(hits: DataFrame, parent: str, per_hit: float = 0.02, top_mean: float = 0.3) -> DataFrame:
    """(parent, score): best + per_hit * number + top_mean * mean of the best three."""
    best = F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, 3)
    mean = F.aggregate(F.col("best"), F.lit(0.0), lambda s, x: s + x) / F.size("best")
    return hits.groupBy(parent).agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n"), best.alias("best")).select(parent, (F.col("top") + per_hit * F.col("n") + top_mean * mean).alias("score"))


def best_windows(hits: DataFrame, parent: str, size: int, penalty: float = 0.0) -> DataFrame:
    """(parent, first, last, score): of each parent, the run of up to ``size`` neighbouring parts with the largest sum.

    ``hits`` has part numbers and scores; parts without a hit count 0; runs start at a hit. Ties take the first.
    """
    reach = Window.partitionBy(parent).orderBy("part").rangeBetween(0, size - 1)
    rows = hits.select(parent, F.col("part").alias("first"), F.max("part").over(reach).alias("last"), F.sum("score").over(reach).alias("sum"))
    rows = rows.withColumn("score", F.col("sum") - penalty * (F.col("last") - F.col("first")))
    order = Window.partitionBy(parent).orderBy(F.desc("score"), "first")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select(parent, "first", "last", "score")


def slots(hits: DataFrame, by: list[str], parent: str, quota: tuple[int, ...], limit: int) -> DataFrame:
    """The hits that fill the slots: the best parent gives ``quota[0]``, the next ``quota[1]`` …, then the best of the rest.

    ``hits`` (by…, parent, part, score, parent_score) holds a pool of candidates for each query, bounded by its top k.
    """
    parents = hits.select(*by, parent, "parent_score").distinct().withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("parent_score"), parent)))
    ranked = hits.join(parents.select(*by, parent, "p"), [*by, parent]).withColumn("k", F.row_number().over(Window.partitionBy(*by, parent).orderBy(F.desc("score"), "part")))
    share = F.array(*[F.lit(q) for q in quota])
    within = (F.col("p") <= len(quota)) & (F.col("k") <= F.get(share, F.col("p") - 1))
    first = F.when(F.coalesce(within, F.lit(False)), 0).otherwise(1)
    filled = ranked.withColumn("first", first).withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("first", F.when(F.col("first") == 0, F.col("p")), F.desc("score"), parent, "part")))
    return filled.where(F.col("slot") <= limit).select(*by, "slot", parent, "part", "score")


# Parents looked at, weights of their hits' number and mean, and parts given by each of the best windows.
SELECTIONS = {"vector": (5, 0.0, 0.0, (2, 2, 1)), "lexical": (5, 0.05, 0.0, None), "lexical_small": (1, 0.0, 0.0, (3, 1, 1))}


def window_selection(hits: DataFrame, sizes: DataFrame, profile: str, k: int, outside: float = 0.0, span: float = 0.0) -> DataFrame:
    """(qid, slot, parent, part): ``k`` parts of each query, the first of the best windows of its best parents, then the best of the rest.

    ``hits`` (qid, parent, part, score) is a pool bounded by its top k; ``sizes`` (parent, total) tells how many parts
    a parent has. A window is a run of ``k`` parts that holds a hit; its score sums the hits' min-max normalised
    scores less ``span`` for each step from its middle and ``outside`` for each part without a hit. Windows rank by it
    and their parent's score; each gives as many of its first parts as the profile says, one where it says none.
    """
    parents_kept, per_hit, top_mean, quota = SELECTIONS[profile]
    quota = quota or (1,) * k
    pool = cut(minmax(cut(hits.select("qid", "parent", "part", "score")), ["qid"], 1.0))
    best = F.slice(F.reverse(F.array_sort(F.collect_list("norm"))), 1, 3)
    scored = pool.groupBy("qid", "parent").agg(F.max("norm").alias("top"), F.count(F.lit(1)).alias("n"), best.alias("best"))
    value = F.col("top") + per_hit * F.col("n") + top_mean * F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")
    chosen = top_k(scored.select("qid", "parent", value.alias("parent_score")), parents_kept, ["qid"], "parent_score", "parent").drop("rank")
    inside = pool.join(chosen, ["qid", "parent"]).join(sizes.select("parent", "total"), "parent")
    shifts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.greatest(F.lit(0), F.least(F.col("total") - k, F.col("part") - s)))
    starts = inside.select("qid", "parent", "total", "parent_score", F.explode(shifts).alias("start")).distinct()
    met = starts.join(pool.select("qid", "parent", "part", "norm"), ["qid", "parent"]).where((F.col("part") >= F.col("start")) & (F.col("part") < F.col("start") + k))
    length = F.least(F.lit(k), F.col("total") - F.col("start"))
    worth = F.sum(F.col("norm") - span * F.abs(F.col("part") - F.col("start") - k // 2)) - outside * (F.max(length) - F.count(F.lit(1)))
    windows = met.groupBy("qid", "parent", "start", "total", "parent_score").agg(worth.alias("worth"))
    one = windows.withColumn("_k", F.row_number().over(Window.partitionBy("qid", "parent").orderBy(F.round("worth", 9).desc(), "start"))).where("_k = 1")
    order = Window.partitionBy("qid").orderBy(F.round(F.col("parent_score") + F.col("worth"), 9).desc(), "parent")
    ranked = one.withColumn("w", F.row_number().over(order)).where(F.col("w") <= len(quota))
    share = F.get(F.array(*[F.lit(q) for q in quota]), F.col("w") - 1)
    own = ranked.select("qid", "parent", "w", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + share, F.col("total")) - 1)).alias("part"))
    first = own.select("qid", "parent", "part", F.lit(0).alias("group"), F.struct(F.col("w").cast("double").alias("a"), F.col("part").cast("double").alias("b")).alias("order"))
    rest = pool.select("qid", "parent", "part", F.lit(1).alias("group"), F.struct((-F.col("norm")).alias("a"), F.lit(0.0).alias("b")).alias("order"))
    both = first.unionByName(rest).groupBy("qid", "parent", "part").agg(F.min(F.struct("group", "order")).alias("v"))
    slot = F.row_number().over(Window.partitionBy("qid").orderBy("v", "parent", "part"))
    return both.withColumn("slot", slot).where(F.col("slot") <= k).select("qid", "slot", "parent", "part")


def capped_by_top(score: Column, over: Window) -> Column:
    """Scores divided by the best if that exceeds 1."""
    top = F.max(score).over(over)
    return F.when(top > 1, score / top).otherwise(score)


def quality(results: DataFrame, gold: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(k, coverage, hit): mean share of each query's gold documents within the first k, and share of queries with any."""
    need = gold.groupBy("qid").agg(F.count_distinct("doc_id").alias("need"))
    found = gold.select("qid", "doc_id").distinct().join(results, ["qid", "doc_id"])
    out = None
    for k in cutoffs:
        got = found.where(F.col("rank") <= k).groupBy("qid").agg(F.count_distinct("doc_id").alias("got"))
        per = need.join(got, "qid", "left").select((F.coalesce("got", F.lit(0)) / F.col("need")).alias("c"), F.when(F.col("got") > 0, 1.0).otherwise(0.0).alias("h"))
        row = per.agg(F.avg("c").alias("coverage"), F.avg("h").alias("hit")).select(F.lit(k).cast("long").alias("k"), "coverage", "hit")
        out = row if out is None else out.unionByName(row)
    return out
