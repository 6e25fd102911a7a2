"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.abuse import THRESHOLD, abuse_rates, abuse_scores, agreement, normal_source, train
from graphloom.llm.conversations import conversations, with_texts
from graphloom.llm.mixing import mix, shares
from graphloom.llm.pieces import pieces
from graphloom.llm.routines import documented_routines
from graphloom.llm.tokens import encode
from graphloom.llm.vectors import VectorTable, similar_pairs
from graphloom.plans.session import cut
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per message of every whole chat."""
    return conversations(table(spark, folder, "agent_turn")).select("chat_id", "msg_no", "turn_id")


def p1_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of every whole chat with role and text."""
    turns = table(spark, folder, "agent_turn")
    return with_texts(conversations(turns), turns)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documented procedures and functions of the current modules."""
    return documented_routines(table(spark, folder, "module_source"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Description and body of every documented routine."""
    pairs = documented_routines(table(spark, folder, "module_source"), full=True)
    return pairs.select("module_id", "line_no", "name", "kind", "description", F.length("body").alias("body_chars"), "body")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every current routine body above the limit."""
    return pieces(table(spark, folder, "routine"), "id", "body").withColumnRenamed("id", "routine_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similar vectors of the three embedding fields."""
    routines = VectorTable(table(spark, folder, "routine"), "id", ["code_embedding", "description_embedding"])
    objects = VectorTable(table(spark, folder, "metadata_object"), "object_qn", ["object_summary_embedding"])
    return similar_pairs([routines, objects]).select("field_name", "id_a", "id_b")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, folder, "documents"), keep=["doc_id"])


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens of every source."""
    documents = table(spark, folder, "documents").select(normal_source(F.col("source")).alias("source"), "text")
    counted = encode(documents, ids="tokens", keep=["source"], count_only=True)
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select("doc_id", normal_source(F.col("source")).alias("source"), "text")
    plans = table(spark, folder, "mix_target").withColumn("source", normal_source(F.col("source")))
    return encode(documents, ids="tokens", keep=["doc_id", "source"], count_only=True), plans


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each plan's mix with their copies."""
    documents, plans = _sized(spark, folder)
    return mix(documents, plans).select("plan_id", "source", "doc_id", "tokens", "copies")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the tokens that each source of a plan reached."""
    documents, plans = _sized(spark, folder)
    documents = cut(documents)
    return shares(mix(documents, plans), documents, plans)


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return abuse_scores(documents, train(documents, table(spark, folder, "doc_label")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _abuse(spark, folder).where(F.col("score") >= THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score and kind of the worst passage of every document."""
    return _abuse(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of such documents of every source, quoted passages apart."""
    return abuse_rates(_abuse(spark, folder))


def p9_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How the scores meet the majority of the raters."""
    return agreement(_abuse(spark, folder), table(spark, folder, "doc_label"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_conversations, p2_found, p2_pairs, p4_found, p5_found, p7_ids, p7_counts, p8_mix, p8_shares, p9_found, p9_scores, p9_rates, p9_agreement)}


def _said(column: str) -> str:
    """SQL of has_content."""
    bare = rf"lower(regexp_replace({column}, '^[\s\x{{A0}}\x{{3000}}]+|[\s\x{{A0}}\x{{3000}}]+$', '', 'g'))"
    words = "'null', 'none', 'nil', 'undefined', 'n/a', 'na', 'nan', 'void', 'empty', 'no answer', 'no reply', 'no response', 'нет ответа', 'нет текста', 'пустой ответ', 'ответ не получен', 'пусто'"
    return rf"coalesce(regexp_matches({column}, '[\p{{L}}\p{{N}}]') AND {bare} NOT IN ({words}) AND NOT regexp_matches({bare}, '^[\[({{<]+[^\[\](){{}}<>]*(null|none|nil|undefined|n/a|empty|missing|blank|no |not |нет |пуст|не получ|отсутств|без )[^\[\](){{}}<>]*[\])}}>]+$'), false)"


_CHATS = rf"""WITH c AS (SELECT turn_id, chat_id, seq, status, user_text, assistant_text, {_said("user_text")} AS u, {_said("assistant_text")} AS a, row_number() OVER (PARTITION BY turn_id ORDER BY loaded_at DESC) AS k FROM agent_turn),
    t AS (SELECT * FROM c WHERE k = 1 AND chat_id IS NOT NULL AND regexp_replace(chat_id, '[\s\x{{A0}}\x{{3000}}]+', '', 'g') <> ''),
    m AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS n, lag(a) OVER (PARTITION BY chat_id ORDER BY seq) AS before, lead(seq) OVER (PARTITION BY chat_id ORDER BY seq) AS after FROM t),
    ok AS (SELECT chat_id FROM m GROUP BY chat_id HAVING bool_and(coalesce(seq = n AND status = 'done' AND (u OR a) AND CASE WHEN before IS NULL THEN u ELSE u = before END AND (after IS NOT NULL OR a), false))),
    x AS (SELECT chat_id, seq, 0 AS part, turn_id, 'user' AS role, user_text AS text FROM t WHERE u UNION ALL SELECT chat_id, seq, 1, turn_id, 'assistant', assistant_text FROM t WHERE a)"""
_NO = "CAST(row_number() OVER (PARTITION BY chat_id ORDER BY seq, part) AS INTEGER) AS msg_no"
_P1 = f"{_CHATS} SELECT chat_id, {_NO}, turn_id FROM x JOIN ok USING (chat_id)"
_P1_TEXTS = f"{_CHATS} SELECT chat_id, {_NO}, turn_id, role, text FROM x JOIN ok USING (chat_id)"


def _usable(name: str, key: str, field: str) -> str:
    return f"""SELECT '{field}' AS f, {key} AS id, CAST({field} AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) AS k FROM {name}) WHERE k = 1 AND len({field}) = 64
        AND list_bool_and(list_transform({field}, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform({field}, lambda x: x <> 0))"""


_P5 = f"""WITH v AS ({_usable("routine", "id", "code_embedding")} UNION ALL {_usable("routine", "id", "description_embedding")} UNION ALL {_usable("metadata_object", "object_qn", "object_summary_embedding")}),
    c AS (SELECT a.f, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cos FROM v a JOIN v b ON a.f = b.f AND a.id <> b.id),
    n AS (SELECT f, a, b FROM (SELECT *, row_number() OVER (PARTITION BY f, a ORDER BY cos DESC) AS k FROM c) WHERE k <= 5 AND cos >= 0.90)
    SELECT DISTINCT f AS field_name, least(a, b) AS id_a, greatest(a, b) AS id_b FROM n"""


# The greedy walk of p4: line ends with their kinds are listed once a body, blanks are looked for only where no line ends.
_P4 = r"""WITH RECURSIVE b AS (SELECT id, body, length(body) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS k FROM routine) WHERE k = 1 AND length(body) > 3600),
    l AS (SELECT id, line, i, count(*) OVER (PARTITION BY id) AS m, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i) AS z FROM (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM b)),
    e AS (SELECT id, list(struct_pack(z := z, kind := CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 0 WHEN ends_with(rtrim(line, ' ' || chr(9) || chr(13)), ';') THEN 1 ELSE 2 END) ORDER BY z) AS ends FROM l WHERE i < m GROUP BY id),
    t AS (SELECT b.id, b.body, b.n, coalesce(e.ends, []) AS ends FROM b LEFT JOIN e USING (id)),
    w AS (SELECT id, -1 AS part, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS till, CAST(0 AS BIGINT) AS nxt FROM t
        UNION ALL SELECT id, part + 1, s, till, CASE WHEN till = n THEN NULL ELSE coalesce(list_min(list_transform(list_filter(ends, lambda x: x.z BETWEEN till - 720 AND till - 480), lambda x: x.z)), till - 720) END FROM (
            SELECT id, part, s, n, ends, CAST(CASE WHEN n - s <= 3600 THEN n WHEN len(can) > 0 THEN list_max(list_transform(list_filter(can, lambda x: x.kind = list_min(list_transform(can, lambda y: y.kind))), lambda x: x.z))
                ELSE s + coalesce(nullif(3100 + length(regexp_extract(substring(body, s + 3101, 500), '(?s)^.*[ \t]')), 3100), 3600) END AS BIGINT) AS till
            FROM (SELECT t.id, w.part, w.nxt AS s, t.n, t.body, t.ends, list_filter(t.ends, lambda x: x.z BETWEEN w.nxt + 3101 AND w.nxt + 3600) AS can FROM w JOIN t USING (id) WHERE w.nxt IS NOT NULL)))
    SELECT id AS routine_id, CAST(part AS INTEGER) AS part_index, CAST(s AS INTEGER) AS char_start, CAST(till AS INTEGER) AS char_end FROM w WHERE part >= 0"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_conversations": _P1_TEXTS, "p4_found": _P4, "p5_found": _P5}
