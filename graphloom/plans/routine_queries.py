"""Queries of call sites, routine tools and code search, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import calls as C
from graphloom.operators import relations as R
from graphloom.operators import retrieval
from graphloom.operators import search as S
from graphloom.plans import catalog as K
from graphloom.plans.session import cut
from graphloom.sources.tables import table
from graphloom.tools import routines as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ROU = K.ROU


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _routines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.current_rows(table(spark, d, "routine"), "id", list(columns))


# --- call sites

_DECLARED = r"(?i)(?:(?:асинх|async)\s+)?(процедура|функция|procedure|function|новый|new)[ \t]+[\p{L}_][\p{L}\p{N}_]*\s*\("
_CHAIN = r"(\.?\s*[\p{L}_][\p{L}\p{N}_]*(?:[ \t]*\.[ \t]*[\p{L}_][\p{L}\p{N}_]*)*)\s*\("
_RESERVED = "'если', 'иначеесли', 'и', 'или', 'не', 'возврат', 'пока', 'для', 'каждого', 'из', 'по', 'цикл', 'тогда', 'иначе', 'выполнить', 'попытка', 'перейти', 'if', 'elsif', 'and', 'or', 'not', 'return', 'while', 'for', 'each', 'in', 'to', 'do', 'then', 'else', 'execute', 'try', 'goto'"
_BARE = r"regexp_replace(body, '\"(?:[^\"]|\"\")*\"?|//[^\r\n]*', ' ', 'g')"
_SITES = rf"""x AS (SELECT id, unnest(regexp_extract_all(regexp_replace({_BARE}, '{_DECLARED}', '(', 'g'), '{_CHAIN}', 1)) AS chain FROM {ROU} WHERE body IS NOT NULL),
    sites AS (SELECT id, regexp_replace(chain, '\s+', '', 'g') AS chain FROM x), named AS (SELECT id, split_part(chain, '.', -1) AS name, CASE WHEN contains(chain, '.') THEN regexp_replace(chain, '\.[^.]*$', '') END AS qualifier FROM sites WHERE NOT starts_with(chain, '.') AND lower(chain) NOT IN ({_RESERVED}))"""


def _sites(spark, d):
    """Sites of the current bodies, found where the bodies are read."""
    held = C.with_sites(table(spark, d, "routine"), ["id", "loaded_at"])
    return C.flat_sites(R.current_rows(held, "id", ["sites"]))


@query(f"WITH {_SITES} SELECT id, name, qualifier, count(*) AS sites FROM named GROUP BY ALL")
def call_sites(spark, d):
    """Calls by routine and name, literals, comments, declarations and constructors left out."""
    found = _sites(spark, d).where(F.col("kind").isin("direct", "qualified"))
    return found.groupBy("id", "name", "qualifier").agg(F.count(F.lit(1)).alias("sites"))


@query()
def call_site_lines(spark, d):
    """Every call with its kind, number of arguments and line."""
    return _sites(spark, d)


_SIG = "id", "module_id", "owner_qn", "module_type", "params_text", "name", "directives"
_CLASS = "CASE WHEN directives IS NULL OR len(directives) = 0 THEN ['neutral'] ELSE list_distinct(list_transform(directives, lambda x: CASE WHEN contains(lower(x), 'наклиенте') OR contains(lower(x), 'atclient') THEN 'client' WHEN (contains(lower(x), 'насервере') OR contains(lower(x), 'atserver')) AND (contains(lower(x), 'безконтекста') OR contains(lower(x), 'nocontext')) THEN 'server_no_context' WHEN contains(lower(x), 'насервере') OR contains(lower(x), 'atserver') THEN 'server' WHEN contains(lower(x), 'навнешнемсоединении') OR contains(lower(x), 'atexternalconnection') THEN 'external' ELSE 'neutral' END)) END"
_LOCAL = rf"""{_SITES}, sig AS (SELECT id, module_id, lower(name) AS lname, {_CLASS} AS ctx, list_filter(list_transform(string_split(regexp_replace(coalesce(params_text, ''), '"[^"]*"', 's', 'g'), ','), lambda p: trim(p)), lambda p: p <> '') AS ps FROM {ROU}),
    s2 AS (SELECT id, module_id, lname, ctx, len(ps) AS most, len(list_filter(ps, lambda p: NOT contains(p, '='))) AS least FROM sig),
    one AS (SELECT id, lower(name) AS lname, count(*) AS n FROM named WHERE qualifier IS NULL GROUP BY ALL),
    cand AS (SELECT o.id AS caller, e.id AS callee, o.n, o.lname, e.least, e.most, CASE WHEN (list_contains(e.ctx, 'client') AND list_contains(e.ctx, 'server')) OR list_contains(e.ctx, 'neutral') OR list_contains(c.ctx, 'neutral') OR (list_contains(e.ctx, 'server_no_context') AND (list_contains(c.ctx, 'server') OR list_contains(c.ctx, 'client'))) OR list_has_any(c.ctx, e.ctx) THEN 0 ELSE 1 END AS tier
        FROM one o JOIN s2 c ON c.id = o.id JOIN s2 e ON e.module_id = c.module_id AND e.lname = o.lname),
    edges AS (SELECT caller, callee, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY caller, lname ORDER BY tier, least, most, callee) AS k FROM cand) WHERE k = 1 GROUP BY ALL)"""


def _resolved(spark, d):
    return C.resolve_calls(_sites(spark, d), _routines(spark, d, *_SIG))


def _edges(spark, d):
    return cut(C.call_edges(_resolved(spark, d).where("kind = 'direct'")))


@query(f"WITH {_LOCAL} SELECT caller, callee, calls FROM edges")
def call_edges_local(spark, d):
    """Direct calls resolved within the caller's module, the best of several namesakes."""
    return C.call_edges(_resolved(spark, d).where("kind = 'direct'")).select("caller", "callee", "calls")


@query()
def call_edges(spark, d):
    """All resolved calls as edges with their number and first lines."""
    return C.call_edges(_resolved(spark, d))


# --- tools


@query(f"SELECT id, owner_qn, name FROM {ROU} WHERE starts_with(lower(name), 'сравнить') AND is_export")
def tool_search_name(spark, d):
    return T.search(_routines(spark, d, "owner_qn", "name", "is_export"), "name", "Сравнить", "starts_with", export=True)


@query(f"SELECT id, owner_qn, name FROM {ROU} WHERE contains(lower(name || '(' || coalesce(params_text, '') || ')'), '(набор')")
def tool_search_signature(spark, d):
    return T.search(_routines(spark, d, "owner_qn", "name", "params_text", "is_export"), "signature", "(Набор")


@query(f"SELECT id, owner_qn, name FROM {ROU} WHERE contains(lower(doc_description), 'остат')")
def tool_search_description(spark, d):
    return T.search(_routines(spark, d, "owner_qn", "name", "doc_description", "is_export"), "description", "остат")


@query(f"WITH {_LOCAL} SELECT id, owner_qn, name FROM {ROU} WHERE id NOT IN (SELECT callee FROM edges) AND NOT (module_type = 'FormModule' AND starts_with(lower(name), 'при'))")
def tool_search_unused(spark, d):
    """Routines nobody calls that no form has as a handler."""
    r = _routines(spark, d, "owner_qn", "name", "module_type", "is_export")
    handlers = r.where((F.col("module_type") == "FormModule") & F.lower("name").startswith("при"))
    return T.search(r, "unused", edges=_edges(spark, d), handlers=handlers)


@query(
    f"""WITH {_LOCAL}, r AS (SELECT id, name FROM {ROU}), up AS (SELECT e.callee AS id, r.name, row_number() OVER (PARTITION BY e.callee ORDER BY r.name, r.id) AS k FROM edges e JOIN r ON r.id = e.caller),
    down AS (SELECT e.caller AS id, r.name, row_number() OVER (PARTITION BY e.caller ORDER BY r.name, r.id) AS k FROM edges e JOIN r ON r.id = e.callee),
    a AS (SELECT id, string_agg(name, ',' ORDER BY name) FILTER (WHERE k <= 2) AS s, count(*) AS n FROM up GROUP BY id), b AS (SELECT id, string_agg(name, ',' ORDER BY name) FILTER (WHERE k <= 2) AS s, count(*) AS n FROM down GROUP BY id)
    SELECT r.id, coalesce(a.s, '') AS callers, coalesce(a.n, 0) AS callers_total, coalesce(b.s, '') AS callees, coalesce(b.n, 0) AS callees_total FROM r LEFT JOIN a USING (id) LEFT JOIN b USING (id)"""
)
def tool_call_context(spark, d):
    """Every routine with the first two of its callers and callees."""
    r = _routines(spark, d, "name")
    rows = T.with_call_context(r.select("id"), _edges(spark, d), r, 2)
    return rows.select("id", F.array_join("callers", ",").alias("callers"), "callers_total", F.array_join("callees", ",").alias("callees"), "callees_total")


@query(f"SELECT id, name, substring(body, 41, 60) AS part, CAST(coalesce(length(body), 0) AS BIGINT) AS total, CASE WHEN length(body) > 100 THEN CAST(100 AS BIGINT) END AS next_offset FROM {ROU} WHERE lower(name) = (SELECT min(lower(name)) FROM {ROU})")
def tool_routine_body(spark, d):
    """A slice of the bodies of all routines of the first name, with the offset to go on from."""
    r = _routines(spark, d, "name", "params_text", "body")
    first = r.agg(F.min(F.lower("name"))).first()[0] or ""
    return T.bodies(r, "name", first, 60, 40)


@query(f"SELECT owner_qn, module_type, count(*) AS routines, count(*) FILTER (WHERE is_export) AS exported FROM {ROU} GROUP BY ALL")
def tool_modules_of_owner(spark, d):
    return T.modules(_routines(spark, d, "owner_qn", "module_type", "is_export"), "modules_of_owner")


@query(f"SELECT module_id, id, name, line_no FROM {ROU}")
def tool_module_routines(spark, d):
    return T.modules(_routines(spark, d, "module_id", "name", "line_no"), "module_routines")


@query(f"SELECT owner_qn, id, name FROM {ROU} WHERE split_part(owner_qn, '/', 3) = 'ОбщиеМодули' AND is_export")
def tool_common_modules(spark, d):
    return T.modules(_routines(spark, d, "owner_qn", "name", "is_export"), "common_module_routines")


@query(f"WITH {_LOCAL} SELECT caller AS start, callee AS routine, 'direct' AS kind, calls FROM edges WHERE caller IN (SELECT id FROM {ROU} WHERE is_export)")
def tool_callees(spark, d):
    """Direct callees of all exported routines."""
    starts = _routines(spark, d, "is_export").where("is_export").select(F.col("id").alias("start"))
    return T.neighbours(_edges(spark, d), starts, "callees")


@query(f"WITH {_LOCAL} SELECT callee AS start, caller AS routine, 'direct' AS kind, calls FROM edges")
def tool_callers(spark, d):
    """Direct callers of all routines."""
    return T.neighbours(_edges(spark, d), _routines(spark, d, "name").select(F.col("id").alias("start")), "callers")


@query(f"WITH {_LOCAL}, o AS (SELECT id, owner_qn FROM {ROU}) SELECT a.owner_qn AS from_owner, b.owner_qn AS to_owner, count(*) AS pairs, CAST(sum(calls) AS BIGINT) AS calls FROM edges e JOIN o a ON a.id = e.caller JOIN o b ON b.id = e.callee GROUP BY ALL")
def tool_between_owners(spark, d):
    """Calls between owners, those within one included."""
    return T.between_owners(_edges(spark, d), _routines(spark, d, "owner_qn"), same_owner=True)


@query(
    f"""WITH RECURSIVE {_LOCAL}, steps AS (SELECT 'out' AS side, caller AS src, callee AS dst FROM edges UNION ALL SELECT 'in', callee, caller FROM edges),
    w AS (SELECT side, src AS start, [src, dst] AS nodes, [src || '>' || dst] AS used FROM steps WHERE src IN (SELECT id FROM {ROU})
        UNION ALL SELECT w.side, w.start, list_append(w.nodes, s.dst), list_append(w.used, s.src || '>' || s.dst) FROM w JOIN steps s ON s.side = w.side AND s.src = w.nodes[-1] WHERE len(w.used) < 3 AND NOT list_contains(w.used, s.src || '>' || s.dst)),
    p AS (SELECT *, row_number() OVER (PARTITION BY start, side ORDER BY len(used), array_to_string(nodes, '>')) AS path_no FROM w), f AS (SELECT start, side, path_no, nodes, unnest(range(1, len(nodes))) AS step FROM p WHERE path_no <= 5)
    SELECT start, side, path_no, CASE WHEN side = 'out' THEN nodes[step] ELSE nodes[step + 1] END AS caller, CASE WHEN side = 'out' THEN nodes[step + 1] ELSE nodes[step] END AS callee, CAST(step AS INTEGER) AS step FROM f"""
)
def tool_call_subtree(spark, d):
    """The first five paths of up to three calls from and to every routine, edge by edge."""
    return T.subtree(_edges(spark, d), _routines(spark, d, "name").select(F.col("id").alias("start")), "both", 3, 5).withColumn("path_no", F.col("path_no").cast("long"))


# --- search of code

_FIELDS = f"""r AS (SELECT id, {K._sql_tokens("name", K._CODE_STOP)} AS symbol, {K._sql_tokens("split_part(owner_qn, '/', 4)", K._CODE_STOP)} AS object, {K._sql_tokens("coalesce(body, '')", K._CODE_STOP)} AS body FROM {ROU})"""
_ASK = {1: "сравнить остатки по складу", 2: "ЗагрузитьДоговоры списком", 3: "запрос по регистру накопления", 4: "открыть форму выбора"}
_ASKED = "q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest(t) AS token FROM (" + " UNION ALL ".join(f"SELECT {i} AS qid, {K._sql_tokens(repr(t), K._CODE_STOP)} AS t" for i, t in _ASK.items()) + ")) GROUP BY ALL)"


def _asked(spark):
    rows = spark.createDataFrame(list(_ASK.items()), "qid int, text string")
    return rows.select("qid", X.tokens(F.col("text"), stop=X.CODE_STOP_WORDS).alias("tokens"))


def _counted(spark):
    return _asked(spark).select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))


def _field(name: str, weight: float) -> str:
    return f"""SELECT q.qid, p.id, {weight} * q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / s.mean)) AS part
        FROM q JOIN (SELECT id, len, token, count(*) AS tf FROM (SELECT id, len({name}) AS len, unnest({name}) AS token FROM r) GROUP BY ALL) p USING (token)
        JOIN (SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest({name}) AS token FROM r) GROUP BY token) d USING (token) CROSS JOIN (SELECT count(*) AS n, avg(len({name})) AS mean FROM r) s"""


@query(f"WITH {_FIELDS}, {_ASKED}, parts AS ({_field('symbol', 6.0)} UNION ALL {_field('object', 2.0)} UNION ALL {_field('body', 1.0)}) SELECT CAST(qid AS BIGINT) AS qid, id, round(sum(part), 6) AS score FROM parts GROUP BY qid, id")
def field_bm25(spark, d):
    """Scores over names, owners and bodies, each with its own statistics and weight."""
    fields = cut(S.fields_of(_routines(spark, d, "name", "owner_qn", "body")).select("id", "symbol", "object", "body"))
    scored = retrieval.field_bm25(fields, {"symbol": (F.col("symbol"), 6.0), "object": (F.col("object"), 2.0), "form": (F.col("symbol"), 0.0), "body": (F.col("body"), 1.0)}, _counted(spark), "id")
    return scored.select(F.col("qid").cast("long").alias("qid"), "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_FIELDS}, {_ASKED}, p AS (SELECT id, len, token, count(*) AS tf FROM (SELECT id, len(body) AS len, unnest(body) AS token FROM r) GROUP BY ALL), d AS (SELECT token, count(DISTINCT id) AS df FROM p GROUP BY token), s AS (SELECT count(*) AS n, avg(len(body)) AS mean FROM r)
    SELECT CAST(qid AS BIGINT) AS qid, id, round(-sum(greatest(1e-6, ln((s.n - d.df + 0.5) / (d.df + 0.5))) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / s.mean))), 6) AS score FROM (SELECT DISTINCT qid, token FROM q) q JOIN p USING (token) JOIN d USING (token) CROSS JOIN s GROUP BY qid, id"""
)
def fts_bm25(spark, d):
    """Scores over bodies as an embedded full-text index gives them."""
    docs = S.fields_of(_routines(spark, d, "name", "owner_qn", "body")).select("id", "body")
    return S.fts_bm25(docs, F.col("body"), _counted(spark), "id").select(F.col("qid").cast("long").alias("qid"), "id", F.round("score", 6).alias("score"))


_POOL = f"""{_FIELDS}, {_ASKED}, parts AS ({_field("body", 1.0)}), pool AS (SELECT qid, id, score, k FROM (SELECT qid, id, sum(part) AS score, row_number() OVER (PARTITION BY qid ORDER BY sum(part) DESC, id) AS k FROM parts GROUP BY qid, id) WHERE k <= 50),
    qt AS (SELECT qid, list(DISTINCT token) AS t FROM q GROUP BY qid)"""
_SHARE = "CASE WHEN len({0}) > 0 THEN len(list_intersect(t, {0})) / len(t) ELSE 0 END"


def _pool(spark, d, *columns):
    fields = cut(S.fields_of(_routines(spark, d, "name", "owner_qn", "body")))
    scored = retrieval.bm25(fields.select("id", "body"), F.col("body"), _counted(spark), "id")
    return cut(retrieval.top_k(scored, 50, ["qid"], tie="id").join(fields.select("id", "symbol", "object", "form", "metadata_type"), "id"))


@query(f"WITH {_POOL} SELECT CAST(qid AS BIGINT) AS qid, id, round(1.0 * {_SHARE.format('symbol')} + 0.6 * {_SHARE.format('object')}, 6) AS boost FROM pool JOIN r USING (id) JOIN qt USING (qid)")
def metadata_boost(spark, d):
    """How much of each query stands in the names of its best fifty candidates."""
    return S.overlap_boost(_pool(spark, d), _asked(spark)).select(F.col("qid").cast("long").alias("qid"), "id", F.round("boost", 6).alias("boost"))


@query(
    f"""WITH {_POOL}, b AS (SELECT qid, id, score, 1.0 * {_SHARE.format("symbol")} + 0.6 * {_SHARE.format("object")} AS boost, 1.0 / k AS inv FROM pool JOIN r USING (id) JOIN qt USING (qid)),
    n AS (SELECT qid, id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS a, coalesce((boost - min(boost) OVER w) / nullif(max(boost) OVER w - min(boost) OVER w, 0), 0) AS b, coalesce((inv - min(inv) OVER w) / nullif(max(inv) OVER w - min(inv) OVER w, 0), 0) AS c FROM b WINDOW w AS (PARTITION BY qid))
    SELECT CAST(qid AS BIGINT) AS qid, id, round((2.0 * a + 1.0 * b + 0.5 * c) / 3.5, 6) AS score FROM n"""
)
def hybrid_blend(spark, d):
    """Weighted mean of three normalised signals over a pool."""
    pool = S.overlap_boost(_pool(spark, d), _asked(spark)).withColumnRenamed("score", "lexical").withColumn("inverse", 1.0 / F.col("rank"))
    return S.blended(pool, {"lexical": 2.0, "boost": 1.0, "inverse": 0.5}).select(F.col("qid").cast("long").alias("qid"), "id", F.round("score", 6).alias("score"))


@query(f"WITH {_POOL} SELECT CAST(qid AS BIGINT) AS qid, round(max(CASE WHEN k = 1 THEN score END) - coalesce(max(CASE WHEN k = 2 THEN score END), 0), 6) AS margin, max(CASE WHEN k = 1 THEN score END) - coalesce(max(CASE WHEN k = 2 THEN score END), 0) >= 0.05 AS confident FROM pool GROUP BY qid")
def confidence_gate(spark, d):
    return S.confident(_pool(spark, d), 0.05).select(F.col("qid").cast("long").alias("qid"), F.round("margin", 6).alias("margin"), "confident")


@query(f"WITH {_POOL}, rest AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS rank FROM pool WHERE k > 10) SELECT CAST(qid AS BIGINT) AS qid, id, CAST(rank AS INTEGER) AS rank FROM rest WHERE rank <= 10")
def cursor_page(spark, d):
    """The second page of ten, the first being excluded by its ids."""
    pool = _pool(spark, d)
    return S.not_shown(pool.select("qid", "id", "rank"), pool.where("rank <= 10"), 10).select(F.col("qid").cast("long").alias("qid"), "id", F.col("rank").cast("int").alias("rank"))


@query(
    f"""WITH {_POOL}, a AS (SELECT qid, id, 0 AS source, k FROM pool WHERE k <= 3), s AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY sum(part) DESC, id) AS k FROM ({_field("symbol", 1.0)}) GROUP BY qid, id),
    u AS (SELECT * FROM a UNION ALL SELECT s.qid, s.id, 1, s.k FROM s ANTI JOIN a ON a.qid = s.qid AND a.id = s.id)
    SELECT CAST(qid AS BIGINT) AS qid, id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source, k, id) AS rank FROM u) WHERE rank <= 8"""
)
def top_up(spark, d):
    """Three results of the first leg, filled up to eight from a second."""
    fields = cut(S.fields_of(_routines(spark, d, "name", "owner_qn", "body")).select("id", "symbol"))
    second = retrieval.bm25(fields, F.col("symbol"), _counted(spark), "id")
    second = second.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return S.topped_up(_pool(spark, d).where("rank <= 3"), second, 8).select(F.col("qid").cast("long").alias("qid"), "id", "source", F.col("rank").cast("int").alias("rank"))


@query()
def fuzzy_names(spark, d):
    """Fuzzy likeness of the queries' words to the names of a pool."""
    return S.fuzzy_scores(_pool(spark, d), _asked(spark)).select("qid", "id", F.round("fuzzy", 6).alias("fuzzy"))


@query()
def tool_search_code(spark, d):
    """Lexical search of code with intent routing."""
    return S.code_search(S.fields_of(_routines(spark, d, "name", "owner_qn", "body")), _ASK).select("qid", "id", F.round("score", 6).alias("score"))


_UNITS = "SELECT DISTINCT routine_id, part_index, body_hash, CAST(size_chars AS DOUBLE) / 1000 AS score FROM routine_code_unit"


@query(
    f"""WITH u AS ({_UNITS}), live AS (SELECT id AS routine_id, body_hash FROM {ROU} WHERE id NOT IN (SELECT routine_id FROM routine_code_unit WHERE index_epoch = 2)), f AS (SELECT DISTINCT routine_id, part_index, score FROM u JOIN live USING (routine_id, body_hash))
    SELECT 1 AS qid, routine_id AS routine, round(max(score), 6) AS score, array_to_string(list_sort(list(DISTINCT part_index)), ',') AS parts FROM f GROUP BY routine_id"""
)
def materialised_results(spark, d):
    """Fragments by routine: those of outdated bodies and of routines under change are hidden."""
    u = table(spark, d, "routine_code_unit")
    fragments = u.select(F.lit(1).alias("qid"), F.col("routine_id").alias("routine"), F.col("part_index").alias("part"), (F.col("size_chars").cast("double") / 1000).alias("score"), "body_hash")
    current = _routines(spark, d, "body_hash").select(F.col("id").alias("routine"), "body_hash")
    pending = u.where("index_epoch = 2").select(F.col("routine_id").alias("routine"))
    rows = S.materialised(fragments, pending, current)
    return rows.select("qid", "routine", F.round("score", 6).alias("score"), F.array_join(F.transform("parts", lambda p: p.cast("string")), ",").alias("parts"))


_SUM = "WITH o AS (SELECT object_qn, coalesce(object_summary, '') AS text FROM " + K.OBJ + ")"


@query(
    f"""{_SUM}, r AS (SELECT object_qn AS id, {K._sql_tokens("text")} AS body FROM o), q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest(t) AS token FROM ({" UNION ALL ".join(f"SELECT {i} AS qid, {K._sql_tokens(repr(t))} AS t" for i, t in K.QUERIES.items())})) GROUP BY ALL), parts AS ({_field("body", 1.0)}),
    l AS (SELECT qid, id, sum(part) AS score FROM parts GROUP BY qid, id), n AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) AS norm FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS k FROM l) WHERE k <= 50)
    SELECT CAST(qid AS BIGINT) AS qid, id AS object_qn, round(0.7 * norm, 6) AS score FROM n"""
)
def tool_objects_by_summary(spark, d):
    """Objects by their summaries: the lexical leg of a weighted search whose vector leg found nothing."""
    o = R.current_rows(table(spark, d, "metadata_object"), "object_qn", ["object_summary"]).select(F.col("object_qn").alias("id"), F.coalesce("object_summary", F.lit("")).alias("text"))
    scored = retrieval.bm25(o, X.tokens(F.col("text")), K._query_tokens(spark), "id")
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    pool = cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 50))
    lex = retrieval.max_norm(pool, ["qid"]).select("qid", "id", "norm")
    fused = retrieval.fuse_weighted(lex, lex.where("false"), ["qid", "id"], 0.3)
    return fused.select(F.col("qid").cast("long").alias("qid"), F.col("id").alias("object_qn"), F.round("score", 6).alias("score"))
