"""Queries of the text functions and the remaining aggregates, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import chunks
from graphloom.functions import predicates as P
from graphloom.functions import text as X
from graphloom.operators import incremental as I
from graphloom.operators import model as M
from graphloom.operators import relations as R
from graphloom.operators import retrieval
from graphloom.plans import catalog as K
from graphloom.plans import model_queries as MQ
from graphloom.plans.session import cut
from graphloom.sources.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ROU, OBJ = K.ROU, K.OBJ


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


def _r(spark, d, *columns):
    return R.current_rows(table(spark, d, "routine"), "id", list(columns))


# --- words

_SYN = {"остатки": ["остаток", "наличие"], "сравнить": ["сверить"], "загрузить": ["импорт", "сравнить"]}


@query(
    f"""WITH t AS (SELECT id, {K._sql_tokens("name")} AS t FROM {ROU}), s AS (SELECT id, t, list_filter(flatten(list_transform(t, lambda w: CASE w WHEN 'остатки' THEN ['остаток', 'наличие'] WHEN 'сравнить' THEN ['сверить'] WHEN 'загрузить' THEN ['импорт', 'сравнить'] ELSE [] END)), lambda x: NOT list_contains(t, x)) AS more FROM t)
    SELECT id, array_to_string(list_concat(t, flatten(list_transform(more, lambda x: [x, x]))), ' ') AS words FROM s"""
)
def synonym_expand(spark, d):
    """Names' tokens with their synonyms, twice each."""
    return _r(spark, d, "name").select("id", F.array_join(X.synonym_tokens(X.tokens(F.col("name")), _SYN, 2), " ").alias("words"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(trim(coalesce(text, ''), ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: lower(trim(translate(w, '"''()[]{}:^*+-', '             '), ' '))), lambda w: length(w) >= 3), ' ') AS words FROM documents""")
def fts_words(spark, d):
    """Every document as terms of a full-text query, repeated ones and all."""
    bare = F.transform(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.lower(F.trim(F.translate(w, "\"'()[]{}:^*+-", " " * 13))))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(bare, lambda w: F.length(w) >= 3), " ").alias("words"))


@query(f"SELECT object_qn, regexp_replace(object_summary, '([+\\-!(){{}}\\[\\]^\"~*?:\\\\/&|])', '\\\\\\1', 'g') AS safe FROM {OBJ}")
def escaped_text(spark, d):
    """Summaries with all operators of a query parser escaped."""
    return K._objects(spark, d, "object_summary").select("object_qn", F.regexp_replace("object_summary", r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1").alias("safe"))


@query(f"SELECT id FROM {ROU} WHERE contains(lower(body), 'начисления')")
def substring_search(spark, d):
    """Bodies that contain a text: those that have all its runs of three characters, then verified."""
    needle = "начисления"
    wanted = {needle[i : i + 3] for i in range(len(needle) - 2)}
    rows = _r(spark, d, "body")
    narrowed = F.lit(True)
    for part in sorted(wanted):
        narrowed = narrowed & F.lower("body").contains(part)
    return rows.where(narrowed).where(P.matches(F.col("body"), needle, "contains")).select("id")


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[\"''«“](.+?)[\"''»”]', 1), '|') AS phrases FROM documents WHERE text IS NOT NULL")
def quoted_phrases(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.quoted(F.col("text")), "|").alias("phrases"))


@query(f"SELECT id, round(len(list_intersect(list_distinct(a), b)) / greatest(len(list_distinct(a)), 1), 6) AS share FROM (SELECT id, {K._sql_tokens('name')} AS a, {K._sql_tokens('''coalesce(body, '')''')} AS b FROM {ROU}) WHERE len(a) > 0")
def token_overlap(spark, d):
    """The share of a name's tokens that its body has."""
    rows = _r(spark, d, "name", "body").select("id", X.tokens(F.col("name")).alias("a"), X.tokens(F.coalesce("body", F.lit(""))).alias("b"))
    return rows.where(F.size("a") > 0).select("id", F.round(X.overlap(F.col("a"), F.col("b")), 6).alias("share"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(replace(body, chr(13), chr(10)), '(^|\\n)[ \\t]*([A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*)[ \\t]*=', 2))), ',') AS names FROM {ROU} WHERE body IS NOT NULL")
def assigned_names(spark, d):
    """Names that a body assigns at the start of a line."""
    return _r(spark, d, "body").where("body is not null").select("id", F.array_join(F.array_sort(F.array_distinct(X.assigned_names(F.col("body")))), ",").alias("names"))


@query(f"SELECT id, array_to_string(list_filter(regexp_extract_all(body, '\"([^\"\\r\\n]{{3,160}})\"', 1), lambda s: regexp_matches(s, '[A-Za-zА-Яа-яЁё]')), '|') AS literals FROM {ROU} WHERE body IS NOT NULL")
def string_literals(spark, d):
    return _r(spark, d, "body").where("body is not null").select("id", F.array_join(X.string_literals(F.col("body")), "|").alias("literals"))


_SRC = K._sql_current("module_source", "module_id")


@query(
    rf"""SELECT module_id, array_to_string(regexp_extract_all(t, '(?im)^[ \t]*#(?:область|region)[ \t]+([\p{{L}}_][\p{{L}}\p{{N}}_]*)', 1), ',') AS regions, len(regexp_extract_all(t, '//[ \t]*([^\r\n]*)', 1)) AS comments,
    array_to_string(regexp_extract_all(t, '(?m)^[ \t]*(&[\p{{L}}]+)', 1), ',') AS directives FROM (SELECT module_id, replace(source_text, chr(13), chr(10)) AS t FROM {_SRC}) WHERE t IS NOT NULL"""
)
def module_segments(spark, d):
    """Regions, comments and directives of every module."""
    m = R.current_rows(table(spark, d, "module_source"), "module_id", ["source_text"]).where("source_text is not null")
    s = m.select("module_id", X.segments(F.replace("source_text", F.lit("\r"), F.lit("\n"))).alias("s"))
    return s.select("module_id", F.array_join("s.regions", ",").alias("regions"), F.size("s.comments").cast("long").alias("comments"), F.array_join("s.directives", ",").alias("directives"))


@query(f"SELECT id, trim(concat_ws(' ', CASE WHEN trim(name) <> '' THEN name || ' ' || name || ' ' || name END, CASE WHEN trim(doc_description) <> '' THEN doc_description || ' ' || doc_description END), ' ') AS text FROM {ROU}")
def weighted_text(spark, d):
    """Names three times and descriptions twice as one search text."""
    return _r(spark, d, "name", "doc_description").select("id", F.trim(X.weighted_text([(F.col("name"), 3), (F.col("doc_description"), 2)])).alias("text"))


@query(f"SELECT id, '//' || split_part(owner_qn, '/', 3) || '.' || split_part(owner_qn, '/', 4) || chr(10) || '//' || name || chr(10) AS prefix FROM {ROU} WHERE owner_qn IS NOT NULL AND len(string_split(owner_qn, '/')) = 4")
def context_prefix(spark, d):
    rows = _r(spark, d, "name", "owner_qn").where(F.size(F.split("owner_qn", "/")) == 4).select("id", "name", X.owner_parts(F.col("owner_qn")).alias("o"))
    return rows.select("id", X.context_prefix(F.col("o.type"), F.col("o.object"), F.col("o.form"), F.col("name")).alias("prefix"))


@query(f"SELECT id, len(string_split(body, chr(10))) AS lines, len(regexp_extract_all(b, '(?i)(^|[^\\p{{L}}\\p{{N}}_.])(если|иначеесли|if|elsif)([^\\p{{L}}\\p{{N}}_]|$)')) AS branches, len(regexp_extract_all(b, '(?i)(^|[^\\p{{L}}\\p{{N}}_.])(возврат|return)([^\\p{{L}}\\p{{N}}_]|$)')) AS returns FROM (SELECT id, body, regexp_replace(body, '\"(?:[^\"]|\"\")*\"|//[^\\r\\n]*', '', 'g') AS b FROM {ROU} WHERE body <> '')")
def code_facts(spark, d):
    """Lines, branches and returns of every body."""
    rows = _r(spark, d, "body").where("body <> ''").select("id", X.code_facts(F.col("body")).alias("f"))
    return rows.select("id", F.col("f.lines").cast("long").alias("lines"), F.col("f.branches").cast("long").alias("branches"), F.col("f.returns").cast("long").alias("returns"))


@query(f"SELECT id, CAST(len(ps) AS INTEGER) AS n, CAST(len(list_filter(ps, lambda p: contains(p, '='))) AS INTEGER) AS optional FROM (SELECT id, list_filter(list_transform(string_split(regexp_replace(coalesce(params_text, ''), '\"[^\"]*\"', 's', 'g'), ','), lambda p: trim(p)), lambda p: p <> '') AS ps FROM {ROU})")
def split_params(spark, d):
    """Numbers of parameters and of those with a default."""
    rows = _r(spark, d, "params_text").select("id", X.split_params(F.coalesce("params_text", F.lit(""))).alias("ps"))
    return rows.select("id", F.size("ps").alias("n"), F.size(F.filter("ps", lambda p: X.param_facts(p)["default"].isNotNull())).alias("optional"))


@query(f"SELECT object_qn, name, array_to_string(list_transform(types, lambda t: CASE split_part(t, '.', 1) WHEN 'Число' THEN 'Ч' WHEN 'Строка' THEN 'С' WHEN 'Дата' THEN 'Д' WHEN 'Булево' THEN 'Б' WHEN 'СправочникСсылка' THEN 'СС' WHEN 'ДокументСсылка' THEN 'ДС' WHEN 'ПеречислениеСсылка' THEN 'ПС' WHEN 'ОпределяемыйТип' THEN 'ОТ' ELSE split_part(t, '.', 1) END || CASE WHEN contains(t, '.') THEN '.' || split_part(t, '.', 2) ELSE '' END), '|') AS short FROM el WHERE kind = 'attribute'".join((MQ._E + " ", "")))
def short_types(spark, d):
    """Types of all attributes in short form."""
    e = M.elements(MQ._objects(spark, d)).where("kind = 'attribute'")
    return e.select("object_qn", "name", F.array_join(F.transform("types", X.short_type), "|").alias("short"))


@query()
def short_unions(spark, d):
    """The types of each object's attributes as one short text."""
    e = M.elements(MQ._objects(spark, d)).where("kind = 'attribute'")
    return e.groupBy("object_qn").agg(X.short_union(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types"))))).alias("short"))


@query(
    rf"""{MQ._E}, n AS (SELECT object_qn, regexp_extract(name, '^(\D*)\d+', 1) AS prefix, CAST(regexp_extract(name, '\d+') AS BIGINT) AS i, regexp_extract(name, '\d+(\D*)$', 1) AS suffix FROM el WHERE kind = 'attribute' AND len(regexp_extract_all(name, '\d+')) = 1),
    g AS (SELECT object_qn, prefix, suffix, i, i - row_number() OVER (PARTITION BY object_qn, prefix, suffix ORDER BY i) AS run FROM (SELECT DISTINCT * FROM n)), s AS (SELECT object_qn, prefix, suffix, min(i) AS a, max(i) AS b FROM g GROUP BY object_qn, prefix, suffix, run)
    SELECT object_qn, prefix || '[' || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '..' || b END, '|' ORDER BY a) || ']' || suffix AS series FROM s GROUP BY object_qn, prefix, suffix"""
)
def name_series(spark, d):
    """Attributes whose names differ by a number only, as one name with ranges."""
    e = M.elements(MQ._objects(spark, d)).where("kind = 'attribute'").select("object_qn", X.numbered(F.col("name")).alias("p")).where("p is not null")
    group = ["object_qn", "prefix", "suffix"]
    runs = R.number_runs(e.select("object_qn", "p.prefix", "p.suffix", "p.number"), group, "number")
    return R.runs_text(runs, group, "r").select("object_qn", F.concat("prefix", F.lit("["), "r", F.lit("]"), "suffix").alias("series"))


@query(f"SELECT object_qn, a = b AND a <> '' AS redundant FROM (SELECT object_qn, lower(translate(regexp_replace(coalesce(object_name, ''), '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g'), 'ёЁ', 'еЕ')) AS a, lower(translate(regexp_replace(coalesce(json_extract_string(j, '$.properties.\"Синоним\"'), ''), '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g'), 'ёЁ', 'еЕ')) AS b FROM m)".join((MQ._M + " ", "")))
def redundant_synonyms(spark, d):
    """Whether each object's synonym only repeats its name."""
    return MQ._objects(spark, d).select("object_qn", X.same_words(F.col("object_name"), F.element_at("model.properties", "Синоним")).alias("redundant"))


@query(f"SELECT category_name, c FROM (SELECT DISTINCT category_name, unnest([category_name, upper(category_name), lower(category_name)]) AS c FROM {OBJ}) WHERE category_name IS NOT NULL")
def canonical_categories(spark, d):
    """Categories by names in any case: each name leads to its category."""
    known = spark.createDataFrame([(n.lower(), c) for c in P.CATEGORY_NAMES for n in (c, *P.CATEGORY_NAMES[c])], "k string, c string")
    o = K._objects(spark, d, "category_name").where("category_name is not null").select("category_name").distinct()
    asked = o.select("category_name", F.explode(F.array("category_name", F.upper("category_name"), F.lower("category_name"))).alias("n")).distinct()
    return asked.join(F.broadcast(known), F.lower("n") == F.col("k")).select(F.col("c").alias("category_name"), F.col("n").alias("c"))


@query()
def text_chunks(spark, d):
    """Every document in overlapping chunks at natural boundaries."""
    return chunks.chunked(table(spark, d, "documents"), "doc_id", "text", 600, 80).drop("chunk")


# --- aggregates


@query(f"SELECT owner_qn, max(score) AS score FROM (SELECT owner_qn, length(name) AS score FROM {ROU} UNION ALL SELECT object_qn, 2 * length(obj_name) FROM {OBJ}) WHERE owner_qn IS NOT NULL GROUP BY owner_qn")
def best_of_union(spark, d):
    """The best score of each node over two branches."""
    a = _r(spark, d, "owner_qn", "name").select("owner_qn", F.length("name").cast("long").alias("score"))
    b = K._objects(spark, d, "obj_name").select(F.col("object_qn").alias("owner_qn"), (2 * F.length("obj_name")).cast("long").alias("score"))
    return a.unionByName(b).where("owner_qn is not null").groupBy("owner_qn").agg(F.max("score").alias("score"))


@query(f"SELECT file_path, string_agg(name, ' ' ORDER BY line_no, id) AS names, string_agg(coalesce(doc_description, ''), ' ' ORDER BY line_no, id) AS docs FROM {ROU} WHERE file_path IS NOT NULL GROUP BY file_path")
def module_text(spark, d):
    """Columns of each file's routines as one text each, in the order of lines."""
    rows = _r(spark, d, "file_path", "name", "doc_description", "line_no").where("file_path is not null")
    one = F.array_sort(F.collect_list(F.struct(F.coalesce("line_no", F.lit(2**31 - 1)).alias("line_no"), "id", "name", F.coalesce("doc_description", F.lit("")).alias("doc"))))
    return rows.groupBy("file_path").agg(one.alias("r")).select("file_path", F.array_join("r.name", " ").alias("names"), F.array_join("r.doc", " ").alias("docs"))


@query(f"{MQ._EDGES} SELECT src, rel, count(*) AS n, array_to_string(list_sort(list(dst))[1:3], ',') AS shown FROM ed GROUP BY src, rel")
def grouped_relations(spark, d):
    """The relations of each node with their number and the first three targets, ranked before they are collected."""
    e = MQ._edges(spark, d)
    first = R.first_of_each(e, ["src", "rel"], [F.col("dst")], 3).groupBy("src", "rel").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("shown"))
    return e.groupBy("src", "rel").agg(F.count(F.lit(1)).alias("n")).join(first, ["src", "rel"])


@query(f"SELECT id, kind, rank FROM (SELECT id, kind, row_number() OVER (PARTITION BY owner_qn ORDER BY p DESC, name, id) AS rank, p FROM (SELECT id, owner_qn, name, routine_type AS kind, is_export AS p FROM {ROU})) WHERE p OR rank <= 3")
def protected_first(spark, d):
    """Exported routines of each owner, all of them, and others up to three in all."""
    rows = _r(spark, d, "owner_qn", "name", "routine_type", "is_export")
    kept = I.first_matches(rows, ["owner_qn"], F.col("is_export"), F.col("name"), 3, "id")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("owner_qn").orderBy(F.col("is_export").desc(), "name", "id")))
    return ranked.select("id", F.col("routine_type").alias("kind"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {K._BM_CTE} SELECT CAST(qid AS BIGINT) AS qid, doc_id, round(1.0 / rank, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= 50")
def inverse_ranks(spark, d):
    """One by the rank of the best fifty of each query."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = K._lexical(spark, d).withColumn("rank", F.row_number().over(order)).where("rank <= 50")
    return ranked.select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round(1.0 / F.col("rank"), 9).alias("score"))


@query(f"WITH {K._BM_CTE} SELECT CAST(qid AS BIGINT) AS qid, doc_id, round(CASE WHEN max(score) OVER w > 1 THEN score / max(score) OVER w ELSE score END, 6) AS score FROM bm WINDOW w AS (PARTITION BY qid)")
def capped_scores(spark, d):
    """Scores divided by the best of their query where that exceeds one."""
    scored = cut(K._lexical(spark, d))
    top = retrieval.small(retrieval.leg_spans(scored, ["qid"]))
    capped = F.when(F.col("high") > 1, F.col("score") / F.col("high")).otherwise(F.col("score"))
    return scored.join(top, "qid").select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round(capped, 6).alias("score"))


@query(
    f"""WITH {K._BM_CTE}, r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm), g AS (SELECT qid, doc_id FROM bm WHERE doc_id % 7 = 0), need AS (SELECT qid, count(*) AS n FROM g GROUP BY qid),
    k AS (SELECT unnest([5, 50, 200]) AS k), got AS (SELECT k, need.qid, n, (SELECT count(*) FROM r JOIN g USING (qid, doc_id) WHERE r.qid = need.qid AND rank <= k) AS c FROM need CROSS JOIN k)
    SELECT CAST(k AS BIGINT) AS k, round(avg(c / n), 6) AS coverage, round(avg(CASE WHEN c > 0 THEN 1 ELSE 0 END), 6) AS hit FROM got GROUP BY k"""
)
def retrieval_metrics(spark, d):
    """Coverage and hits of a lexical search at three depths; as answers count the found documents whose number divides by seven."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = cut(K._lexical(spark, d).withColumn("rank", F.row_number().over(order)))
    q = retrieval.quality(ranked, ranked.where("doc_id % 7 = 0"), [5, 50, 200])
    return q.select("k", F.round("coverage", 6).alias("coverage"), F.round("hit", 6).alias("hit"))


@query(
    f"""WITH h AS ({K._UNIT}), x AS (SELECT routine_id, part, score, substring(routine_id, 1, 1) AS q FROM h), ps AS (SELECT q, routine_id, max(score) + 0.02 * count(*) + 0.3 * list_avg(list_sort(list(score), 'DESC')[1:3]) AS parent_score FROM x GROUP BY q, routine_id),
    p AS (SELECT q, routine_id, row_number() OVER (PARTITION BY q ORDER BY round(parent_score, 9) DESC, routine_id) AS p FROM ps), r AS (SELECT x.*, p, row_number() OVER (PARTITION BY x.q, x.routine_id ORDER BY score DESC, part) AS k FROM x JOIN p USING (q, routine_id)),
    f AS (SELECT *, CASE WHEN p <= 3 AND k <= [2, 2, 1][p] THEN 0 ELSE 1 END AS first FROM r) SELECT q, slot, routine_id, part FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first, CASE WHEN first = 0 THEN p END NULLS FIRST, score DESC, routine_id, part) AS slot FROM f) WHERE slot <= 8"""
)
def slot_quota(spark, d):
    """Two, two and one part of the three best routines of each query (first letters stand for them), then the best of the rest up to eight."""
    hits = K._hits(spark, d).withColumn("q", F.substring("routine_id", 1, 1))
    parents = retrieval.parent_scores(hits, "routine_id").select("routine_id", F.round("score", 9).alias("parent_score"))
    filled = retrieval.slots(hits.join(parents, "routine_id"), ["q"], "routine_id", (2, 2, 1), 8)
    return filled.select("q", F.col("slot").cast("long").alias("slot"), "routine_id", "part")
