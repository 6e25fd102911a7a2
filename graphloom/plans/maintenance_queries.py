"""Queries of sources, sinks, incremental maintenance and streams, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.functions import text as X
from graphloom.operators import calls as C
from graphloom.operators import graph, retrieval
from graphloom.operators import incremental as I
from graphloom.operators import model as M
from graphloom.operators import relations as R
from graphloom.operators import sinks
from graphloom.plans import catalog as K
from graphloom.plans import model_queries as MQ
from graphloom.plans import routine_queries as RQ
from graphloom.plans.session import checkpoint_dir, cut
from graphloom.sources import code, reports, xml_files
from graphloom.sources.tables import table
from graphloom.streaming import maintain

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


# --- sources

_HIDDEN = r"regexp_replace(source_text, '\"(?:[^\"]|\"\")*\"?|//[^\r\n]*', ' ', 'g')"
_MOD = K._sql_current("module_source", "module_id")


@query(rf"SELECT module_id, array_to_string(regexp_extract_all({_HIDDEN}, '(?i)(?:процедура|функция|procedure|function)\s+([\p{{L}}_][\p{{L}}\p{{N}}_]*)\s*\(', 1), ',') AS names FROM {_MOD} WHERE regexp_matches({_HIDDEN}, '(?i)(?:процедура|функция|procedure|function)\s+([\p{{L}}_][\p{{L}}\p{{N}}_]*)\s*\(')")
def code_scan(spark, d):
    """The routines of every module in order, from its text."""
    m = R.current_rows(table(spark, d, "module_source"), "module_id", ["source_text"])
    found = code.modules(m, "module_id", "source_text")
    return found.groupBy(F.col("module").alias("module_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.length("body").alias("n"), "name"))), lambda r: r["name"]), ",").alias("names"))


@query()
def code_scan_full(spark, d):
    """Headers, parameters, directives, regions, comments and hashes of every routine of every module."""
    m = R.current_rows(table(spark, d, "module_source"), "module_id", ["source_text"])
    return code.modules(m, "module_id", "source_text").drop("body")


def _xml(objects: DataFrame) -> DataFrame:
    """(path, text): descriptors of the objects, written as XML."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    kinds = lambda p: F.concat(F.lit("<Type>"), F.array_join(F.transform(M.types_of(p), lambda t: F.concat(F.lit("<v8:Type>cfg:"), safe(t), F.lit("</v8:Type>"))), ""), F.lit("</Type>"))
    item = lambda tag, e, more: F.concat(F.lit(f"<{tag}><Properties><Name>"), safe(e["name"]), F.lit("</Name>"), kinds(e["properties"]), F.lit("</Properties>"), more, F.lit(f"</{tag}>"))
    all_of = lambda tag, items: F.coalesce(F.array_join(F.transform(items, lambda e: item(tag, e, F.lit(""))), ""), F.lit(""))
    parts = F.coalesce(F.array_join(F.transform("model.tabular_parts", lambda p: item("TabularSection", p, F.concat(F.lit("<ChildObjects>"), all_of("Attribute", p["attributes"]), F.lit("</ChildObjects>")))), ""), F.lit(""))
    head = '<?xml version="1.0" encoding="UTF-8"?><MetaDataObject xmlns="urn:m" xmlns:v8="urn:v8"><Catalog><Properties><Name>'
    text = F.concat(F.lit(head), safe(F.col("object_name")), F.lit("</Name></Properties><ChildObjects>"), all_of("Attribute", F.col("model.attributes")), parts, all_of("Form", F.col("model.forms")), F.lit("</ChildObjects></Catalog></MetaDataObject>"))
    return objects.where("model is not null").select(F.col("object_qn").alias("path"), text.alias("text"))


@query(f"{MQ._E} SELECT object_qn, kind, container, name, array_to_string(types, '|') AS types FROM el")
def xml_descriptor_scan(spark, d):
    """The elements of all objects from descriptors written for them: the same as the snapshots hold."""
    found = xml_files.descriptors(_xml(MQ._objects(spark, d))).where("kind <> 'property'")
    return found.select(F.col("path").alias("object_qn"), "kind", "container", "name", F.array_join("types", "|").alias("types"))


@query(f"{MQ._E} SELECT object_qn, name, array_to_string(types, chr(10)) AS types FROM el WHERE kind = 'attribute'")
def txt_report_scan(spark, d):
    """Attributes and their types from indented reports written for all objects; a type after the first stands on a deeper line."""
    line = lambda e: F.concat(F.lit("\t\t- Реквизиты."), e["name"], F.lit('\n\t\t\tТип: "'), F.array_join(M.types_of(e["properties"]), '"\n\t\t\t\t"'), F.lit('"\n\t\t\tСиноним: "x"\n'))
    text = F.concat(F.lit("- Конфигурации.X\n\t- "), "category", F.lit("."), "object_name", F.lit("\n"), F.array_join(F.transform("model.attributes", line), ""))
    files = MQ._objects(spark, d).where("model.attributes is not null").select(F.col("object_qn").alias("path"), text.alias("text"))
    rows = cut(reports.reports(files))
    items = rows.where("item is not null").select("path", F.col("line").alias("parent"), F.substring_index("item", ".", -1).alias("name"))
    props = rows.where("key = 'Тип'").select("path", "parent", F.coalesce("value", F.lit("")).alias("types"))
    return props.join(items, ["path", "parent"]).select(F.col("path").alias("object_qn"), "name", "types")


# --- dependency paths over several families

_DEP = f"""WITH RECURSIVE {MQ._U.removeprefix("WITH ")}, {K._CALLS}, o AS (SELECT project, category, object_name, object_qn FROM m),
    e AS (SELECT DISTINCT us.object_qn AS src, o.object_qn AS dst, 'USED_IN' AS rel FROM us JOIN o ON o.project = split_part(us.object_qn, '/', 1) AND o.category = us.target_category AND o.object_name = us.target_name WHERE us.object_qn <> o.object_qn
        UNION SELECT a.owner_qn, b.owner_qn, 'CALLS' FROM calls JOIN r a ON a.id = calls.caller JOIN r b ON b.id = calls.callee WHERE a.owner_qn <> b.owner_qn
        UNION SELECT owner_qn, id, 'HAS_ROUTINE' FROM r WHERE owner_qn IS NOT NULL UNION SELECT caller, callee, 'CALLS' FROM calls),
    s AS (SELECT src, dst, rel FROM e UNION ALL SELECT dst, src, '^' || rel FROM e),
    w AS (SELECT src AS start, [src] AS nodes, src AS text FROM (SELECT DISTINCT src FROM s) UNION ALL SELECT w.start, list_append(w.nodes, s.dst), w.text || ' -[' || s.rel || ']-> ' || s.dst FROM w JOIN s ON s.src = w.nodes[-1] WHERE len(w.nodes) < 3 AND NOT list_contains(w.nodes, s.dst))"""


@query(f"{_DEP} SELECT rels, count(*) AS paths, count(DISTINCT start) AS starts FROM (SELECT DISTINCT start, text, array_to_string(list_sort(regexp_extract_all(text, '-\\[([^\\]]*)\\]', 1)), ',') AS rels FROM w WHERE len(nodes) > 1) GROUP BY rels")
def tool_dependency_paths(spark, d):
    """Paths of up to two hops both ways from everything, over use by type, calls and owners, counted by their relations."""
    o = cut(MQ._objects(spark, d))
    u = M.usages(M.elements(o)).withColumn("project", F.get(F.split("object_qn", "/"), F.lit(0)))
    target = o.select(F.col("object_qn").alias("dst"), "project", F.col("category").alias("target_category"), F.col("object_name").alias("target_name"))
    used = u.join(target, ["project", "target_category", "target_name"]).select(F.col("object_qn").alias("src"), "dst", F.lit("USED_IN").alias("rel"))
    r = cut(K._routines(spark, d, "owner_qn"))
    calls = cut(K._calls(spark, d)).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("rel"))
    own = calls.join(r.select(F.col("id").alias("src"), F.col("owner_qn").alias("a")), "src").join(r.select(F.col("id").alias("dst"), F.col("owner_qn").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel")
    has = r.where("owner_qn is not null").select(F.col("owner_qn").alias("src"), F.col("id").alias("dst"), F.lit("HAS_ROUTINE").alias("rel"))
    edges = cut(used.unionByName(own).unionByName(has).unionByName(calls).where("src <> dst").distinct())
    starts = edges.select(F.col("src").alias("start")).union(edges.select("dst"))
    walked = graph.trails(graph.directed(edges, "both"), starts, 2)
    signed = walked.select("start", graph.signature(F.col("nodes"), F.col("rels")).alias("path"), F.array_join(F.array_sort("rels"), ",").alias("rels")).distinct()
    return signed.groupBy("rels").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("start").alias("starts"))


_BRIDGE = f"""WITH RECURSIVE {MQ._U.removeprefix("WITH ")}, {K._CALLS}, o AS (SELECT project, category, object_name, object_qn FROM m),
    e AS (SELECT DISTINCT us.object_qn AS src, o.object_qn AS dst, 'USED_IN' AS rel FROM us JOIN o ON o.project = split_part(us.object_qn, '/', 1) AND o.category = us.target_category AND o.object_name = us.target_name WHERE us.object_qn <> o.object_qn
        UNION SELECT caller, callee, 'CALLS' FROM calls UNION SELECT owner_qn, callee, 'OWNS_CALL' FROM calls JOIN r ON r.id = calls.caller WHERE owner_qn IS NOT NULL),
    ow AS (SELECT id AS element, owner_qn AS owner FROM r WHERE owner_qn IS NOT NULL), ways AS (SELECT unnest([0, 1]) AS way),
    w AS (SELECT src AS start, src AS node, [src] AS nodes, src AS path, 0 AS depth, 0 AS way FROM (SELECT DISTINCT src FROM e)
        UNION ALL SELECT w.start, CASE WHEN ways.way = 1 THEN ow.owner ELSE e.dst END, CASE WHEN ways.way = 1 THEN list_append(list_append(w.nodes, e.dst), ow.owner) ELSE list_append(w.nodes, e.dst) END,
            w.path || ' -[' || e.rel || ']-> ' || e.dst || CASE WHEN ways.way = 1 THEN ' => ' || ow.owner ELSE '' END, w.depth + 1, ways.way
        FROM w JOIN e ON e.src = w.node CROSS JOIN ways LEFT JOIN ow ON ow.element = e.dst WHERE w.depth < 3 AND NOT list_contains(w.nodes, e.dst) AND (ways.way = 0 OR (ow.owner IS NOT NULL AND NOT list_contains(w.nodes, ow.owner))))"""


@query(f'{_BRIDGE} SELECT DISTINCT start, node AS "end", CAST(depth AS BIGINT) AS depth, path FROM w WHERE depth > 0 AND way = 0')
def bridged_paths(spark, d):
    """Paths of up to three hops from everything that uses or calls; a routine hands over to its owner for free."""
    o = cut(MQ._objects(spark, d))
    u = M.usages(M.elements(o)).withColumn("project", F.get(F.split("object_qn", "/"), F.lit(0)))
    target = o.select(F.col("object_qn").alias("dst"), "project", F.col("category").alias("target_category"), F.col("object_name").alias("target_name"))
    used = u.join(target, ["project", "target_category", "target_name"]).select(F.col("object_qn").alias("src"), "dst", F.lit("USED_IN").alias("rel")).where("src <> dst")
    r = cut(K._routines(spark, d, "owner_qn"))
    calls = cut(K._calls(spark, d)).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("rel"))
    owned = calls.join(r.select(F.col("id").alias("src"), "owner_qn"), "src").where("owner_qn is not null").select(F.col("owner_qn").alias("src"), "dst", F.lit("OWNS_CALL").alias("rel"))
    edges = cut(used.unionByName(calls).unionByName(owned).distinct())
    owners = r.where("owner_qn is not null").select(F.col("id").alias("element"), F.col("owner_qn").alias("owner"), F.lit(True).alias("itself"))
    found = graph.bridged_paths(edges, edges.select(F.col("src").alias("start")), owners, 3)
    return found.select("start", "end", F.col("depth").cast("long").alias("depth"), "path")


# --- sinks


@query(
    """WITH n AS (SELECT object_qn, loaded_at, obj_name, category_name, object_summary, config_name FROM metadata_object WHERE loaded_at IS NOT NULL),
    f AS (SELECT object_qn, arg_min(obj_name, loaded_at) AS obj_name FROM n GROUP BY object_qn), p AS (SELECT object_qn, unnest(['config', 'summary']) AS k, unnest([config_name, object_summary]) AS v, loaded_at FROM n),
    l AS (SELECT object_qn, k, v FROM (SELECT *, row_number() OVER (PARTITION BY object_qn, k ORDER BY loaded_at DESC) AS i FROM p) WHERE i = 1 AND v IS NOT NULL)
    SELECT f.object_qn, obj_name, coalesce((SELECT string_agg(k || '=' || v, ';' ORDER BY k) FROM l WHERE l.object_qn = f.object_qn), '') AS properties FROM f"""
)
def merge_nodes(spark, d):
    """All deliveries of objects written one after another: names as first made, properties as last written, null ones removed."""
    rows = table(spark, d, "metadata_object").where("loaded_at is not null")
    new = rows.select("object_qn", "obj_name", F.create_map(F.lit("summary"), "object_summary", F.lit("config"), "config_name").alias("properties"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("ord"))
    merged = sinks.merged_nodes(new.where("false").drop("ord"), new, "object_qn", ["obj_name"])
    shown = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return merged.select("object_qn", "obj_name", shown.alias("properties"))


@query(f"SELECT DISTINCT c.parent_qn AS src, c.child_qn AS dst FROM child_rel c WHERE c.parent_qn IN (SELECT child_qn FROM child_rel WHERE child_qn IS NOT NULL) AND c.child_qn IS NOT NULL")
def upsert_edges(spark, d):
    """Links whose both ends are there, once each; links without an end are not written."""
    e = table(spark, d, "child_rel").select(F.col("parent_qn").alias("src"), F.col("child_qn").alias("dst"))
    return R.upsert_edges(e, e.where("dst is not null").select(F.col("dst").alias("id")).distinct(), ["src", "dst"])


@query("SELECT project_name, count(*) AS n FROM child_rel WHERE NOT coalesce(starts_with(child_qn, 'sklad_main/') , false) GROUP BY project_name")
def delete_scope(spark, d):
    """What is left of the links after a project is deleted."""
    left = R.delete_scope(table(spark, d, "child_rel").select("child_qn", "project_name"), F.col("child_qn").startswith("sklad_main/"))
    return left.groupBy("project_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id % 3 AS provider, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def usage_totals(spark, d):
    """Counters by event and provider: those of even events, then the rest added."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("provider"), "event_id", F.lit(1).cast("long").alias("events"), F.col("value").alias("total"))
    first = e.where("event_id % 2 = 0").groupBy("event_type", "provider").agg(F.sum("events").alias("events"), F.sum("total").alias("total"))
    both = sinks.accumulated(first, e.where("event_id % 2 = 1"), ["event_type", "provider"], ["events", "total"])
    return both.select("event_type", "provider", "events", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT unit_id, CASE WHEN part_total > 1 THEN printf('%s#unit:%04d/%04d', routine_id, part_index + 1, part_total) ELSE routine_id END AS made FROM routine_code_unit")
def unit_ids(spark, d):
    return table(spark, d, "routine_code_unit").select("unit_id", sinks.unit_id(F.col("routine_id"), F.col("part_index"), F.col("part_total")).alias("made")).distinct()


@query()
def hashed_vectors(spark, d):
    """Deterministic vectors of all documents, which stand in for an embedding source."""
    return sinks.hashed_vectors(table(spark, d, "documents").select("doc_id", "text"), "doc_id", X.tokens(F.col("text"))).select("doc_id", F.transform("vector", lambda v: F.round(v.cast("double"), 5)).alias("vector"))


# --- incremental


@query(
    f"SELECT n.c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'new' WHEN o.c_acctbal = n.c_acctbal AND o.size = n.size THEN 'skip' WHEN o.digest = n.digest THEN 'touch' ELSE 'change' END AS action FROM {K._NEW} n LEFT JOIN {K._OLD} o ON o.c_custkey = n.c_custkey"
)
def change_discovery(spark, d):
    """Files (customers) against a manifest: what is new, to be skipped, touched or changed; only candidates are hashed."""
    old, new = _manifests(spark, d)
    stamps = ("c_acctbal", "size")
    found = I.discover(new, old, "c_custkey", stamps)
    candidates = new.join(found.where("action = 'candidate'").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "digest")
    return I.hashed(found, candidates, old, "c_custkey")


def _manifests(spark, d):
    c = table(spark, d, "customer").withColumn("size", F.length("c_name")).withColumn("digest", F.md5("c_mktsegment"))
    new = c.where("c_custkey % 10 <> 7").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return c.where("c_custkey % 10 <> 3"), new.withColumn("digest", F.when(F.col("c_custkey") % 15 == 0, F.md5(F.lit("x"))).otherwise(F.col("digest")))


@query(f"SELECT o.c_custkey FROM {K._OLD} o WHERE o.c_custkey NOT IN (SELECT c_custkey FROM {K._NEW})")
def reconcile_deletes(spark, d):
    """What a full listing no longer has."""
    old, new = _manifests(spark, d)
    return I.deleted(new, old, "c_custkey")


_FIRST = K._sql_current("routine", "id").replace("DESC", "ASC")


@query(f"WITH {RQ._LOCAL} SELECT caller, callee, calls FROM edges")
def scoped_calls(spark, d):
    """Call edges of the first deliveries brought up to date for the affected callers only: the same as all resolved anew."""
    rows = table(spark, d, "routine").withColumn("digest", F.xxhash64("body"))
    kept = [*RQ._SIG[1:], "body_hash", "digest", "sites"]
    v = F.struct("loaded_at", *kept)
    both = cut(C.with_sites(rows, ["id", "loaded_at", *kept[:-1]]).groupBy("id").agg(F.min(v).alias("o"), F.max(v).alias("n")))
    side = lambda s: both.select("id", *[F.col(f"{s}.{c}").alias(c) for c in kept])
    edges = lambda r: cut(C.call_edges(C.resolve_calls(C.flat_sites(r), r.drop("sites")).where("kind = 'direct'")))
    signature = lambda s: F.concat_ws("(", f"{s}.name", f"{s}.params_text", F.array_join(f"{s}.directives", ","), f"{s}.module_id")
    changed = F.when(~signature("o").eqNullSafe(signature("n")), "signature_changed").when(~F.col("o.body_hash").eqNullSafe(F.col("n.body_hash")) | ~F.col("o.digest").eqNullSafe(F.col("n.digest")), "body_changed")
    marks = both.withColumn("change", changed).where("change is not null")
    changes = marks.select("id", F.col("o.name").alias("name"), "change").unionByName(marks.select("id", F.col("n.name").alias("name"), "change")).distinct()
    before = edges(side("o"))
    callers = C.invalidated_callers(before, C.flat_sites(side("n")), changes)
    return C.rebuilt(before, callers, edges(side("n"))).select("caller", "callee", "calls")


@query(f"WITH {K._TOK_CTE} SELECT token, count(*) AS df FROM post GROUP BY token")
def incremental_df(spark, d):
    """Document frequencies kept by signed contributions: half of the documents, then the rest added and some taken out and put back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    posted = cut(retrieval.postings(docs, "doc_id", K._words()))
    none = posted.where("false")
    state = I.contributions(posted.where("doc_id % 2 = 0"), none)
    moved = posted.where("doc_id % 10 = 0")
    state = I.applied(state, I.contributions(posted.where("doc_id % 2 = 1"), moved))
    return I.applied(state, I.contributions(moved, none))


@query(
    f"""WITH o AS (SELECT id, name, params_text, body_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS k FROM routine) WHERE k = 1), n AS (SELECT id, name, params_text, body_hash, length(body) AS size FROM {ROU})
    SELECT n.id AS unit_id FROM n JOIN o USING (id) WHERE n.name IS NOT DISTINCT FROM o.name AND n.params_text IS NOT DISTINCT FROM o.params_text AND n.body_hash IS NOT DISTINCT FROM o.body_hash AND size > 0 AND size <= 3600 AND NOT starts_with(id, 'f') AND id < 'c'"""
)
def transferred_vectors(spark, d):
    """Routines whose first vectors can stand for the last delivery: inputs are equal, the range is valid, they were done then and aren't yet now."""
    v = F.struct("loaded_at", "name", "params_text", "body_hash", F.length("body").alias("char_end"))
    both = table(spark, d, "routine").groupBy(F.col("id").alias("unit_id")).agg(F.min(v).alias("o"), F.max(v).alias("n"))
    side = lambda s: both.select("unit_id", *[F.col(f"{s}.{c}").alias(c) for c in ("name", "params_text", "body_hash", "char_end")], F.lit(0).alias("char_start"), F.lit(3600).alias("most"))
    old, new = side("o"), side("n")
    return I.transferable(old, new, "unit_id", ["name", "params_text", "body_hash"], old.where("unit_id < 'c'").select("unit_id"), new.where("unit_id like 'f%'").select("unit_id"), "most")


@query("SELECT DISTINCT unit_id FROM routine_code_unit WHERE unit_id NOT IN (SELECT unit_id FROM routine_code_unit WHERE part_index % 3 = 0)")
def pending_units(spark, d):
    """Units that are not done, by worker; done are those whose part number divides by three."""
    u = table(spark, d, "routine_code_unit")
    return I.pending(u, u.where("part_index % 3 = 0").select("unit_id").distinct(), "unit_id", 4).select("unit_id")


_ENDS = "(SELECT id, arg_min(code_embedding, loaded_at) AS a, arg_max(code_embedding, loaded_at) AS b, count(DISTINCT loaded_at) AS n FROM routine WHERE code_embedding IS NOT NULL AND len(code_embedding) = 64 AND list_bool_and(list_transform(code_embedding, lambda x: x IS NOT NULL AND isfinite(x))) GROUP BY id)"


@query(f"SELECT id, list_bool_or([coalesce(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), -1) < 0.999]) OR list_sum(list_transform(a, lambda x: abs(x))) = 0 OR list_sum(list_transform(b, lambda x: abs(x))) = 0 AS drifted FROM {_ENDS} WHERE n > 1")
def embedding_drift(spark, d):
    """Routines delivered more than once: whether their first and last vectors still agree."""
    r = table(spark, d, "routine").where(F.col("code_embedding").isNotNull() & (F.size("code_embedding") == 64) & F.forall("code_embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ends = r.groupBy("id").agg(F.min_by("code_embedding", "loaded_at").alias("a"), F.max_by("code_embedding", "loaded_at").alias("b"), F.count_distinct("loaded_at").alias("n")).where("n > 1")
    return I.drifted(ends.select("id", F.col("a").alias("v")), ends.select("id", F.col("b").alias("v")), "id", "v").select("id", "drifted")


@query(
    f"""WITH n AS (SELECT object_qn, md5(coalesce(object_summary, '')) AS s FROM {OBJ}), o AS (SELECT object_qn, md5(coalesce(object_summary, '')) AS s FROM (SELECT *, row_number() OVER (PARTITION BY object_qn ORDER BY loaded_at) AS k FROM metadata_object) WHERE k = 1),
    v AS (SELECT object_qn, s FROM o WHERE ends_with(object_qn, '1') OR ends_with(object_qn, '2')) SELECT n.object_qn, CASE WHEN o.s IS DISTINCT FROM n.s THEN 'generate' WHEN v.s IS DISTINCT FROM n.s THEN 'embed' ELSE 'done' END AS stage FROM n LEFT JOIN o USING (object_qn) LEFT JOIN v USING (object_qn)"""
)
def summary_stages(spark, d):
    """What each object's summary needs next, the first delivery being what was made so far."""
    rows = table(spark, d, "metadata_object")
    state = lambda c: F.md5(F.coalesce(c, F.lit("")))
    both = rows.groupBy("object_qn").agg(F.max_by("object_summary", "loaded_at").alias("n"), F.min_by("object_summary", "loaded_at").alias("o"))
    items, made = both.select("object_qn", state("n").alias("state")), both.select("object_qn", state("o").alias("state"))
    return I.stages(items, made, made.where(F.col("object_qn").rlike("[12]$")), "object_qn", "state")


@query(
    """WITH s AS (SELECT DISTINCT project_name || '/' || source_type AS scope, snapshot_no AS n FROM metadata_object_hashes WHERE snapshot_no IS NOT NULL), top AS (SELECT max(n) AS hi FROM s), sc AS (SELECT DISTINCT scope FROM s WHERE scope IS NOT NULL),
    m AS (SELECT scope, (SELECT count(*) FROM s x WHERE x.scope = sc.scope AND x.n = hi) = 0 AS now, (SELECT count(*) FROM s x WHERE x.scope = sc.scope AND x.n = hi - 1) = 0 AS before FROM sc CROSS JOIN top)
    SELECT scope, CAST(1 + CASE WHEN before THEN 1 ELSE 0 END AS INTEGER) AS misses, 1 + CASE WHEN before THEN 1 ELSE 0 END >= CASE WHEN ends_with(scope, '/xml') THEN 2 ELSE 1 END AS remove FROM m WHERE now"""
)
def scope_removal(spark, d):
    """Scopes that miss the last snapshot: removed at once, or after two cycles where the source (xml) may be broken."""
    s = table(spark, d, "metadata_object_hashes").where("snapshot_no is not null and project_name is not null and source_type is not null").select(F.concat_ws("/", "project_name", "source_type").alias("scope"), "snapshot_no").distinct()
    top = s.agg(F.max("snapshot_no")).first()[0] or 0
    scopes = s.select("scope").distinct()
    missing = lambda n: scopes.join(s.where(F.col("snapshot_no") == n).select("scope"), "scope", "left_anti")
    return I.confirmed(missing(top).withColumn("malformed", F.col("scope").endswith("/xml")), missing(top - 1).withColumn("misses", F.lit(1)), "scope")


@query("SELECT c.object_qn, c.category_name, cv <> coalesce(ov, false) AS changed, cv AS visible FROM (SELECT object_qn, category_name, category_name NOT IN ('Отчеты', 'Обработки') AND NOT contains(obj_name, 'Типовой') AS cv FROM " + OBJ + ") c LEFT JOIN (SELECT object_qn, category_name NOT IN ('Отчеты', 'Обработки') AS ov FROM " + OBJ + ") o USING (object_qn) WHERE cv <> coalesce(ov, false)")
def visibility_flag(spark, d):
    """Objects whose visibility flag changes when a second rule joins the first; the others are not written."""
    o = K._objects(spark, d, "category_name", "obj_name")
    old = ~F.col("category_name").isin("Отчеты", "Обработки")
    new = P.visible(F.col("category_name"), ["Отчеты", "Обработки"], F.col("obj_name").contains("Типовой"))
    return o.withColumn("visible", new).where(new != old).select("object_qn", "category_name", F.lit(True).alias("changed"), "visible")


# --- streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as they arrive, one file a batch."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if os.path.isfile(path) else reader.parquet(path)


def _work(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's state in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


@query(f"SELECT id, name, owner_qn FROM {ROU}")
def stream_current_rows(spark, d):
    """The current rows of all routines, kept by a stream over their deliveries."""
    return maintain.current_rows(_stream(spark, d, "routine"), "id", ["name", "owner_qn"], _work(spark, "routine"))


@query(f"WITH {K._TOK_CTE} SELECT token, count(*) AS df FROM post GROUP BY token")
def stream_incremental(spark, d):
    """Document frequencies kept by a stream over the documents: equal to the full count."""
    return maintain.document_frequencies(_stream(spark, d, "documents"), "doc_id", K._words(), _work(spark, "documents"))


@query("SELECT id, CAST(sum(CASE WHEN before IS NOT NULL AND before <> body_hash THEN 1 ELSE 0 END) AS INTEGER) AS changes FROM (SELECT id, body_hash, lag(body_hash) OVER (PARTITION BY id ORDER BY loaded_at, body_hash) AS before FROM routine WHERE body_hash IS NOT NULL) GROUP BY id")
def stream_manifest(spark, d):
    """How often the content of each routine changed over its deliveries, kept by a stream."""
    s = _stream(spark, d, "routine").where("body_hash is not null").select(F.col("id").alias("path"), F.col("loaded_at").alias("seq"), F.col("line_no").alias("modified"), F.length("body").alias("length"), F.col("body_hash").alias("digest"))
    s = s.select("path", "seq", F.lit(0).alias("modified"), F.lit(0).alias("length"), "digest")
    return maintain.manifest(s, _work(spark, "manifest")).select(F.col("path").alias("id"), "changes")


# --- filters before top-k, thresholds, pages over kinds

_DOCS_RU = K._BM_CTE


@query(f"WITH {K._BM_CTE}, ru AS (SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE source IS NOT NULL AND project_name = 'sklad_main') SELECT CAST(qid AS BIGINT) AS qid, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ru) WHERE rank <= 20")
def prefiltered_topk(spark, d):
    """The best twenty documents of one project: filtered before the ranking, scored with the statistics of all."""
    scored = K._lexical(spark, d)
    keep = table(spark, d, "documents").where("source is not null and project_name = 'sklad_main'").select("doc_id")
    ranked = scored.join(keep, "doc_id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")))
    return ranked.where("rank <= 20").select(F.col("qid").cast("long").alias("qid"), "doc_id", "rank")


@query(f"WITH {K._BM_CTE}, n AS (SELECT qid, sum(qtf) AS n FROM q GROUP BY qid) SELECT CAST(qid AS BIGINT) AS qid, count(*) AS hits FROM bm JOIN n USING (qid) WHERE score >= CASE WHEN n <= 2 THEN 2.0 WHEN n <= 5 THEN 1.0 ELSE 0.1 END GROUP BY qid")
def adaptive_threshold(spark, d):
    """Hits of each query above the least score that its number of tokens asks for."""
    sizes = K._query_tokens(spark).groupBy("qid").agg(F.sum("qtf").alias("n")).collect()
    least = F.lit(0.0)
    for r in sizes:
        least = F.when(F.col("qid") == r["qid"], P.by_length(int(r["n"]), P.MIN_TEXT_SCORE)).otherwise(least)
    return K._lexical(spark, d).where(F.col("score") >= least).groupBy(F.col("qid").cast("long").alias("qid")).agg(F.count(F.lit(1)).alias("hits"))


@query(f"{MQ._E} SELECT ord, name, element_qn FROM (SELECT CASE kind WHEN 'attribute' THEN 0 WHEN 'form' THEN 1 ELSE 2 END AS ord, name, element_qn FROM el WHERE kind IN ('attribute', 'form', 'tabular_part')) ORDER BY ord, name, element_qn LIMIT 100 OFFSET 150")
def slice_over_kinds(spark, d):
    """One page over several kinds laid end to end."""
    e = M.elements(MQ._objects(spark, d)).where(F.col("kind").isin("attribute", "form", "tabular_part"))
    rows = e.select(F.when(F.col("kind") == "attribute", 0).when(F.col("kind") == "form", 1).otherwise(2).alias("ord"), "name", "element_qn")
    return rows.orderBy("ord", "name", "element_qn").offset(150).limit(100)
