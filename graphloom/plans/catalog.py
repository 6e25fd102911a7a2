"""Queries of the reference operators over the domain tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.functions import text as X
from graphloom.operators import graph, retrieval
from graphloom.operators.hierarchy import current_links, hierarchies
from graphloom.operators import relations as R
from graphloom.plans.session import cut
from graphloom.sources.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


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


# Current rows, in SQL and as DataFrames.
def _sql_current(name: str, key: str) -> str:
    return f"(SELECT * EXCLUDE (k_) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) AS k_ FROM {name}) WHERE k_ = 1)"


OBJ = _sql_current("metadata_object", "object_qn")
ROU = _sql_current("routine", "id")
SUB = _sql_current("subsystem_edge", "child_qn")
WORD = r"[A-Za-zА-Яа-яЁё0-9_]+"
NAME = r"[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*"


def _objects(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.current_rows(table(spark, d, "metadata_object"), "object_qn", list(columns))


def _routines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.current_rows(table(spark, d, "routine"), "id", list(columns))


# --- inventory and predicates


@query(f"SELECT project_name, config_name, category_name, count(*) AS object_count FROM {OBJ} GROUP BY ALL")
def inventory_summary(spark, d):
    """Objects of each configuration and category."""
    return _objects(spark, d, "project_name", "config_name", "category_name").groupBy("project_name", "config_name", "category_name").agg(F.count(F.lit(1)).alias("object_count"))


@query(f"SELECT object_qn, obj_name FROM {OBJ} WHERE lower(obj_name) = lower('ТИПОВОЙРЕГИСТР35')")
def objects_match_exact(spark, d):
    return _objects(spark, d, "obj_name").where(P.matches(F.col("obj_name"), "ТИПОВОЙРЕГИСТР35", "exact")).select("object_qn", "obj_name")


@query(f"SELECT object_qn, obj_name FROM {OBJ} WHERE starts_with(lower(obj_name), 'типовой')")
def objects_match_prefix(spark, d):
    return _objects(spark, d, "obj_name").where(P.matches(F.col("obj_name"), "Типовой", "starts_with")).select("object_qn", "obj_name")


@query(f"SELECT object_qn, obj_name FROM {OBJ} WHERE contains(lower(obj_name), 'отчет1')")
def objects_match_contains(spark, d):
    return _objects(spark, d, "obj_name").where(P.matches(F.col("obj_name"), "ОТЧЕТ1", "contains")).select("object_qn", "obj_name")


@query(f"SELECT object_qn, category_name FROM {OBJ} WHERE category_name = 'Документы'")
def optional_category_filter(spark, d):
    return P.optional_equal(_objects(spark, d, "category_name"), "category_name", "Документы").select("object_qn", "category_name")


@query("SELECT object_qn FROM metadata_object WHERE false")
def unknown_category_empty(spark, d):
    """Categories are given but none is known: no rows, not all rows."""
    return P.in_list(_objects(spark, d, "category_name"), "category_name", ["Выдуманные"], ["Документы", "Справочники"]).select("object_qn")


@query(f"SELECT object_qn FROM {OBJ} WHERE category_name IN ('Документы', 'Отчеты')")
def category_in_list(spark, d):
    return P.in_list(_objects(spark, d, "category_name"), "category_name", ["Документы", "Отчеты"]).select("object_qn")


@query(f"SELECT id, owner_qn FROM {ROU} WHERE owner_qn = 'sklad_main/УчетСкладаБазовая/Документы' OR starts_with(owner_qn, 'sklad_main/УчетСкладаБазовая/Документы/')")
def subtree_prefix(spark, d):
    return _routines(spark, d, "owner_qn").where(P.in_subtree(F.col("owner_qn"), "sklad_main/УчетСкладаБазовая/Документы")).select("id", "owner_qn")


@query(f"SELECT id, name FROM {ROU} WHERE list_contains(directives, '&НаКлиенте')")
def list_any_predicate(spark, d):
    return _routines(spark, d, "name", "directives").where(F.coalesce(P.any_equals(F.col("directives"), "&НаКлиенте"), F.lit(False))).select("id", "name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_property(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


@query(f"SELECT id, file_path FROM {ROU} WHERE file_path > 'M' OR (file_path = 'M' AND id > '0')")
def keyset_scan(spark, d):
    """The condition of a scan that goes on after (file_path, id)."""
    return _routines(spark, d, "file_path").where(P.after_key(["file_path", "id"], ("M", "0"))).select("id", "file_path")


# --- joins


@query(f"SELECT o.object_qn, o.category_name, r.id, r.name FROM {OBJ} o JOIN {ROU} r ON r.owner_qn = o.object_qn")
def typed_expand(spark, d):
    """One hop from objects to their routines."""
    o, r = _objects(spark, d, "category_name"), _routines(spark, d, "name", "owner_qn")
    return o.join(r, o["object_qn"] == r["owner_qn"]).select("object_qn", "category_name", "id", "name")


@query(f"SELECT object_qn FROM {OBJ} o WHERE EXISTS (SELECT 1 FROM {ROU} r WHERE r.owner_qn = o.object_qn AND r.is_export)")
def exists_semi(spark, d):
    """Objects with an exported routine."""
    r = _routines(spark, d, "owner_qn", "is_export").where("is_export").select(F.col("owner_qn").alias("object_qn"))
    return _objects(spark, d, "category_name").join(r, "object_qn", "left_semi").select("object_qn")


@query(f"SELECT object_qn FROM {OBJ} o WHERE NOT EXISTS (SELECT 1 FROM {ROU} r WHERE r.owner_qn = o.object_qn)")
def not_exists_anti(spark, d):
    """Objects without routines."""
    r = _routines(spark, d, "owner_qn").select(F.col("owner_qn").alias("object_qn"))
    return _objects(spark, d, "category_name").join(r, "object_qn", "left_anti").select("object_qn")


@query(f"SELECT o.object_qn, count(r.id) AS routines, count(r.id) FILTER (WHERE r.is_export) AS exported FROM {OBJ} o LEFT JOIN {ROU} r ON r.owner_qn = o.object_qn GROUP BY o.object_qn")
def optional_expand(spark, d):
    """Every object with its number of routines, none included; the routines are counted before the join."""
    r = _routines(spark, d, "owner_qn", "is_export").groupBy(F.col("owner_qn").alias("object_qn")).agg(F.count(F.lit(1)).alias("routines"), F.count_if("is_export").alias("exported"))
    o = _objects(spark, d, "category_name").join(r, "object_qn", "left")
    zero = F.lit(0).cast("long")
    return o.select("object_qn", F.coalesce("routines", zero).alias("routines"), F.coalesce("exported", zero).alias("exported"))


@query(f"SELECT DISTINCT name, 'routine' AS kind FROM {ROU} WHERE contains(lower(name), 'остатки') UNION SELECT DISTINCT obj_name, 'object' FROM {OBJ} WHERE contains(lower(obj_name), 'отчет')")
def usage_union(spark, d):
    """Distinct union of two patterns."""
    a = _routines(spark, d, "name").where(P.matches(F.col("name"), "остатки", "contains")).select("name", F.lit("routine").alias("kind"))
    b = _objects(spark, d, "obj_name").where(P.matches(F.col("obj_name"), "отчет", "contains")).select(F.col("obj_name").alias("name"), F.lit("object").alias("kind"))
    return a.unionByName(b).distinct()


@query("SELECT kind, count(*) AS n FROM (SELECT 'subsystem' AS kind FROM subsystem_edge UNION ALL SELECT 'control' FROM child_rel) GROUP BY kind")
def children_union_all(spark, d):
    a = table(spark, d, "subsystem_edge").select(F.lit("subsystem").alias("kind"))
    b = table(spark, d, "child_rel").select(F.lit("control").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT owner_qn FROM {ROU} WHERE is_export EXCEPT SELECT owner_qn FROM {ROU} WHERE NOT is_export")
def set_difference(spark, d):
    r = _routines(spark, d, "owner_qn", "is_export")
    return r.where("is_export").select("owner_qn").subtract(r.where("not is_export").select("owner_qn"))


@query(f"SELECT owner_qn FROM {ROU} WHERE is_export INTERSECT SELECT owner_qn FROM {ROU} WHERE NOT is_export")
def set_intersection(spark, d):
    r = _routines(spark, d, "owner_qn", "is_export")
    return r.where("is_export").select("owner_qn").intersect(r.where("not is_export").select("owner_qn"))


# The overlay of a configuration takes over every object whose name ends in an even digit and adds one of its own for each that ends in 1.
_EXT = f"""(SELECT replace(object_qn, '/' || config_name || '/', '/' || config_name || '_ext/') AS ext_qn, config_name FROM {OBJ} WHERE regexp_matches(object_qn, '[02468]$')
    UNION ALL SELECT replace(object_qn, '/' || config_name || '/', '/' || config_name || '_ext/') || '_own', config_name FROM {OBJ} WHERE regexp_matches(object_qn, '1$'))"""


def _overlay(spark, d):
    """(object_qn, config_name) of an overlay made of the objects: its names lie in another configuration."""
    o = _objects(spark, d, "config_name").withColumn("ext", F.expr("replace(object_qn, concat('/', config_name, '/'), concat('/', config_name, '_ext/'))"))
    taken = o.where(F.col("object_qn").rlike("[02468]$")).select(F.col("ext").alias("object_qn"), "config_name")
    own = o.where(F.col("object_qn").rlike("1$")).select(F.concat("ext", F.lit("_own")).alias("object_qn"), "config_name")
    return taken.unionByName(own)


def _rewritten():
    return F.expr("replace(object_qn, concat('/', config_name, '_ext/'), concat('/', config_name, '/'))")


@query(f"SELECT e.ext_qn AS extension_qn, o.object_qn AS base_qn FROM {_EXT} e JOIN {OBJ} o ON replace(e.ext_qn, '/' || e.config_name || '_ext/', '/' || e.config_name || '/') = o.object_qn")
def qn_rewrite_selfjoin(spark, d):
    """Overlay pairs by rewritten names: an overlay's object belongs to the base object whose name it has in the base configuration."""
    return R.overlay_pairs(_objects(spark, d, "config_name").select("object_qn"), _overlay(spark, d), "object_qn", _rewritten())


@query(
    f"""WITH e AS (SELECT * FROM {_EXT}), n AS (SELECT object_qn FROM {OBJ} UNION ALL SELECT ext_qn FROM e),
    p AS (SELECT e.ext_qn, o.object_qn AS base_qn FROM e JOIN {OBJ} o ON replace(e.ext_qn, '/' || e.config_name || '_ext/', '/' || e.config_name || '/') = o.object_qn)
    SELECT n.object_qn, CASE WHEN x.ext_qn IS NOT NULL THEN 'extension' WHEN b.base_qn IS NOT NULL THEN 'base' ELSE 'none' END AS role, coalesce(x.base_qn, b.exts, '') AS partners FROM n
    LEFT JOIN p x ON x.ext_qn = n.object_qn LEFT JOIN (SELECT base_qn, string_agg(ext_qn, ',' ORDER BY ext_qn) AS exts FROM p GROUP BY base_qn) b ON b.base_qn = n.object_qn"""
)
def adoption_roles(spark, d):
    """Role of every object of a base configuration and its overlay, with its partners."""
    base, ext = _objects(spark, d, "config_name").select("object_qn"), _overlay(spark, d)
    pairs = R.overlay_pairs(base, ext, "object_qn", _rewritten())
    return R.adoption_roles(base.unionByName(ext.select("object_qn")), pairs, "object_qn").select("object_qn", "role", F.array_join("partners", ",").alias("partners"))


@query(f"SELECT name, project_name, min(id) AS id FROM {ROU} GROUP BY name, project_name HAVING count(*) = 1")
def resolve_unambiguous(spark, d):
    """Names that mean exactly one routine of a project."""
    r = _routines(spark, d, "name", "project_name")
    return r.groupBy("name", "project_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "project_name", "id")


@query(
    f"""WITH r AS (SELECT id, name, owner_qn, project_name, is_export FROM {ROU}),
    c AS (SELECT a.id AS caller, b.id AS callee, CASE WHEN a.owner_qn = b.owner_qn THEN 0 ELSE 1 END AS tier FROM r a JOIN r b ON a.name = b.name AND a.project_name = b.project_name AND a.id <> b.id AND (b.is_export OR a.owner_qn = b.owner_qn))
    SELECT caller, callee, CAST(tier AS BIGINT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY tier, callee) AS k FROM c) WHERE k = 1"""
)
def tiered_resolution(spark, d):
    """The best namesake of each routine: of the same owner first, then exported ones of the project.

    Each group of namesakes gives its two smallest ids, one of which isn't the caller: no pairs within a name.
    """
    r = _routines(spark, d, "name", "owner_qn", "project_name", "is_export").where(F.col("name").isNotNull() & F.col("project_name").isNotNull())
    own, shared = ["name", "project_name", "owner_qn"], ["name", "project_name"]
    mine = R.first_of_each(r.where(F.col("owner_qn").isNotNull()), own, [F.col("id")], 2).groupBy(*own).agg(F.sort_array(F.collect_list("id")).alias("mine"))
    theirs = R.first_of_each(r.where("is_export"), shared, [F.col("id")], 2).groupBy(*shared).agg(F.sort_array(F.collect_list("id")).alias("theirs"))
    both = r.join(mine, own, "left").join(theirs, shared, "left")
    other = lambda ids: F.get(F.filter(ids, lambda x: x != F.col("id")), F.lit(0))
    rows = both.select(F.col("id").alias("caller"), other(F.col("mine")).alias("m"), other(F.col("theirs")).alias("t"))
    return rows.where("m is not null or t is not null").select("caller", F.coalesce("m", "t").alias("callee"), F.when(F.col("m").isNotNull(), 0).otherwise(1).cast("long").alias("tier"))


@query(
    f"""SELECT r.id, coalesce(o.object_summary, c.s, 'none') AS about FROM {ROU} r LEFT JOIN (SELECT object_qn, object_summary FROM {OBJ} WHERE trim(object_summary) <> '') o ON o.object_qn = r.owner_qn
    LEFT JOIN (SELECT category_qn, min(object_summary) AS s FROM {OBJ} WHERE trim(object_summary) <> '' GROUP BY category_qn) c ON c.category_qn = regexp_replace(r.owner_qn, '/[^/]*$', '')"""
)
def coalesce_fallback_join(spark, d):
    """What is known about a routine's owner: its own summary, else one of its category."""
    o = _objects(spark, d, "object_summary", "category_qn").where(F.trim("object_summary") != "")
    c = o.groupBy("category_qn").agg(F.min("object_summary").alias("s"))
    r = _routines(spark, d, "owner_qn").withColumn("category_qn", F.regexp_replace("owner_qn", "/[^/]*$", ""))
    one = o.select(F.col("object_qn").alias("owner_qn"), "object_summary")
    return r.join(one, "owner_qn", "left").join(c, "category_qn", "left").select("id", F.coalesce("object_summary", "s", F.lit("none")).alias("about"))


@query(f"SELECT r.id, m.module_id FROM {ROU} r JOIN {_sql_current('module_source', 'module_id')} m ON r.project_name = m.project_name AND r.config_name = m.config_name AND r.owner_qn = m.owner_qn WHERE contains(r.file_path, m.module_type)")
def theta_contains_join(spark, d):
    """Containment as the residue of an equi join, so the join stays a hash or merge join."""
    r = _routines(spark, d, "project_name", "config_name", "owner_qn", "file_path")
    m = R.current_rows(table(spark, d, "module_source"), "module_id", ["project_name", "config_name", "owner_qn", "module_type"])
    return r.join(m, ["project_name", "config_name", "owner_qn"]).where(F.col("file_path").contains(F.col("module_type"))).select("id", "module_id")


# --- aggregates


@query(f"SELECT project_name, count(DISTINCT owner_qn) AS owners, count(DISTINCT module_id) AS modules, count(DISTINCT CASE WHEN is_export THEN owner_qn END) AS exporting FROM {ROU} GROUP BY project_name")
def distinct_counts(spark, d):
    r = _routines(spark, d, "project_name", "owner_qn", "module_id", "is_export")
    return r.groupBy("project_name").agg(F.count_distinct("owner_qn").alias("owners"), F.count_distinct("module_id").alias("modules"), F.count_distinct(F.when(F.col("is_export"), F.col("owner_qn"))).alias("exporting"))


@query(f"SELECT owner_qn, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT owner_qn, name FROM {ROU}) GROUP BY owner_qn")
def collect_sorted(spark, d):
    return _routines(spark, d, "owner_qn", "name").groupBy("owner_qn").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("SELECT turn_id, count(*) AS deliveries FROM agent_turn GROUP BY turn_id HAVING count(*) > 1")
def having_duplicates(spark, d):
    return table(spark, d, "agent_turn").groupBy("turn_id").agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


@query(
    """WITH t AS (SELECT user_id, event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
    SELECT src, dst, count(*) AS n, len(list(DISTINCT user_id)) AS users FROM t WHERE dst IS NOT NULL GROUP BY src, dst"""
)
def edge_aggregate(spark, d):
    """Transitions between consecutive events as edges with counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")
    return t.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    """WITH t AS (SELECT user_id, event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
    SELECT user_id, src, dst, count(*) AS n, array_to_string(list_sort(list(event_id))[1:50], ',') AS lines FROM t WHERE dst IS NOT NULL GROUP BY user_id, src, dst"""
)
def edge_aggregate_capped(spark, d):
    """The same per user with the first 50 places, as the edge's property keeps them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")
    edge = ["user_id", "src", "dst"]
    places = R.first_of_each(t, edge, [F.col("event_id")], 50).groupBy(*edge).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("lines"))
    return t.groupBy(*edge).agg(F.count(F.lit(1)).alias("n")).join(places, edge)


@query(
    """SELECT c_mktsegment AS role, o_orderpriority AS target, o_orderstatus AS right_name, bool_and(o_totalprice > 1000) AS allowed, bool_or(c_acctbal < 0) AS has_condition,
    min(CASE WHEN c_acctbal < 0 THEN c_name END) AS condition FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
)
def rights_deny_wins(spark, d):
    """Rights of a role on a target: one denial denies, any condition counts."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = j.select(F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("right_name"), (F.col("o_totalprice") > 1000).alias("ok"), F.when(F.col("c_acctbal") < 0, F.col("c_name")).alias("cond"))
    return R.effective_rights(rows, ["role", "target"], "right_name", "ok", "cond")


@query("SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '..' || b END, '|' ORDER BY a) AS ranges FROM (SELECT user_id, min(n) AS a, max(n) AS b FROM (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM (SELECT DISTINCT user_id, event_id // 40 AS n FROM events)) GROUP BY user_id, g) GROUP BY user_id")
def numbered_collapse(spark, d):
    """Numbers of each user as ranges."""
    e = table(spark, d, "events").select("user_id", F.expr("event_id div 40").alias("n"))
    return R.runs_text(R.number_runs(e, ["user_id"], "n"), ["user_id"], "ranges")


@query(
    f"""SELECT project_name, sha256(string_agg(h, ',' ORDER BY bucket)) AS state FROM (SELECT project_name, substring(md5(id), 1, 3) AS bucket,
    sha256(string_agg(id || ':' || coalesce(body_hash, ''), ',' ORDER BY id)) AS h FROM {ROU} GROUP BY ALL) GROUP BY project_name"""
)
def source_state_hash(spark, d):
    """One hash over the ids and body hashes of a project, formed in 4,096 buckets of ids and over the buckets in order."""
    r = _routines(spark, d, "project_name", "body_hash").withColumn("bucket", F.substring(F.md5("id"), 1, 3)).withColumn("one", F.concat("id", F.lit(":"), F.coalesce("body_hash", F.lit(""))))
    parts = r.groupBy("project_name", "bucket").agg(F.expr("sha2(listagg(one, ',') within group (order by id), 256)").alias("h"))
    return parts.groupBy("project_name").agg(F.expr("sha2(listagg(h, ',') within group (order by bucket), 256)").alias("state"))


# --- windows, order and pages


@query(f"SELECT owner_qn, name, line_no, k FROM (SELECT owner_qn, name, CAST(line_no AS BIGINT) AS line_no, row_number() OVER (PARTITION BY owner_qn ORDER BY name, id) AS k FROM {ROU}) WHERE k <= 3")
def top_n_per_group(spark, d):
    """The first three routines of each owner."""
    r = _routines(spark, d, "owner_qn", "name", "line_no").withColumn("k", F.row_number().over(Window.partitionBy("owner_qn").orderBy("name", "id")).cast("long"))
    return r.where("k <= 3").select("owner_qn", "name", F.col("line_no").cast("long").alias("line_no"), "k")


@query(f"SELECT object_qn, category_name FROM {OBJ} ORDER BY object_qn LIMIT 101 OFFSET 100")
def page_with_lookahead(spark, d):
    """The second page of 100 with one row more, which tells whether there is another."""
    return _objects(spark, d, "category_name").orderBy("object_qn").offset(100).limit(101).select("object_qn", "category_name")


@query(f"SELECT p.object_qn, count(r.id) AS routines FROM (SELECT object_qn FROM {OBJ} ORDER BY object_qn LIMIT 100) p LEFT JOIN {ROU} r ON r.owner_qn = p.object_qn GROUP BY p.object_qn")
def page_then_enrich(spark, d):
    """A page first, its details then."""
    page = _objects(spark, d, "category_name").orderBy("object_qn").limit(100).select("object_qn")
    r = _routines(spark, d, "owner_qn").select(F.col("owner_qn").alias("object_qn"), "id")
    return page.join(r, "object_qn", "left").groupBy("object_qn").agg(F.count("id").alias("routines"))


@query(f"SELECT object_qn, total FROM (SELECT object_qn, count(*) OVER () AS total FROM {OBJ} WHERE category_name = 'Отчеты') ORDER BY object_qn LIMIT 50 OFFSET 10")
def total_and_slice(spark, d):
    """A page with the total of all rows; the total is one aggregated row."""
    o = _objects(spark, d, "category_name").where(F.col("category_name") == "Отчеты").select("object_qn")
    return o.orderBy("object_qn").offset(10).limit(50).crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("total"))))


# --- text


@query(rf"SELECT id, regexp_replace(regexp_replace(name, '([a-zа-яё0-9])([A-ZА-ЯЁ])', '\1 \2', 'g'), '([A-ZА-ЯЁ])([A-ZА-ЯЁ][a-zа-яё])', '\1 \2', 'g') AS words FROM {ROU}")
def camel_split(spark, d):
    return _routines(spark, d, "name").select("id", X.camel_split(F.col("name")).alias("words"))


@query(f"SELECT object_qn, translate(lower(obj_name), 'ё _-', 'е') AS folded FROM {OBJ}")
def norm_fold(spark, d):
    return _objects(spark, d, "obj_name").select("object_qn", X.folded(F.col("obj_name")).alias("folded"))


@query(f"SELECT object_qn, split_part(object_qn, '/', -1) AS last FROM {OBJ}")
def last_token(spark, d):
    return _objects(spark, d, "obj_name").select("object_qn", X.last_part(F.col("object_qn"), "/").alias("last"))


@query(f"SELECT id, array_to_string(string_split(body, chr(10))[2:4], chr(10)) AS lines FROM {ROU} WHERE body IS NOT NULL")
def line_slice(spark, d):
    return _routines(spark, d, "body").where("body is not null").select("id", X.lines_of(F.col("body"), F.lit(2), F.lit(4)).alias("lines"))


@query(f"SELECT id, substring(body, 101, 200) AS part, CAST(coalesce(length(body), 0) AS BIGINT) AS total FROM {ROU}")
def body_slice(spark, d):
    return _routines(spark, d, "body").select("id", X.body_slice(F.col("body"), 100, 200).alias("part"), F.coalesce(F.length("body"), F.lit(0)).cast("long").alias("total"))


_STOP = """'как', 'где', 'что', 'чтобы', 'если', 'или', 'для', 'при', 'это', 'этот', 'эта', 'эти', 'этой', 'этого', 'будет', 'есть', 'нет', 'надо', 'нужно', 'который', 'которая', 'которые', 'каких', 'каким', 'какие',
    'по', 'из', 'на', 'в', 'с', 'к', 'от', 'до', 'и', 'а', 'же', 'ли', 'не', 'за', 'под', 'над', 'через', 'между'"""
_CODE_STOP = _STOP + """, 'тогда', 'иначе', 'иначеесли', 'конецесли', 'каждого', 'цикл', 'конеццикла', 'пока', 'попытка', 'исключение', 'конецпопытки', 'возврат', 'перем', 'знач', 'экспорт', 'новый', 'истина', 'ложь', 'неопределено',
    'null', 'true', 'false', 'procedure', 'function', 'endprocedure', 'endfunction', 'if', 'then', 'else', 'elsif', 'endif', 'for', 'each', 'while', 'return', 'export', 'new'"""
# Runs of capitals split into single letters: two passes of the same replacement see every boundary.
_SPLIT = r"regexp_replace(regexp_replace({0}, '([а-яa-z0-9])([А-ЯA-Z])', '\1 \2', 'g'), '([а-яa-z0-9])([А-ЯA-Z])', '\1 \2', 'g')"


def _sql_tokens(column: str, stop: str = _STOP) -> str:
    return f"list_filter(regexp_extract_all(lower({_SPLIT.format(column)}), '{WORD}'), lambda w: length(w) >= 3 AND w NOT IN ({stop}))"


@query(f"SELECT id, array_to_string({_sql_tokens('body', _CODE_STOP)}, ' ') AS tokens FROM {ROU} WHERE body IS NOT NULL")
def tokenize(spark, d):
    """Tokens of every body, stop words of code left out."""
    return _routines(spark, d, "body").where("body is not null").select("id", F.array_join(X.tokens(F.col("body"), stop=X.CODE_STOP_WORDS), " ").alias("tokens"))


@query(rf"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '({NAME})\s*\(', 1))), ',') AS calls FROM {ROU} WHERE body IS NOT NULL")
def structural_extract(spark, d):
    """The distinct names called in each body."""
    return _routines(spark, d, "body").where("body is not null").select("id", F.array_join(F.array_sort(F.array_distinct(X.called_names(F.col("body")))), ",").alias("calls"))


_ENDS = """['иями', 'ями', 'ами', 'ого', 'ему', 'ыми', 'ими', 'иях', 'иям', 'ией', 'ию', 'ия', 'ые', 'ие', 'ой', 'ий', 'ый', 'ая', 'яя', 'ое', 'ее', 'ую', 'юю', 'ов', 'ев', 'ам', 'ям', 'ах', 'ях', 'ом', 'ем', 'ей', 'ою', 'ею',
    'ы', 'и', 'а', 'я', 'е', 'у', 'ю']"""


def _sql_stem(word: str) -> str:
    bare = f"replace(lower({word}), '_', '')"
    ending = f"list_filter({_ENDS}, lambda e: ends_with({bare}, e) AND length({bare}) - length(e) >= 4)[1]"
    return f"CASE WHEN regexp_full_match({bare}, '[а-яё]+') AND length({bare}) > 4 THEN left({bare}, length({bare}) - coalesce(length({ending}), 0)) ELSE {bare} END"


@query(f"SELECT id, array_to_string(list_transform(t, lambda w: {_sql_stem('w')}), ' ') AS stems FROM (SELECT id, {_sql_tokens('name')} AS t FROM {ROU})")
def word_stem(spark, d):
    """The stems of every name's tokens."""
    return _routines(spark, d, "name").select("id", F.array_join(F.transform(X.tokens(F.col("name")), lambda w: X.stem(w)), " ").alias("stems"))


@query(f"SELECT object_qn, string_split(object_qn, '/')[1] AS project, string_split(object_qn, '/')[2] AS config, string_split(object_qn, '/')[3] AS category FROM {OBJ}")
def qn_parts(spark, d):
    parts = F.split("object_qn", "/")
    return _objects(spark, d, "obj_name").select("object_qn", F.get(parts, F.lit(0)).alias("project"), F.get(parts, F.lit(1)).alias("config"), F.get(parts, F.lit(2)).alias("category"))


@query(f"SELECT id, sha1(concat_ws('|', module_id, routine_type, name, params_text)) AS rid, sha256(coalesce(body, '')) AS body_sha FROM {ROU}")
def identity_hashes(spark, d):
    r = _routines(spark, d, "module_id", "routine_type", "name", "params_text", "body")
    return r.select("id", F.sha1(F.concat_ws("|", "module_id", "routine_type", "name", "params_text")).alias("rid"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_sha"))


@query("SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) AS plain FROM documents")
def html_to_text(spark, d):
    """Every document as plain text; null for null text."""
    return table(spark, d, "documents").select("doc_id", X.html_text(F.col("text")).alias("plain"))


# --- retrieval

QUERIES = {1: "проведение документа по регистру остатков", 2: "обмен с узлом остановлен", 3: "posting of the document to the register", 4: "печатная форма макет подписи"}
_TOK_CTE = f"tok AS (SELECT doc_id, unnest({_sql_tokens('text')}) AS token FROM documents WHERE text IS NOT NULL), post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id, CAST(coalesce(len({_sql_tokens('text')}), 0) AS BIGINT) AS length FROM documents)"
_QRY_CTE = "q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest(t) AS token FROM (" + " UNION ALL ".join(f"SELECT {i} AS qid, {_sql_tokens(repr(t))} AS t" for i, t in QUERIES.items()) + ")) GROUP BY ALL)"
_BM_CTE = f"""{_TOK_CTE}, {_QRY_CTE}, st AS (SELECT count(*) AS n, avg(length) AS mean FROM len), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
    bm AS (SELECT q.qid, p.doc_id, sum(q.qtf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len.length / st.mean))) AS score
    FROM q JOIN post p USING (token) JOIN df USING (token) JOIN len USING (doc_id) CROSS JOIN st GROUP BY q.qid, p.doc_id)"""


def _words():
    return F.coalesce(X.tokens(F.col("text")), F.array().cast("array<string>"))


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _posted(spark, d):
    return retrieval.postings(_documents(spark, d), "doc_id", _words())


def _query_tokens(spark):
    rows = spark.createDataFrame(list(QUERIES.items()), "qid int, text string")
    return rows.select("qid", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))


def _lexical(spark, d):
    return retrieval.bm25(_documents(spark, d), _words(), _query_tokens(spark), "doc_id")


@query(f"WITH {_TOK_CTE} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM post GROUP BY token")
def corpus_df(spark, d):
    """Documents and occurrences of every token."""
    return _posted(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {_TOK_CTE} SELECT count(*) AS documents, CAST(sum(length) AS BIGINT) AS tokens, round(avg(length), 6) AS mean FROM len")
def corpus_stats(spark, d):
    lengths = _documents(spark, d).select(F.size(_words()).cast("long").alias("length"))
    return lengths.agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("tokens"), F.round(F.avg("length"), 6).alias("mean"))


@query(f"WITH {_BM_CTE} SELECT CAST(qid AS BIGINT) AS qid, doc_id, round(score, 6) AS score FROM bm")
def bm25(spark, d):
    """Score of every document that shares a token with a query."""
    return _lexical(spark, d).select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM_CTE} SELECT CAST(qid AS BIGINT) AS qid, doc_id, round((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 6) AS norm FROM bm WINDOW w AS (PARTITION BY qid)")
def minmax_norm(spark, d):
    n = retrieval.minmax(cut(_lexical(spark, d)), ["qid"], 0.0)
    return n.select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round("norm", 6).alias("norm"))


@query(
    f"""WITH {_BM_CTE}, p AS (SELECT qid, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95, max(score) AS top FROM bm GROUP BY qid)
    SELECT CAST(qid AS BIGINT) AS qid, doc_id, round(CASE WHEN p95 > p50 THEN greatest(0, least(1, (score - p50) / (p95 - p50))) WHEN top > 0 THEN greatest(0, least(1, score / top)) ELSE 0 END, 6) AS norm FROM bm JOIN p USING (qid)"""
)
def p95_norm(spark, d):
    n = retrieval.robust_norm(cut(_lexical(spark, d)), ["qid"])
    return n.select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round("norm", 6).alias("norm"))


_VEC = "SELECT a.vec_id AS qid, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos, b.label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"


def _vectors(spark, d):
    """(queries, base): every vector whose id is divisible by 20 is a query against all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))
    return e.where("id % 20 = 0").select(F.col("id").alias("qid"), "v"), e


@query(f"SELECT qid, vec_id, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 12) DESC, vec_id) AS k FROM ({_VEC})) WHERE k <= 10")
def vector_topk(spark, d):
    """The ten nearest of each query."""
    q, e = _vectors(spark, d)
    return retrieval.blocked_topk(q, e, 10, DIM).select("qid", F.col("id").alias("vec_id"), F.round("cos", 6).alias("cos"))


@query(f"SELECT qid, CAST(label AS BIGINT) AS label, vec_id, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY round(cos, 12) DESC, vec_id) AS k FROM ({_VEC})) WHERE k <= 2")
def vector_topk_per_category(spark, d):
    """The two nearest of each category, so that no category fills the pool."""
    q, e = _vectors(spark, d)
    return retrieval.blocked_topk(q, e, 2, DIM, "label").select("qid", "label", F.col("id").alias("vec_id"), F.round("cos", 6).alias("cos"))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS i, round(sum(x * w) / sum(w), 6) AS x FROM (SELECT label, vec_id % 7 + 1 AS w, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i")
def mean_pool(spark, d):
    """The weighted mean vector of each label."""
    pooled = retrieval.mean_pool(table(spark, d, "embeddings"), "label", "embedding", F.col("vec_id") % 7 + 1, DIM)
    return pooled.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


#: Candidates of each leg of a hybrid search, and elements of a vector.
POOL, DIM = 200, 64
_LEGS = f"""WITH {_BM_CTE}, lex AS (SELECT qid, doc_id, score / max(score) OVER (PARTITION BY qid) AS norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= {POOL}),
    vec0 AS (SELECT CAST(q.qid AS INTEGER) AS qid, b.vec_id AS doc_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM (SELECT DISTINCT qid FROM q) q JOIN embeddings a ON a.vec_id = q.qid JOIN embeddings b ON a.vec_id <> b.vec_id),
    vec AS (SELECT qid, doc_id, score / max(score) OVER (PARTITION BY qid) AS norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rank FROM vec0) WHERE rank <= {POOL})"""


def _legs(spark, d):
    """The best POOL lexical and vector candidates of the queries; query n's vector is embedding n."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    lex = _lexical(spark, d).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= POOL)
    _, e = _vectors(spark, d)
    vec = retrieval.blocked_topk(e.where(F.col("id").isin(*QUERIES)).select(F.col("id").alias("qid"), "v"), e, POOL, DIM)
    vec = vec.select(F.col("qid").cast("int").alias("qid"), F.col("id").alias("doc_id"), F.col("cos").alias("score"), "rank")
    return [retrieval.max_norm(cut(leg.select("qid", "doc_id", "score", "rank")), ["qid"]) for leg in (lex, vec)]


@query(f"{_LEGS} SELECT CAST(coalesce(l.qid, v.qid) AS BIGINT) AS qid, coalesce(l.doc_id, v.doc_id) AS doc_id, round(0.3 * coalesce(l.norm, 0) + 0.7 * coalesce(v.norm, 0), 6) AS score FROM lex l FULL JOIN vec v ON l.qid = v.qid AND l.doc_id = v.doc_id")
def hybrid_weighted(spark, d):
    lex, vec = _legs(spark, d)
    return retrieval.fuse_weighted(lex, vec, ["qid", "doc_id"], 0.7).select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round("score", 6).alias("score"))


@query(f"{_LEGS} SELECT CAST(coalesce(l.qid, v.qid) AS BIGINT) AS qid, coalesce(l.doc_id, v.doc_id) AS doc_id, round(coalesce(0.3 / (60 + l.rank), 0) + coalesce(0.7 / (60 + v.rank), 0), 9) AS score FROM lex l FULL JOIN vec v ON l.qid = v.qid AND l.doc_id = v.doc_id")
def hybrid_rrf(spark, d):
    lex, vec = _legs(spark, d)
    return retrieval.fuse_rrf(lex, vec, ["qid", "doc_id"], (0.3, 0.7)).select(F.col("qid").cast("long").alias("qid"), "doc_id", F.round("score", 9).alias("score"))


_UNIT = "SELECT DISTINCT routine_id, CAST(part_index AS BIGINT) AS part, CAST(size_chars AS DOUBLE) / 1000 AS score FROM routine_code_unit WHERE index_epoch = (SELECT max(index_epoch) FROM routine_code_unit)"


def _hits(spark, d):
    u = table(spark, d, "routine_code_unit")
    last = u.agg(F.max("index_epoch").alias("index_epoch"))
    return u.join(F.broadcast(last), "index_epoch").select("routine_id", F.col("part_index").cast("long").alias("part"), (F.col("size_chars").cast("double") / 1000).alias("score")).distinct()


@query(
    f"""WITH h AS ({_UNIT}), w AS (SELECT routine_id, part AS first, max(part) OVER x AS last, sum(score) OVER x AS s FROM h WINDOW x AS (PARTITION BY routine_id ORDER BY part RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT routine_id, first, last, round(score, 6) AS score FROM (SELECT *, s - 0.05 * (last - first) AS score, row_number() OVER (PARTITION BY routine_id ORDER BY round(s - 0.05 * (last - first), 9) DESC, first) AS k FROM w) WHERE k = 1"""
)
def best_window(spark, d):
    w = retrieval.best_windows(_hits(spark, d).withColumn("score", F.col("score")), "routine_id", 3, 0.05)
    return w.select("routine_id", "first", "last", F.round("score", 6).alias("score"))


@query(f"WITH h AS ({_UNIT}) SELECT routine_id, round(max(score) + 0.02 * count(*) + 0.3 * list_avg(list_sort(list(score), 'DESC')[1:3]), 6) AS score FROM h GROUP BY routine_id")
def parent_scores(spark, d):
    return retrieval.parent_scores(_hits(spark, d), "routine_id").select("routine_id", F.round("score", 6).alias("score"))


# --- graph

_CALLS = rf"""r AS (SELECT id, name, project_name, owner_qn, body FROM {ROU}), u AS (SELECT project_name, owner_qn, lower(name) AS called, min(id) AS callee FROM r GROUP BY ALL HAVING count(*) = 1),
    c AS (SELECT id AS caller, project_name, owner_qn, lower(unnest(regexp_extract_all(body, '({NAME})\s*\(', 1))) AS called FROM r),
    calls AS (SELECT c.caller, u.callee, count(*) AS calls FROM c JOIN u USING (project_name, owner_qn, called) WHERE c.caller <> u.callee GROUP BY ALL)"""


def _calls(spark, d):
    """Names are taken from the bodies where these are read: no body is shuffled."""
    named = table(spark, d, "routine").select("id", "loaded_at", "name", "project_name", "owner_qn", X.called_names(F.col("body")).alias("called"))
    r = R.current_rows(named, "id", ["name", "project_name", "owner_qn", "called"])
    return graph.recovered_calls(r, F.col("called"), ["project_name", "owner_qn"])


@query(f"WITH {_CALLS} SELECT * FROM calls")
def recovered_calls(spark, d):
    """Call edges found in the bodies, where the name means one routine of the owner."""
    return _calls(spark, d)


@query(f"WITH {_CALLS} SELECT r.id FROM r WHERE id NOT IN (SELECT callee FROM calls)")
def unused_routines(spark, d):
    called = _calls(spark, d).select(F.col("callee").alias("id"))
    return _routines(spark, d, "name").select("id").join(called, "id", "left_anti")


@query(
    f"""WITH RECURSIVE {_CALLS}, s AS (SELECT id FROM {ROU} WHERE is_export), w AS (SELECT id AS start, id AS node, 0 AS depth, [id] AS path FROM s
    UNION ALL SELECT w.start, c.callee, w.depth + 1, list_append(w.path, c.callee) FROM w JOIN calls c ON c.caller = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, c.callee))
    SELECT start, node AS "end", CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM w WHERE depth > 0"""
)
def trails_k(spark, d):
    """All node-simple call paths of up to three steps from exported routines."""
    edges = _calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("rel"))
    starts = _routines(spark, d, "is_export").where("is_export").select(F.col("id").alias("start"))
    return graph.trails(edges, starts, 3).select("start", "end", F.col("depth").cast("long").alias("depth"), F.array_join("nodes", ">").alias("path"))


def _clean(name):
    return rf"nfc_normalize(regexp_replace({name}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'))"


@query(
    f"""WITH RECURSIVE n AS (SELECT 'subsystem_edge' AS t, {_clean("child_qn")} AS c, {_clean("parent_qn")} AS p, loaded_at FROM subsystem_edge UNION ALL SELECT 'child_rel', {_clean("child_qn")}, {_clean("parent_qn")}, loaded_at FROM child_rel),
    e AS (SELECT t, c, nullif(p, '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY loaded_at DESC) AS k FROM n WHERE c <> '') WHERE k = 1),
    s AS (SELECT t, c AS node FROM e WHERE p IS NULL UNION SELECT t, p FROM e WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e x WHERE x.t = e.t AND x.c = e.p)),
    w AS (SELECT t, node AS start, node, 0 AS depth FROM s UNION ALL SELECT w.t, w.start, e.c, w.depth + 1 FROM w JOIN e ON e.t = w.t AND e.p = w.node)
    SELECT t AS edge_table, start, node, CAST(depth AS BIGINT) AS depth FROM w"""
)
def closure(spark, d):
    """All nodes below every name of both link tables that has no parent, with their distance, from the tours' positions."""
    links = [current_links(table(spark, d, t), t) for t in ("subsystem_edge", "child_rel")]
    forest = hierarchies(links[0].unionByName(links[1]))
    return forest.where("depth >= 0").select("edge_table", F.col("root_qn").alias("start"), F.col("node_qn").alias("node"), F.col("depth").cast("long").alias("depth"))


@query(
    f"""WITH RECURSIVE {_CALLS}, e AS (SELECT caller, callee FROM calls UNION SELECT callee, caller FROM calls),
    w AS (SELECT id AS start, id AS node, 0 AS depth FROM r UNION SELECT w.start, e.callee, w.depth + 1 FROM w JOIN e ON e.caller = w.node WHERE w.depth < 4)
    SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY ALL"""
)
def call_subtree_depths(spark, d):
    """Undirected distances over calls, up to four, from every routine."""
    c = cut(_calls(spark, d))
    edges = c.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).unionByName(c.select(F.col("callee").alias("src"), F.col("caller").alias("dst")))
    starts = _routines(spark, d).select(F.col("id").alias("start"))
    return graph.reachable(edges, starts, 4).select("start", "node", F.col("depth").cast("long").alias("depth"))


@query(
    f"""WITH RECURSIVE {_CALLS}, e AS (SELECT DISTINCT caller AS src, callee AS dst, 'CALLS' AS rel FROM calls UNION SELECT owner_qn, id, 'HAS_ROUTINE' FROM r WHERE owner_qn IS NOT NULL),
    w AS (SELECT o.owner_qn AS start, o.owner_qn AS node, 0 AS depth, [o.owner_qn] AS path, o.owner_qn AS text FROM (SELECT DISTINCT owner_qn FROM r WHERE owner_qn IS NOT NULL) o
    UNION ALL SELECT w.start, e.dst, w.depth + 1, list_append(w.path, e.dst), w.text || ' -[' || e.rel || ']-> ' || e.dst FROM w JOIN e ON e.src = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.dst))
    SELECT DISTINCT start, node AS "end", CAST(depth AS BIGINT) AS depth, text AS path FROM w WHERE depth > 0"""
)
def dependency_paths(spark, d):
    """Dependency paths of the objects of all projects over routines and calls."""
    r = cut(_routines(spark, d, "owner_qn").where("owner_qn is not null"))
    calls = cut(_calls(spark, d)).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("rel"))
    edges = calls.unionByName(r.select(F.col("owner_qn").alias("src"), F.col("id").alias("dst"), F.lit("HAS_ROUTINE").alias("rel")))
    found = graph.dependency_paths(edges, r.select(F.col("owner_qn").alias("start")), "downstream", None, 3)
    return found.select("start", "end", F.col("depth").cast("long").alias("depth"), "path")


# --- incremental

_OLD = "(SELECT c_custkey, c_acctbal, length(c_name) AS size, md5(c_mktsegment) AS digest FROM customer WHERE c_custkey % 10 <> 3)"
_NEW = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, length(c_name) AS size, CASE WHEN c_custkey % 15 = 0 THEN md5('x') ELSE md5(c_mktsegment) END AS digest FROM customer WHERE c_custkey % 10 <> 7)"


@query(
    f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_acctbal = n.c_acctbal AND o.size = n.size THEN 'unchanged'
    WHEN o.digest = n.digest THEN 'touched' ELSE 'changed' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey"""
)
def manifest_diff(spark, d):
    """Two manifests made of the customers: stamps by balance and name length, content by segment."""
    c = table(spark, d, "customer").withColumn("size", F.length("c_name")).withColumn("digest", F.md5("c_mktsegment"))
    old = c.where("c_custkey % 10 <> 3")
    new = c.where("c_custkey % 10 <> 7").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("digest", F.when(F.col("c_custkey") % 15 == 0, F.md5(F.lit("x"))).otherwise(F.col("digest")))
    return R.manifest_changes(old, new, "c_custkey", ["c_acctbal", "size"], "digest")


@query(
    """WITH f AS (SELECT id, min(struct_pack(t := loaded_at, n := name, p := params_text, b := body_hash, d := doc_description, f := file_path, l := line_no)) AS o, max(struct_pack(t := loaded_at, n := name, p := params_text, b := body_hash, d := doc_description, f := file_path, l := line_no)) AS n FROM routine GROUP BY id)
    SELECT change, count(*) AS routines FROM (SELECT CASE WHEN o.n || '(' || o.p <> n.n || '(' || n.p THEN 'signature_changed' WHEN o.b IS DISTINCT FROM n.b OR o.f IS DISTINCT FROM n.f THEN 'body_changed' WHEN o.d IS DISTINCT FROM n.d THEN 'doc_changed' WHEN o.l IS DISTINCT FROM n.l THEN 'line_only' ELSE 'unchanged' END AS change FROM f) GROUP BY change"""
)
def routine_delta_classes(spark, d):
    """First against last delivery of every routine."""
    r = table(spark, d, "routine")
    v = F.struct("loaded_at", "name", "params_text", "body_hash", "doc_description", "file_path", "line_no")
    both = r.groupBy("id").agg(F.min(v).alias("o"), F.max(v).alias("n"))
    side = lambda s: both.select("id", F.concat(f"{s}.name", F.lit("("), f"{s}.params_text").alias("sig"), *[F.col(f"{s}.{c}").alias(c) for c in ("body_hash", "doc_description", "file_path", "line_no")])
    return R.routine_delta(side("o"), side("n"), "id", "sig", "body_hash", "doc_description", "file_path", "line_no").groupBy("change").agg(F.count(F.lit(1)).alias("routines"))


@query(f"WITH {_TOK_CTE} SELECT token, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS df FROM post GROUP BY token HAVING sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) <> 0")
def signed_delta(spark, d):
    """Document frequencies as signed contributions: even documents are added, odd ones taken away, zeros left out."""
    posted = _posted(spark, d)
    signed = posted.groupBy("token").agg(F.sum(F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)).alias("df"))
    return signed.where("df <> 0")


@query("SELECT body_hash, count(DISTINCT id) AS routines, min(id) AS kept FROM routine GROUP BY body_hash")
def content_hash_dedup(spark, d):
    """Routines of the same content and the one of them that stays."""
    return table(spark, d, "routine").groupBy("body_hash").agg(F.count_distinct("id").alias("routines"), F.min("id").alias("kept"))
