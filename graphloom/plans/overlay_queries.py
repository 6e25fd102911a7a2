"""Queries of overlays, forms, rights, handlers and what is left of predicates and set operations, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.functions import text as X
from graphloom.operators import graph, retrieval
from graphloom.operators import incremental as I
from graphloom.operators import model as M
from graphloom.operators import overlay as O
from graphloom.operators import relations as R
from graphloom.operators import search as S
from graphloom.operators.hierarchy import current_links, hierarchies
from graphloom.plans import catalog as K
from graphloom.plans import model_queries as MQ
from graphloom.plans import routine_queries as RQ
from graphloom.plans.session import cut
from graphloom.sources.tables import table
from graphloom.tools import forms as T

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


# --- forms

_CONTROLS = f"""WITH RECURSIVE n AS (SELECT {K._clean("child_qn")} AS c, {K._clean("parent_qn")} AS p, loaded_at FROM child_rel),
    e AS (SELECT c, nullif(p, '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY loaded_at DESC) AS k FROM n WHERE c <> '') WHERE k = 1),
    s AS (SELECT c AS node FROM e WHERE p IS NULL UNION SELECT p FROM e WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e x WHERE x.c = e.p)),
    w AS (SELECT node, 0 AS depth FROM s UNION ALL SELECT e.c, w.depth + 1 FROM w JOIN e ON e.p = w.node),
    ctl AS (SELECT split_part(node, '/Control/', 1) AS form, node AS control, split_part(node, '/', -1) AS name, regexp_extract(split_part(node, '/', -1), '^([^0-9]*)', 1) AS kind, regexp_extract(split_part(node, '/', -1), '([0-9]+)$', 1) AS no, depth FROM w WHERE contains(node, '/Control/'))"""


def _controls(spark, d):
    """(form, control, name, kind, no, depth, position) of all controls that hang in a tree."""
    forest = hierarchies(current_links(table(spark, d, "child_rel"), "child_rel")).where("depth >= 0 and contains(node_qn, '/Control/')")
    name = F.substring_index("node_qn", "/", -1)
    rows = forest.select(F.substring_index("node_qn", "/Control/", 1).alias("form"), F.col("node_qn").alias("control"), name.alias("name"), F.regexp_extract(name, "^([^0-9]*)", 1).alias("kind"), F.regexp_extract(name, "([0-9]+)$", 1).alias("no"), "depth", F.lit(0).alias("position"))
    return cut(rows)


@query(f"{_CONTROLS} SELECT form, control, kind, depth FROM ctl WHERE kind IN ('Поле', 'Таблица')")
def tool_form_structure(spark, d):
    """Fields and tables of all forms with their depth."""
    return T.form_structure(_controls(spark, d), kinds=["Поле", "Таблица"]).drop("position")


@query(f"{_CONTROLS} SELECT form, array_to_string(string_split(form, '/')[1:4], '/') AS target, count(DISTINCT control) AS controls FROM ctl WHERE kind = 'Поле' GROUP BY form")
def form_flattening(spark, d):
    """What each form is bound to through its fields, in one hop."""
    c = _controls(spark, d)
    bound = c.where("kind = 'Поле'").select("control", F.array_join(F.slice(F.split("form", "/"), 1, 4), "/").alias("target"))
    return T.flattened(c, bound)


@query(f"{_CONTROLS} SELECT form, control, array_to_string(string_split(form, '/')[1:4], '/') AS target FROM ctl WHERE kind = 'Кнопка'")
def tool_form_links(spark, d):
    """The controls of all forms that are bound to something."""
    c = _controls(spark, d)
    bound = c.where("kind = 'Кнопка'").select("control", F.array_join(F.slice(F.split("form", "/"), 1, 4), "/").alias("target"))
    return T.form_links(bound, c, "controls_bound_to")


@query(f"{_CONTROLS} SELECT a.form || '_ext' AS overlay_parent, a.form AS base_parent, a.control || '_ext' AS overlay, b.control AS base FROM ctl a JOIN ctl b ON a.form = b.form AND a.no = b.no WHERE a.no <> '' AND CAST(a.no AS BIGINT) % 2 = 0")
def paired_controls(spark, d):
    """Controls of overlay forms with the base controls whose number they carry, within paired forms."""
    c = _controls(spark, d).where("no <> ''")
    pairs = c.select(F.concat("form", F.lit("_ext")).alias("overlay_parent"), F.col("form").alias("base_parent")).distinct()
    base = c.select(F.col("form").alias("parent"), F.col("no").alias("id"), F.col("control").alias("element"))
    over = c.where("cast(no as bigint) % 2 = 0").select(F.concat("form", F.lit("_ext")).alias("parent"), F.col("no").alias("base_id"), F.concat("control", F.lit("_ext")).alias("element"))
    return O.paired_by_id(pairs, base, over)


@query(f"{_CONTROLS} SELECT form AS parent, control AS element FROM ctl WHERE no <> '' AND CAST(no AS BIGINT) % 2 = 1 AND form IN (SELECT form FROM ctl WHERE kind = 'Таблица')")
def only_in_base(spark, d):
    """Controls that no overlay takes over, of forms that have one."""
    c = _controls(spark, d).where("no <> ''")
    partners = c.where("kind = 'Таблица'").select(F.col("form").alias("parent"))
    rows = c.select(F.col("form").alias("parent"), F.col("control").alias("element"))
    return O.only_in_base(rows, c.where("cast(no as bigint) % 2 = 0").select(F.col("control").alias("element")), partners)


# --- overlays of routines and properties

_ENDS = "ends AS (SELECT id, min(struct_pack(t := loaded_at, o := owner_qn, h := body_hash)) AS a, max(struct_pack(t := loaded_at, o := owner_qn, h := body_hash)) AS b FROM routine GROUP BY id)"


@query(f"WITH {_ENDS} SELECT b.o AS overlay_parent, a.o AS base_parent, id AS name, CASE WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'modified' END AS state FROM ends WHERE a.o = b.o")
def paired_parent_join(spark, d):
    """Last deliveries of routines against the first ones, paired by owner and id, compared by hash."""
    v = F.struct("loaded_at", "owner_qn", "body_hash")
    both = table(spark, d, "routine").groupBy("id").agg(F.min(v).alias("a"), F.max(v).alias("b"))
    side = lambda s: both.select(F.col(f"{s}.owner_qn").alias("parent"), F.col("id").alias("name"), F.col(f"{s}.body_hash").alias("digest"))
    pairs = side("a").select(F.col("parent").alias("overlay_parent"), F.col("parent").alias("base_parent")).distinct()
    return O.paired_by_name(pairs, side("a"), side("b"))


_CHANGED = f"x AS (SELECT id, module_id FROM {ROU} WHERE list_contains(list_transform(directives, lambda s: starts_with(lower(s), '&изменениеиконтроль(')), true)), b AS (SELECT module_id, min(id) AS id FROM {ROU} GROUP BY module_id)"


def _interceptions(spark, d):
    """Routines with a decorator against a base routine of that name in each module: the first one stands for it."""
    r = _r(spark, d, "module_id", "directives").withColumnRenamed("module_id", "module")
    base = r.groupBy("module").agg(F.min("id").alias("id")).withColumn("name", F.lit("Базовая"))
    return r, O.interceptions(r, base)


@query(f"WITH {_CHANGED} SELECT x.id, 'change' AS way, 'Базовая' AS called, b.id AS target FROM x LEFT JOIN b USING (module_id)")
def interceptions(spark, d):
    return _interceptions(spark, d)[1]


@query(
    f"""WITH {_CHANGED}, l AS (SELECT x.id, b.id AS target FROM x JOIN b USING (module_id)), t AS (SELECT target AS id, string_agg(id, ',' ORDER BY id) AS xs FROM l GROUP BY target)
    SELECT r.id, CASE WHEN l.id IS NOT NULL THEN 'extension' WHEN t.id IS NOT NULL THEN 'base' ELSE 'none' END AS role, coalesce(l.target, t.xs, '') AS partners FROM {ROU} r LEFT JOIN l USING (id) LEFT JOIN t USING (id)"""
)
def interception_roles(spark, d):
    r, links = _interceptions(spark, d)
    return O.interception_roles(r, links).select("id", "role", F.array_join("partners", ",").alias("partners"))


@query(f"WITH r AS (SELECT id, name, substring(id, 1, 1) AS h FROM {ROU}), b AS (SELECT name, min(id) AS id FROM r GROUP BY name) SELECT r.name AS event, r.id AS overlay_handler, b.id AS base_handler, CASE WHEN h < '3' THEN 'Before' WHEN h < '5' THEN 'After' ELSE 'Override' END AS call_type FROM r JOIN b USING (name) WHERE h < '8'")
def action_extends(spark, d):
    """Actions of an overlay (routines by the first digit of their id) against the main action of their event."""
    r = _r(spark, d, "name").select(F.col("name").alias("event"), F.col("id").alias("handler"), F.substring("id", 1, 1).alias("h"))
    over = r.withColumn("call_type", F.when(F.col("h") < "3", "Before").when(F.col("h") < "5", "After").when(F.col("h") < "8", "Override").otherwise("Main"))
    return O.action_extends(over, r.groupBy("event").agg(F.min("handler").alias("handler")).withColumn("call_type", F.lit("Main")))


@query(f"SELECT a.id AS source, b.id FROM {ROU} a JOIN {ROU} b ON a.owner_qn = b.owner_qn AND lower(a.name) = lower(b.name)")
def handler_links(spark, d):
    """Handlers written as dotted names, resolved within their owner by the last part."""
    r = _r(spark, d, "owner_qn", "name").withColumnRenamed("owner_qn", "owner")
    return O.handler_links(r.select(F.col("id").alias("source"), "owner", F.concat(F.lit(" CommonModule.Х."), F.upper("name"), F.lit(" ")).alias("handler")), r)


_SIDES = f"""WITH {MQ._sql_objects("m1", "source_type = 'txt'")}, {MQ._sql_objects("m2", "source_type = 'xml'")},
    ks AS (SELECT object_qn, unnest(json_keys(j, '$.properties')) AS k FROM m1 UNION SELECT object_qn, unnest(json_keys(j, '$.properties')) FROM m2)"""
_PROP = "json_extract_string({0}.j, '$.properties.\"' || k || '\"')"
_HAS = "list_contains(json_keys({0}.j, '$.properties'), k)"


def _sides(spark, d):
    rows = table(spark, d, "metadata_object_hashes")
    side = lambda t: M.current_objects(rows.where(F.col("source_type") == t)).select("object_qn", F.col("model.properties").alias("p"))
    return side("txt"), side("xml")


@query(f"{_SIDES} SELECT object_qn, string_agg(k || '=' || coalesce(CASE WHEN {_HAS.format('m2')} THEN {_PROP.format('m2')} ELSE {_PROP.format('m1')} END, 'null'), ';' ORDER BY k) AS merged FROM ks JOIN m1 USING (object_qn) JOIN m2 USING (object_qn) GROUP BY object_qn")
def overlay_merge(spark, d):
    """Properties of the txt source with those of the xml source laid over them."""
    a, b = _sides(spark, d)
    both = a.withColumnRenamed("p", "a").join(b.withColumnRenamed("p", "b"), "object_qn").withColumn("m", O.laid_over(F.col("a"), F.col("b"))).where(F.size("m") > 0)
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at("m", k), F.lit("null")))), ";")
    return both.select("object_qn", shown.alias("merged"))


@query(f"{_SIDES} SELECT object_qn, string_agg(k, ',' ORDER BY k) AS changed FROM ks JOIN m1 USING (object_qn) JOIN m2 USING (object_qn) WHERE k <> 'meta_uuid' AND {_PROP.format('m1')} IS DISTINCT FROM {_PROP.format('m2')} GROUP BY object_qn")
def property_changes(spark, d):
    """The properties in which the two sources of an object differ."""
    a, b = _sides(spark, d)
    none = F.create_map().cast("map<string,string>")
    both = a.withColumnRenamed("p", "a").join(b.withColumnRenamed("p", "b"), "object_qn")
    keys = R.map_changes(F.coalesce("a", none), F.coalesce("b", none), ["meta_uuid"])
    return both.select("object_qn", F.array_join(keys, ",").alias("changed")).where("changed <> ''")


@query(
    f"""{MQ._E}, p AS (SELECT object_qn || '/F' AS form, object_qn AS owner, 'Объект.' || upper(name) AS path, 'attribute' AS kind, element_qn AS target FROM el WHERE kind = 'attribute' UNION ALL SELECT object_qn || '/F', object_qn, 'object.' || container || '.' || name, 'tabular_attribute', element_qn FROM el WHERE kind = 'tabular_attribute'
        UNION ALL SELECT object_qn || '/F', object_qn, name, 'form_attribute', element_qn FROM el WHERE kind = 'form' UNION ALL SELECT object_qn || '/F', object_qn, 'Объект.Нет', NULL, NULL FROM m) SELECT DISTINCT * FROM p"""
)
def data_paths(spark, d):
    """Data paths of all forms resolved by ordered rules; one of each form means nothing."""
    o = cut(MQ._objects(spark, d))
    e = cut(M.elements(o).select("object_qn", "kind", "container", "name", "element_qn").distinct())
    form = F.concat("object_qn", F.lit("/F")).alias("form")
    of = lambda kind, path: e.where(F.col("kind") == kind).select(form, F.col("object_qn").alias("owner"), path.alias("path"))
    paths = of("attribute", F.concat(F.lit("Объект."), F.upper("name"))).unionByName(of("tabular_attribute", F.concat_ws(".", F.lit("object"), "container", "name"))).unionByName(of("form", F.col("name")))
    paths = paths.unionByName(o.select(form, F.col("object_qn").alias("owner"), F.lit("Объект.Нет").alias("path"))).distinct()
    pick = lambda kind, *c: e.where(F.col("kind") == kind).select(*c, F.col("element_qn").alias("target"))
    return O.data_paths(paths, pick("attribute", F.col("object_qn").alias("owner"), "name"), pick("tabular_attribute", F.col("object_qn").alias("owner"), "container", "name"), pick("form", form, "name"))


@query(f"SELECT id FROM {ROU} WHERE split_part(owner_qn, '/', 3) = 'ОбщиеМодули' AND is_export AND owner_qn IN (SELECT object_qn FROM {OBJ} WHERE category_name = 'ОбщиеМодули') AND module_type = 'CommonModule'")
def api_marking(spark, d):
    """Exported routines of common modules, the module type standing for their region."""
    r = _r(spark, d, "owner_qn", "is_export", "module_type").withColumn("region", F.concat("module_type", F.lit("/x")))
    listed = K._objects(spark, d, "category_name").where("category_name = 'ОбщиеМодули'").select("object_qn")
    return O.marked_api(r, listed, ["CommonModule"])


@query(
    f"""WITH {RQ._LOCAL}, s AS (SELECT id, 'export' AS reason FROM {ROU} WHERE is_export UNION ALL SELECT id, 'doc' FROM {ROU} WHERE trim(doc_description) <> ''),
    u AS (SELECT caller AS a, callee AS b FROM edges UNION ALL SELECT callee, caller FROM edges), given AS (SELECT id, reason FROM s UNION SELECT u.b, 'via:' || reason FROM u JOIN s ON s.id = u.a) SELECT id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM given GROUP BY id"""
)
def reason_propagation(spark, d):
    """Why routines matter, handed one call on in both directions."""
    r = _r(spark, d, "is_export", "doc_description")
    reasons = r.where("is_export").select("id", F.lit("export").alias("reason")).unionByName(r.where("trim(doc_description) <> ''").select("id", F.lit("doc").alias("reason")))
    return O.propagated(reasons, RQ._edges(spark, d)).select("id", F.array_join("reasons", ",").alias("reasons"))


# --- rights, predefined values, subscriptions

_RIGHTS = "rt AS (SELECT c_mktsegment AS role, o_orderpriority AS target, o_orderstatus AS r, o_totalprice > 1000 AS ok, CASE WHEN c_acctbal < 0 THEN c_name END AS cond FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {_RIGHTS}, e AS (SELECT role, target, r, bool_and(ok) AS ok, bool_or(cond IS NOT NULL) AS h, min(cond) AS cond FROM rt GROUP BY ALL) SELECT role, target, string_agg(r, ',' ORDER BY r) AS rights, bool_or(h) AS has_condition, min(cond) AS condition FROM e WHERE ok GROUP BY role, target")
def tool_access_rights(spark, d):
    """Effective rights of all roles on all targets; orders stand for grants."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = j.select(F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("right"), (F.col("o_totalprice") > 1000).alias("allowed"), F.when(F.col("c_acctbal") < 0, F.col("c_name")).alias("condition"))
    return T.access_rights(rows, "all", include_conditions=True).withColumn("rights", F.array_join("rights", ","))


_ITEMS = "it AS (SELECT r_name AS owner, n_name AS name, n_nationkey % 2 = 0 AS even, CASE WHEN n_nationkey < 10 THEN 'Active' ELSE 'Passive' END AS kind, 'S' || n_nationkey % 3 AS sub FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_ITEMS} SELECT 'name' AS mode, owner, name FROM it WHERE starts_with(lower(name), 'nation_1') UNION ALL SELECT 'flag', owner, name FROM it WHERE NOT even UNION ALL SELECT 'account_type', owner, name FROM it WHERE kind = 'Active' UNION ALL SELECT 'subconto_type', owner, name FROM it WHERE sub = 'S2'")
def tool_predefined_values(spark, d):
    """Predefined items by all four criteria; nations stand for them."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = n.select(F.col("r_name").alias("owner"), F.col("n_name").alias("name"), F.create_map(F.lit("even"), F.col("n_nationkey") % 2 == 0).alias("flags"), F.when(F.col("n_nationkey") < 10, "Active").otherwise("Passive").alias("account_type"), F.array(F.concat(F.lit("S"), (F.col("n_nationkey") % 3).cast("string"))).alias("subconto"))
    found = {"name": T.predefined_values(items, "name", "nation_1", "starts_with"), "flag": T.predefined_values(items, "flag", flag="even", value=False), "account_type": T.predefined_values(items, "account_type", "active"), "subconto_type": T.predefined_values(items, "subconto_type", "s2", "exact")}
    out = None
    for mode, rows in found.items():
        rows = rows.select(F.lit(mode).alias("mode"), "owner", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


_SUBS = f"sb AS (SELECT id, name, routine_type AS event, 'CommonModule.' || split_part(owner_qn, '/', 4) || '.' || name AS handler, owner_category AS s1, module_type AS s2 FROM {ROU} WHERE module_type = 'CommonModule')"


def _subscriptions(spark, d):
    r = _r(spark, d, "name", "routine_type", "owner_qn", "owner_category", "module_type").where("module_type = 'CommonModule'")
    return r.select("name", F.col("routine_type").alias("event"), F.concat(F.lit("CommonModule."), F.get(F.split("owner_qn", "/"), F.lit(3)), F.lit("."), "name").alias("handler"), F.array("owner_category", "module_type").alias("sources"))


@query(f"WITH {_SUBS} SELECT name, event, handler FROM sb WHERE lower(s1) = 'общиемодули' OR lower(s2) = 'общиемодули'")
def tool_subscriptions_of_object(spark, d):
    """Subscriptions to one source; routines of common modules stand for them."""
    return T.subscriptions(_subscriptions(spark, d), "of_object", "ОбщиеМодули")


@query(f"WITH {_SUBS} SELECT name, name AS procedure, split_part(handler, '.', 2) AS module FROM sb")
def tool_subscription_handlers(spark, d):
    return T.subscriptions(_subscriptions(spark, d), "handlers")


# --- predicates, sets, joins that are left

_WALK = f"""e AS (SELECT DISTINCT nullif({K._clean("parent_qn")}, '') AS p, {K._clean("child_qn")} AS c FROM subsystem_edge), g AS (SELECT p, c FROM e WHERE p IS NOT NULL AND c <> '' AND p <> c)"""


@query(f"WITH {_WALK}, x AS (SELECT p AS a, c AS b, NULL AS z FROM g UNION ALL SELECT g.p, g.c, h.c FROM g JOIN g h ON g.c = h.p WHERE h.c <> g.p AND h.c <> g.c) SELECT a AS start, coalesce(z, b) AS \"end\" FROM x WHERE (a = 'sklad_main' OR starts_with(a, 'sklad_main/')) AND (b = 'sklad_main' OR starts_with(b, 'sklad_main/')) AND (z IS NULL OR z = 'sklad_main' OR starts_with(z, 'sklad_main/'))")
def paths_in_scope(spark, d):
    """Paths of up to two links all of whose nodes lie in one project."""
    from graphloom.functions.names import composed_name

    t = table(spark, d, "subsystem_edge").select(composed_name(F.col("parent_qn")).alias("src"), composed_name(F.col("child_qn")).alias("dst"), F.lit("PART").alias("rel")).where("src <> '' and dst <> '' and src <> dst").distinct()
    t = cut(t)
    walked = graph.trails(t, t.select(F.col("src").alias("start")), 2)
    return walked.where(P.all_in_scope(F.col("nodes"), "sklad_main")).select("start", "end")


@query(f"SELECT id, CASE WHEN module_type = 'CommonModule' THEN 'CommonModule' WHEN routine_type = 'Function' THEN 'Function' END AS label FROM {ROU}")
def first_label(spark, d):
    """The first of the preferred labels that a routine has."""
    return _r(spark, d, "module_type", "routine_type").select("id", P.first_of(F.array("routine_type", "module_type"), ["CommonModule", "Function"]).alias("label"))


@query(f"SELECT 'hidden' AS policy, object_qn FROM {OBJ} WHERE category_name NOT IN ('Отчеты') AND NOT contains(obj_name, 'Регламентный') UNION ALL SELECT 'wanted', object_qn FROM {OBJ} WHERE category_name IN ('Отчеты', 'Документы') AND NOT contains(obj_name, 'Регламентный') UNION ALL SELECT 'regulated', object_qn FROM {OBJ} WHERE category_name NOT IN ('Отчеты')")
def coverage_policy(spark, d):
    """Hidden categories, wanted ones that put them out of force, and regulated rows asked for."""
    o = K._objects(spark, d, "category_name", "obj_name")
    category, regulated = F.col("category_name"), F.col("obj_name").contains("Регламентный")
    rules = {"hidden": P.covered(category, None, ["Отчеты"], regulated), "wanted": P.covered(category, ["Отчеты", "Документы"], ["Отчеты"], regulated), "regulated": P.covered(category, None, ["Отчеты"], regulated, True)}
    return o.select("object_qn", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("policy"))


@query(f"SELECT r.id, r.name FROM (SELECT unnest(list(id ORDER BY id)[1:50]) AS id FROM {ROU}) l JOIN {ROU} r USING (id)")
def literal_join(spark, d):
    """Rows of a list of ids given by the caller."""
    ids = [(r["id"],) for r in _r(spark, d, "name").orderBy("id").limit(50).collect()]
    return _r(spark, d, "name").join(F.broadcast(spark.createDataFrame(ids, "id string")), "id").select("id", "name")


@query(f"SELECT e.ext_qn AS extension_qn, o.object_qn AS base_qn FROM {K._EXT} e JOIN {OBJ} o ON replace(e.ext_qn, '/' || e.config_name || '_ext/', '/' || e.config_name || '/') = o.object_qn")
def scoped_pairs(spark, d):
    """Overlay pairs after those of one project were dropped and made anew: the same as all made anew."""
    every = cut(R.overlay_pairs(K._objects(spark, d, "config_name").select("object_qn"), K._overlay(spark, d), "object_qn", K._rewritten()))
    stale = every.where(~F.col("extension_qn").startswith("sklad_main/")).unionByName(every.where(F.col("extension_qn").startswith("sklad_main/")).withColumn("base_qn", F.lit("stale")))
    return I.recomputed(stale, every.where(F.col("extension_qn").startswith("sklad_main/")), "extension_qn", every)


@query(f"WITH {K._BM_CTE} SELECT CAST(qid AS BIGINT) AS qid, doc_id, object_qn FROM bm JOIN documents USING (doc_id)")
def hits_with_rows(spark, d):
    """Hits of a search with the rows they stand for, joined by number."""
    return K._lexical(spark, d).select(F.col("qid").cast("long").alias("qid"), "doc_id").join(table(spark, d, "documents").select("doc_id", "object_qn"), "doc_id")


@query(f"WITH {RQ._FIELDS}, {RQ._ASKED}, parts AS (SELECT qid, id, sum(part) AS score FROM ({RQ._field('symbol', 1.0)}) GROUP BY qid, id UNION ALL SELECT qid, id, sum(part) FROM ({RQ._field('body', 1.0)}) GROUP BY qid, id) SELECT CAST(qid AS BIGINT) AS qid, id, round(max(score), 6) AS score FROM parts GROUP BY qid, id")
def merged_stores(spark, d):
    """Two stores' results by id, the larger score standing."""
    fields = cut(S.fields_of(_r(spark, d, "name", "owner_qn", "body")).select("id", "symbol", "body"))
    legs = [retrieval.bm25(fields.select("id", F.col(c).alias("w")), F.col("w"), RQ._counted(spark), "id") for c in ("symbol", "body")]
    return S.merged(legs).select(F.col("qid").cast("long").alias("qid"), "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {RQ._FIELDS}, {RQ._ASKED}, s AS (SELECT qid, id, sum(part) AS score FROM ({RQ._field("symbol", 1.0)}) GROUP BY qid, id), u AS (SELECT id, module_id AS module FROM {ROU}), m AS (SELECT qid, module, max(score) AS score FROM s JOIN u USING (id) GROUP BY qid, module),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, module) AS k FROM m) WHERE k <= 5), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY id) AS k FROM u) WHERE k <= 3)
    SELECT 'all' AS leg, CAST(qid AS BIGINT) AS qid, u.id, round(max(score), 6) AS score FROM m JOIN u USING (module) GROUP BY qid, u.id UNION ALL SELECT 'local', CAST(qid AS BIGINT), v.id, round(max(score), 6) FROM t JOIN v USING (module) GROUP BY qid, v.id"""
)
def module_expansion(spark, d):
    """Scores of modules on each of their units, and on the first three units of the first five modules."""
    r = cut(S.fields_of(_r(spark, d, "name", "owner_qn", "body")).select("id", "symbol"))
    units = _r(spark, d, "module_id").select("id", F.col("module_id").alias("module"))
    scored = retrieval.bm25(r, F.col("symbol"), RQ._counted(spark), "id").join(units, "id").groupBy("qid", "module").agg(F.round(F.max("score"), 9).alias("score"))
    scored = cut(scored)
    legs = {"all": S.spread_to_units(scored, units), "local": S.spread_to_units(scored, units, 3, 5)}
    out = None
    for name, rows in legs.items():
        rows = rows.select(F.lit(name).alias("leg"), F.col("qid").cast("long").alias("qid"), "id", F.round("score", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT qid, vec_id, round(cos, 6) AS cos FROM (SELECT qid, vec_id, cos, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 12) DESC, vec_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY round(cos, 12) DESC, vec_id) AS k FROM ({K._VEC})) WHERE k <= 3) WHERE r <= 5")
def vector_leg_merged(spark, d):
    """One probe of each category, merged and cut to the best five."""
    q, e = K._vectors(spark, d)
    found = retrieval.blocked_topk(q, e, 3, K.DIM, "label")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("cos", 12).desc(), "id"))).where("r <= 5")
    return ranked.select("qid", F.col("id").alias("vec_id"), F.round("cos", 6).alias("cos"))


@query(K._SQL["dependency_paths"].replace("SELECT DISTINCT start, node", "SELECT start, \"end\", depth, path, row_number() OVER (ORDER BY depth, path) AS path_no FROM (SELECT DISTINCT start, node") + ") ORDER BY depth, path LIMIT 50 OFFSET 100")
def path_page(spark, d):
    """The third page of fifty dependency paths."""
    return graph.page_of_paths(K.dependency_paths(spark, d), 100, 50).withColumn("path_no", F.col("path_no").cast("long"))


@query(f"WITH a AS (SELECT lower(name) AS s, id, 0 AS source FROM {ROU} WHERE is_export UNION ALL SELECT lower(name), id, 1 FROM {ROU}) SELECT s, id, source FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY source, id) AS k FROM a) WHERE k = 1")
def concat_dedup(spark, d):
    """Exported routines, then all, of each name the first."""
    r = _r(spark, d, "name", "is_export")
    rows = r.select(F.lower("name").alias("s"), "id")
    return graph.first_by_signature([r.where("is_export").select(F.lower("name").alias("s"), "id"), rows], ["s"], ["id"])


@query(f"SELECT id, sha256(coalesce(doc_description, '')) AS doc_hash, sha256(lower(name) || '(' || coalesce(params_text, '') || ')' || coalesce(array_to_string(directives, ','), '')) AS signature_hash FROM {ROU}")
def part_hashes(spark, d):
    """Hashes of what may change in a routine apart from its body."""
    r = _r(spark, d, "doc_description", "name", "params_text", "directives")
    signature = F.concat(F.lower("name"), F.lit("("), F.coalesce("params_text", F.lit("")), F.lit(")"), F.coalesce(F.array_join("directives", ","), F.lit("")))
    return r.select("id", F.sha2(F.coalesce("doc_description", F.lit("")), 256).alias("doc_hash"), F.sha2(signature, 256).alias("signature_hash"))


@query(f"SELECT id, array_to_string((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(c) AS x, unnest(range(len(c))) AS i) GROUP BY x))[1:5], ',') AS names FROM (SELECT id, regexp_extract_all(body, '({K.NAME})\\s*\\(', 1) AS c FROM {ROU} WHERE body IS NOT NULL)")
def unique_limited(spark, d):
    """The first five distinct names called in each body, in the order of the body."""
    return _r(spark, d, "body").where("body is not null").select("id", F.nullif(F.array_join(X.distinct_first(X.called_names(F.col("body")), 5), ","), F.lit("")).alias("names"))


@query(f"SELECT id, CAST(len(regexp_extract_all(body, '\"[\\s|]*(?i:выбрать|select)[^\\p{{L}}\\p{{N}}_]')) AS INTEGER) AS queries FROM {ROU} WHERE body IS NOT NULL")
def embedded_queries(spark, d):
    """Numbers of query texts in the literals of each body."""
    return _r(spark, d, "body").where("body is not null").select("id", F.size(X.embedded_queries(F.col("body"))).alias("queries"))


@query(f"{MQ._E} SELECT label, count(*) AS n FROM (SELECT kind AS label FROM el UNION ALL SELECT 'object' FROM m UNION ALL SELECT 'routine' FROM {ROU}) GROUP BY label")
def label_counts(spark, d):
    """Nodes by label."""
    o = cut(MQ._objects(spark, d))
    rows = M.elements(o).select(F.col("kind").alias("label")).unionByName(o.select(F.lit("object").alias("label"))).unionByName(_r(spark, d, "name").select(F.lit("routine").alias("label")))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def window_selection(spark, d):
    """Eight parts of each query (first letters stand for queries) from the best windows of its best routines."""
    hits = K._hits(spark, d).select(F.substring("routine_id", 1, 1).alias("qid"), F.col("routine_id").alias("parent"), F.col("part").cast("int").alias("part"), "score")
    sizes = hits.groupBy("parent").agg((F.max("part") + 1).alias("total"))
    return retrieval.window_selection(hits, sizes, "vector", 8)


@query()
def tool_return_schema(spark, d):
    """Parameters and columns of every tool."""
    from graphloom.tools.schema import schema_rows

    return spark.createDataFrame(schema_rows(), "tool string, parameters string, columns string")
