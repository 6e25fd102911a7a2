"""Queries of the metadata model and its tools, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators import model as M
from graphloom.operators import relations as R
from graphloom.plans.session import cut
from graphloom.sources.tables import table
from graphloom.tools import metadata as T

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


_CLEAN = r"nfc_normalize(regexp_replace(object_qn, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))"


def _sql_objects(name: str = "m", where: str = "true") -> str:
    return f"""{name} AS (SELECT qn AS object_qn, string_split(qn, '/')[1] AS project, string_split(qn, '/')[2] AS config, string_split(qn, '/')[3] AS category, string_split(qn, '/')[4] AS object_name, CASE WHEN json_valid(j) THEN j END AS j
        FROM (SELECT qn, object_snapshot_json AS j, row_number() OVER (PARTITION BY qn ORDER BY snapshot_no DESC, delivered_at DESC NULLS LAST, source_type DESC NULLS LAST, object_snapshot_json DESC NULLS LAST) AS k
            FROM (SELECT *, {_CLEAN} AS qn FROM metadata_object_hashes WHERE snapshot_no IS NOT NULL AND object_qn IS NOT NULL AND {where})) WHERE k = 1)"""


def _sql_elements(of: str = "m", name: str = "el") -> str:
    items = lambda field, source, doc: f"unnest(from_json(json_extract({doc}, '$.{field}'), '[\"json\"]')) AS e FROM {source}"
    own = lambda kind, step, field: f"SELECT object_qn, '{kind}' AS kind, CAST(NULL AS VARCHAR) AS container, object_qn || '/{step}/' || json_extract_string(e, '$.name') AS element_qn, e FROM (SELECT object_qn, {items(field, of, 'j')})"
    return f"""{name}0 AS ({own("attribute", "Attribute", "attributes")} UNION ALL {own("form", "Form", "forms")} UNION ALL {own("tabular_part", "TabularPart", "tabular_parts")}
        UNION ALL SELECT object_qn, 'tabular_attribute', c, object_qn || '/TabularPart/' || c || '/Attribute/' || json_extract_string(e, '$.name'), e FROM (SELECT object_qn, c, {items("attributes", f"(SELECT object_qn, json_extract_string(e, '$.name') AS c, e AS p FROM (SELECT object_qn, {items('tabular_parts', of, 'j')}))", "p")})),
        {name} AS (SELECT object_qn, kind, container, element_qn, json_extract_string(e, '$.name') AS name, CASE WHEN kind = 'tabular_part' THEN [] ELSE coalesce(from_json(json_extract(e, '$.properties."Тип"'), '["varchar"]'), []) END AS types, json_extract(e, '$.properties') AS props FROM {name}0)"""


_M = f"WITH {_sql_objects()}"
_E = f"{_M}, {_sql_elements()}"
_CATEGORY = "CASE h " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"Справочник": "Справочники", "Документ": "Документы", "Перечисление": "Перечисления", "ОпределяемыйТип": "ОпределяемыеТипы", "РегистрСведений": "РегистрыСведений", "РегистрНакопления": "РегистрыНакопления", "Отчет": "Отчеты", "Обработка": "Обработки"}.items()) + " END"
_U = f"""{_E}, ty AS (SELECT object_qn, kind, container, element_qn, name, unnest(types) AS t FROM el),
    us AS (SELECT *, {_CATEGORY} AS target_category FROM (SELECT *, regexp_replace(split_part(t, '.', 1), '(Ссылка|Объект|НаборЗаписей|Менеджер)$', '') AS h, split_part(t, '.', -1) AS target_name FROM ty WHERE contains(t, '.')))"""


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return M.current_objects(table(spark, d, "metadata_object_hashes"))


@query(f"{_M} SELECT project, config, category, count(*) AS objects FROM m GROUP BY ALL")
def tool_metadata_summary(spark, d):
    return T.metadata(_objects(spark, d))


@query(f"{_M} SELECT project, config, count(*) AS objects, count(DISTINCT category) AS categories FROM m GROUP BY ALL")
def tool_metadata_configurations(spark, d):
    return T.metadata(_objects(spark, d), "configurations")


@query(f"{_M} SELECT category, count(*) AS objects, count(DISTINCT project) AS projects FROM m GROUP BY ALL")
def tool_metadata_categories(spark, d):
    return T.metadata(_objects(spark, d), "categories")


@query(f"{_M} SELECT object_qn, project, config, category, object_name FROM m WHERE contains(lower(object_name), 'заказ') ORDER BY object_qn LIMIT 100 OFFSET 0")
def tool_metadata_objects(spark, d):
    """The first page of the objects with a word in their name."""
    return T.metadata(_objects(spark, d), "objects", name="заказ")


def _found(items: str) -> str:
    return f"{_E} SELECT m.object_qn, m.category, m.object_name, array_to_string(f, ',') AS found FROM m JOIN ({items}) USING (object_qn)"


def _joined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("found", F.array_join("found", ","))


@query(_found("SELECT object_qn, list_sort(list(DISTINCT name)) AS f FROM el WHERE kind = 'attribute' AND starts_with(lower(name), 'цен') GROUP BY object_qn"))
def tool_find_by_attribute(spark, d):
    return _joined(T.find_objects(_objects(spark, d), "attribute", "Цен", "starts_with", limit=None))


@query(_found("SELECT object_qn, list_sort(list(DISTINCT json_extract_string(props, '$.role'))) AS f FROM el WHERE kind = 'form' AND lower(json_extract_string(props, '$.role')) = 'object' GROUP BY object_qn"))
def tool_find_by_form_role(spark, d):
    return _joined(T.find_objects(_objects(spark, d), "form_role", "object", "exact", limit=None))


@query(_found("SELECT object_qn, list_sort(list(DISTINCT name)) AS f FROM el WHERE kind = 'tabular_attribute' AND contains(lower(name), 'сканер') GROUP BY object_qn"))
def tool_find_by_tabular_attribute(spark, d):
    return _joined(T.find_objects(_objects(spark, d), "tabular_attribute", "Сканер", limit=None))


@query(_found("SELECT object_qn, list_sort(list(DISTINCT array_to_string(types, ','))) AS f FROM el WHERE kind = 'attribute' AND contains(lower(array_to_string(types, ',')), 'склады') GROUP BY object_qn"))
def tool_find_by_type(spark, d):
    return _joined(T.find_objects(_objects(spark, d), "attribute_type", "склады", limit=None))


@query(f"{_M} SELECT object_qn, category, object_name, s AS found FROM (SELECT *, json_extract_string(j, '$.properties.\"Синоним\"') AS s FROM m) WHERE contains(lower(s), 'журнал') AND category IN ('Документы', 'Отчеты')")
def tool_find_by_synonym(spark, d):
    return _joined(T.find_objects(_objects(spark, d), "synonym", "журнал", categories=["Документы", "Отчеты"], limit=None))


@query(f"{_E} SELECT object_qn, kind, container, name, array_to_string(types, '|') AS types, json_extract_string(props, '$.\"Синоним\"') AS synonym FROM el")
def tool_structure(spark, d):
    """The structure of every object."""
    return T.structure(_objects(spark, d)).withColumn("types", F.array_join("types", "|"))


@query(f"{_E} SELECT element_qn, object_qn, container, name, array_to_string(types, '|') AS types FROM el WHERE kind = 'attribute' AND contains(lower(name), 'цен')")
def tool_find_elements(spark, d):
    return T.find_elements(_objects(spark, d), "attribute", "цен", limit=None).withColumn("types", F.array_join("types", "|"))


@query(f"{_U} SELECT object_qn, split_part(object_qn, '/', 3) AS category, count(DISTINCT element_qn) AS places FROM us WHERE lower(target_name) = 'склады' AND target_category = 'Справочники' GROUP BY object_qn")
def tool_usages_objects(spark, d):
    return T.usages_of(_objects(spark, d), "objects", "Склады", "Справочники")


@query(f"{_U} SELECT DISTINCT object_qn, split_part(object_qn, '/', 3) AS category, element_qn, kind, t AS type_literal, target_category, target_name FROM us WHERE starts_with(lower(target_name), 'зак') AND container IS NULL")
def tool_usages_paths(spark, d):
    return T.usages_of(_objects(spark, d), "paths", "Зак", match="starts_with", include_tabular=False)


@query(f"{_U} SELECT element_qn, object_qn, kind, container, name, t AS type_literal, target_category, target_name FROM us")
def type_references(spark, d):
    """Every reference of an element's type to a metadata type."""
    return M.usages(M.elements(_objects(spark, d)))


@query(f"{_U} SELECT ty.object_qn, ty.kind, ty.container, ty.name, ty.t AS type_literal, o.object_qn AS target_qn FROM ty LEFT JOIN (SELECT DISTINCT element_qn, t, target_category, target_name FROM us) u ON u.element_qn = ty.element_qn AND u.t = ty.t LEFT JOIN m o ON o.object_qn = split_part(ty.object_qn, '/', 1) || '/' || split_part(ty.object_qn, '/', 2) || '/' || u.target_category || '/' || u.target_name")
def tool_element_types(spark, d):
    return T.element_types(_objects(spark, d))


@query(f"{_M}, p AS (SELECT object_qn, unnest(json_keys(j, '$.properties')) AS key, j FROM m WHERE object_qn = 'sklad_main/УчетСкладаБазовая/Документы' OR starts_with(object_qn, 'sklad_main/УчетСкладаБазовая/Документы/')) SELECT object_qn, key, json_extract_string(j, '$.properties.\"' || key || '\"') AS value FROM p WHERE trim(json_extract_string(j, '$.properties.\"' || key || '\"')) <> '' AND key <> 'meta_uuid'")
def tool_details_prefix(spark, d):
    """The properties of all objects below a name."""
    return T.details(_objects(spark, d), "qualified_name_prefix", "sklad_main/УчетСкладаБазовая/Документы", ("meta_uuid",))


@query(
    f"""{_M}, refs AS (SELECT DISTINCT ref FROM (SELECT object_name AS ref FROM m UNION ALL SELECT category || '.' || upper(object_name) FROM m UNION ALL SELECT object_qn FROM m UNION ALL SELECT object_name || '?' FROM m) WHERE ref IS NOT NULL),
    n AS (SELECT 0 AS tier, lower(object_qn) AS k, object_qn FROM m UNION ALL SELECT 1, lower(config || '/' || category || '/' || object_name), object_qn FROM m UNION ALL SELECT 2, lower(category || '.' || object_name), object_qn FROM m UNION ALL SELECT 3, lower(object_name), object_qn FROM m),
    c AS (SELECT tier, k, count(*) AS candidates, min(object_qn) AS object_qn FROM n GROUP BY ALL),
    f AS (SELECT ref, tier, candidates, object_qn, row_number() OVER (PARTITION BY ref ORDER BY tier) AS i FROM refs LEFT JOIN c ON c.k = lower(trim(ref)))
    SELECT ref, tier, CASE WHEN candidates = 1 THEN object_qn END AS object_qn, coalesce(candidates, 0) AS candidates FROM f WHERE i = 1"""
)
def tool_resolve(spark, d):
    """References of four forms, resolved by the first rule that finds anything."""
    o = cut(_objects(spark, d))
    forms = [F.col("object_name"), F.concat("category", F.lit("."), F.upper("object_name")), F.col("object_qn"), F.concat("object_name", F.lit("?"))]
    return T.resolve(o, o.select(F.explode(F.array(*forms)).alias("ref")).where("ref is not null"))


@query(
    f"""{_E}, known AS (SELECT object_qn, j FROM m WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'), s AS (SELECT unnest(['attributes', 'forms', 'tabular_parts', 'tabular_attributes', 'properties', 'routines']) AS section),
    n AS (SELECT object_qn, CASE kind WHEN 'attribute' THEN 'attributes' WHEN 'form' THEN 'forms' WHEN 'tabular_part' THEN 'tabular_parts' ELSE 'tabular_attributes' END AS section, count(*) AS n FROM el GROUP BY ALL
        UNION ALL SELECT object_qn, 'properties', len(json_keys(j, '$.properties')) FROM known
        UNION ALL SELECT owner_qn, 'routines', count(*) FROM (SELECT owner_qn, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS k FROM routine) WHERE k = 1 GROUP BY owner_qn)
    SELECT object_qn, section, CAST(coalesce(n, 0) AS BIGINT) AS n FROM known CROSS JOIN s LEFT JOIN n USING (object_qn, section)"""
)
def tool_card(spark, d):
    """How much of each section every object has."""
    return T.card(_objects(spark, d), R.current_rows(table(spark, d, "routine"), "id", ["owner_qn"]))


_DIFF = f"""WITH {_sql_objects("m1", "source_type = 'txt'")}, {_sql_objects("m2", "source_type = 'xml'")}, {_sql_elements("m1", "e1")}, {_sql_elements("m2", "e2")},
    shared AS (SELECT object_qn FROM m1 INTERSECT SELECT object_qn FROM m2),
    a AS (SELECT object_qn, kind, coalesce(container, '') AS container, name, max(array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || '=' || coalesce(CAST(json_extract(props, '$."' || k || '"') AS VARCHAR), 'null')), ';')) AS h FROM e1 WHERE object_qn IN (FROM shared) GROUP BY ALL),
    b AS (SELECT object_qn, kind, coalesce(container, '') AS container, name, max(array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || '=' || coalesce(CAST(json_extract(props, '$."' || k || '"') AS VARCHAR), 'null')), ';')) AS h FROM e2 WHERE object_qn IN (FROM shared) GROUP BY ALL),
    j AS (SELECT coalesce(a.object_qn, b.object_qn) AS object_qn, coalesce(a.kind, b.kind) AS kind, coalesce(a.container, b.container) AS container, coalesce(a.name, b.name) AS name,
        CASE WHEN a.object_qn IS NULL THEN 'own' WHEN b.object_qn IS NULL THEN 'base_only' WHEN a.h IS DISTINCT FROM b.h THEN 'modified' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.object_qn = b.object_qn AND a.kind = b.kind AND a.container = b.container AND a.name = b.name)"""


@query(f"{_DIFF} SELECT object_qn, kind, nullif(container, '') AS container, name, state FROM j")
def tool_overlay_diff(spark, d):
    """The elements of the xml source against those of the txt source of the same objects."""
    rows = table(spark, d, "metadata_object_hashes")
    base, overlay = (cut(M.current_objects(rows.where(F.col("source_type") == t))) for t in ("txt", "xml"))
    return T.overlay_diff(base, overlay, F.col("object_qn"), include_unchanged=True)


@query(
    f"""WITH {_sql_objects("m1", "snapshot_no <= 4")}, {_sql_objects("m2")}, {_sql_elements("m1", "e1")}, {_sql_elements("m2", "e2")},
    p AS (SELECT 1 AS s, * FROM e1 UNION ALL SELECT 2, * FROM e2), q AS (SELECT s, object_qn, kind, coalesce(container, '') AS container, name,
        max(array_to_string(list_transform(list_filter(list_sort(json_keys(props)), lambda k: k <> 'meta_uuid'), lambda k: k || '=' || coalesce(CAST(json_extract(props, '$."' || k || '"') AS VARCHAR), 'null')), ';')) AS h FROM p GROUP BY ALL)
    SELECT object_qn, kind, nullif(container, '') AS container, name, action FROM (SELECT object_qn, kind, container, name, CASE WHEN bool_and(s = 2) THEN 'added' WHEN bool_and(s = 1) THEN 'removed' WHEN count(DISTINCT coalesce(h, '')) > 1 THEN 'changed' END AS action FROM q GROUP BY ALL) WHERE action IS NOT NULL"""
)
def child_changes(spark, d):
    """Elements added, removed or changed between the state after the fourth snapshot and the last one."""
    rows = table(spark, d, "metadata_object_hashes")
    return M.child_diff(M.elements(M.current_objects(rows.where("snapshot_no <= 4"))), M.elements(M.current_objects(rows)), ("meta_uuid",))


_EDGES = f"""{_E}, ed AS (SELECT DISTINCT project AS src, project || '/' || config AS dst, 'HAS_CONFIGURATION' AS rel FROM m UNION ALL SELECT DISTINCT project || '/' || config, project || '/' || config || '/' || category, 'HAS_CATEGORY' FROM m
    UNION ALL SELECT project || '/' || config || '/' || category, object_qn, 'CONTAINS_OBJECT' FROM m
    UNION ALL SELECT CASE WHEN container IS NULL THEN object_qn ELSE object_qn || '/TabularPart/' || container END, element_qn, CASE kind WHEN 'form' THEN 'HAS_FORM' WHEN 'tabular_part' THEN 'HAS_TABULAR_PART' ELSE 'HAS_ATTRIBUTE' END FROM el)"""


def _edges(spark, d):
    o = cut(_objects(spark, d))
    return cut(M.containment(o, M.elements(o)))


@query(f"{_EDGES} SELECT src, dst, rel FROM ed")
def model_edges(spark, d):
    """Containment from projects down to elements."""
    return _edges(spark, d)


@query(f"{_EDGES} SELECT DISTINCT a.src AS object_qn, a.dst AS part, b.dst AS attribute FROM ed a JOIN ed b ON a.dst = b.src WHERE a.rel = 'HAS_TABULAR_PART' AND b.rel = 'HAS_ATTRIBUTE'")
def chain_expand(spark, d):
    """Two hops: object, tabular part, its attribute."""
    e = _edges(spark, d)
    a = e.where("rel = 'HAS_TABULAR_PART'").select(F.col("src").alias("object_qn"), F.col("dst").alias("part"))
    b = e.where("rel = 'HAS_ATTRIBUTE'").select(F.col("src").alias("part"), F.col("dst").alias("attribute"))
    return a.join(b, "part").select("object_qn", "part", "attribute").distinct()


@query(f"{_U}, t AS (SELECT m.object_qn AS target, u.element_qn, u.object_qn FROM us u JOIN m ON m.category = u.target_category AND m.object_name = u.target_name AND m.project = split_part(u.object_qn, '/', 1)) SELECT target, count(DISTINCT object_qn) AS users, count(DISTINCT element_qn) AS places FROM t GROUP BY target UNION ALL SELECT target_category || '.' || target_name, count(DISTINCT object_qn), count(DISTINCT element_qn) FROM us GROUP BY ALL")
def two_sided_usage(spark, d):
    """What is used through attributes, by its object where the project has it and by its type's name everywhere."""
    o = cut(_objects(spark, d))
    u = M.usages(M.elements(o)).withColumn("project", F.get(F.split("object_qn", "/"), F.lit(0)))
    target = o.select(F.col("object_qn").alias("target"), "project", F.col("category").alias("target_category"), F.col("object_name").alias("target_name"))
    counts = [F.count_distinct("object_qn").alias("users"), F.count_distinct("element_qn").alias("places")]
    real = u.join(target, ["project", "target_category", "target_name"]).groupBy("target").agg(*counts)
    return real.unionByName(u.groupBy("target_category", "target_name").agg(*counts).select((F.concat("target_category", F.lit("."), "target_name")).alias("target"), "users", "places"))


@query(f"{_EDGES}, w AS (SELECT a.src AS start, a.dst AS node, 1 AS depth FROM ed a WHERE a.rel IN ('HAS_TABULAR_PART', 'HAS_ATTRIBUTE') AND a.src IN (SELECT object_qn FROM m) UNION SELECT a.src, b.dst, 2 FROM ed a JOIN ed b ON a.dst = b.src WHERE a.rel IN ('HAS_TABULAR_PART', 'HAS_ATTRIBUTE') AND b.rel IN ('HAS_TABULAR_PART', 'HAS_ATTRIBUTE') AND a.src IN (SELECT object_qn FROM m) UNION SELECT object_qn, object_qn, 0 FROM m) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL")
def mixed_closure(spark, d):
    """Everything below each object over two relations together."""
    o = cut(_objects(spark, d))
    e = M.containment(o, M.elements(o)).where(F.col("rel").isin("HAS_TABULAR_PART", "HAS_ATTRIBUTE"))
    return graph.reachable(e.select("src", "dst"), o.select(F.col("object_qn").alias("start")))


@query(f"{_EDGES} SELECT rel, count(*) AS edges FROM ed WHERE NOT (src = 'sklad_main' OR starts_with(src, 'sklad_main/')) GROUP BY rel")
def project_delete(spark, d):
    """Edges left by relation after everything that a project reaches is deleted."""
    e = _edges(spark, d)
    doomed = graph.reachable(e.select("src", "dst"), e.select(F.lit("sklad_main").alias("start")).limit(1)).select(F.col("node").alias("src"))
    return e.join(doomed, "src", "left_anti").groupBy("rel").agg(F.count(F.lit(1)).alias("edges"))


@query(f"{_E}, f AS (SELECT object_qn, string_agg(name || ':' || coalesce(json_extract_string(props, '$.role'), ''), ',' ORDER BY name, json_extract_string(props, '$.role')) AS forms FROM el WHERE kind = 'form' GROUP BY object_qn) SELECT m.object_qn, coalesce(forms, '') AS forms FROM m LEFT JOIN f USING (object_qn)")
def collected_children(spark, d):
    """Every object with its forms as one list, objects without forms with an empty one; forms are collected before the join."""
    o = cut(_objects(spark, d))
    named = M.elements(o).where("kind = 'form'").groupBy("object_qn").agg(F.array_sort(F.collect_list(F.struct("name", F.coalesce(F.element_at("properties", "role"), F.lit("")).alias("role")))).alias("f"))
    return o.select("object_qn").join(named, "object_qn", "left").select("object_qn", F.coalesce(F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit(":"), x["role"])), ","), F.lit("")).alias("forms"))
