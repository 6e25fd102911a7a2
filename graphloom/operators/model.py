"""The metadata model as node and edge rows, read from the snapshots of its objects.

Nodes are objects and their elements (attributes, tabular parts, their attributes, forms); the name of a node is
that of its owner with its kind and own name behind. Edges are containment and, by the types of attributes, use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import composed_name

_ITEM = "struct<name: string, properties: map<string, string>>"
#: What is read of a snapshot's JSON.
SNAPSHOT = f"name string, properties map<string, string>, attributes array<{_ITEM}>, forms array<{_ITEM}>, tabular_parts array<struct<name: string, properties: map<string, string>, attributes: array<{_ITEM}>>>"
TYPE = "Тип"
# Categories by the prefix of a reference type.
TYPE_CATEGORIES = {
    "Справочник": "Справочники", "Документ": "Документы", "Перечисление": "Перечисления", "ПланВидовХарактеристик": "ПланыВидовХарактеристик",
    "ПланСчетов": "ПланыСчетов", "БизнесПроцесс": "БизнесПроцессы", "Задача": "Задачи", "ПланОбмена": "ПланыОбмена", "ОпределяемыйТип": "ОпределяемыеТипы",
    "РегистрСведений": "РегистрыСведений", "РегистрНакопления": "РегистрыНакопления", "Отчет": "Отчеты", "Обработка": "Обработки",
}


def current_objects(hashes: DataFrame, name: str = "object_qn", snapshot: str = "snapshot_no", delivered: str = "delivered_at", source: str = "source_type", value: str = "object_snapshot_json") -> DataFrame:
    """(object_qn, project, config, category, object_name, model) of every object by its last snapshot.

    Names are trimmed and composed; rows without a name or number are void. The last snapshot, of its deliveries the
    latest, of sources the larger counts. ``model`` is null where the JSON is missing or can't be read.
    """
    named = hashes.where(F.col(name).isNotNull() & F.col(snapshot).isNotNull()).select(composed_name(F.col(name)).alias("object_qn"), F.col(snapshot).alias("s"), F.col(delivered).alias("d"), F.col(source).alias("t"), F.col(value).alias("j"))
    last = named.groupBy("object_qn").agg(F.max(F.struct("s", "d", "t", "j")).alias("v")).select("object_qn", F.col("v.j").alias("j"))
    at = F.split("object_qn", "/")
    parsed = F.when(F.try_parse_json("j").isNotNull(), F.from_json("j", SNAPSHOT))
    return last.select("object_qn", F.get(at, F.lit(0)).alias("project"), F.get(at, F.lit(1)).alias("config"), F.get(at, F.lit(2)).alias("category"), F.get(at, F.lit(3)).alias("object_name"), parsed.alias("model"))


def types_of(properties: Column) -> Column:
    """The type literals of an element: a list, or a single one."""
    text = F.element_at(properties, TYPE)
    one = F.when(text.isNotNull() & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.startswith(text, F.lit("[")), F.coalesce(F.from_json(text, "array<string>"), one)).otherwise(one)


def elements(objects: DataFrame) -> DataFrame:
    """(object_qn, kind, container, element_qn, name, types, properties) of all elements; ``container`` is the tabular part's name or null."""
    none = F.lit(None).cast("string")

    def rows(kind: str, step: str, items: Column) -> DataFrame:
        flat = objects.select("object_qn", F.explode(items).alias("e"))
        return flat.select("object_qn", F.lit(kind).alias("kind"), none.alias("container"), F.concat_ws("/", "object_qn", F.lit(step), "e.name").alias("element_qn"), "e.name", types_of(F.col("e.properties")).alias("types"), "e.properties")

    parts = objects.select("object_qn", F.explode("model.tabular_parts").alias("p")).select("object_qn", F.col("p.name").alias("container"), F.explode("p.attributes").alias("e"))
    inner = parts.select(
        "object_qn", F.lit("tabular_attribute").alias("kind"), "container", F.concat_ws("/", "object_qn", F.lit("TabularPart"), "container", F.lit("Attribute"), "e.name").alias("element_qn"),
        "e.name", types_of(F.col("e.properties")).alias("types"), "e.properties",
    )
    plain = [("attribute", "Attribute", F.col("model.attributes")), ("form", "Form", F.col("model.forms"))]
    flat_parts = objects.select("object_qn", F.explode("model.tabular_parts").alias("e")).select(
        "object_qn", F.lit("tabular_part").alias("kind"), none.alias("container"), F.concat_ws("/", "object_qn", F.lit("TabularPart"), "e.name").alias("element_qn"), "e.name", F.array().cast("array<string>").alias("types"), "e.properties"
    )
    out = flat_parts.unionByName(inner)
    for kind, step, items in plain:
        out = out.unionByName(rows(kind, step, items))
    return out


def type_target(literal: Column) -> Column:
    """(category, name) that a type literal refers to; null for plain types."""
    head, name = F.substring_index(literal, ".", 1), F.substring_index(literal, ".", -1)
    stem = F.regexp_replace(head, "(Ссылка|Объект|НаборЗаписей|Менеджер)$", "")
    table = F.create_map(*[F.lit(x) for pair in TYPE_CATEGORIES.items() for x in pair])
    return F.when(literal.contains("."), F.struct(F.element_at(table, stem).alias("category"), name.alias("name")))


def usages(items: DataFrame) -> DataFrame:
    """(element_qn, object_qn, kind, container, name, type_literal, target_category, target_name): one row for each reference type of an element."""
    flat = items.select("element_qn", "object_qn", "kind", "container", "name", F.explode("types").alias("type_literal"))
    used = flat.withColumn("t", type_target(F.col("type_literal"))).where("t is not null")
    return used.select("element_qn", "object_qn", "kind", "container", "name", "type_literal", F.col("t.category").alias("target_category"), F.col("t.name").alias("target_name"))


def containment(objects: DataFrame, items: DataFrame) -> DataFrame:
    """(src, dst, rel): projects, configurations, categories, objects and elements, each below its owner."""
    at = lambda n: F.concat_ws("/", *["project", "config", "category"][:n])
    up = [
        objects.select(at(1).alias("src"), at(2).alias("dst"), F.lit("HAS_CONFIGURATION").alias("rel")), objects.select(at(2).alias("src"), at(3).alias("dst"), F.lit("HAS_CATEGORY").alias("rel")),
        objects.select(at(3).alias("src"), F.col("object_qn").alias("dst"), F.lit("CONTAINS_OBJECT").alias("rel")),
    ]
    rel = F.when(F.col("kind") == "form", "HAS_FORM").when(F.col("kind") == "tabular_part", "HAS_TABULAR_PART").otherwise("HAS_ATTRIBUTE")
    src = F.when(F.col("container").isNotNull(), F.concat_ws("/", "object_qn", F.lit("TabularPart"), "container")).otherwise(F.col("object_qn"))
    out = items.select(src.alias("src"), F.col("element_qn").alias("dst"), rel.alias("rel"))
    for rows in up:
        out = out.unionByName(rows.distinct())
    return out


def child_diff(old: DataFrame, new: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(object_qn, kind, container, name, action): children added, removed or changed between two states of ``elements``.

    Children are the same by object, kind, container and name, null containers being equal; they have changed if
    any property outside ``excluded`` differs. Repeated children count once, the larger properties standing.
    """
    key = ["object_qn", "kind", "container", "name"]
    kept = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("properties", lambda k, v: ~k.isin(*excluded) if excluded else F.lit(True))))))
    side = lambda d, c: d.select(*[F.coalesce(k, F.lit("")).alias(k) for k in key], kept.alias("h")).groupBy(*key).agg(F.max("h").alias(c), F.lit(True).alias(f"{c}_there"))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    action = F.when(F.col("o_there").isNull(), "added").when(F.col("n_there").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.withColumn("action", action).where("action is not null").select("object_qn", "kind", F.when(F.col("container") != "", F.col("container")).alias("container"), "name", "action")
