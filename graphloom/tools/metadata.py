"""Tools over the metadata model: inventory, search, structure, usages, types, details, cards and overlay differences.

Each takes the rows of ``operators.model`` and parameters and gives rows; pages are counted after a full order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.operators import model as M

PAGE = 100
SEARCHES = ("name", "synonym", "attribute", "tabular_part", "tabular_attribute", "form", "form_role", "attribute_type")


def page(rows: DataFrame, order: list[str], limit: int | None = PAGE, offset: int = 0) -> DataFrame:
    """One page by ``order``; no limit gives all rows."""
    return rows if limit is None else rows.orderBy(*order).offset(offset).limit(limit)


def metadata(objects: DataFrame, mode: str = "summary", category: str | None = None, config: str | None = None, name: str | None = None, match: str = "contains", limit: int | None = PAGE, offset: int = 0) -> DataFrame:
    """Inventory: ``summary`` counts by project, configuration and category; ``configurations``, ``categories`` and ``objects`` list them."""
    rows = P.optional_equal(P.optional_equal(objects, "category", category), "config", config)
    if mode == "summary":
        return rows.groupBy("project", "config", "category").agg(F.count(F.lit(1)).alias("objects"))
    if mode == "configurations":
        return rows.groupBy("project", "config").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("category").alias("categories"))
    if mode == "categories":
        return rows.groupBy("category").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("project").alias("projects"))
    if mode != "objects":
        raise ValueError(f"unknown mode {mode!r}")
    rows = rows if name is None else rows.where(P.matches(F.col("object_name"), name, match))
    return page(rows.select("object_qn", "project", "config", "category", "object_name"), ["object_qn"], limit, offset)


def find_objects(objects: DataFrame, search_by: str, text: str, match: str = "contains", categories: list[str] | None = None, known: list[str] | None = None, limit: int | None = PAGE, offset: int = 0) -> DataFrame:
    """(object_qn, category, object_name, found): objects that one of their own names, synonyms, elements or types tells."""
    rows = P.in_list(objects, "category", categories, known)
    if search_by == "name":
        hit = rows.where(P.matches(F.col("object_name"), text, match)).withColumn("found", F.array("object_name"))
    elif search_by == "synonym":
        synonym = F.element_at("model.properties", "Синоним")
        hit = rows.where(P.matches(synonym, text, match)).withColumn("found", F.array(synonym))
    elif search_by in SEARCHES:
        kind, named = {
            "attribute": ("model.attributes", lambda e: e["name"]), "tabular_part": ("model.tabular_parts", lambda e: e["name"]), "form": ("model.forms", lambda e: e["name"]),
            "form_role": ("model.forms", lambda e: F.element_at(e["properties"], "role")), "tabular_attribute": (None, lambda e: e["name"]), "attribute_type": ("model.attributes", lambda e: F.concat_ws(",", M.types_of(e["properties"]))),
        }[search_by]
        items = F.col(kind) if kind else F.flatten(F.transform("model.tabular_parts", lambda p: p["attributes"]))
        names = F.filter(F.transform(items, named), lambda n: P.matches(n, text, match))
        hit = rows.withColumn("found", F.array_sort(F.array_distinct(names))).where(F.size("found") > 0)
    else:
        raise ValueError(f"unknown search {search_by!r}; one of {SEARCHES}")
    return page(hit.select("object_qn", "category", "object_name", "found"), ["object_qn"], limit, offset)


def structure(objects: DataFrame, ref: str | None = None, sections: list[str] | None = None, name: str | None = None, match: str = "contains") -> DataFrame:
    """(object_qn, kind, container, name, types, synonym): the elements of one object, or of all."""
    held = objects if ref is None else objects.where(F.col("object_qn") == ref)
    rows = P.in_list(M.elements(held), "kind", sections)
    rows = rows if name is None else rows.where(P.matches(F.col("name"), name, match))
    return rows.select("object_qn", "kind", "container", "name", "types", F.element_at("properties", "Синоним").alias("synonym"))


def find_elements(objects: DataFrame, kind: str, name: str, match: str = "contains", limit: int | None = PAGE, offset: int = 0) -> DataFrame:
    """(element_qn, object_qn, container, name, types) of the elements of a kind by their name."""
    rows = M.elements(objects).where((F.col("kind") == kind) & P.matches(F.col("name"), name, match))
    return page(rows.select("element_qn", "object_qn", "container", "name", "types"), ["element_qn"], limit, offset)


def usages_of(objects: DataFrame, mode: str, target: str, category: str | None = None, match: str = "exact", result_category: str | None = None, include_tabular: bool = True) -> DataFrame:
    """What uses an object by type. ``objects``: (object_qn, category, places); ``paths``: one row for each element."""
    used = M.usages(M.elements(objects)).where(P.matches(F.col("target_name"), target, match))
    used = P.optional_equal(used, "target_category", category)
    used = used if include_tabular else used.where("container is null")
    used = used.withColumn("category", F.get(F.split("object_qn", "/"), F.lit(2)))
    used = P.optional_equal(used, "category", result_category)
    if mode == "paths":
        return used.select("object_qn", "category", "element_qn", "kind", "type_literal", "target_category", "target_name").distinct()
    if mode != "objects":
        raise ValueError(f"unknown mode {mode!r}")
    return used.groupBy("object_qn", "category").agg(F.count_distinct("element_qn").alias("places"))


def element_types(objects: DataFrame, ref: str | None = None, kinds: list[str] | None = None, name: str | None = None) -> DataFrame:
    """(object_qn, kind, container, name, type_literal, target_qn): each type of each element with the object of its configuration it refers to."""
    items = P.in_list(M.elements(objects if ref is None else objects.where(F.col("object_qn") == ref)), "kind", kinds)
    items = items if name is None else items.where(P.matches(F.col("name"), name))
    flat = items.select("object_qn", "kind", "container", "name", F.explode("types").alias("type_literal")).withColumn("t", M.type_target(F.col("type_literal")))
    at = F.split("object_qn", "/")
    flat = flat.withColumn("wanted", F.when(F.col("t.category").isNotNull(), F.concat_ws("/", F.get(at, F.lit(0)), F.get(at, F.lit(1)), "t.category", "t.name")))
    targets = objects.select(F.col("object_qn").alias("wanted"), F.col("object_qn").alias("target_qn"))
    return flat.join(targets, "wanted", "left").select("object_qn", "kind", "container", "name", "type_literal", "target_qn")


def details(objects: DataFrame, mode: str, ref: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(object_qn, key, value): the properties of the objects named by ``qualified_name``, ``qualified_name_prefix`` or ``name``; empty ones left out."""
    rule = {"qualified_name": F.col("object_qn") == ref, "qualified_name_prefix": P.in_subtree(F.col("object_qn"), ref), "name": F.lower("object_name") == ref.lower()}[mode]
    kept = P.pruned(F.col("model.properties"), list(excluded)) if excluded else F.map_filter("model.properties", lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return objects.where(rule).select("object_qn", F.explode(kept).alias("key", "value"))


def resolved(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, tier, target, candidates): what each reference means, by the first rule that finds anything.

    ``names`` is (tier, k, target): under which lower-case names each rule knows each target. More than one target of
    that rule is ambiguous: the reference is then unresolved, with their number.
    """
    counted = names.groupBy("tier", "k").agg(F.count_distinct("target").alias("candidates"), F.min("target").alias("target"))
    met = refs.select("ref").distinct().withColumn("k", F.lower(F.trim("ref"))).join(counted, "k", "left")
    first = met.groupBy("ref").agg(F.min(F.struct("tier", "candidates", "target")).alias("v"))
    return first.select("ref", "v.tier", F.when(F.col("v.candidates") == 1, F.col("v.target")).alias("target"), F.coalesce("v.candidates", F.lit(0)).alias("candidates"))


def _named(rows: DataFrame, target: str, rules: list[Column], first: int = 0) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(first + i).alias("tier"), F.lower(r).alias("k")) for i, r in enumerate(rules)])
    return rows.select(F.col(target).alias("target"), F.inline(keys)).where("k is not null").select("tier", "k", "target")


def resolve(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, tier, object_qn, candidates): objects by the whole qualified name, the name within any project (configuration/category/name), Category.Name or the plain name."""
    rules = [F.col("object_qn"), F.concat_ws("/", "config", "category", "object_name"), F.concat_ws(".", "category", "object_name"), F.col("object_name")]
    return resolved(_named(objects, "object_qn", rules), refs).withColumnRenamed("target", "object_qn")


def start_nodes(objects: DataFrame, routines: DataFrame, forms: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, tier, target, candidates): where a traversal begins, by seven rules in order.

    The id of a routine; the qualified name of an object; that of a form; a name within any project; Category.Name;
    Object.Routine; the plain name of an object. ``routines`` has id, owner_qn and name, ``forms`` form_qn.
    """
    owner = F.get(F.split("owner_qn", "/"), F.lit(3))
    names = _named(routines, "id", [F.col("id")], 0).unionByName(_named(objects, "object_qn", [F.col("object_qn")], 1)).unionByName(_named(forms, "form_qn", [F.col("form_qn")], 2))
    names = names.unionByName(_named(objects, "object_qn", [F.concat_ws("/", "config", "category", "object_name"), F.concat_ws(".", "category", "object_name")], 3))
    names = names.unionByName(_named(routines, "id", [F.concat_ws(".", owner, F.col("name"))], 5)).unionByName(_named(objects, "object_qn", [F.col("object_name")], 6))
    return resolved(names, refs)


def card(objects: DataFrame, routines: DataFrame | None = None) -> DataFrame:
    """(object_qn, section, n): how much of each section every object has, sections without anything at 0."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    inner = F.flatten(F.transform("model.tabular_parts", lambda p: p["attributes"]))
    known = objects.where("model is not null")
    sections = {"attributes": F.col("model.attributes"), "forms": F.col("model.forms"), "tabular_parts": F.col("model.tabular_parts"), "tabular_attributes": inner, "properties": F.map_keys("model.properties")}
    rows = known.select("object_qn", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.greatest(count(c), F.lit(0)).cast("long").alias("n")) for s, c in sections.items()])).alias("v")).select("object_qn", "v.*")
    if routines is not None:
        have = routines.groupBy(F.col("owner_qn").alias("object_qn")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.unionByName(known.select("object_qn").join(have, "object_qn", "left").select("object_qn", F.lit("routines").alias("section"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    return rows


def overlay_diff(base: DataFrame, overlay: DataFrame, to_base: Column, include_unchanged: bool = False) -> DataFrame:
    """(object_qn, kind, container, name, state): elements of an overlay against those of its base objects.

    ``to_base`` turns an overlay's object name into the base's. States: own (only in the overlay), base_only,
    modified, unchanged. Objects without a partner are left out.
    """
    taken = overlay.withColumn("object_qn", to_base)
    pairs = taken.select("object_qn").distinct().join(base.select("object_qn").distinct(), "object_qn")
    a, b = M.elements(base.join(pairs, "object_qn", "left_semi")), M.elements(taken.join(pairs, "object_qn", "left_semi"))
    found = M.child_diff(a, b).select("object_qn", "kind", "container", "name", F.when(F.col("action") == "added", "own").when(F.col("action") == "removed", "base_only").otherwise("modified").alias("state"))
    if not include_unchanged:
        return found
    key = ["object_qn", "kind", "name"]
    same = b.select(*key, "container").distinct().join(found.select(*key, F.col("container").alias("c")), [b[k].eqNullSafe(found[k]) for k in key] + [b["container"].eqNullSafe(F.col("c"))], "left_anti")
    return found.unionByName(same.select("object_qn", "kind", "container", "name", F.lit("unchanged").alias("state")))
