"""Joins between a base configuration and what extensions lay over it: pairs of elements, interceptions, handlers, merged properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decorators of routines and the way they intercept; of form actions, how they stand to the base's.
DECORATORS = {"перед": "before", "before": "before", "после": "after", "after": "after", "вместо": "instead", "around": "instead", "изменениеиконтроль": "change", "changeandvalidate": "change"}
CALL_TYPES = ("Before", "After", "Override")


def paired_by_name(pairs: DataFrame, base: DataFrame, overlay: DataFrame, parent: str = "parent", name: str = "name", digest: str = "digest") -> DataFrame:
    """(overlay_parent, base_parent, name, state): elements of paired parents (overlay_parent, base_parent) that share a name; ``modified`` if their hashes differ, else ``unchanged``."""
    b = base.select(F.col(parent).alias("base_parent"), F.col(name).alias("name"), F.col(digest).alias("_b"))
    o = overlay.select(F.col(parent).alias("overlay_parent"), F.col(name).alias("name"), F.col(digest).alias("_o"))
    met = o.join(pairs.select("overlay_parent", "base_parent").distinct(), "overlay_parent").join(b, ["base_parent", "name"])
    return met.select("overlay_parent", "base_parent", "name", F.when(F.col("_o").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified").alias("state"))


def paired_by_id(pairs: DataFrame, base: DataFrame, overlay: DataFrame, parent: str = "parent", base_id: str = "id", wanted: str = "base_id") -> DataFrame:
    """(overlay_parent, base_parent, overlay, base): controls of an overlay's form with the control of the paired base form whose number they carry."""
    b = base.select(F.col(parent).alias("base_parent"), F.col(base_id).alias("_id"), F.col("element").alias("base"))
    o = overlay.select(F.col(parent).alias("overlay_parent"), F.col(wanted).alias("_id"), F.col("element").alias("overlay"))
    return o.join(pairs.select("overlay_parent", "base_parent").distinct(), "overlay_parent").join(b, ["base_parent", "_id"]).select("overlay_parent", "base_parent", "overlay", "base")


def only_in_base(base: DataFrame, adopted: DataFrame, partners: DataFrame, parent: str = "parent", element: str = "element") -> DataFrame:
    """(parent, element): elements of base parents that have an overlay, which the overlay doesn't take over; ``adopted`` is (element), ``partners`` (parent)."""
    scoped = base.join(partners.select(parent).distinct(), parent, "left_semi")
    return scoped.select(parent, element).join(adopted.select(element).distinct(), element, "left_anti").select(parent, element)


def interceptions(routines: DataFrame, base: DataFrame) -> DataFrame:
    """(id, way, target): routines with a decorator ``&Way("Name")`` and the base routine of that name in the paired module.

    Both have id, name and module (the module's name in the base configuration); a target that isn't there is null.
    """
    found = routines.select("id", "module", F.explode("directives").alias("d")).select(
        "id", "module", F.lower(F.regexp_extract("d", r"(?u)^&\s*([\p{L}]+)\s*\(", 1)).alias("w"), F.regexp_extract("d", r'\(\s*"([^"]*)"', 1).alias("called")
    )
    table = F.create_map(*[F.lit(x) for pair in DECORATORS.items() for x in pair])
    marked = found.withColumn("way", F.element_at(table, F.col("w"))).where("way is not null")
    targets = base.select("module", F.lower("name").alias("k"), F.col("id").alias("target"))
    return marked.join(targets, [marked["module"] == targets["module"], F.lower("called") == targets["k"]], "left").select("id", "way", "called", "target")


def interception_roles(routines: DataFrame, links: DataFrame) -> DataFrame:
    """(id, role, partners): ``extension`` with its target, ``base`` with those that intercept it, else ``none``."""
    ext = links.where("target is not null").groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("_t"))
    base = links.where("target is not null").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set(F.col("id"))).alias("_x"))
    both = routines.select("id").join(ext, "id", "left").join(base, "id", "left")
    role = F.when(F.col("_t").isNotNull(), "extension").when(F.col("_x").isNotNull(), "base").otherwise("none")
    return both.select("id", role.alias("role"), F.coalesce("_t", "_x", F.array().cast("array<string>")).alias("partners"))


def action_extends(overlay: DataFrame, base: DataFrame) -> DataFrame:
    """(event, overlay_handler, base_handler, call_type): actions of an overlay's events that run before, after or instead of the base's main one."""
    o = overlay.where(F.col("call_type").isin(*CALL_TYPES)).select("event", F.col("handler").alias("overlay_handler"), "call_type")
    return o.join(base.where("call_type = 'Main'").select("event", F.col("handler").alias("base_handler")), "event").select("event", "overlay_handler", "base_handler", "call_type")


def handler_links(handlers: DataFrame, routines: DataFrame, handler: str = "handler") -> DataFrame:
    """(source, id): what names a handler (source, owner, handler) with the routine it means: the last part of a dotted name, in the owner's modules.

    ``routines`` has id, owner and name; case does not matter.
    """
    asked = handlers.select("source", "owner", F.lower(F.substring_index(F.trim(handler), ".", -1)).alias("k")).where("k <> ''")
    return asked.join(routines.select("id", "owner", F.lower("name").alias("k")), ["owner", "k"]).select("source", "id")


def laid_over(base: Column, overlay: Column) -> Column:
    """The properties of a base with those of an overlay over them; either may be null."""
    empty = F.create_map().cast("map<string,string>")
    low, high = F.coalesce(base, empty), F.coalesce(overlay, empty)
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.array_contains(F.map_keys(high), k)), high)


def data_paths(paths: DataFrame, attributes: DataFrame, tabular: DataFrame, form_attributes: DataFrame) -> DataFrame:
    """(form, owner, path, kind, target): what a dotted data path of a form means, by the first rule that finds anything.

    ``Объект.Имя`` and ``Object.Name`` are an attribute of the owner, with a further part one of a tabular part;
    a first part alone is an attribute of the form. ``attributes`` is (owner, name, target), ``tabular`` (owner,
    container, name, target), ``form_attributes`` (form, name, target). What nothing explains has a null target.
    """
    at = F.split("path", r"\.")
    own = F.lower(F.get(at, F.lit(0))).isin("объект", "object")
    rows = paths.select("form", "owner", "path", own.alias("own"), F.size(at).alias("n"), *[F.lower(F.get(at, F.lit(i))).alias(f"p{i}") for i in range(3)])
    a = attributes.select("owner", F.lower("name").alias("p1"), F.col("target").alias("ta"))
    t = tabular.select("owner", F.lower("container").alias("p1"), F.lower("name").alias("p2"), F.col("target").alias("tt"))
    f = form_attributes.select("form", F.lower("name").alias("p0"), F.col("target").alias("tf"))
    met = rows.join(a, ["owner", "p1"], "left").join(t, ["owner", "p1", "p2"], "left").join(f, ["form", "p0"], "left")
    inner, outer = F.col("own") & (F.col("n") == 3) & F.col("tt").isNotNull(), F.col("own") & (F.col("n") == 2) & F.col("ta").isNotNull()
    plain = ~F.col("own") & F.col("tf").isNotNull()
    kind = F.when(inner, "tabular_attribute").when(outer, "attribute").when(plain, "form_attribute")
    return met.select("form", "owner", "path", kind.alias("kind"), F.when(inner, F.col("tt")).when(outer, F.col("ta")).when(plain, F.col("tf")).alias("target"))


def marked_api(routines: DataFrame, composition: DataFrame, areas: list[str], area: str = "region") -> DataFrame:
    """(id): exported routines of the objects a subtree is made of (object_qn) whose region path begins with one of the areas."""
    listed = routines.join(composition.select(F.col("object_qn").alias("owner_qn")).distinct(), "owner_qn", "left_semi")
    inside = F.lit(False)
    for a in areas:
        inside = inside | (F.col(area) == a) | F.col(area).startswith(a + "/")
    return listed.where(F.col("is_export") & F.coalesce(inside, F.lit(False))).select("id")


def propagated(reasons: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reasons): the reasons (id, reason) for which routines matter, theirs and, one call away in either direction, those of their neighbours with ``via:`` before them."""
    via = reasons.withColumn("reason", F.concat(F.lit("via:"), "reason"))
    up = edges.select(F.col("callee").alias("near"), F.col("caller").alias("to")).unionByName(edges.select(F.col("caller").alias("near"), F.col("callee").alias("to")))
    handed = up.join(via.withColumnRenamed("id", "near"), "near").select(F.col("to").alias("id"), "reason")
    return reasons.select("id", "reason").unionByName(handed).groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
