"""Tools over forms, predefined values, rights and event subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.operators import relations as R


def form_structure(controls: DataFrame, form: str | None = None, kinds: list[str] | None = None, name: str | None = None) -> DataFrame:
    """(form, control, kind, depth, position): the controls of one form, or of all, from the top down.

    ``controls`` has form, control, name, kind, depth and position.
    """
    rows = P.in_list(P.optional_equal(controls, "form", form), "kind", kinds)
    rows = rows if name is None else rows.where(P.matches(F.col("name"), name, "contains"))
    return rows.select("form", "control", "kind", "depth", "position")


def flattened(controls: DataFrame, bindings: DataFrame) -> DataFrame:
    """(form, target, controls): what a form is bound to through any of its controls, as one hop; ``bindings`` is (control, target)."""
    return controls.select("form", "control").join(bindings, "control").groupBy("form", "target").agg(F.count_distinct("control").alias("controls"))


def form_links(bindings: DataFrame, controls: DataFrame, mode: str, ref: str | None = None) -> DataFrame:
    """(form, control, target): ``controls_bound_to`` a target, or ``events_handled_by_routine`` where targets are routines; all without a ref."""
    if mode not in ("controls_bound_to", "events_handled_by_routine"):
        raise ValueError(f"unknown mode {mode!r}")
    return P.optional_equal(bindings, "target", ref).join(controls.select("form", "control"), "control").select("form", "control", "target").distinct()


def predefined_values(items: DataFrame, mode: str, criterion: str | None = None, match: str = "contains", flag: str | None = None, value: bool = True) -> DataFrame:
    """(owner, name): predefined items by ``name``, by a ``flag`` among their flags, by ``account_type`` or by one of their ``subconto_type`` values.

    ``items`` has owner, name, flags map<string, boolean>, account_type and subconto array<string>.
    """
    rule = {
        "name": lambda: P.matches(F.col("name"), criterion, match), "flag": lambda: F.coalesce(F.element_at("flags", flag), F.lit(False)) == value,
        "account_type": lambda: F.lower("account_type") == criterion.lower(), "subconto_type": lambda: F.exists("subconto", lambda s: P.matches(s, criterion, match)),
    }
    if mode not in rule:
        raise ValueError(f"unknown mode {mode!r}")
    return items.where(rule[mode]()).select("owner", "name")


def access_rights(rows: DataFrame, mode: str, ref: str | None = None, match: str = "exact", include_conditions: bool = False) -> DataFrame:
    """Effective rights (role, target, rights…): ``roles_of_target``, ``targets_of_role`` or ``all``; a denial wins over any grant.

    ``rows`` has role, target, right, allowed, condition. Only rights that are granted come out, as a sorted list.
    """
    rows = rows if ref is None else rows.where(P.matches(F.col({"roles_of_target": "target", "targets_of_role": "role", "all": "role"}[mode]), ref, match))
    effective = R.effective_rights(rows, ["role", "target"], "right", "allowed", "condition").where("allowed")
    out = effective.groupBy("role", "target").agg(F.array_sort(F.collect_set("right")).alias("rights"), F.max("has_condition").alias("has_condition"), F.min("condition").alias("condition"))
    return out if include_conditions else out.drop("condition")


def subscriptions(rows: DataFrame, mode: str, ref: str | None = None, match: str = "exact") -> DataFrame:
    """Event subscriptions (name, event, handler, sources): ``list`` them by name, those ``of_object`` by one of their sources, their ``sources`` or ``handlers`` one by one."""
    if mode == "list":
        rows = rows if ref is None else rows.where(P.matches(F.col("name"), ref, match))
        return rows.select("name", "event", "handler", F.size("sources").alias("sources"))
    if mode == "of_object":
        return rows.where(F.exists("sources", lambda s: P.matches(s, ref, match))).select("name", "event", "handler")
    rows = rows if ref is None else rows.where(P.matches(F.col("name"), ref, match))
    if mode == "sources":
        return rows.select("name", F.explode("sources").alias("source"))
    if mode == "handlers":
        return rows.select("name", F.substring_index("handler", ".", -1).alias("procedure"), F.get(F.split("handler", r"\."), F.lit(1)).alias("module"))
    raise ValueError(f"unknown mode {mode!r}")
