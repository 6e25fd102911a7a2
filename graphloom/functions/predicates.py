"""Predicates of the typed queries, as Column expressions; over a table of current rows they reach its scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_MODES = ("exact", "starts_with", "contains")


def matches(field: Column, text: str, mode: str = "exact") -> Column:
    """Case-insensitive comparison; the text is literal in every mode."""
    return matches_norm(F.lower(field), text, mode)


def matches_norm(lowered: Column, text: str, mode: str = "exact") -> Column:
    """The same over a column that is stored in lower case."""
    value = text.lower()
    if mode == "exact":
        return lowered == value
    if mode == "starts_with":
        return lowered.startswith(value)
    if mode == "contains":
        return lowered.contains(value)
    raise ValueError(f"unknown match mode {mode!r}; one of {MATCH_MODES}")


def optional_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """No filter for None; decided here, so the plan has no OR."""
    return df if value is None else df.where(F.col(column) == value)


def in_list(df: DataFrame, column: str, values: Iterable[object] | None, known: Iterable[object] | None = None) -> DataFrame:
    """No filter for an empty list; no rows if values are given but none of them is ``known``."""
    wanted = list(values or [])
    if not wanted:
        return df
    if known is not None:
        wanted = [v for v in wanted if v in set(known)]
    return df.where(F.col(column).isin(*wanted)) if wanted else df.where(F.lit(False))


def in_subtree(column: Column, root: str) -> Column:
    """The node itself or below it; the slash keeps siblings with a longer name out."""
    return (column == root) | column.startswith(root + "/")


def any_equals(items: Column, value: object) -> Column:
    """Whether any element of an array equals a value."""
    return F.exists(items, lambda x: x == value)


def all_in_scope(nodes: Column, root: str) -> Column:
    """Whether all nodes of a path lie in a subtree."""
    return F.forall(nodes, lambda n: in_subtree(n, root))


def first_of(labels: Column, preferred: list[str]) -> Column:
    """The first of the preferred labels that a node has."""
    return F.get(F.filter(F.array(*[F.lit(p) for p in preferred]), lambda p: F.array_contains(labels, p)), F.lit(0))


def pruned(properties: Column, excluded: list[str]) -> Column:
    """A property map without empty values and excluded keys."""
    return F.map_filter(properties, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~k.isin(*excluded))


# Thresholds by the number of query tokens (up to 2, up to 5, more).
MIN_TEXT_SCORE = (2.0, 1.0, 0.1)
MIN_SIMILARITY = (0.25, 0.20, 0.15)


def by_length(query_tokens: int, values: tuple[float, float, float]) -> float:
    """The threshold for a query of so many tokens."""
    return values[0] if query_tokens <= 2 else values[1] if query_tokens <= 5 else values[2]


def after_key(columns: list[str], last: tuple) -> Column:
    """Rows after ``last`` in the order of ``columns``: the condition of keyset paging."""
    condition = F.lit(False)
    for i in range(len(columns)):
        same = F.lit(True)
        for j in range(i):
            same = same & (F.col(columns[j]) == F.lit(last[j]))
        condition = condition | (same & (F.col(columns[i]) > F.lit(last[i])))
    return condition


def visible(category: Column, hidden: list[str], flag: Column) -> Column:
    """Whether a row is shown: its category isn't hidden and its flag isn't set; unknown ones are shown."""
    return F.coalesce(~category.isin(*hidden), F.lit(True)) & ~F.coalesce(flag, F.lit(False))


def covered(category: Column, wanted: list[str] | None, hidden: list[str], regulated: Column, with_regulated: bool = False) -> Column:
    """Whether a search covers a row: wanted categories put the hidden ones out of force, regulated rows are left out either way unless asked for."""
    rule = category.isin(*wanted) if wanted else F.coalesce(~category.isin(*hidden), F.lit(True)) if hidden else F.lit(True)
    return rule if with_regulated else rule & ~F.coalesce(regulated, F.lit(False))


# Categories with their singular and English names.
CATEGORY_NAMES = {
    "Справочники": ("Справочник", "Catalogs", "Catalog"), "Документы": ("Документ", "Documents", "Document"), "Отчеты": ("Отчет", "Reports", "Report"), "Обработки": ("Обработка", "DataProcessors", "DataProcessor"),
    "Перечисления": ("Перечисление", "Enums", "Enum"), "ОбщиеМодули": ("ОбщийМодуль", "CommonModules", "CommonModule"), "РегистрыСведений": ("РегистрСведений", "InformationRegisters", "InformationRegister"),
    "РегистрыНакопления": ("РегистрНакопления", "AccumulationRegisters", "AccumulationRegister"), "ПланыВидовХарактеристик": ("ПланВидовХарактеристик", "ChartsOfCharacteristicTypes", "ChartOfCharacteristicTypes"),
}
#: Names that mean several categories.
CATEGORY_GROUPS = {"регистры": ("РегистрыСведений", "РегистрыНакопления"), "registers": ("РегистрыСведений", "РегистрыНакопления")}


def canonical_categories(names: Iterable[str]) -> list[str]:
    """The categories that names in either number or language, in any case and with or without blanks, mean; unknown names are left out."""
    table = {n.lower(): (c,) for c, more in CATEGORY_NAMES.items() for n in (c, *more)} | CATEGORY_GROUPS
    return list(dict.fromkeys(c for n in names for c in table.get(n.lower().replace(" ", "").replace("_", ""), ())))
