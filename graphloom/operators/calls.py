"""Call sites of routine bodies and what they call.

A site is direct (``F(…)``), qualified (``A.F(…)``, ``A.B.F(…)``), dynamic (a literal that holds a call) or a
notification (a literal name handed to the constructor of a callback). Sites resolve in tiers against the routines
of the caller's module, of common modules and of object managers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions import text as X
from graphloom.operators.relations import best_candidates, first_of_each

_NAME = r"[^\W\d]\w*"
_PART = re.compile(rf'(?P<string>"(?:[^"]|"")*"?)|(?P<comment>//[^\r\n]*)|(?P<line>\r\n|\r|\n)|(?P<chain>\.?\s*{_NAME}(?:[ \t]*\.[ \t]*{_NAME})*)(?P<open>\s*\()?|(?P<mark>[(),\[\]])|(?P<other>[^\s])')
_DYNAMIC = re.compile(rf'^"\s*({_NAME}(?:\.{_NAME})*)\s*\(')
# Words that stand before a bracket without being called, and those after which a name is declared or made.
_WORDS = frozenset("если иначеесли и или не возврат пока для каждого из по цикл тогда иначе выполнить попытка перейти if elsif and or not return while for each in to do then else execute try goto".split())
_DECLARE, _MAKE = frozenset(("процедура", "функция", "procedure", "function")), frozenset(("новый", "new"))
_CALLBACK = frozenset(("описаниеоповещения", "notifydescription"))
LINES_KEPT = 50


def sites_of(body: str | None) -> list[tuple[str, str, str | None, int | None, int]]:
    """(kind, name, qualifier, arguments, line from 1) of every call in a body, in the order of their names."""
    if not body:
        return []
    found: list[list] = []
    stack: list[list] = []  # [index of the site or None, commas, whether anything stands in the brackets]
    line, before = 1, ""
    for m in _PART.finditer(body):
        kind = m.lastgroup if m.lastgroup != "open" else "chain"
        text = m.group()
        if kind == "line":
            line += 1
            continue
        if kind == "comment":
            continue
        if stack and kind != "mark":
            stack[-1][2] = True
        if kind == "string":
            line += text.count("\n") + text.count("\r") - text.count("\r\n")
            dynamic = _DYNAMIC.match(text)
            if dynamic:
                *rest, name = dynamic.group(1).split(".")
                found.append(["dynamic", name, ".".join(rest) or None, None, line])
            elif stack and stack[-1][0] is not None and stack[-1][1] == 0 and found[stack[-1][0]][0] == "callback" and re.fullmatch(rf'"{_NAME}"', text):
                found.append(["notification", text[1:-1], None, None, line])
        elif kind == "chain":
            chain = re.sub(r"\s+", "", m.group("chain"))
            word = chain.lower()
            start = line
            gap = m.group("chain")
            line += gap.count("\n") + gap.count("\r") - gap.count("\r\n")
            if m.group("open") is not None:
                opened = m.group("open")
                site = None
                if chain.startswith(".") or word in _WORDS or before in _DECLARE:
                    pass
                elif before in _MAKE:
                    if word in _CALLBACK:
                        found.append(["callback", chain, None, None, start])
                        site = len(found) - 1
                else:
                    *rest, name = chain.split(".")
                    found.append(["qualified" if rest else "direct", name, ".".join(rest) or None, 0, start])
                    site = len(found) - 1
                line += opened.count("\n") + opened.count("\r") - opened.count("\r\n")
                stack.append([site, 0, False])
            before = word
            continue
        elif kind == "mark":
            if text in "([":
                if stack:
                    stack[-1][2] = True
                stack.append([None, 0, False])
            elif text == ",":
                if stack:
                    stack[-1][1] += 1
            elif stack:
                site, commas, any_ = stack.pop()
                if site is not None:
                    found[site][3] = commas + 1 if any_ or commas else 0
        before = ""
    return [tuple(f) for f in found if f[0] != "callback"]


def with_sites(rows: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """The columns ``keep`` and ``sites``, the calls of each body, found where the bodies are read: what follows moves names, never bodies."""
    fields = [rows.schema[c] for c in keep]
    item = T._parse_datatype_string("array<struct<kind: string, name: string, qualifier: string, args: int, line: int>>")
    arrow = to_arrow_type(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "name", "qualifier", "args", "line"), site)) for site in sites_of(t)] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(found, arrow)], names=[*keep, "sites"])

    return rows.select(*keep, F.col(body).cast("string").alias("_body")).mapInArrow(run, T.StructType([*fields, T.StructField("sites", item)]))


def call_sites(routines: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(id, kind, name, qualifier, args, line) of every call; null bodies have none."""
    return flat_sites(with_sites(routines.select(F.col(key).cast("string").alias("id"), F.col(body).alias("body")), ["id"]))


def flat_sites(held: DataFrame) -> DataFrame:
    """The same of rows (id, sites)."""
    return held.select("id", F.inline("sites"))


def contexts(directives: Column) -> Column:
    """Where code may run by its directives: client, server, server_no_context, external, or neutral without any."""
    low = F.transform(F.coalesce(directives, F.array().cast("array<string>")), lambda d: F.lower(d))
    has = lambda *words: F.exists(low, lambda d: _any(d, words))
    _any = lambda d, words: F.greatest(*[d.contains(w) for w in words]) if len(words) > 1 else d.contains(words[0])
    client, server = has("наклиенте", "atclient"), F.filter(low, lambda d: _any(d, ("насервере", "atserver")) & ~_any(d, ("наклиенте", "atclient")))
    bare = lambda d: _any(d, ("безконтекста", "nocontext"))
    found = F.filter(
        F.array(
            F.when(client, "client"), F.when(F.exists(server, lambda d: ~bare(d)), "server"), F.when(F.exists(server, bare), "server_no_context"), F.when(has("навнешнемсоединении", "atexternalconnection"), "external")
        ),
        lambda c: c.isNotNull(),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("neutral"))).otherwise(found)


def compatible(caller: Column, callee: Column) -> Column:
    """Whether code in the contexts ``caller`` may call code in the contexts ``callee``."""
    has = F.array_contains
    return (
        (has(callee, "client") & has(callee, "server")) | has(callee, "neutral") | has(caller, "neutral")
        | (has(callee, "server_no_context") & (has(caller, "server") | has(caller, "client"))) | F.arrays_overlap(caller, callee)
    )


def signatures(routines: DataFrame) -> DataFrame:
    """(id, project, config, module_id, category, object_name, module_type, name, least, most, contexts) of routines with id, module_id, owner_qn, module_type, name, params_text, directives."""
    at = F.split("owner_qn", "/")
    params = X.split_params(F.coalesce("params_text", F.lit("")))
    return routines.select(
        "id", F.get(at, F.lit(0)).alias("project"), F.get(at, F.lit(1)).alias("config"), "module_id", F.get(at, F.lit(2)).alias("category"), F.lower(F.get(at, F.lit(3))).alias("object_name"), "module_type",
        F.lower("name").alias("name"), F.size(F.filter(params, lambda p: ~p.contains("="))).alias("least"), F.size(params).alias("most"), contexts(F.col("directives")).alias("contexts"),
    )


def resolve_calls(sites: DataFrame, routines: DataFrame) -> DataFrame:
    """(caller, callee, kind, line, n) of the sites that resolve, ``n`` of them equal.

    Local calls, callbacks and ``ЭтотОбъект`` look in the caller's module and take, of several namesakes, those that
    may run there, then the one with the fewest required and possible parameters. A name behind a common module's
    must fit in its number of arguments first. ``Категория.Объект.Метод`` resolves only if exactly one routine is
    left: of the caller's configuration, else of those that fit in arguments and context, else in arguments.
    """
    s = signatures(routines)
    own = s.select(F.col("id").alias("caller"), F.col("project").alias("p"), F.col("config").alias("c"), F.col("module_id").alias("m"), F.col("contexts").alias("here"))
    rows = sites.withColumnRenamed("id", "caller").join(own, "caller").withColumn("called", F.lower("name")).withColumn("q", F.lower(F.coalesce("qualifier", F.lit(""))))
    # Equal sites of a line resolve alike: once, with their number.
    rows = rows.groupBy("caller", "line", "called", "q", "kind", "args", "p", "c", "m", "here").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("q", r"\.")
    itself = F.col("q").isin("этотобъект", "thisobject")
    callee = s.select(F.col("id").alias("callee"), "project", "config", "module_id", "category", "object_name", "module_type", "name", "least", "most", "contexts")

    local = rows.where((F.col("q") == "") | itself).join(callee, (F.col("m") == F.col("module_id")) & (F.col("called") == F.col("name")))
    common = rows.where((F.col("q") != "") & ~itself & (F.size(parts) == 1)).join(
        callee.where((F.col("category") == "ОбщиеМодули") & (F.col("module_type") == "CommonModule")), (F.col("p") == F.col("project")) & (F.col("q") == F.col("object_name")) & (F.col("called") == F.col("name"))
    )
    fits_args = F.col("args").isNull() | ((F.col("least") <= F.col("args")) & (F.col("args") <= F.col("most")))
    may = compatible(F.col("here"), F.col("contexts"))
    site = ["caller", "line", "called", "q", "kind", "args"]
    # Arguments decide nothing in local direct calls; dynamic and common ones have them checked.
    checked = lambda d, with_args: d.withColumn("tier", F.when((fits_args if with_args else F.lit(True)) & may, 0).when(fits_args if with_args else F.lit(True), 1).otherwise(2))
    order = [F.col("tier"), F.col("least"), F.col("most"), F.col("callee")]
    best = best_candidates(checked(local, False).unionByName(checked(common, True)), site, order)
    best = best.select("caller", "callee", F.when(F.col("q").isin("этотобъект", "thisobject"), "method").otherwise(F.col("kind")).alias("kind"), "line", "n")

    two = rows.where(F.size(parts) == 2).withColumn("cat", F.get(F.split("q", r"\."), F.lit(0))).withColumn("obj", F.get(F.split("q", r"\."), F.lit(1)))
    managed = two.join(callee.where(F.col("module_type") == "ManagerModule"), (F.col("p") == F.col("project")) & (F.col("cat") == F.lower("category")) & (F.col("obj") == F.col("object_name")) & (F.col("called") == F.col("name")))
    w = Window.partitionBy(*site)
    same, both, args_only = F.col("c") == F.col("config"), fits_args & may, fits_args
    number = lambda c: F.count_if(F.coalesce(c, F.lit(False))).over(w)
    counted = managed.withColumn("n0", number(same)).withColumn("n1", number(both)).withColumn("n2", number(args_only))
    kept = counted.where(F.when(F.col("n0") == 1, same).when(F.col("n1") > 0, (F.col("n1") == 1) & both).otherwise((F.col("n2") == 1) & args_only))
    return best.unionByName(kept.select("caller", "callee", F.lit("qualified").alias("kind"), "line", "n"))


def call_edges(resolved: DataFrame, lines_kept: int = LINES_KEPT) -> DataFrame:
    """(caller, callee, kind, calls, lines): edges with the number of sites and their first lines, the lines of an edge ranked before they are collected."""
    edge = ["caller", "callee", "kind"]
    lines = first_of_each(resolved.select(*edge, "line").distinct(), edge, [F.col("line")], lines_kept).groupBy(*edge).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return resolved.groupBy(*edge).agg(F.sum("n").alias("calls")).join(lines, edge)


def invalidated_callers(edges: DataFrame, sites: DataFrame, changes: DataFrame) -> DataFrame:
    """(caller, reason): whose calls must be resolved again after ``changes`` (id, name, change) of routines.

    Three classes: the changed routine itself calls differently (body); the callers of one that went or changed its
    signature (target); those that name a routine that has come or gone, resolved or not (name).
    """
    body = changes.where(F.col("change").isin("added", "body_changed", "signature_changed")).select(F.col("id").alias("caller"), F.lit("body").alias("reason"))
    gone = changes.where(F.col("change").isin("deleted", "signature_changed")).select(F.col("id").alias("callee")).distinct()
    target = edges.join(gone, "callee", "left_semi").select("caller", F.lit("target").alias("reason"))
    names = changes.where(F.col("change").isin("added", "deleted", "signature_changed")).select(F.lower("name").alias("called")).distinct()
    named = sites.select(F.col("id").alias("caller"), F.lower("name").alias("called")).join(names, "called", "left_semi").select("caller", F.lit("name").alias("reason"))
    return body.unionByName(target).unionByName(named).distinct()


def rebuilt(edges: DataFrame, callers: DataFrame, again: DataFrame) -> DataFrame:
    """Edges after the calls of ``callers`` (caller) were resolved anew: theirs from ``again``, the others as they were."""
    doomed = callers.select("caller").distinct()
    return edges.join(doomed, "caller", "left_anti").unionByName(again.join(doomed, "caller", "left_semi"))
