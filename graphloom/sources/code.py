"""Scan of source code: routines with headers, parameters, directives, regions, comments and bodies."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = r"[^\W\d]\w*"
_HIDDEN = re.compile(r'"(?:[^"]|"")*"?|//[^\r\n]*')
_HEADER = re.compile(rf"(?im)(?<![\w.])(?:(?:асинх|async)\s+)?(процедура|функция|procedure|function)\s+({_NAME})\s*\(")
_END = re.compile(r"(?i)(?<![\w.])(?:конецпроцедуры|конецфункции|endprocedure|endfunction)\b")
_REGION = re.compile(rf"(?im)^[^\S\r\n]*#[^\S\r\n]*(?:(?:область|region)[^\S\r\n]+({_NAME})|(конецобласти|endregion))")
_EXPORT = re.compile(r"\s*(?:экспорт|export)\b", re.I)
_LINE = re.compile(r"\r\n|\r|\n")
_SCHEMA = "module string, name string, kind string, is_export boolean, params string, directives array<string>, region string, doc string, line int, end_line int, body string, body_hash string"


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\r\n]", " ", m.group())


def scan(text: str | None) -> Iterator[tuple]:
    """(name, kind, is_export, params, directives, region, doc, line, end line, body, sha256 of the body) of a module's routines in order.

    Literals and comments hide what is in them. A routine without its end keyword ends before the next header or
    with the text. The region is the path of open regions; the comment is the unbroken run of comment lines above
    the header and its directives.
    """
    if not text:
        return
    masked = _HIDDEN.sub(_blank, text)
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    number = lambda at: bisect.bisect_right(starts, at)
    edges, path = [0], [""]
    opened: list[str] = []
    for m in _REGION.finditer(masked):
        opened = opened[:-1] if m.group(2) else [*opened, m.group(1)]
        edges.append(m.start())
        path.append("/".join(opened))
    heads = list(_HEADER.finditer(masked))
    for i, m in enumerate(heads):
        close, depth = m.end(), 1
        limit = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        while close < limit and depth:
            depth += {"(": 1, ")": -1}.get(masked[close], 0)
            close += 1
        end = _END.search(masked, close, limit)
        stop = end.end() if end else limit
        first = number(m.start(1))
        above, directives, doc = first - 2, [], []
        line = lambda k: text[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(text)].strip("\r\n \t﻿")
        while above >= 0 and line(above).startswith("&"):
            directives.insert(0, line(above).split("//")[0].strip())
            above -= 1
        while above >= 0 and line(above).startswith("//"):
            doc.insert(0, line(above))
            above -= 1
        body = text[m.start(1) : stop]
        yield (
            m.group(2), m.group(1), bool(_EXPORT.match(masked, close)), text[m.end() : close - 1].strip(), directives, path[bisect.bisect_right(edges, m.start()) - 1] or None,
            "\n".join(doc) or None, first, number(max(m.start(), stop - 1)), body, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(),
        )


def modules(files: DataFrame, module: str = "path", text: str = "text") -> DataFrame:
    """The routines of module texts; ``module`` is whatever names the text."""
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in scan(t)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.select(module, text).mapInArrow(run, _SCHEMA)
