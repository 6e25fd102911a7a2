"""Scan of text reports: an indented tree of items (``- Category.Object``) and properties (``Key: "value"``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_SCHEMA = "path string, line int, parent int, depth int, item string, key string, value string"


def levels(raw: str) -> tuple[int, str]:
    """(depth, rest) of a line: tabs and fours of blanks count one level each."""
    depth = i = 0
    while True:
        if raw.startswith("\t", i):
            i += 1
        elif raw.startswith("    ", i):
            i += 4
        else:
            return depth, raw[i:].strip()
        depth += 1


def parse(text: str | None) -> Iterator[tuple[int, int | None, int, str | None, str | None, str | None]]:
    """(line from 1, line of the item it belongs to, depth, item, key, value) of a report.

    A line that starts with ``-`` is an item. Any other holds a key and, after a colon, a value in quotes or not;
    deeper lines below it go on with its value, line by line.
    """
    items: list[tuple[int, int]] = []  # (depth, line) of the open items
    held: list | None = None  # the property that is going on

    def done() -> Iterator[tuple]:
        if held is not None:
            *row, values = held
            yield (*row, "\n".join(values) if values else None)

    for n, raw in enumerate((text or "").lstrip("﻿").splitlines(), 1):
        if not raw.strip():
            continue
        depth, line = levels(raw.rstrip())
        if held is not None and depth > held[2] and not line.startswith("-"):
            held[-1].append(line.strip('"'))
            continue
        yield from done()
        held = None
        while items and items[-1][0] >= depth:
            items.pop()
        parent = items[-1][1] if items else None
        if line.startswith("-"):
            items.append((depth, n))
            yield (n, parent, depth, line[1:].strip(), None, None)
            continue
        key, colon, value = line.partition(":")
        if colon:
            value = value.strip().strip('"')
            held = [n, parent, depth, None, key.strip(), [value] if value else []]
    yield from done()


def reports(files: DataFrame) -> DataFrame:
    """(path, line, parent, depth, item, key, value) of report files (path, text); null and empty texts give nothing."""
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse(t)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, _SCHEMA)
