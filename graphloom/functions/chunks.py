"""Texts cut into chunks for a model with a limited window, and code reduced to its words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of sentences, each two characters long.
SENTENCES = (". ", "! ", "? ", ".\n", "!\n", "?\n")


def chunks_of(text: str | None, size: int, overlap: int, most: int, least: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a stripped text, offsets counting from its first character that is no blank.

    A chunk ends, within ``least`` to ``size`` characters, after the last empty line, else the last line, sentence or
    blank, else at ``size``; the next begins ``overlap`` before that end. At most ``most`` chunks come out.
    """
    text = (text or "").strip()
    if not text or size <= 0 or most <= 0:
        return []
    overlap = max(0, overlap) if overlap < size else max(0, size // 4)
    floor = min(1000, size // 3) if least is None else max(0, least) if (least or 0) < size else max(0, size // 3)
    out, start = [], 0
    while start < len(text) and len(out) < most:
        end = len(text)
        if end - start > size:
            lo, end = start + floor, start + size
            for marks in (("\n\n",), ("\n",), SENTENCES, (" ",)):
                at = max((text.rfind(m, lo, end) + len(m) for m in marks if text.rfind(m, lo, end) >= 0), default=-1)
                if at >= 0:
                    end = at
                    break
        out.append((start, end))
        if end >= len(text):
            break
        start = end - overlap if end - overlap > start else end
    return out


def chunked(df: DataFrame, key: str, text: str, size: int, overlap: int, most: int = 1_000_000, least: int | None = None) -> DataFrame:
    """(key, part, char_start, char_end, chunk) of every text; null and blank ones have none. Texts are cut where they are read."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, part int, char_start int, char_end int, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, starts, ends, texts = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                bare = (t or "").strip()
                for k, (s, e) in enumerate(chunks_of(t, size, overlap, most, least)):
                    rows.append(i)
                    parts.append(k)
                    starts.append(s)
                    ends.append(e)
                    texts.append(bare[s:e])
            keys = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(parts, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=[key, "part", "char_start", "char_end", "chunk"])

    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


_OPEN = re.compile(r"(?i)^\s*(?:если|для|пока|попытка|if|for|while|try)\b")
_CLOSE = re.compile(r"(?i)^\s*(?:конецесли|конеццикла|конецпопытки|endif|enddo|endtry)\b")


def line_depths(code: str) -> list[int]:
    """How many blocks are open before each line of code."""
    out, depth = [], 0
    for line in code.split("\n"):
        if _CLOSE.match(line):
            depth = max(0, depth - 1)
        out.append(depth)
        if _OPEN.match(line):
            depth += 1
    return out


def safe_ranges(code: str | None, window: int, overlap: int, tolerance: int) -> list[tuple[int, int]]:
    """(start, end) of windows over code that end, within ``tolerance`` of their size, before the line with the fewest open blocks, the latest of several; every window goes on by at least a line."""
    if not code:
        return []
    if len(code) <= window + tolerance:
        return [(0, len(code))]
    starts, at = [], 0
    for line in code.split("\n"):
        starts.append(at)
        at += len(line) + 1
    depths = line_depths(code)
    out, begin = [], 0
    while len(code) - begin > window + tolerance:
        near = [(depths[i], -s) for i, s in enumerate(starts) if begin + window - tolerance <= s <= begin + window + tolerance and s > begin]
        end = -min(near)[1] if near else begin + window
        out.append((begin, end))
        back = [s for s in starts if begin < s <= end - overlap]
        begin = max(back) if back and max(back) > begin else end
    out.append((begin, len(code)))
    return out


# Keywords that say nothing about what code is about.
KEYWORDS = frozenset(
    "если тогда иначе иначеесли конецесли для каждого из по цикл конеццикла пока попытка исключение конецпопытки возврат перем знач экспорт новый и или не истина ложь неопределено процедура функция конецпроцедуры конецфункции "
    "if then else elsif endif for each in to do enddo while try except endtry return var val export new and or not true false undefined procedure function endprocedure endfunction".split()
)
_CHAIN = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*")


def compressed(code: str | None) -> str | None:
    """Code as the first occurrences of its names and chains, line by line, keywords left out; never longer than the code itself."""
    if code is None:
        return None
    seen: set[str] = set()
    lines = []
    for line in re.sub(r"//[^\r\n]*", "", code).splitlines():
        fresh = []
        for chain in _CHAIN.findall(line):
            low = chain.lower()
            if low not in KEYWORDS and low not in seen:
                seen.add(low)
                fresh.append(chain)
        if fresh:
            lines.append(" ".join(fresh))
    out = "\n".join(lines)
    return out if len(out) < len(code) else code
