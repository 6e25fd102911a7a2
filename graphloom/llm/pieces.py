"""Splitting oversized texts at natural boundaries, with overlap.

Method: a text is read in byte ranges with a halo of a few bytes before each; the ranges of a giant text go to
many tasks. Workers find the boundaries within their range; what a line's end needs from the range before (was the
line blank so far, what was its last mark) is kept in a small summary, so the boundary tables are stitched exactly.
Prefix sums of the ranges' code points turn local offsets into global ones, and the pieces are emitted by offset
from a sliding window over the tables: no Python step holds a whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.session import cut

#: Bytes per range.
RANGE_BYTES = 256 * 1024


@dataclass(frozen=True)
class Limits:
    """Sizes in code points: a piece has ``least`` to ``most``; the next begins ``near`` to ``far`` before its end."""

    most: int = 3600
    least: int = 3101
    far: int = 720
    near: int = 480


# Kinds of boundaries, the better the smaller.
BLANK, STATEMENT, LINE, SPACE = 0, 1, 2, 3


def range_boundaries(data: bytes, start: int, end: int, dense: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int, int, int]:
    """Boundaries of the bytes ``start:end`` of ``data``, which may hold a few more bytes on either side.

    Returns (code points, line ends, their kinds, space ends, head mark, tail mark, whether there is a line
    feed). Offsets count code points from the range's own first one. A mark is 0 for nothing but blanks, 1 if
    the last other character is ``;``, else 2: the head mark belongs to what precedes the first line feed, the
    tail mark to what follows the last. Spaces are listed only where line ends are more than ``dense`` apart.
    """
    # Code points that begin in the range belong to it.
    raw = np.frombuffer(data, np.uint8)
    begins = (raw & 0xC0) != 0x80
    raw, begins = raw[start:end], begins[start:end]
    points = int(begins.sum())
    after = np.cumsum(begins)  # code points up to and with this byte
    feeds = np.flatnonzero(raw == 10)
    blank = (raw == 32) | (raw == 9) | (raw == 13)
    marked = np.flatnonzero(~blank & (raw != 10))
    last_mark = np.searchsorted(marked, feeds) - 1  # of each feed: the last byte before it that isn't blank
    line_from = np.r_[-1, feeds[:-1]] if len(feeds) else feeds
    where = np.where(last_mark >= 0, marked[last_mark] if len(marked) else -1, -1)
    empty = where <= line_from
    kinds = np.where(empty, BLANK, np.where((where >= 0) & (raw[where] == 59), STATEMENT, LINE)).astype(np.int8)

    def mark(a: int, b: int) -> int:
        i = np.searchsorted(marked, b) - 1
        return 0 if i < 0 or marked[i] < a else 1 if raw[marked[i]] == 59 else 2

    head = mark(0, int(feeds[0]) if len(feeds) else len(raw))
    tail = mark(int(feeds[-1]) + 1 if len(feeds) else 0, len(raw))
    ends = after[feeds].astype(np.int32)
    # Spaces matter only in long gaps; the range's edges count as long.
    gaps = np.r_[0, ends, points]
    long = np.diff(gaps) > dense
    long[[0, -1]] = True
    spaces = np.flatnonzero((raw == 32) | (raw == 9))
    if long.any() and len(spaces):
        at = after[spaces]
        spaces = at[long[np.minimum(np.searchsorted(ends, at, side="right"), len(long) - 1)]]
    else:
        spaces = np.empty(0)
    return points, ends, kinds, spaces.astype(np.int32), head, tail, int(len(feeds) > 0)


@dataclass
class Walker:
    """Emits the pieces of one text from its boundary tables, range after range in order."""

    limits: Limits
    size: int
    done: int = 0  # code points of the ranges seen
    carry: int = 0  # mark of the line that the ranges seen left open
    start: int = 0
    over: bool = False
    at: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    kind: np.ndarray = field(default_factory=lambda: np.empty(0, np.int8))
    pieces: list[tuple[int, int]] = field(default_factory=list)

    def add(self, begin: int, points: int, ends: np.ndarray, kinds: np.ndarray, spaces: np.ndarray, head: int, tail: int, has_feed: int) -> None:
        """The boundary table of the range that begins at code point ``begin``, the prefix sum of the ranges before it."""
        if has_feed:
            kinds = kinds.copy()
            kinds[0] = (BLANK, STATEMENT, LINE)[head or self.carry]
            self.carry = tail
        else:
            self.carry = tail or self.carry
        new_at = np.r_[ends.astype(np.int64), spaces.astype(np.int64)] + begin
        order = np.argsort(new_at, kind="stable")
        self.at = np.r_[self.at, new_at[order]]
        self.kind = np.r_[self.kind, np.r_[kinds, np.full(len(spaces), SPACE, np.int8)][order]]
        self.done = begin + points
        self._walk()

    def _walk(self) -> None:
        lim = self.limits
        while not self.over:
            if self.size - self.start <= lim.most:
                self.pieces.append((self.start, self.size))
                self.over = True
                break
            if self.done < min(self.size, self.start + lim.most):
                break
            a, b = np.searchsorted(self.at, self.start + lim.least), np.searchsorted(self.at, self.start + lim.most, side="right")
            end = self.start + lim.most
            if b > a:
                best = self.kind[a:b].min()
                end = int(self.at[a:b][self.kind[a:b] == best][-1])
            self.pieces.append((self.start, end))
            a, b = np.searchsorted(self.at, end - lim.far), np.searchsorted(self.at, end - lim.near, side="right")
            lines = self.at[a:b][self.kind[a:b] != SPACE]
            self.start = int(lines[0]) if len(lines) else end - lim.far
        keep = np.searchsorted(self.at, self.start)
        self.at, self.kind = self.at[keep:], self.kind[keep:]


_RANGE = "id string, loaded timestamp_ntz, size long, mark long, part int, points int, ends binary, kinds binary, spaces binary, head byte, tail byte, feed byte, data binary, lead int, width int"
_KEY = ["id", "loaded", "size", "mark", "part"]
_NOTHING = (0, b"", b"", b"", 0, 0, 0)


def _batch(b: pa.RecordBatch, rows: list[int], tables: list[tuple], data: list[bytes | None], lead: list[int], width: list[int]) -> pa.RecordBatch:
    kept = b.select(_KEY).take(pa.array(rows, pa.int64()))
    columns = list(zip(*tables, strict=True)) if tables else [()] * 7
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int8(), pa.int8(), pa.int8())
    return pa.RecordBatch.from_arrays(
        [*kept.columns, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(data, pa.binary()), pa.array(lead, pa.int32()), pa.array(width, pa.int32())],
        names=[c.split()[0] for c in _RANGE.split(", ")],
    )


def _tables(dense: int, range_bytes: int | None):  # noqa: ANN202
    """Boundary tables of ranges; with ``range_bytes``, where texts are read, those of texts of several ranges are left to others.

    There, too, a delivery older than one already seen by the task is dropped, so a key with very many rows
    sends only a few of them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest: dict[str, tuple] = {}
        for b in batches:
            rows, tables, datas, leads, widths = [], [], [], [], []
            ids, loaded, size, mark = (b.column(n).to_pylist() for n in _KEY[:4])
            data, lead, width = (b.column(n).to_pylist() for n in ("data", "lead", "width"))
            giant = b.column("giant").to_pylist() if range_bytes else [False] * b.num_rows
            done = b.column("ready").to_pylist() if not range_bytes else None
            for i in range(b.num_rows):
                if range_bytes:
                    rank = (loaded[i] is not None, loaded[i] or 0, size[i], mark[i])
                    best = newest.get(ids[i])
                    if best is not None and rank < best:
                        continue
                    newest[ids[i]] = rank
                rows.append(i)
                if done is not None and done[i] is not None:
                    tables.append(tuple(done[i].values()))
                    datas.append(None)
                elif data[i] is None or giant[i]:
                    tables.append(_NOTHING)
                    datas.append(data[i])
                else:
                    points, ends, kinds, spaces, head, tail, feed = range_boundaries(data[i], lead[i], lead[i] + width[i], dense)
                    tables.append((points, ends.tobytes(), kinds.tobytes(), spaces.tobytes(), head, tail, feed))
                    datas.append(None)
                leads.append(lead[i])
                widths.append(width[i])
            yield _batch(b, rows, tables, datas, leads, widths)

    return run


def _emit(limits: Limits):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by id, the current text first, part: emits the pieces of the current text of each id."""
        ident: str | None = None
        text, walker, seen = None, None, -1
        for b in batches:
            ids, indices, starts, ends_ = [], [], [], []
            col = {n: b.column(n).to_pylist() for n in b.schema.names}
            for i, key in enumerate(col["id"]):
                this = (col["loaded"][i], col["size"][i], col["mark"][i])
                if key != ident:
                    ident, text, seen = key, this, -1
                    walker = Walker(limits, col["size"][i]) if col["size"][i] > limits.most else None
                if walker is None or this != text or col["part"][i] <= seen:
                    continue  # an earlier delivery, or the same one again
                seen = col["part"][i]
                before = len(walker.pieces)
                walker.add(
                    col["begin"][i], col["points"][i], np.frombuffer(col["ends"][i], np.int32), np.frombuffer(col["kinds"][i], np.int8), np.frombuffer(col["spaces"][i], np.int32),
                    col["head"][i], col["tail"][i], col["feed"][i],
                )
                for k in range(before, len(walker.pieces)):
                    ids.append(key)
                    indices.append(k)
                    starts.append(walker.pieces[k][0])
                    ends_.append(walker.pieces[k][1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(indices, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends_, pa.int64())],
                names=["id", "part_index", "char_start", "char_end"],
            )

    return run


def _stitched(tables: DataFrame, limits: Limits) -> DataFrame:
    """Prefix sums of the code points of each text's ranges, then the pieces by offset.

    One sort by (id, current text first, part) serves the sums and the emission.
    """
    own = tables.select(*_KEY, "points", "ends", "kinds", "spaces", "head", "tail", "feed").repartition("id")
    order = [F.col("loaded").desc_nulls_last(), F.col("size").desc(), F.col("mark").desc(), F.col("part")]
    w = Window.partitionBy("id").orderBy(*order)
    last = lambda c: F.lag(c).over(w)
    again = last("loaded").eqNullSafe(F.col("loaded")) & (last("size") == F.col("size")) & (last("mark") == F.col("mark")) & (last("part") == F.col("part"))
    fresh = own.withColumn("fresh", F.when(F.coalesce(again, F.lit(False)), 0).otherwise(F.col("points")).cast("long"))
    summed = fresh.withColumn("begin", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("points")).drop("fresh")
    out = summed.sortWithinPartitions(F.col("id"), *order).mapInArrow(_emit(limits), "id string, part_index int, char_start long, char_end long")
    return out.select("id", "part_index", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))


def pieces(df: DataFrame, key: str, text: str, loaded: str = "loaded_at", limits: Limits = Limits(), range_bytes: int = RANGE_BYTES) -> DataFrame:  # noqa: B008
    """(key, part_index, char_start, char_end): overlapping pieces of every current text above the limit.

    Texts of at most ``limits.most`` code points, null ones included, have no pieces. The first piece starts
    at 0; a rest within the limit is one piece. Otherwise a piece ends, within its allowed lengths, after a
    blank line, else after a line that ends in ``;``, else after any line, else after a space or tab, else at
    the limit, each as late as possible; the next begins at the first line start ``far`` to ``near`` before
    that end, else exactly ``far`` before. The current row of a key is the latest by ``loaded`` (null is the
    earliest; of rows loaded at once the longest counts, of those the larger hash). Null keys are no items; extra
    columns are ignored.

    Scale: a text of one range is turned into its table where it is read; the ranges of a longer one are spread
    over all tasks first. What is shuffled is the tables, about a tenth of the long texts, twice, the ranges of
    giant texts once, and a small row for each short text that may replace a long one.
    """
    body = F.col(text).cast("string")
    size = F.coalesce(F.length(body), F.lit(0)).cast("long")
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(loaded).cast("timestamp_ntz").alias("loaded"), size.alias("size"), F.when(size > limits.most, F.xxhash64(body)).otherwise(0).alias("mark"), body.alias("body")
    )
    # A short text is a row without data: it stands for a body that may replace a long one.
    is_long = F.col("size") > limits.most
    encoded = rows.select("id", "loaded", "size", "mark", F.when(is_long, F.encode("body", "UTF-8")).alias("bytes"))
    last = F.when(is_long, F.floor((F.octet_length("bytes") - 1) / range_bytes)).otherwise(0).cast("int")
    parts = encoded.select("id", "loaded", "size", "mark", "bytes", (last > 0).alias("giant"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    ranged = parts.select(
        *_KEY, F.expr(f"substring(bytes, part * {range_bytes} + 1 - if(part > 0, 4, 0), {range_bytes} + if(part > 0, 4, 0))").alias("data"),
        F.when(F.col("part") > 0, 4).otherwise(0).alias("lead"), F.expr(f"coalesce(least({range_bytes}, octet_length(bytes) - part * {range_bytes}), 0)").cast("int").alias("width"), "giant",
    )
    read = ranged.mapInArrow(_tables(limits.most - limits.least, range_bytes), _RANGE)
    return _stitched(_spread(read, limits), limits).withColumnRenamed("id", key)


def _spread(read: DataFrame, limits: Limits) -> DataFrame:
    """Ranges that still hold their bytes become tables in whatever task they fall to."""
    table = ("points", "ends", "kinds", "spaces", "head", "tail", "feed")
    ready = F.when(F.col("data").isNull(), F.struct(*table)).alias("ready")
    even = read.repartition(F.xxhash64("id", "part")).select(*_KEY, ready, "data", "lead", "width")
    return even.mapInArrow(_tables(limits.most - limits.least, None), _RANGE)


def file_pieces(spark: SparkSession, paths: list[str], limits: Limits = Limits(), range_bytes: int = RANGE_BYTES) -> DataFrame:  # noqa: B008
    """(path, part_index, char_start, char_end): the same for UTF-8 files on a file system that all executors mount.

    Executors look up the sizes; each task seeks to its byte ranges and reads only those; the number of code
    points is summed over the ranges first. Missing files are an error, files within the limit have no pieces.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "id string")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [os.path.getsize(p) for p in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.int64())], names=["id", "bytes"])

    sized = listed.mapInArrow(sizes, "id string, bytes long").where("bytes > 0")
    ranges = sized.select("id", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / range_bytes).cast("int"))).alias("part")).repartition(F.xxhash64("id", "part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, total, part in zip(*(b.column(n).to_pylist() for n in ("id", "bytes", "part")), strict=True):
                lead = 4 if part else 0
                width = min(range_bytes, total - part * range_bytes)
                with open(path, "rb") as f:
                    f.seek(part * range_bytes - lead)
                    data = f.read(width + lead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.nulls(1, pa.timestamp("us")), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.string()), pa.array([data]), pa.array([lead], pa.int32()), pa.array([width], pa.int32())],
                    names=[*_KEY, "ready", "data", "lead", "width"],
                )

    raw = ranges.mapInArrow(read, "id string, loaded timestamp_ntz, size long, mark long, part int, ready string, data binary, lead int, width int")
    # The tables are read for the sizes and for the pieces, the files once.
    tables = cut(raw.mapInArrow(_tables(limits.most - limits.least, None), _RANGE).drop("data"))
    whole = tables.groupBy("id").agg(F.sum("points").cast("long").alias("size"))
    return _stitched(tables.drop("size").join(whole, "id").where(F.col("size") > limits.most), limits).withColumnRenamed("id", "path")
