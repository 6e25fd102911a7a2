"""Most similar vectors for every vector.

Method: additive quantisation. A coarse codebook and full-dimensional residual codebooks are trained on a
bounded sample; each vector is encoded by beam search and filed, as a code with its stored norm, under its
``PROBES`` nearest coarse cells. The code ends with a last book, two bits for each element of what the others leave
over. A vector then looks up its own cell: lookup tables of its products with the codebooks score all codes filed
there, the last book refines the scores of those that may be neighbours, and the best are ranked again by their exact
cosine. Where codes cannot tell more candidates apart than are kept, as in a dense group of near copies, the lookup is
answered exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.session import cut, release, tasks_for

#: Vectors of a field that the codebooks are trained on, at most.
SAMPLE = 20_000
#: Residual codebooks, entries of each, and encodings kept by the beam.
BOOKS, ENTRIES, BEAM = 12, 64, 4
#: Cells that hold each code, candidates kept for the exact ranking, and how far a code's score may fall short.
PROBES, KEPT, SLACK = 10, 12, 0.26
#: The last book: values of its two bits and bounds between them, best for normal deviates, and how far a refined score may fall short.
FINE, FINE_BOUND, FINE_SLACK = np.array([-1.510, -0.4528, 0.4528, 1.510], np.float32), 0.9816, 0.08
#: Entries of the two levels of the coarse codebook, at most: together enough cells for some 4 * 10^9 vectors.
FIRST_CELLS, SECOND_CELLS = 8_192, 32
#: Vectors that look up one cell in one task; a cell with more is split.
LOOKUPS = 4_096
ROWS_PER_TASK = 300_000
#: The exact search: vectors of one region on average, lookups of a region in one task, and room for rounding of angles.
REGION, EXACT_LOOKUPS, ROUNDING = 8_192, 16_384, 1e-3


@dataclass
class Books:
    coarse: np.ndarray  # cells x dim, unit length
    residual: np.ndarray  # books x entries x dim


def cells_for(vectors: int, sampled: int) -> tuple[int, int]:
    """(first, second) numbers of coarse entries, whose product, the cells, is about four times the root of the vectors.

    The first level is a power of two of at most half of the sample; beyond it a second level, of the residuals
    that all first entries share, lets the cells grow on with the vectors.
    """
    want = 1 << max(0, round(np.log2(4 * np.sqrt(max(1, vectors)))))
    first = int(max(1, min(want, FIRST_CELLS, sampled // 2)))
    return first, int(min(-(-want // first), SECOND_CELLS)) if want > first else 1


def _means(x: np.ndarray, label: np.ndarray, centres: np.ndarray) -> np.ndarray:
    order = np.argsort(label, kind="stable")
    which, begin = np.unique(label[order], return_index=True)
    out = centres.copy()
    out[which] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.r_[begin, len(label)])[:, None]
    return out


def train(sample: np.ndarray, vectors: int, seed: int = 7) -> Books:
    """Codebooks of unit vectors; deterministic for the same sample."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    if not len(sample):
        return Books(np.zeros((1, dim), np.float32), np.zeros((BOOKS, 1, dim), np.float32))
    k, second = cells_for(vectors, len(sample))
    coarse = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(3):
        coarse = _means(sample, (sample @ coarse.T).argmax(1), coarse)
        coarse /= np.maximum(np.linalg.norm(coarse, axis=1, keepdims=True), 1e-12)
    if second > 1:
        off = sample - coarse[(sample @ coarse.T).argmax(1)]
        fine = off[rng.choice(len(off), min(second, len(off)), replace=False)]
        for _ in range(4):
            fine = _means(off, (off @ fine.T - 0.5 * (fine * fine).sum(1)).argmax(1), fine)
        coarse = (coarse[:, None, :] + fine[None, :, :]).reshape(-1, sample.shape[1])
        coarse /= np.maximum(np.linalg.norm(coarse, axis=1, keepdims=True), 1e-12)
    rest = sample[:10_000]
    rest = rest - coarse[(rest @ coarse.T).argmax(1)]
    books = []
    for _ in range(BOOKS):
        book = rest[rng.choice(len(rest), min(ENTRIES, len(rest)), replace=False)]
        for _ in range(4):
            book = _means(rest, (rest @ book.T - 0.5 * (book * book).sum(1)).argmax(1), book)
        rest = rest - book[(rest @ book.T - 0.5 * (book * book).sum(1)).argmax(1)]
        books.append(np.vstack([book, np.zeros((ENTRIES - len(book), dim))]) if len(book) < ENTRIES else book)
    return Books(np.ascontiguousarray(coarse, np.float32), np.ascontiguousarray(books, np.float32))


def _filed(dim: int) -> np.dtype:
    """A code with the norms of the decoded vector, without and with the last book."""
    return np.dtype([("coarse", np.int32), ("norm", np.float32), ("code", np.uint8, (BOOKS,)), ("fine_norm", np.float16), ("scale", np.float16), ("fine", np.uint8, (-(-dim // 4),))])


def _levels(fine: np.ndarray, dim: int) -> np.ndarray:
    """Values of the last book, to be scaled."""
    return FINE[(fine[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(fine), -1)[:, :dim]]


def encode_vectors(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """(cells, nearest first; what is filed) of unit vectors, the code by beam search."""
    n, dim = x.shape
    near = x @ books.coarse.T  # blocks of x keep this small
    probes = min(PROBES, near.shape[1])
    cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
    cells = np.take_along_axis(cells, np.argsort(-np.take_along_axis(near, cells, 1), axis=1, kind="stable"), 1).astype(np.int32)
    rest = (x - books.coarse[cells[:, 0]])[:, None, :]
    errors = (rest**2).sum(2)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books.residual:
        width, own = rest.shape[1], (book * book).sum(1)
        d = (own - 2 * (rest.reshape(n * width, -1) @ book.T)).reshape(n, width, -1) + errors[:, :, None]
        d = d.reshape(n, -1)
        keep = min(BEAM, d.shape[1])
        top = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        beam, entry = top // len(book), top % len(book)
        rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[entry]
        errors = np.take_along_axis(d, top, 1)
        codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
    best, rows = errors.argmin(1), np.arange(n)
    rest = rest[rows, best]
    filed = np.zeros(n, _filed(dim))
    filed["coarse"], filed["code"] = cells[:, 0], codes[rows, best]
    filed["norm"] = np.maximum(np.linalg.norm(x - rest, axis=1), 1e-6)
    bound = FINE_BOUND * np.sqrt((rest * rest).mean(1, keepdims=True))
    bits = np.zeros((n, 4 * filed["fine"].shape[1]), np.uint8)
    bits[:, :dim] = (rest > -bound).astype(np.uint8) + (rest > 0) + (rest > bound)
    filed["fine"] = (bits.reshape(n, -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)
    levels = FINE[bits[:, :dim]]
    filed["scale"] = (rest * levels).sum(1) / (levels * levels).sum(1)
    filed["fine_norm"] = np.linalg.norm(x - rest + filed["scale"].astype(np.float32)[:, None] * levels, axis=1)
    return cells, filed


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _units(lists: pa.Array, dim: int) -> tuple[list[bytes | None], list[int | None]]:
    """Unit vectors as bytes and the hash that copies of any length share; None where a vector is unusable."""
    blank: list = [None] * len(lists)
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    if not len(right):
        return blank, list(blank)
    flat = lists.take(pa.array(right)).flatten()
    x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(x).all(1)
    x = np.where(finite[:, None], x, 0.0)
    top = np.abs(x).max(1)
    good = finite & (top > 0)
    x = x / np.where(top > 0, top, 1.0)[:, None]
    unit = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]).astype(np.float32)
    rounded = np.rint(unit * 4096).astype(np.int16)
    out, marks = list(blank), list(blank)
    for i, row in enumerate(right):
        if good[i]:
            out[row] = unit[i].tobytes()
            h = xxhash.xxh3_64_intdigest(rounded[i].tobytes())
            marks[row] = h - (1 << 64) if h >= 1 << 63 else h
    return out, marks


@dataclass
class VectorTable:
    """A table with a key and vector fields; the row of a key loaded last is its current one."""

    df: DataFrame
    key: str
    fields: list[str]
    loaded: str = "loaded_at"


def _scan(t: VectorTable, first: int, dim: int, whole: bool) -> DataFrame:
    """The usable vectors as they are read: (id, loaded, marks) with a null mark where there is none, or (field, mark, vec)."""
    n = len(t.fields)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_units(b.column(2 + i), dim)[1] for i in range(n)]
            lists = [list(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["id", "loaded", "marks"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(n):
                vec, mark = _units(b.column(i), dim)
                made = pa.RecordBatch.from_arrays(
                    [pa.array([first + i] * b.num_rows, pa.int32()), pa.array(mark, pa.int64()), pa.array(vec, pa.binary())], names=["field", "mark", "vec"]
                )
                yield made.filter(made.column("vec").is_valid())

    lists = [F.col(f).cast("array<float>").alias(f"f{i}") for i, f in enumerate(t.fields)]
    rows = t.df.where(F.col(t.key).isNotNull())
    if whole:
        return rows.select(*lists).mapInArrow(vectors, "field int, mark long, vec binary")
    return rows.select(F.col(t.key).cast("string").alias("id"), F.col(t.loaded).cast("timestamp_ntz").alias("loaded"), *lists).mapInArrow(marks, "id string, loaded timestamp_ntz, marks array<long>")


def _members(t: VectorTable, first: int, dim: int) -> DataFrame:
    """(field, id, mark) of the usable vectors of the current rows."""
    latest = _scan(t, first, dim, whole=False).groupBy("id").agg(F.max(F.struct("loaded", "marks")).alias("v"))
    each = latest.select("id", F.posexplode("v.marks").alias("i", "mark")).where(F.col("mark").isNotNull())
    return each.select((F.col("i") + first).alias("field"), "id", "mark")


# A slot is the field, cell, part of the cell and kind of a row in one number.
_CELL_BITS, _PART_BITS = 22, 22


def _search(books: dict[int, Books], dim: int, least: float):  # noqa: ANN202
    """Rows sorted by slot: the lookups (kind 0) of a part of a cell, then the codes filed in the cell.

    A lookup with more candidates than KEPT has one more row, without b, with the best score left out. The
    candidates are chosen by refined scores: the number of those that come within SLACK of ``least`` without the
    last book grows with the table.
    """
    rough, floor = least - SLACK, least - FINE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: int | None = None
        seekers: list[tuple[np.ndarray, np.ndarray]] = []
        best: tuple[np.ndarray, np.ndarray] | None = None
        tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if best is None or tables is None:
                return
            marks, _, vecs = tables
            score, found = best
            # One more than is kept: where that place is taken, its score is the best of those left out.
            last, rows = score.argmin(1), np.arange(len(score))
            left_out = score[rows, last].copy()
            full = np.flatnonzero(left_out >= floor)
            score[full, last[full]] = -2.0
            r, c = np.nonzero(score >= floor)
            if len(r):
                raw = [v.tobytes() for v in vecs]
                a, of = np.r_[r, full], group >> (_CELL_BITS + _PART_BITS)
                b = pa.array(np.r_[found[r, c], np.zeros(len(full), np.int64)], mask=np.arange(len(a)) >= len(r))
                rejected = pa.array(np.r_[np.zeros(len(r), np.float32), left_out[full]].astype(np.float32), mask=np.arange(len(a)) < len(r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of] * len(a), pa.int32()), pa.array(marks[a]), pa.array([raw[i] for i in a], pa.binary()), b, rejected], names=["field", "a", "vec_a", "b", "rejected"]
                )

        def refined(s: np.ndarray, v: np.ndarray, block: np.ndarray) -> np.ndarray:
            """Scores with the last book, -2 where s is or where they are under the floor."""
            r, c = np.nonzero(s > -2.0)
            if not len(r):
                return s
            norm, after = block["norm"], np.maximum(block["fine_norm"].astype(np.float32), 1e-6)
            levels = _levels(block["fine"], dim) * block["scale"].astype(np.float32)[:, None]
            if 8 * len(r) > s.size:
                s = np.where(s > -2.0, (s * norm + v @ levels.T) / after, np.float32(-2.0))
            else:
                for k in range(0, len(r), 65_536):
                    a, b = r[k : k + 65_536], c[k : k + 65_536]
                    s[a, b] = (s[a, b] * norm[b] + np.einsum("ij,ij->i", v[a], levels[b])) / after[b]
            s[s < floor] = -2.0
            return s

        def score(marks: np.ndarray, block: np.ndarray) -> None:
            nonlocal tables, best
            own = books[group >> (_CELL_BITS + _PART_BITS)]
            if tables is None:
                m = np.concatenate([s[0] for s in seekers])
                v = np.concatenate([s[1] for s in seekers])
                tables = m, np.einsum("nd,bed->bne", v, own.residual, optimize=True), v
                best = np.full((len(m), KEPT + 1), -2.0, np.float32), np.zeros((len(m), KEPT + 1), np.int64)
            m, lut, v = tables
            codes = block["code"]
            which, inverse = np.unique(block["coarse"], return_inverse=True)
            s = np.take(v @ own.coarse[which].T, inverse, axis=1)
            for j in range(len(lut)):
                s += np.take(lut[j], codes[:, j], axis=1)
            s /= block["norm"]
            s[s < rough] = -2.0
            s[m[:, None] == marks[None, :]] = -2.0
            s = refined(s, v, block)
            rows = np.flatnonzero((s > -2.0).any(1))
            if not len(rows):
                return
            s = s[rows]
            keep = min(KEPT + 1, s.shape[1])
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            both = np.concatenate([best[0][rows], np.take_along_axis(s, top, 1)], 1)
            ids = np.concatenate([best[1][rows], marks[top]], 1)
            top = np.argpartition(-both, KEPT, axis=1)[:, : KEPT + 1]
            best[0][rows], best[1][rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)

        for b in batches:
            if not b.num_rows:
                continue
            slot, mark = b.column("slot").to_numpy(), b.column("mark").to_numpy()
            change = np.flatnonzero(slot[1:] != slot[:-1]) + 1
            for i, j in zip(np.r_[0, change], np.r_[change, b.num_rows]):
                here, kind = int(slot[i]) >> 1, int(slot[i]) & 1
                if here != group:
                    yield from close()
                    group, seekers, best, tables = here, [], None, None
                data = b.column("data").slice(i, j - i)
                if kind == 0:
                    seekers.append((mark[i:j], _matrix(data, dim)))
                elif seekers:
                    filed = np.frombuffer(b"".join(data.to_pylist()), _filed(dim))
                    # Blocks keep the table of scores small.
                    step = max(64, 4_000_000 // max(1, sum(len(s[0]) for s in seekers)))
                    for k in range(0, j - i, step):
                        score(mark[i:j][k : k + step], filed[k : k + step])
        yield from close()

    return run


def _exact_search(dim: int, least: float):  # noqa: ANN202
    """Rows sorted by slot: the lookups (kind 0) of a part of a region, then all vectors of the region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: int | None = None
        seekers: list[tuple[np.ndarray, np.ndarray]] = []
        best: tuple[np.ndarray, np.ndarray] | None = None
        held: tuple[np.ndarray, np.ndarray] | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if best is None or held is None:
                return
            r, c = np.nonzero(best[0] >= least)
            if len(r):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group >> (_CELL_BITS + _PART_BITS)] * len(r), pa.int32()), pa.array(held[0][r]), pa.array(best[1][r, c]), pa.array(best[0][r, c])], names=["field", "a", "b", "cosine"]
                )

        def score(marks: np.ndarray, x: np.ndarray) -> None:
            nonlocal best, held
            if held is None:
                held = np.concatenate([s[0] for s in seekers]), np.concatenate([s[1] for s in seekers])
                best = np.full((len(held[0]), KEPT), -2.0), np.zeros((len(held[0]), KEPT), np.int64)
            s = held[1] @ x.T
            s[held[0][:, None] == marks[None, :]] = -2.0
            rows = np.flatnonzero((s >= np.maximum(best[0].min(1), least)[:, None]).any(1))
            if not len(rows):
                return
            both = np.concatenate([best[0][rows], s[rows]], 1)
            ids = np.concatenate([best[1][rows], np.broadcast_to(marks, (len(rows), len(marks)))], 1)
            top = np.argpartition(-both, KEPT - 1, axis=1)[:, :KEPT]
            best[0][rows], best[1][rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)

        for b in batches:
            if not b.num_rows:
                continue
            slot, mark = b.column("slot").to_numpy(), b.column("mark").to_numpy()
            change = np.flatnonzero(slot[1:] != slot[:-1]) + 1
            for i, j in zip(np.r_[0, change], np.r_[change, b.num_rows]):
                here, kind = int(slot[i]) >> 1, int(slot[i]) & 1
                if here != group:
                    yield from close()
                    group, seekers, best, held = here, [], None, None
                x = _matrix(b.column("data").slice(i, j - i), dim).astype(np.float64)
                if kind == 0:
                    seekers.append((mark[i:j], x))
                elif seekers:
                    step = max(64, 4_000_000 // max(1, sum(len(s[0]) for s in seekers)))
                    for k in range(0, j - i, step):
                        score(mark[i:j][k : k + step], x[k : k + step])
        yield from close()

    return run


def _crowded(hits: DataFrame, near: DataFrame, coded: DataFrame, books: dict[int, Books], dim: int, nearest: int, least: float) -> DataFrame | None:
    """(field, a, b, cosine): the exact neighbours of the lookups whose codes left out what may be one; None if there are none.

    A candidate left out may be a neighbour if its score comes within FINE_SLACK of the ``nearest``-th cosine found.
    Where such a lookup has ``nearest`` neighbours its cell is dense, the group may have many cells, and all
    lookups that file their codes in one of them are asked too. A lookup visits every region with a cell that can hold a vector that near: a vector's angle to its
    cell's centre lies between the least and the largest of the cell, and differs from the lookup's by no more
    than the angle between the two. Vectors lie in one region each.
    """
    spark = hits.sparkSession
    bar = near.groupBy("field", "a").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c")).select("field", "a", F.get("c", F.lit(nearest - 1)).alias("bar"))
    full = hits.where("b is null").join(bar, ["field", "a"], "left").where(F.col("rejected") + FINE_SLACK >= F.coalesce("bar", F.lit(least)))
    full = cut(full.select("field", "a", "vec_a", "bar"))
    if not full.limit(1).count():
        return None
    sent = spark.sparkContext.broadcast(books)
    # At most one row for each cell of each field.
    dense = coded.select("field", F.col("mark").alias("a"), F.col("cells")[0].alias("cell")).join(full.where("bar is not null").select("field", "a"), ["field", "a"], "left_semi").select("field", "cell").distinct().collect()
    if dense:
        flags = {f: np.zeros(len(own.coarse), bool) for f, own in books.items()}
        for r in dense:
            flags[r["field"]][r["cell"]] = True

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fields, cells = b.column("field").to_pylist(), b.column("cells").to_pylist()
                yield b.select(["field", "a", "vec_a"]).filter(pa.array([bool(flags[f][c].any()) for f, c in zip(fields, cells)], pa.bool_()))

        more = coded.select("field", F.col("mark").alias("a"), F.col("vec").alias("vec_a"), "cells").mapInArrow(beside, "field int, a long, vec_a binary")
        full = full.unionByName(more.join(full.select("field", "a"), ["field", "a"], "left_anti").join(bar, ["field", "a"], "left"))
    full = full.withColumn("bar", F.coalesce("bar", F.lit(least)))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, fields, cells = _matrix(b.column("vec"), dim), b.column("field").to_numpy(), b.column("cell").to_numpy()
                centres = np.zeros_like(x)
                for f in np.unique(fields):
                    centres[fields == f] = sent.value[int(f)].coarse[cells[fields == f]]
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, centres), -1, 1)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("field"), b.column("cell"), pa.array(angle)], names=["field", "cell", "angle"])

    placed = coded.select("field", F.col("cells")[0].alias("cell"), "mark", "vec")
    # At most one row for each cell of each field: bounded by the size of the codebooks.
    spans = placed.mapInArrow(turns, "field int, cell int, angle double").groupBy("field", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
    bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    rng = np.random.default_rng(7)
    for f in {r["field"] for r in spans}:
        own, coarse = [r for r in spans if r["field"] == f], books[f].coarse
        lo, hi = np.full(len(coarse), np.inf), np.full(len(coarse), -np.inf)
        at = [r["cell"] for r in own]
        lo[at], hi[at] = [r["lo"] for r in own], [r["hi"] for r in own]
        heads = rng.choice(len(coarse), min(len(coarse), -(-sum(r["n"] for r in own) // REGION)), replace=False)
        bounds[f] = lo, hi, (coarse @ coarse[heads].T).argmax(1)
    told = spark.sparkContext.broadcast(bounds)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fields, x, bar = b.column("field").to_numpy(), _matrix(b.column("vec_a"), dim), b.column("bar").to_numpy()
            for f in np.unique(fields):
                lo, hi, region = told.value[int(f)]
                order = np.argsort(region, kind="stable")
                which, begin = np.unique(region[order], return_index=True)
                rows = np.flatnonzero(fields == f)
                for k in range(0, len(rows), 512):
                    at = rows[k : k + 512]
                    angle = np.arccos(np.clip(x[at] @ sent.value[int(f)].coarse.T, -1, 1))
                    reach = np.arccos(np.clip(bar[at], -1, 1))[:, None] + ROUNDING
                    can = (angle >= lo - reach) & (angle <= hi + reach)
                    r, c = np.nonzero(np.logical_or.reduceat(can[:, order], begin, axis=1))
                    chosen = pa.array(at[r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(f)] * len(r), pa.int32()), pa.array(which[c].astype(np.int32)), b.column("a").take(chosen), b.column("vec_a").take(chosen)], names=["field", "cell", "mark", "data"]
                    )

    seekers = cut(full.mapInArrow(visits, "field int, cell int, mark long, data binary"))
    # At most one row for each region, then for each cell.
    wanted = {(r["field"], r["cell"]): r["n"] for r in seekers.groupBy("field", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {k: -(-n // EXACT_LOOKUPS) for k, n in wanted.items()}
    regions = [(f, c, int(bounds[f][2][c]), parts[f, int(bounds[f][2][c])]) for f, c in ((r["field"], r["cell"]) for r in spans) if (f, int(bounds[f][2][c])) in parts]
    regions = F.broadcast(spark.createDataFrame(regions, "field int, cell int, region int, parts int"))
    counted = F.broadcast(spark.createDataFrame([(*k, n) for k, n in parts.items()], "field int, cell int, parts int"))

    def slot(cell: str, kind: int) -> Column:
        at = F.shiftleft(F.col("field").cast("long"), _CELL_BITS) + F.col(cell)
        return (F.shiftleft(F.shiftleft(at, _PART_BITS) + F.col("part"), 1) + kind).alias("slot")

    asked = seekers.join(counted, ["field", "cell"]).withColumn("part", F.pmod(F.xxhash64("mark"), "parts")).select(slot("cell", 0), "mark", "data")
    there = placed.join(regions, ["field", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(slot("region", 1), "mark", F.col("vec").alias("data"))
    held = sum(r["n"] * parts.get((r["field"], int(bounds[r["field"]][2][r["cell"]])), 0) for r in spans) + sum(wanted.values())
    rows = asked.unionByName(there).repartition(tasks_for(spark, held, 4 * REGION), F.shiftright("slot", 1)).sortWithinPartitions("slot")
    return rows.mapInArrow(_exact_search(dim, least), "field int, a long, b long, cosine double")


def similar_pairs(tables: list[VectorTable], dim: int = 64, nearest: int = 5, least: float = 0.90) -> DataFrame:
    """(field_name, id_a, id_b, cosine): pairs of a field with a cosine of at least ``least``, either among the ``nearest`` of the other.

    The current row of a key is the latest by its load time (null is the earliest); null keys are no items.
    Usable is a vector of ``dim`` finite elements that are not all zero; its length as a vector is ignored.
    The smaller id, in UTF-8 byte order, comes first. Vectors that agree to 1/4096 in every element of their
    unit vectors are copies: one of them is searched for, and the copies share its neighbours; equal
    similarities rank by id, so each of many copies is paired with the first ids of its group; the cosine of
    copies, which differs from 1 by less than 1e-6, is taken as 1. Only the search for candidates is approximate;
    all other cosines are exact. No candidate is lost for want of room: lookups with
    more than KEPT that codes cannot tell apart are answered by ``_crowded``. Empty tables give no rows.

    Scale: codebooks (at most FIRST_CELLS * SECOND_CELLS entries, 70 MB, a field) are broadcast, their sample is bounded by SAMPLE. A code is
    filed in PROBES cells, whose number grows with the square root of the vectors; a cell's lookups are split
    at LOOKUPS. Hot copies are reduced to one by a partial aggregation before any search. Vectors are shuffled
    three times in all: by their mark, to their cells, and for the exact ranking. The exact search of a dense
    group is quadratic in its size.
    """
    spark = tables[0].df.sparkSession
    names: list[str] = []
    members, scans = None, None
    for t in tables:
        found, scan = _members(t, len(names), dim), _scan(t, len(names), dim, whole=True)
        members = found if members is None else members.unionByName(found)
        scans = scan if scans is None else scans.unionByName(scan)
        names += t.fields
    members = cut(members)
    sized = cut(members.groupBy("field", "mark").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")))
    counts = {r["field"]: r["n"] for r in sized.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Marks are hashes: a slice of their range is a random sample. Superseded vectors fall into it too, so each
    # field's is ordered and cut to SAMPLE rows before it is collected.
    share = F.lit(0)
    for field, n in counts.items():
        share = F.when(F.col("field") == field, int(min(1.0, 1.1 * SAMPLE / n) * 1_000_000)).otherwise(share)
    sampled = cut(scans.where(F.pmod(F.xxhash64("mark"), F.lit(1_000_000)) < share).groupBy("field", "mark").agg(F.min("vec").alias("vec")))
    books: dict[int, Books] = {}
    for field, n in counts.items():
        got = sampled.where(F.col("field") == field).orderBy(F.xxhash64("mark"), "mark").limit(SAMPLE).select("vec").toArrow()
        books[field] = train(_matrix(got.column("vec"), dim), n)
    sent = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fields = b.column("field").to_numpy()
            x = _matrix(b.column("vec"), dim)
            cells: list = [None] * len(x)
            filed = np.zeros(len(x), _filed(dim))
            for f in np.unique(fields):
                rows = np.flatnonzero(fields == f)
                step = max(64, min(2_048, 32_000_000 // len(sent.value[int(f)].coarse)))
                for k in range(0, len(rows), step):
                    at = rows[k : k + step]
                    c, filed[at] = encode_vectors(x[at], sent.value[int(f)])
                    for i, row in enumerate(at):
                        cells[row] = c[i]
            codes = [filed[i].tobytes() for i in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [b.column("field"), b.column("mark"), b.column("vec"), pa.array(cells, pa.list_(pa.int32())), pa.array(codes, pa.binary())], names=["field", "mark", "vec", "cells", "code"]
            )

    current = scans.groupBy("field", "mark").agg(F.min("vec").alias("vec")).join(sized.select("field", "mark"), ["field", "mark"])
    coded = cut(current.select("field", "mark", "vec").mapInArrow(encode, "field int, mark long, vec binary, cells array<int>, code binary"))
    del sampled
    release(spark)
    # At most one row for each cell of each field: bounded by the size of the codebooks.
    parts = coded.groupBy("field", F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOOKUPS)
    parts = parts.select("field", "cell", F.ceil(F.col("n") / LOOKUPS).cast("int").alias("parts"))

    def placed_rows(rows: DataFrame, part: Column, kind: int) -> DataFrame:
        """The slot of each lookup's part, or of every part for a code."""
        known = rows.join(F.broadcast(parts), ["field", "cell"], "left").withColumn("part", part)
        cell = F.shiftleft(F.col("field").cast("long"), _CELL_BITS) + F.col("cell")
        return known.select((F.shiftleft(F.shiftleft(cell, _PART_BITS) + F.col("part"), 1) + kind).alias("slot"), "mark", "data")

    in_cell = F.coalesce(F.col("parts"), F.lit(1))
    lookups = coded.select("field", F.col("cells")[0].alias("cell"), "mark", F.col("vec").alias("data"))
    filed = coded.select("field", F.explode("cells").alias("cell"), "mark", F.col("code").alias("data"))
    lookups = placed_rows(lookups, F.pmod(F.xxhash64("mark"), in_cell), 0)
    filed = placed_rows(filed, F.explode(F.sequence(F.lit(0), in_cell - 1)), 1)
    tasks = tasks_for(spark, sum(counts.values()) * (PROBES + 1), ROWS_PER_TASK)
    placed = lookups.unionByName(filed).repartition(tasks, F.shiftright("slot", 1)).sortWithinPartitions("slot")
    hits = cut(placed.mapInArrow(lambda it: _search(sent.value, dim, least)(it), "field int, a long, vec_a binary, b long, rejected float"))
    release(spark)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cos = np.einsum("ij,ij->i", _matrix(b.column("vec_a"), dim).astype(np.float64), _matrix(b.column("vec_b"), dim).astype(np.float64))
            close = pa.array(cos >= least)
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("a"), b.column("b"), pa.array(cos)], names=["field", "a", "b", "cosine"]).filter(close)

    targets = coded.select("field", F.col("mark").alias("b"), F.col("vec").alias("vec_b"))
    near = hits.where("b is not null").join(targets, ["field", "b"]).select("field", "a", "vec_a", "b", "vec_b").mapInArrow(exact, "field int, a long, b long, cosine double")
    near = cut(near)
    release(spark)
    crowded = _crowded(hits, near, coded, books, dim, nearest, least)
    if crowded is not None:
        near = cut(near.unionByName(crowded))
    # All that is left to do is about ids: the vectors, their codes and the candidates may go.
    del coded, parts, lookups, filed, placed, hits, targets, crowded
    release(spark)
    links = near.unionByName(near.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).groupBy("field", "a", "b").agg(F.max("cosine").alias("cosine"))

    # The first ids of each group of copies, one more than a member needs.
    firsts = members.withColumn("k", F.row_number().over(Window.partitionBy("field", "mark").orderBy("id"))).where(F.col("k") <= nearest + 1)
    firsts = firsts.groupBy("field", "mark").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    info = sized.where("copies > 1").join(firsts, ["field", "mark"]).select("field", "mark", "copies", "ids")
    info = info.unionByName(sized.where("copies = 1").select("field", "mark", "copies", F.array("first").alias("ids")))
    info = cut(info)

    order = Window.partitionBy("field", "a").orderBy(F.desc("cosine"), F.col("ids")[0])
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = links.join(info.select("field", F.col("mark").alias("b"), F.col("copies").alias("copies_b"), "ids"), ["field", "b"])
    ranked = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= nearest)
    ranked = ranked.withColumn("taken", F.coalesce(F.sum("copies_b").over(ahead), F.lit(0)))
    ranked = ranked.join(info.select("field", F.col("mark").alias("a"), F.col("copies").alias("copies_a")), ["field", "a"])
    free = F.lit(nearest) - (F.col("copies_a") - 1) - F.col("taken")
    chosen = ranked.where(free > 0).select("field", F.col("a").alias("mark"), F.explode(F.slice("ids", F.lit(1), free.cast("int"))).alias("other"), "cosine")
    ends = F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")
    pairs = members.join(chosen, ["field", "mark"]).groupBy("field", *ends).agg(F.max("cosine").alias("cosine"))
    # The ids of a group hold all that its members are paired with, so two of them would give their pair twice.
    among = members.join(info.where("copies > 1").select("field", "mark", "ids"), ["field", "mark"])
    among = among.select("field", "id", "ids", F.explode(F.expr(f"slice(filter(ids, x -> x <> id), 1, {int(nearest)})")).alias("other"))
    copies = among.where(~F.array_contains("ids", F.col("id")) | (F.col("other") > F.col("id"))).select("field", *ends, F.lit(1.0).alias("cosine"))
    pairs = pairs.unionByName(copies)
    return pairs.select(F.array(*[F.lit(n) for n in names])[F.col("field")].alias("field_name"), "id_a", "id_b", "cosine")
