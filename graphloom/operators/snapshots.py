"""Changes between consecutive full snapshots of a keyed table.

Method: rows become compact key and row hashes, are bucketed by the key's hash and, bucket by bucket,
compared as sorted numpy arrays with ``searchsorted`` set differences. Full values are fetched only for
the keys that differ.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import composed
from graphloom.plans.session import cut, tasks_for

#: Keys of a snapshot's JSON that never count as a change.
IGNORED_KEYS = ("meta_uuid", "description_embedding", "description_embedding_model", "description_embedding_updated_at")

#: Rows of the snapshot calendar (scope, snapshot) that may be broadcast, about 8 MB; beyond it is joined by shuffle.
CALENDAR_BROADCAST_ROWS = 200_000
ROWS_PER_BUCKET = 250_000
#: Changes whose hashes (24 bytes each, about 12 MB as a table) may be broadcast to fetch names and values.
CHANGES_BROADCAST_ROWS = 200_000


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value.is_integer() else value


def _no_constant(text: str) -> None:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_float=_number, parse_constant=_no_constant)
_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _without(value: object, ignored: frozenset[str]) -> object:
    if isinstance(value, dict):
        return {k: _without(v, ignored) for k, v in value.items() if k not in ignored}
    if isinstance(value, list):
        return [_without(v, ignored) for v in value]
    return value


def json_digest(text: str | None, ignored: frozenset[str]) -> int | None:
    """Signed 64-bit hash of the JSON value; None if it is missing or can't be read.

    Key order, spacing, escapes and ``1`` against ``1.0`` make no difference; list order and types do.
    """
    if text is None:
        return None
    try:
        value = _DECODER.decode(text)
        if any(f'"{k}"' in text for k in ignored) or "\\" in text:
            value = _without(value, ignored)
        return _signed(xxhash.xxh3_64_intdigest(_ENCODER.encode(value).encode("utf-8", "surrogatepass")))
    except (ValueError, RecursionError):
        return None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _key(parts: tuple[str | None, ...]) -> tuple[int, int]:
    joined = "\x1f".join("\x00" if p is None else p for p in parts).encode("utf-8", "surrogatepass")
    both = xxhash.xxh3_128_intdigest(joined)
    return _signed(both >> 64), _signed(both & ((1 << 64) - 1))


def _keyed(batches: Iterator[pa.RecordBatch], scope: int, width: int, ignored: frozenset[str], values: bool) -> Iterator[pa.RecordBatch]:
    """Columns 0..width-1 are the key (the first ``scope`` of them the scope), then snapshot, the row's hash and, with ``values``, delivered, JSON, hash.

    Without ``values`` the rows are those of changes: their names come out normalised, other columns as they are.
    """
    for batch in batches:
        cache: dict[str | None, str | None] = {}
        names = []
        for i in range(width):
            column = batch.column(i).to_pylist()
            if i < scope:
                for x in set(column):
                    cache.setdefault(x, composed(x))
                names.append([cache[x] for x in column])
            else:
                names.append([composed(x) for x in column])
        keys = np.array([_key(k) for k in zip(*names, strict=True)], dtype=np.int64).reshape(-1, 2)
        out = {"k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1])}
        if values:
            scopes: dict[tuple, int] = {}
            for s in set(zip(*names[:scope], strict=True)):
                scopes[s] = _key(s)[0]
            out["scope"] = pa.array([scopes[s] for s in zip(*names[:scope], strict=True)], pa.int64())
            out["snapshot"] = batch.column(width).cast(pa.int64())
            out["row"] = batch.column(width + 1)
            out["delivered"] = batch.column(width + 2)
            out["jh"] = pa.array([json_digest(x, ignored) for x in batch.column(width + 3).to_pylist()], pa.int64())
            out["oh"] = pa.array([None if x is None else _signed(xxhash.xxh3_64_intdigest(x.strip().lower())) for x in batch.column(width + 4).to_pylist()], pa.int64())
        else:
            for i in range(width, batch.num_columns):
                out[batch.schema.names[i]] = batch.column(i)
            for i in range(width):
                out[f"n{i}"] = pa.array(names[i], pa.string())
        yield pa.RecordBatch.from_pydict(out)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: rows (k1, k2, rank, snapshot, later, jh, oh, row), one per key and snapshot; yields its changes.

    ``row`` of a change is the hash of the row it is seen in, ``before`` that of the row a changed one replaces.
    """
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    col = {n: table.column(n) for n in table.column_names}
    k1, k2 = (col[n].to_numpy() for n in ("k1", "k2"))
    rank, snap = (col[n].to_numpy().astype(np.int64) for n in ("rank", "snapshot"))
    later = col["later"].fill_null(0).to_numpy().astype(np.int64)
    has_later = col["later"].is_valid().to_numpy()
    jh, oh = (col[n].fill_null(0).to_numpy() for n in ("jh", "oh"))
    jv, ov = (col[n].is_valid().to_numpy() for n in ("jh", "oh"))
    row = col["row"].to_numpy()

    order = np.lexsort((rank, k2, k1))
    k1, k2, rank, snap, later, has_later, jh, oh, jv, ov, row = (a[order] for a in (k1, k2, rank, snap, later, has_later, jh, oh, jv, ov, row))
    fresh = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
    stride = int(rank.max()) + 3
    at = (np.cumsum(fresh) - 1) * stride + rank + 1  # sorted: key ordinal and rank in one number

    def found(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        return place, at[place] == wanted

    before, had = found(at - 1)
    _, stays = found(at + 1)
    both_json = jv & jv[before]
    same_hash = (ov == ov[before]) & (~ov | (oh == oh[before]))
    differs = np.where(both_json, jh != jh[before], ~same_hash)
    for kind, mask, number in (
        ("added", (rank > 0) & ~had, snap),
        ("changed", had & differs, snap),
        ("removed", has_later & ~stays, later),
    ):
        if mask.any():
            yield pa.RecordBatch.from_pydict(
                {
                    "k1": pa.array(k1[mask]), "k2": pa.array(k2[mask]), "row": pa.array(row[mask]),
                    "before": pa.array(row[before[mask]]) if kind == "changed" else pa.nulls(int(mask.sum()), pa.int64()),
                    "snapshot": pa.array(number[mask]), "change_kind": pa.array([kind] * int(mask.sum()), pa.string()),
                }
            )


def snapshot_changes(
    df: DataFrame,
    keys: list[str],
    scope: list[str],
    snapshot: str = "snapshot_no",
    delivered: str = "delivered_at",
    value: str = "object_snapshot_json",
    digest: str = "object_hash",
    ignored: tuple[str, ...] = IGNORED_KEYS,
    values: bool = False,
) -> DataFrame:
    """Rows (scope…, keys…, snapshot, change_kind[, old_value, new_value]) that differ between consecutive snapshots of a scope.

    ``scope`` (a project, say) has its own calendar: its snapshots are those in which it has any row, and
    its first has no changes. Of rows with the same scope, keys and snapshot the latest delivery counts;
    equal deliveries tie by the larger hashes. Names are compared and returned trimmed and composed.
    Values differ as JSON; if either is missing or unreadable, ``digest`` decides, letter case aside, where
    two missing digests are equal. With ``values`` the JSON texts of both sides come out, null where there is
    none. Rows without a snapshot number are void; a null key is a key of its own, a null delivery is the
    earliest. An empty table gives no rows, other columns are ignored.

    Scale: what is shuffled is six numbers a row, after map-side aggregation, spread by the hash of the
    whole key, so a scope with a third of all rows is spread too. Names and values are fetched by the rows' hashes
    for the differing keys only: these are broadcast up to CHANGES_BROADCAST_ROWS; beyond it the join is a
    shuffle, before which the engine's run-time Bloom filter drops rows that did not change. The calendar is
    broadcast only below CALENDAR_BROADCAST_ROWS.
    """
    spark = df.sparkSession
    width, fixed = len(scope) + len(keys), frozenset(ignored)
    names = [*scope, *keys]
    n_scope = len(scope)
    texts = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]
    rows = df.where(F.col(snapshot).isNotNull()).select(
        *texts, F.col(snapshot).cast("long").alias("s"), F.col(delivered).cast("timestamp_ntz").alias("d"),
        F.col(value).cast("string").alias("j"), F.col(digest).cast("string").alias("h"),
    )
    marked = rows.withColumn("row", F.xxhash64(*[f"c{i}" for i in range(width)], "s", "d", "j", "h"))

    def scopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[composed(x) for x in b.column(i).to_pylist()] for i in range(n_scope)]
            ids = [_key(s)[0] for s in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_pydict({"scope": pa.array(ids, pa.int64()), "snapshot": b.column(n_scope), "n": b.column(n_scope + 1)})

    counted = rows.groupBy(*[f"c{i}" for i in range(n_scope)], "s").agg(F.count(F.lit(1)).alias("n"))
    calendar = cut(counted.mapInArrow(scopes, "scope long, snapshot long, n long").groupBy("scope", "snapshot").agg(F.sum("n").alias("n")))
    entries, total = calendar.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_scope = Window.partitionBy("scope").orderBy("snapshot")
    calendar = calendar.select("scope", "snapshot", (F.row_number().over(by_scope) - 1).alias("rank"), F.lead("snapshot").over(by_scope).alias("later"))
    calendar = F.broadcast(calendar) if entries <= CALENDAR_BROADCAST_ROWS else calendar.hint("merge")

    compact = (
        marked.select(*[f"c{i}" for i in range(width)], "s", "row", "d", "j", "h")
        .mapInArrow(lambda it: _keyed(it, n_scope, width, fixed, True), "k1 long, k2 long, scope long, snapshot long, row long, delivered timestamp_ntz, jh long, oh long")
        .groupBy("k1", "k2", "scope", "snapshot")
        .agg(F.max(F.struct("delivered", "jh", "oh", "row")).alias("v"))
    )
    ranked = compact.join(calendar, ["scope", "snapshot"]).select("k1", "k2", "rank", "snapshot", "later", "v.jh", "v.oh", "v.row")
    found = cut(ranked.repartition(tasks_for(spark, total, ROWS_PER_BUCKET), "k1", "k2").mapInArrow(_differences, "k1 long, k2 long, row long, before long, snapshot long, change_kind string"))
    few = found.count() <= CHANGES_BROADCAST_ROWS
    kept = [F.col(f"c{i}") for i in range(width)]

    def fetched(wanted: DataFrame) -> DataFrame:
        """The rows of ``marked`` with the wanted hashes; the keys' own hashes are compared too, so no other row slips in."""
        near = marked.join(F.broadcast(wanted) if few else wanted.hint("merge"), "row")
        extra = ["row", "w1", "w2", "d", "j"] if values else ["row", "w1", "w2"]
        types = {"row": "long", "w1": "long", "w2": "long", "d": "timestamp_ntz", "j": "string"}
        schema = "k1 long, k2 long, " + ", ".join(f"{c} {types[c]}" for c in extra) + ", " + ", ".join(f"n{i} string" for i in range(width))
        full = near.select(*kept, *extra).mapInArrow(lambda it: _keyed(it, n_scope, width, fixed, False), schema)
        return full.where("k1 = w1 and k2 = w2").drop("w1", "w2").dropDuplicates(["k1", "k2", "row"])

    wanted = found.select("row", F.col("k1").alias("w1"), F.col("k2").alias("w2"))
    if values:
        wanted = wanted.unionByName(found.where("before is not null").select(F.col("before").alias("row"), F.col("k1").alias("w1"), F.col("k2").alias("w2")))
    named = fetched(wanted.distinct())
    joined = found.join(named, ["k1", "k2", "row"])
    columns = [*[F.col(f"n{i}").alias(c) for i, c in enumerate(names)], F.col("snapshot").cast(df.schema[snapshot].dataType).alias(snapshot), "change_kind"]
    if values:
        old = named.select("k1", "k2", F.col("row").alias("before"), F.col("j").alias("old"))
        joined = joined.join(old, ["k1", "k2", "before"], "left")
        gone = F.col("change_kind") == "removed"
        columns += [F.when(gone, F.col("j")).otherwise(F.col("old")).alias("old_value"), F.when(~gone, F.col("j")).alias("new_value")]
    return joined.select(*columns)
