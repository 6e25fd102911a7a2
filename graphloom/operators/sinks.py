"""Upserts, index tables, stores with epochs, counters and encoders of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import retrieval


def merged_nodes(old: DataFrame, new: DataFrame, key: str, identity: list[str], properties: str = "properties") -> DataFrame:
    """Nodes after an upsert: identity columns keep the value they were made with, properties take the last writer's key by key.

    ``new`` has ``ord``, the order of writing; several rows of a key are laid over each other in it. Properties whose
    new value is null are removed, as a cleanup of keys that have vanished asks for.
    """
    rows = old.select(key, *identity, properties, F.lit(-1).cast("long").alias("ord")).unionByName(new.select(key, *identity, properties, F.col("ord").cast("long").alias("ord")))
    first = rows.groupBy(key).agg(*[F.min_by(c, "ord").alias(c) for c in identity])
    flat = rows.select(key, "ord", F.explode(properties).alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", "ord").alias("v")).where("v is not null")
    props = flat.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(properties))
    empty = F.create_map().cast("map<string,string>")
    return first.join(props, key, "left").select(key, *identity, F.coalesce(properties, empty).alias(properties))


def load(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], folder: str, key: str = "id") -> dict[str, int]:
    """Writes a model: all node tables first, once for each key, then each edge table without the links that lack an end; gives the rows of each table.

    Ends are looked up in what was written, so the order of the edge tables does not matter.
    """
    written: dict[str, int] = {}
    known: DataFrame | None = None
    for name, rows in nodes.items():
        rows.dropDuplicates([key]).write.mode("overwrite").parquet(f"{folder}/nodes/{name}")
        back = rows.sparkSession.read.parquet(f"{folder}/nodes/{name}")
        written[name] = back.count()
        ids = back.select(F.col(key).alias("id"))
        known = ids if known is None else known.unionByName(ids)
    for name, rows in edges.items():
        kept = rows
        for end in ("src", "dst"):
            kept = kept.join(known.withColumnRenamed("id", end), end, "left_semi")
        kept.dropDuplicates(["src", "dst"]).write.mode("overwrite").parquet(f"{folder}/edges/{name}")
        written[name] = rows.sparkSession.read.parquet(f"{folder}/edges/{name}").count()
    return written


def write_text(spark: SparkSession, path: str, text: str, archive: str | None = None) -> None:
    """A small artifact in one piece: written beside its place and renamed into it; what was there before goes to ``archive`` if one is named."""
    jvm = spark.sparkContext._jvm
    final, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final):
        if archive is not None:
            target = jvm.org.apache.hadoop.fs.Path(archive)
            if target.getParent() is not None:
                fs.mkdirs(target.getParent())
            fs.rename(final, target)
        else:
            fs.delete(final, False)
    fs.rename(fresh, final)


def write_index(docs: DataFrame, key: str, words: Column, folder: str, epoch: int) -> None:
    """The inverted index of one epoch as three tables: postings by token range, document frequencies, corpus statistics."""
    posted = retrieval.postings(docs, key, words)
    posted.repartitionByRange("token").sortWithinPartitions("token", key).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}/postings")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{folder}/epoch={epoch}/postings")
    written.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}/frequencies")
    docs.select(F.coalesce(F.size(words), F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens")).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}/statistics")


class Epochs:
    """Versions of a stored table: one is read while the next is built, resumed after a stop, published at once, and old ones are cleared.

    The state is one small file that is replaced by a rename; folders lie on whatever file system the path names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """{read, pending, fingerprint}: the epoch that is read, the one being built and what it is built from."""
        if not self._fs.exists(self._path("state.json")):
            return {"read": None, "pending": None, "fingerprint": None}
        return json.loads(self._spark.read.text(f"{self.folder}/state.json", wholetext=True).first()[0])

    def _save(self, state: dict) -> None:
        fresh, final = self._path("state.json.new"), self._path("state.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        self._fs.rename(fresh, final)

    def begin(self, fingerprint: str) -> tuple[int, bool]:
        """(epoch, resumed): the pending epoch if it is built from the same, else a new one; what was pending before is dropped."""
        s = self.state()
        if s["pending"] is not None and s["fingerprint"] == fingerprint:
            return s["pending"], True
        if s["pending"] is not None:
            self._fs.delete(self._path(f"epoch={s['pending']}"), True)
        epoch = max(s["read"] or 0, s["pending"] or 0) + 1
        self._save({**s, "pending": epoch, "fingerprint": fingerprint})
        return epoch, False

    def publish(self, epoch: int) -> None:
        """Readers go over to a finished epoch; only the pending one can be published."""
        s = self.state()
        if s["pending"] != epoch:
            raise RuntimeError(f"epoch {epoch} is not the one being built ({s['pending']})")
        self._save({"read": epoch, "pending": None, "fingerprint": s["fingerprint"]})

    def clear(self) -> list[int]:
        """Deletes all epochs but the one that is read and the one being built; gives their numbers."""
        s, gone = self.state(), []
        for status in self._fs.listStatus(self._path("")) if self._fs.exists(self._path("")) else []:
            name = status.getPath().getName()
            if name.startswith("epoch=") and int(name[6:]) not in (s["read"], s["pending"]):
                self._fs.delete(status.getPath(), True)
                gone.append(int(name[6:]))
        return sorted(gone)


class Lease:
    """One writer at a time over a shared folder: a file that only one can make, kept alive by its maker and taken over once it is stale."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "lease"):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.json")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._spark = spark

    def holder(self) -> tuple[str, float] | None:
        """(owner, time of the last sign of life), none if nobody holds it."""
        if not self._fs.exists(self._path):
            return None
        held = json.loads(self._spark.read.text(self._path.toString(), wholetext=True).first()[0])
        return held["owner"], held["at"]

    def _write(self, owner: str, now: float, over: bool) -> bool:
        try:
            out = self._fs.create(self._path, over)
        except Exception:  # noqa: BLE001 - another has made it in between
            return False
        out.write(bytearray(json.dumps({"owner": owner, "at": now}).encode()))
        out.close()
        return True

    def take(self, owner: str, now: float, patience: float) -> bool:
        """Whether ``owner`` holds the lease now: it was free, already theirs, or its holder showed no life for ``patience`` seconds."""
        held = self.holder()
        if held is None:
            return self._write(owner, now, False)
        if held[0] == owner:
            return self._write(owner, now, True)
        if now - held[1] < patience:
            return False
        self._fs.delete(self._path, False)
        return self._write(owner, now, False)

    def release(self, owner: str) -> bool:
        """Gives the lease up; only its holder can."""
        held = self.holder()
        return bool(held and held[0] == owner and self._fs.delete(self._path, False))


def accumulated(old: DataFrame, delta: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters after a delta, summed by keys; null keys are keys of their own, a counter missing on both sides stays null."""
    rows = old.select(*keys, *counters).unionByName(delta.select(*keys, *counters))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def unit_id(routine: Column, part: Column, total: Column) -> Column:
    """The id of one part of a routine; a whole routine is its own unit."""
    return F.when(total > 1, F.format_string("%s#unit:%04d/%04d", routine, part + 1, total)).otherwise(routine)


def fingerprint(settings: dict) -> str:
    """sha256 of settings that decide a result, independent of their order."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def _cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        plain = value == value.strip() and value and not any(c in value for c in ',:"\n\\') and value not in ("true", "false", "null")
        return value if plain and not value.replace(".", "", 1).replace("-", "", 1).isdigit() else json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return json.dumps("|".join(_cell(v) for v in value), ensure_ascii=False)
    return str(value)


def as_table(rows: list, name: str = "rows") -> str:
    """A page of rows as a compact table: a head with the number and names of columns, then a line of cells each."""
    if not rows:
        return f"{name}[0]:"
    columns = list(rows[0].asDict())
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(_cell(r[c]) for c in columns) for r in rows)])


def interned(rows: list[dict], columns: list[str], least: int = 2) -> tuple[dict[str, str], list[dict]]:
    """(names, rows) of a page: values that stand at least ``least`` times in ``columns`` become ``@column:number``, numbered as they come."""
    counts: dict[tuple[str, str], int] = {}
    for r in rows:
        for c in columns:
            if isinstance(r.get(c), str):
                counts[c, r[c]] = counts.get((c, r[c]), 0) + 1
    names: dict[tuple[str, str], str] = {}
    for (c, v), n in counts.items():
        if n >= least and len(v) > len(c) + 4:
            names[c, v] = f"@{c}:{sum(k[0] == c for k in names) + 1}"
    return {name: v for (_, v), name in names.items()}, [{k: names.get((k, v), v) if isinstance(v, str) else v for k, v in r.items()} for r in rows]


def prefixed(values: list[str], separator: str = "/", most: int = 5) -> tuple[dict[str, str], list[str]]:
    """(names, values) of a page: the prefix up to a separator that saves most is named, again and again up to ``most`` times while it saves anything."""
    names: dict[str, str] = {}
    left = list(values)
    for i in range(1, most + 1):
        counts: dict[str, int] = {}
        for v in left:
            if not v.startswith("@"):
                parts = v.split(separator)
                for n in range(1, len(parts)):
                    head = separator.join(parts[:n]) + separator
                    counts[head] = counts.get(head, 0) + 1
        short = f"@{i}{separator}"
        gains = {h: c * (len(h) - len(short)) - len(h) - len(short) for h, c in counts.items() if c > 1}
        if not gains or max(gains.values()) <= 0:
            break
        head = min(h for h, g in gains.items() if g == max(gains.values()))
        names[short[:-1]] = head[: -len(separator)]
        left = [short + v[len(head) :] if v.startswith(head) else v for v in left]
    return names, left


def hashed_vectors(texts: DataFrame, key: str, words: Column, dim: int = 64) -> DataFrame:
    """(key, vector): a deterministic stand-in for an embedding source: token counts in ``dim`` hashed places with hashed signs, of unit length; no tokens give null."""
    flat = texts.select(key, F.explode(words).alias("token"))
    place, sign = F.pmod(F.xxhash64("token"), F.lit(dim)).cast("int"), F.when(F.pmod(F.xxhash64("token", F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = flat.groupBy(key, place.alias("i")).agg(F.sum(sign).alias("x"))
    packed = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("size"))
    return texts.select(key).distinct().join(packed.where("size > 0").select(key, vector.cast(T.ArrayType(T.FloatType())).alias("vector")), key, "left")
