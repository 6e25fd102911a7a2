"""Rebuilding conversations from message rows.

Method: the rows of a chat are export fragments of up to ``STRIDE + OVERLAP`` turns; each shares its last
``OVERLAP`` turns with the next one. Every message has a hash of its number, speaker and text. The prefix run of a
fragment is the hash of the messages in its first ``OVERLAP`` turns, its suffix run that of those it shares with
the next. Where a suffix run equals a prefix run the fragments overlap; the overlap graph's unambiguous paths are
merged into contigs, block by block of fragments and then level by level over blocks. A conversation is whole if
one contig that begins at its first turn holds all its fragments and no fragment is faulty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import rank_lists
from graphloom.plans.session import cut, tasks_for

#: Turns from one fragment to the next, and turns that two neighbours share.
STRIDE, OVERLAP = 16, 2
#: Fragments per block; a level merges the contigs of as many blocks.
BLOCK = 256
FRAGMENTS_PER_TASK = 100_000

# Texts that stand for a missing text, lower case.
STAND_INS = ("null", "none", "nil", "undefined", "n/a", "na", "nan", "void", "empty", "no answer", "no reply", "no response", "нет ответа", "нет текста", "пустой ответ", "ответ не получен", "пусто")
# A bracketed text is a stand-in if it speaks of nothing but absence; the form is checked first, so time stays linear.
_INNER = r"[^\[\](){}<>]"
_BRACKETED = rf"(?iu)^[\[({{<]++(?={_INNER}*+[\])}}>]++$){_INNER}*?(?:null|none|nil|undefined|n/a|empty|missing|blank|no |not |нет |пуст|не получ|отсутств|без )"
_SPACE = r"(?U)^\s+|\s+$"


def has_content(text: Column) -> Column:
    """Whether a text is there: it holds a letter or digit and is no stand-in for a missing text."""
    bare = F.lower(F.regexp_replace(text, _SPACE, ""))
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]") & ~(bare.isin(*STAND_INS) | bare.rlike(_BRACKETED)), F.lit(False))


_CONTIG = "chat string, block long, prefix long, suffix long, messages long, ok boolean, first long, last long, part long, before long"


def _contigs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the unambiguous paths of the overlap graph within each block of one task.

    Yields the contigs (part null) and, of every part merged, its number and the messages before it in its contig.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    chats = t.column("chat").combine_chunks().dictionary_encode()
    chat = chats.indices.to_numpy().astype(np.int64)
    block, part, prefix, suffix, messages = (t.column(n).to_numpy() for n in ("block", "part", "prefix", "suffix", "messages"))
    ok, first, last = (t.column(n).to_numpy() for n in ("ok", "first", "last"))
    n = len(chat)
    _, place = np.unique(np.stack([chat, block]), axis=1, return_inverse=True)
    place = place.reshape(-1).astype(np.int64)

    def ends(run: np.ndarray) -> np.ndarray:
        both = np.empty(n, [("p", np.int64), ("h", np.int64)])
        both["p"], both["h"] = place, run
        return both

    def shared(run: np.ndarray) -> np.ndarray:
        _, number, count = np.unique(ends(run), return_inverse=True, return_counts=True)
        return count[number]

    p_count, s_count = shared(prefix), shared(suffix)
    order = np.lexsort((prefix, place))
    key, want = ends(prefix)[order], ends(suffix)
    at = np.minimum(np.searchsorted(key, want), n - 1)
    to = order[at]
    # A suffix meets a prefix if chat, block and run agree and neither run is shared; a link never leads back.
    linked = (key[at] == want) & (s_count == 1) & (p_count[to] == 1) & (part[to] > part)
    succ = np.where(linked, to, np.arange(n))
    tail, steps, ahead = rank_lists(succ, messages)
    # Speakers alternate across a link if they differ on its two sides.
    fits = ok & (~linked | (last != first[to]))
    path = np.lexsort((-steps, tail))
    begins = np.flatnonzero(np.r_[True, tail[path][1:] != tail[path][:-1]])
    head, end = path[begins], path[np.r_[begins[1:], n] - 1]
    contig = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, n]))
    total = np.add.reduceat(messages[path], begins)
    before = np.empty(n, np.int64)
    before[path] = total[contig] - ahead[path]
    none = pa.nulls(len(head), pa.int64())
    name = lambda rows: chats.dictionary.take(pa.array(chat[rows]))
    columns = [c.split()[0] for c in _CONTIG.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [
            name(head), pa.array(block[head]), pa.array(prefix[head]), pa.array(suffix[end]), pa.array(total), pa.array(np.logical_and.reduceat(fits[path], begins)),
            pa.array(first[head]), pa.array(last[end]), none, none,
        ], names=columns,
    )
    gone = pa.nulls(n, pa.int64())
    yield pa.RecordBatch.from_arrays([name(np.arange(n)), pa.array(block), gone, gone, gone, pa.nulls(n, pa.bool_()), gone, gone, pa.array(part), pa.array(before)], names=columns)


def conversations(
    df: DataFrame, chat: str = "chat_id", seq: str = "seq", question: str = "user_text", answer: str = "assistant_text",
    turn: str = "turn_id", status: str = "status", loaded: str = "loaded_at", stride: int = STRIDE, block: int = BLOCK,
) -> DataFrame:
    """(chat_id, msg_no, turn_id, role, loaded_at, text_hash): the messages of every whole chat in order.

    The current row of a turn has the latest load time (null is the earliest; ties take the larger values).
    Rows without a turn id are void, rows whose chat is null or blank belong to no chat. A text is absent if
    ``has_content`` says so. A chat is whole if each of its rows is ``done`` and has a message, the numbers
    run 1, 2, 3 … with one turn each, and roles alternate from a user to a final assistant. Anything else,
    an empty table included, gives no rows; extra columns are ignored.

    Scale: texts are turned into flags and hashes where they are read. Rows are first aggregated by turn and by
    (chat, number), so repeats never pile up; a chat of any length is split into fragments and blocks of them.
    """
    spark = df.sparkSession
    facts = df.where(F.col(turn).isNotNull()).select(
        F.col(turn).alias("turn"), F.col(loaded).alias("loaded"), F.col(chat).alias("chat"), F.col(seq).cast("long").alias("seq"),
        F.coalesce(F.col(status) == "done", F.lit(False)).alias("done"), has_content(F.col(question)).alias("u"), has_content(F.col(answer)).alias("a"),
        F.xxhash64(question).alias("hu"), F.xxhash64(answer).alias("ha"),
    )
    current = facts.groupBy("turn").agg(F.max(F.struct("loaded", "chat", "seq", "done", "u", "a", "hu", "ha")).alias("v")).select("turn", "v.*")
    current = current.where(F.col("chat").isNotNull() & (F.regexp_replace("chat", _SPACE, "") != ""))
    slots = current.groupBy("chat", "seq").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("turn", "loaded", "done", "u", "a", "hu", "ha")).alias("t"))

    # Fragments of consecutive turns; a row without a number, or before the first, makes a fragment nothing can precede.
    numbered = F.coalesce(F.col("seq") >= 1, F.lit(False))
    own = F.floor((F.col("seq") - 1) / stride).cast("long")
    shared = ((F.col("seq") - 1) % stride < OVERLAP) & (own > 0)
    parts = F.when(~numbered, F.array(F.lit(-1).cast("long"))).when(shared, F.array(own, own - 1)).otherwise(F.array(own))
    said = F.concat(
        F.when(F.col("t.u"), F.array(F.xxhash64("seq", F.lit("user"), "t.hu"))).otherwise(F.array().cast("array<long>")),
        F.when(F.col("t.a"), F.array(F.xxhash64("seq", F.lit("assistant"), "t.ha"))).otherwise(F.array().cast("array<long>")),
    )
    placed = slots.select("chat", F.explode(parts).alias("part"), F.struct("seq", "rows", "t.turn", "t.loaded", "t.done", "t.u", "t.a", "t.hu", "t.ha", said.alias("said")).alias("slot"))
    # Slots of a fragment are at most STRIDE + OVERLAP; faulty numbers all lie in part -1, of which one row tells enough.
    faulty = placed.where("part < 0").groupBy("chat", "part").agg(F.min("slot").alias("slot")).select("chat", "part", F.array("slot").alias("slots"))
    grouped = placed.where("part >= 0").groupBy("chat", "part").agg(F.sort_array(F.collect_list("slot")).alias("slots")).unionByName(faulty)
    fragments = cut(grouped)

    first_seq, next_seq = F.col("part") * stride + 1, (F.col("part") + 1) * stride
    at = lambda i: F.element_at("slots", i)
    mine = F.filter("slots", lambda s: s["seq"] <= next_seq)
    run = lambda keep: F.flatten(F.transform(F.filter("slots", keep), lambda s: s["said"]))
    after = run(lambda s: s["seq"] > next_seq)
    neighbours = F.zip_with(F.slice("slots", 1, F.size("slots") - 1), F.slice("slots", 2, F.size("slots")), lambda x, y: x["a"] != ~y["u"])
    # Of two neighbours the first ends with an assistant if it has an answer, the second begins with one if it has no question.
    whole = (F.col("part") >= 0) & (at(1)["seq"] == first_seq) & (at(-1)["seq"] - at(1)["seq"] + 1 == F.size("slots"))
    whole = whole & F.forall("slots", lambda s: (s["rows"] == 1) & s["done"] & (s["u"] | s["a"])) & F.forall(neighbours, lambda x: F.coalesce(x, F.lit(True)))
    owned_last = F.get(mine, F.size(mine) - 1)
    graph = fragments.where(F.size("slots") > 0).select(
        "chat", F.floor(F.col("part") / block).cast("long").alias("block"), F.xxhash64(run(lambda s: s["seq"] < first_seq + OVERLAP)).alias("prefix"),
        F.when(F.size(after) > 0, F.xxhash64(after)).otherwise(F.xxhash64(F.lit("end"), "chat", "part")).alias("suffix"),
        F.coalesce(F.aggregate(mine, F.lit(0).cast("long"), lambda n, s: n + F.size(s["said"])), F.lit(0).cast("long")).alias("messages"),
        F.coalesce(whole & (F.size(mine) > 0), F.lit(False)).alias("ok"), F.when(at(1)["u"], 0).otherwise(1).cast("long").alias("first"),
        F.when(F.coalesce(owned_last["a"], F.lit(False)), 1).otherwise(0).cast("long").alias("last"), "part",
    )
    total, top = graph.agg(F.count(F.lit(1)), F.coalesce(F.max("block"), F.lit(0))).first()
    tasks = tasks_for(spark, total, FRAGMENTS_PER_TASK)
    merged = cut(graph.repartition(tasks, "chat", "block").mapInArrow(_contigs, _CONTIG))
    members = merged.where("part is not null").select("chat", "part", "block", F.col("before").alias("offset"))
    while top > 0:
        contigs = merged.where("part is null").withColumn("part", F.col("block")).withColumn("block", F.floor(F.col("block") / block).cast("long"))
        merged = cut(contigs.drop("before").repartition(tasks, "chat", "block").mapInArrow(_contigs, _CONTIG))
        outer = merged.where("part is not null").select("chat", F.col("part").alias("block"), F.col("block").alias("up"), "before")
        members = members.join(outer, ["chat", "block"]).select("chat", "part", F.col("up").alias("block"), (F.col("offset") + F.col("before")).alias("offset"))
        top //= block
    whole_chats = (
        merged.where("part is null").groupBy("chat")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ok").alias("ok"), F.min("block").alias("block"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where((F.col("n") == 1) & F.col("ok") & (F.col("block") == 0) & (F.col("first") == 0) & (F.col("last") == 1))
        .select("chat")
    )
    numbers = members.join(whole_chats, "chat", "left_semi").select("chat", "part", "offset")
    one = lambda s, role, h: F.struct(s["turn"].alias("turn"), s["loaded"].alias("loaded"), F.lit(role).alias("role"), h.alias("text_hash"))
    told = F.flatten(
        F.transform(mine, lambda s: F.filter(F.array(F.when(s["u"], one(s, "user", s["hu"])), F.when(s["a"], one(s, "assistant", s["ha"]))), lambda m: m.isNotNull()))
    )
    rows = fragments.join(numbers, ["chat", "part"]).select("chat", "offset", F.posexplode(told).alias("i", "m"))
    return rows.select(F.col("chat").alias(chat), (F.col("offset") + F.col("i") + 1).cast("int").alias("msg_no"), F.col("m.turn").alias(turn), "m.role", F.col("m.loaded").alias(loaded), "m.text_hash")


def with_texts(messages: DataFrame, df: DataFrame, question: str = "user_text", answer: str = "assistant_text", chat: str = "chat_id", turn: str = "turn_id", loaded: str = "loaded_at") -> DataFrame:
    """(chat_id, msg_no, turn_id, role, text): ``text`` is that of the row that ``conversations`` took as current, by its hash."""
    sides = F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("text")), F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("text")))
    texts = df.select(turn, F.col(loaded).alias("at"), F.explode(sides).alias("s")).select(turn, "at", "s.role", "s.text", F.xxhash64("s.text").alias("text_hash"))
    joined = messages.join(texts, [turn, "role", "text_hash"]).where(F.col("at").eqNullSafe(F.col(loaded)))
    return joined.groupBy(chat, "msg_no", turn, "role").agg(F.min("text").alias("text"))
