"""Encoding texts with the byte-level BPE of a public tokenizer, exactly.

Method: bytes are mapped to Latin-1 characters, so one automaton over the vocabulary finds all tokens at every
position. Starting from the longest match, tokens are laid side by side as long as each adjacent pair is
compatible, that is, as the merges would have left that boundary alone; compatibility is memoised. On a dead
end the encoder steps back to a shorter token and marks the position as dead, so every position is tried
once for each token that can start there: linear time, and exactly the ids that the merges give.
"""

from __future__ import annotations

import ast
import json
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie on the driver; executors get the file from there.
VOCABULARIES = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Words of at most this many bytes are kept, up to this many of them, in a worker's memory.
CACHED_BYTES, CACHED_WORDS = 64, 200_000


def split_pattern(tokenizers: str = VOCABULARIES) -> str:
    """The pattern that splits a text before the merges, as the vocabularies' own module states it."""
    with open(os.path.join(tokenizers, "__init__.py"), encoding="utf-8") as f:
        stated = ast.parse(f.read()).body
    return next(ast.literal_eval(x.value) for x in stated if isinstance(x, ast.Assign) and x.targets[0].id == "PATTERN")


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Byte-level BPE from a vocabulary file with its ranked merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = _byte_of_symbol()
        latin = lambda s: "".join(chr(of[c]) for c in s)
        ids = {latin(s): i for s, i in model["vocab"].items() if all(c in of for c in s)}
        self.length = {i: len(s) for s, i in ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[latin(left)], ids[latin(right)]
            whole = ids[latin(left) + latin(right)]
            self.merged[a, b] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (a, b)
        # Only tokens that the merges themselves can make, and single bytes, may stand in a result.
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            if len(s) == 1 or i in self.rank:
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.single = {s: i for s, i in ids.items() if len(s) == 1}
        self.split = regex.compile(pattern).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a boundary between the tokens a and b.

        The two tokens are taken apart from the latest merge on. If at some stage the parts that meet at the
        boundary have a merge of their own, which comes before the merge that hides it, the boundary is gone.
        """
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        rank, parts, merged = self.rank, self.parts, self.merged
        # x | y are the parts that meet at some stage; the merges so ranked take them into larger parts. Equal
        # merges run from the left: one that takes x away comes before one at the boundary, one for y after.
        x, y = a, b
        takes_x = takes_y = 1 << 60
        while True:
            meeting = merged.get((x, y))
            if meeting is not None and meeting < takes_x and meeting <= takes_y:
                return False
            made_x, made_y = rank.get(x, -1), rank.get(y, -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                takes_x, x = made_x, parts[x][1]
            else:
                takes_y, y = made_y, parts[y][0]

    def word(self, word: str) -> list[int]:
        """Ids of one word of the split, given as Latin-1 characters."""
        n = len(word)
        if n == 1:
            return [self.single[word]]
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(word):
            starts[end - length + 1].append((length, token))
        # Matches of one start come with growing length, so the longest is last.
        compatible, alive = self.compatible, bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, tries = 0, [len(starts[0]) - 1]
        while at < n:
            options, k = starts[at], tries[-1]
            while k >= 0:
                length, token = options[k]
                if alive[at + length] and (not tokens or compatible(tokens[-1], token)):
                    break
                k -= 1
            if k >= 0:
                tries[-1] = k - 1
                tokens.append(token)
                at += length
                if at < n:
                    tries.append(len(starts[at]) - 1)
            else:
                alive[at] = 0
                tries.pop()
                at -= self.length[tokens.pop()]
        return tokens

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for null and empty texts."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = self.word(raw.decode("latin-1"))
                if len(raw) <= CACHED_BYTES:
                    if len(words) >= CACHED_WORDS:
                        words.clear()
                    words[word] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(name: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    found = _ENCODERS.get((name, pattern))
    if found is None:
        found = _ENCODERS[name, pattern] = Encoder(SparkFiles.get(name), pattern)
    return found


def _send(spark: SparkSession, vocabulary: str, tokenizers: str) -> str:
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_graphloom_vocabularies", set())
    if vocabulary not in sent:
        context.addFile(os.path.join(os.path.realpath(tokenizers), vocabulary))
        sent.add(vocabulary)
    return split_pattern(tokenizers)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", keep: list[str] | None = None, vocabulary: str = VOCABULARY, tokenizers: str = VOCABULARIES, count_only: bool = False) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with the token ids of ``text``, an empty list for null and empty texts.

    With ``count_only`` the new column holds their number instead. A column named ``ids`` before is replaced.
    No shuffle: the vocabulary goes to each executor once, texts stay where they are read, and a text goes to
    Python once and comes back only if it is kept.
    """
    pattern = _send(df.sparkSession, vocabulary, tokenizers)
    kept = [c for c in (df.columns if keep is None else keep) if c != ids]
    arrow = pa.int32() if count_only else pa.list_(pa.int32())
    whole = text in kept and df.schema[text].dataType.simpleString() == "string"
    place = kept.index(text) if whole else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for b in batches:
            lists = [encoder.encode(t) for t in b.column(place).to_pylist()]
            values = pa.array([len(x) for x in lists] if count_only else lists, arrow)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], values], names=[*[f"c{i}" for i in range(len(kept))], "ids"])

    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("ids", T.IntegerType() if count_only else T.ArrayType(T.IntegerType()))])
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], *([] if whole else [F.col(text).cast("string").alias("text")]))
    return rows.mapInArrow(run, schema).toDF(*kept, ids)


def decoder(vocabulary: str = VOCABULARY, tokenizers: str = VOCABULARIES) -> dict[int, bytes]:
    """The bytes of every id."""
    of = _byte_of_symbol()
    with open(os.path.join(tokenizers, vocabulary), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {i: bytes(of[c] for c in s) for s, i in vocab.items() if all(c in of for c in s)}
