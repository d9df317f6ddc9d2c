"""Harmonic packing of tokenised documents into sequences of one capacity."""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.plans.scale import checkpointed

CAPACITY = 4096
END = 2
#: Distinct white-space separated chunks whose ids one worker keeps; as many older ones stay a while.
CHUNKS_KEPT = 600_000
CHUNKS_AT_ONCE = 300_000
TEXTS_AT_ONCE = 2000
#: A piece may leave 1/SLACK of its slot empty before another cut is made.
SLACK = 256
#: Sequences that one group of pieces fills, about.
GROUP_BINS = 4000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long"


class ChunkTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit binaries.

    A tokenizer that drops white space gives a text the ids of its chunks, one after the other, so each distinct
    chunk is encoded once and kept. What a text holds of special-token strings, which have no white space, is
    taken for these tokens, as the tokenizer does of itself.
    """

    #: Words by which it is found out whether the model alone codes words of small letters as the tokenizer does.
    PROBES = ("a", "word", "tokenization", "été", "straße", "ñandú", "слово", "日本語", "שלום", "हिन्दी"[:1], "ĳsvogel", "x" * 40)

    def __init__(self, path: str, kept: int = CHUNKS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.known, self.older, self.tails = Tokenizer.from_file(path), kept, {}, {}, {}
        self.number = None  # of the chunks whose ids are in one array, with their places there
        # the characters that byte-level models write octets with: visible ones as they are, others from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [o for o in range(256) if o not in seen]
        self.letters = {o: 256 + i for i, o in enumerate(hidden)}
        plain = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in self.PROBES]
        self.direct = [self.word_ids(w.encode()) for w in self.PROBES] == [array("I", x).tobytes() for x in plain]

    def word_ids(self, word: bytes) -> bytes:
        """The ids of a word of small letters from the tokenizer's model, past the steps that leave it as it is."""
        tokens = self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts. A long one is worked off in parts."""
        out, held, size = [], [], 0
        for text in texts:
            chunks = text.encode("utf-8", "replace").split()
            if len(chunks) > CHUNKS_AT_ONCE:
                parts = [chunks[at : at + CHUNKS_AT_ONCE] for at in range(0, len(chunks), CHUNKS_AT_ONCE)]
                out += self.coded(held)
                out.append(b"".join(self.coded([part])[0] for part in parts))
                held, size = [], 0
                continue
            held.append(chunks)
            size += len(chunks)
            if size > CHUNKS_AT_ONCE:
                out += self.coded(held)
                held, size = [], 0
        return out + self.coded(held)

    def coded(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of texts given as chunks: each distinct chunk is looked up when it is first met and numbered, its
        ids are dealt out to all its places together."""
        gc.disable()  # nothing here refers to itself, and the collector would walk all that is known again and again
        try:
            return self._coded(texts)
        finally:
            gc.enable()

    def _coded(self, texts: list[list[bytes]]) -> list[bytes]:
        if self.number is None or len(self.number) > self.kept:
            self.number, self.every = defaultdict(count().__next__), np.zeros(0, "<u4")
            self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = self.number
        before = len(number)
        chunks = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if not len(chunks):
            return [b""] * len(texts)
        if len(number) > before:
            new = list(islice(number, before, None))
            missing = [chunk for chunk in new if chunk not in self.known]
            if missing:
                self.learn(missing, new)
            parts = list(map(self.known.__getitem__, new))
            added = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            self.starts = np.concatenate([self.starts, len(self.every) + np.cumsum(added) - added])
            self.sizes = np.concatenate([self.sizes, added])
            self.every = np.concatenate([self.every, np.frombuffer(b"".join(parts), "<u4")])
        every, starts, sizes = self.every, self.starts, self.sizes
        length = sizes[chunks]
        ends = np.cumsum(length)
        ids = every[np.arange(ends[-1]) + np.repeat(starts[chunks] - ends + length, length)]
        stops = np.append(0, ends)[np.cumsum([0, *map(len, texts)])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(stops, stops[1:])]

    def learn(self, new: list[bytes], met: list[bytes]) -> None:
        """Makes sure that the ids of ``new`` distinct chunks are known; ``met`` are those at hand."""
        known = self.known
        if len(known) + len(new) > self.kept:  # what was not met since the last time is forgotten
            self.older, self.known = known, {}
            known, new = self.known, met
        older, words, unseen = self.older, {}, []
        if older:
            known.update((c, older[c]) for c in new if c in older)
            new = [c for c in new if c not in known]
        for chunk in new:
            word, tail, letters = stem(chunk)
            ids = known.get(word)
            if ids is None:
                words[word] = letters
                unseen.append((chunk, word, tail))
            else:
                known[chunk] = ids + self.tail(tail)
        self.encode([w for w, letters in words.items() if letters], [w for w, letters in words.items() if not letters])
        for chunk, word, tail in unseen:
            known[chunk] = known[word] + self.tail(tail)

    def encode(self, words: list[bytes], others: list[bytes]) -> None:
        """Encodes new words of small letters and other chunks."""
        if not self.direct:
            words, others = [], [*words, *others]
        model, letters = self.tokenizer.model, self.letters
        tokenize, known = model.tokenize, self.known
        for word in words:
            spelled = word.decode() if word.isascii() else word.decode("latin-1").translate(letters)
            known[word] = array("I", [t.id for t in tokenize(spelled)]).tobytes()
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        self.known.update(zip(others, (array("I", e.ids).tobytes() for e in coded), strict=True))

    def tail(self, sign: str) -> bytes:
        if sign not in self.tails:
            self.tails[sign] = array("I", self.tokenizer.encode(sign, add_special_tokens=False).ids).tobytes() if sign else b""
        return self.tails[sign]


def stem(chunk: bytes) -> tuple[bytes, str, bool]:
    """A chunk of letters, with one sign of punctuation behind them or none, as its small letters and the sign,
    which a word tokenizer codes apart; any other chunk as it is. Whether it is of letters comes last."""
    if chunk.isalpha():  # of ASCII
        return chunk.lower(), "", True
    if chunk[-1:] in b",.;:!?" and chunk[:-1].isalpha():
        return chunk[:-1].lower(), chunk[-1:].decode(), True
    text = chunk.decode()
    sign = text[-1] if text[-1] in ",.;:!?" else ""
    word = text[:-1] if sign else text
    if not word.isalpha():
        return chunk, "", False
    if not word.isascii() and (not unicodedata.is_normalized("NFC", word) or "\u03a3" in word or "\u0130" in word):
        return chunk, "", False
    return word.lower().encode(), sign, True


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return ChunkTokenizer(path)


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """The lengths of the pieces of ``n`` tokens: whole sequences, then a rest whose pieces all but fill a
    slot of their reciprocal class (slot j holds capacity // j tokens)."""
    lengths, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        slot = capacity // (capacity // rest)
        if (slot - rest) * slack <= slot:
            lengths.append(rest)
            break
        lengths.append(capacity // (capacity // rest + 1))
        rest -= lengths[-1]
    return lengths


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """Documents (doc_id, text) as pieces (doc_id, start, length, doc_tokens, ids, ids_crc32), cut for packing.

    A null text is an empty one: the end id alone. ``ids`` False leaves the ids out (null), to move less.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = chunk_tokenizer(path), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            rows, size = [], 0
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                coded_texts = tokenizer.all_ids(texts[at : at + TEXTS_AT_ONCE])
                for doc, coded in zip(docs[at : at + TEXTS_AT_ONCE], coded_texts, strict=True):
                    coded += last
                    start, n = 0, len(coded) // 4
                    for length in cuts(n, capacity):
                        part = coded[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, n, part if ids else None, zlib.crc32(part)))
                        start, size = start + length, size + (len(part) if ids else 0)
                if size > 32_000_000 or len(rows) > 100_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def harmonic_class(length: Column, capacity: int = CAPACITY) -> Column:
    """j for a length in (capacity / (j + 1), capacity / j]: j such pieces fit one sequence."""
    return F.floor(F.lit(capacity) / length).cast("long")


def pack(cut: DataFrame, capacity: int = CAPACITY, bins: int = GROUP_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to pieces of at most ``capacity``
    tokens (doc_id, start, length, any more columns).

    Lengths fall into reciprocal classes; class j fills each of its sequences with exactly j pieces. Classes
    are dealt into groups by a hash of the piece, each of about ``bins`` sequences in all, which are filled
    without knowing of each other. What the classes of a group have left over (fewer than j pieces each)
    shares sequences, the longest first, each in the fullest that takes it.

    Rows that are equal in every column are each packed. Empty tables give empty tables. ``cut`` is written
    out first, so that a lost executor cannot change an assignment. A column named like a new one is replaced.
    """
    rows = cut.drop("sequence_id", "offset")
    kept = checkpointed(rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("__row")))
    total = kept.agg(F.sum("__row.length")).first()[0] or 0
    groups = max(1, round(total / (capacity * bins)))
    tie = F.xxhash64("__row")
    table = kept.withColumns({
        "__g": F.pmod(F.xxhash64("__row.doc_id", "__row.start", tie), F.lit(groups)),
        "__j": harmonic_class(F.col("__row.length"), capacity),
    })
    of_class = W.partitionBy("__g", "__j")
    place = F.row_number().over(of_class.orderBy("__row.doc_id", "__row.start", "__row.length", tie)) - 1
    table = table.withColumns({"__n": place, "__all": F.count("*").over(of_class)})
    table = table.withColumn("__bin", F.floor(F.col("__n") / F.col("__j")))
    whole = F.col("__bin") < F.floor(F.col("__all") / F.col("__j"))

    # a sequence id holds the group, the class and the number of the sequence in it; class 0 is of the rests
    first = F.col("__g") * F.lit(1 << 32)
    before = W.partitionBy("__g", "__j", "__bin").orderBy("__n").rowsBetween(W.unboundedPreceding, -1)
    filled = table.where(whole).select(
        "__row.*",
        (first + F.col("__j") * F.lit(1 << 18) + F.col("__bin")).alias("sequence_id"),
        F.coalesce(F.sum("__row.length").over(before), F.lit(0)).alias("offset"),
    )
    rest = table.where(~whole).withColumn("length", F.col("__row.length"))
    placed = rest.select("__g", "__j", "__n", "length").groupBy("__g").applyInPandas(
        lambda frame: fullest_first(frame, capacity), "__g long, __j long, __n long, __bin long, offset long"
    )
    shared = rest.drop("__bin").join(placed, ["__g", "__j", "__n"])
    return filled.union(shared.select("__row.*", (first + F.col("__bin")).alias("sequence_id"), "offset"))


def fullest_first(frame: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Lays the rests of a group's classes, fewer than j pieces each, into shared sequences."""
    frame = frame.sort_values(["length", "__j", "__n"], ascending=[False, True, True])
    room: list[tuple[int, int]] = []  # what each sequence has left, in order
    bins, offsets, opened = [], [], 0
    for length in frame["length"].tolist():
        at = bisect_left(room, (length, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number, opened = capacity, opened, opened + 1
        bins.append(number)
        offsets.append(capacity - left)
        if left > length:
            insort(room, (left - length, number))
    return frame[["__g", "__j", "__n"]].assign(__bin=bins, offset=offsets)
