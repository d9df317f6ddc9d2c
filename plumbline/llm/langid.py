"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.scale import checkpointed

ORDER = 4
UNKNOWN = "und"
#: Characters of texts that are looked at together; longer texts are cut into windows that overlap.
AT_ONCE = 500_000
#: Distinct grams of the highest order, of all languages, that the driver and each worker may hold. More stay in
#: tables, which the distinct grams of the texts are joined to; the results are the same.
MODEL_ROWS = 1_000_000
#: Characters of a block of texts that meets such tables, times the languages: it holds the costs of its grams.
BLOCK_COSTS = 40_000_000
#: A text is rejected beyond so many deviations of a language's own entropy: those of its texts and those that
#: the symbols of a text of this length have.
DEVIATIONS = 6.0
_SPACE = 32


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The 16-bit symbol of every code point: the small letter of a letter, a space for all else. Letters
    beyond 16 bits share the private symbols."""
    out = np.full(0x110000, _SPACE, np.uint16)
    for cp in range(0x110000):
        char = chr(cp)
        if char.isalpha():
            low = char.lower()
            small = ord(low) if len(low) == 1 else cp
            out[cp] = small if small < 0x10000 else 0xE000 + small % 6400
    return out


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a text, composed, runs of other characters being one space; empty without a letter."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    found = symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    blank = found == _SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    found = found[keep]
    return found if (found != _SPACE).any() else found[:0]


def grams(found: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each symbol, it and the order - 1 before it in one 64-bit number, the newest lowest. Spaces stand
    before the text."""
    padded = np.concatenate([np.full(order - 1, _SPACE, np.uint16), found]).astype(np.uint64)
    out = np.zeros(len(found), np.uint64)
    for back in range(order):
        out |= padded[order - 1 - back : order - 1 - back + len(found)] << np.uint64(16 * back)
    return out


def windows(text: str | None, order: int = ORDER) -> Iterator[np.ndarray]:
    """The grams of a whole text, at most about AT_ONCE at a time."""
    if not text:
        return
    if len(text) <= AT_ONCE:
        found = symbols_of(text)
        if len(found):
            yield grams(found, order)
        return
    last = np.zeros(0, np.uint16)
    for at in range(0, len(text), AT_ONCE):
        found = symbols_of(text[at : at + AT_ONCE])
        if len(found):
            joined = np.concatenate([last, found])
            yield grams(joined, order)[len(last) :]
            last = joined[-(order - 1) :] if order > 1 else last


def count_rows(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each gram of the highest order occurs in a language's texts. Each task sums
    what it has read before anything is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def settle(lang: str) -> None:
            codes, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            held[lang] = 0
            if lang in sums:
                both = np.concatenate([sums[lang][0], codes])
                codes, where = np.unique(both, return_inverse=True)
                n = np.bincount(where, np.concatenate([sums[lang][1], n]).astype(float)).astype(np.int64)
            sums[lang] = codes, n

        def rows(lang: str) -> pd.DataFrame:
            codes, n = sums.pop(lang)
            return pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n})

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                for codes in windows(text, order):
                    waiting.setdefault(lang, []).append(codes)
                    held[lang] = held.get(lang, 0) + len(codes)
                    if held[lang] > AT_ONCE:
                        settle(lang)
                        if len(sums[lang][0]) > 2 * AT_ONCE:
                            yield rows(lang)
        for lang in list(waiting):
            settle(lang)
        for lang in list(sums):
            yield rows(lang)

    counted = texts.where("lang is not null and text is not null").mapInPandas(run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def mixed(codes: np.ndarray) -> np.ndarray:
    """A reversible 64-bit hash of grams."""
    with np.errstate(over="ignore"):
        return (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def low(codes: np.ndarray, order: int) -> np.ndarray:
    """The newest ``order`` symbols of grams."""
    return codes if order >= 4 else codes & np.uint64((1 << (16 * order)) - 1)


@dataclass
class Level:
    """One order of a language's model in sorted hash arrays: the discounted shares of its grams, and for its
    contexts the weight of the next lower order."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray

    def of(self, codes: np.ndarray, order: int, below: np.ndarray) -> np.ndarray:
        share = _found(self.grams, self.share, mixed(low(codes, order)), 0.0)
        weight = _found(self.contexts, self.weight, mixed(low(codes >> np.uint64(16), order - 1)), 1.0)
        return share + weight * below


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def discount_of(once: int, twice: int) -> float:
    """The absolute discount of an order, from its grams met once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))


def levels_of(codes: np.ndarray, n: np.ndarray, order: int) -> list[Level]:
    """Interpolated Kneser-Ney: occurrences for the highest order, below it the number of distinct symbols that
    stand before a gram; one absolute discount an order, from the grams met once and twice."""
    out = []
    for k in range(order, 0, -1):
        contexts, of = np.unique(low(codes >> np.uint64(16), k - 1), return_inverse=True)
        total, types = np.bincount(of, n), np.bincount(of)
        once, twice = int((n == 1).sum()), int((n == 2).sum())
        discount = discount_of(once, twice)
        grams, keys = mixed(codes), mixed(contexts)
        g, c = np.argsort(grams), np.argsort(keys)
        out.append(Level(grams[g], ((n - discount) / total[of])[g], keys[c], (discount * types / total)[c]))
        codes, n = np.unique(low(codes, k - 1), return_counts=True)
    return out[::-1]


@dataclass
class Model:
    """Models of several languages, and what their rejection is calibrated on: the mean entropy (bits a
    character) of their own texts, its deviation between texts and that of single characters."""

    languages: list[str]
    levels: list[list[Level]]
    alphabet: int
    entropy: np.ndarray | None = None
    deviation: np.ndarray | None = None
    spread: np.ndarray | None = None

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each gram's newest symbol, a row for each language."""
        out = np.empty((len(self.languages), len(codes)))
        for i, levels in enumerate(self.levels):
            p = np.full(len(codes), 1.0 / self.alphabet)
            for k, level in enumerate(levels, 1):
                p = level.of(codes, k, p)
            out[i] = -np.log2(p)
        return out

    def entropies(self, texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of each text, bits a symbol of each language and text) of whole texts."""
        return self.moments(texts, order, 1)[:2]

    def moments(self, texts: list[str | None], order: int = ORDER, powers: int = 2) -> tuple[np.ndarray, ...]:
        """(symbols of each text, then the means of the first ``powers`` powers of the bits of a symbol, of each
        language and text) of whole texts."""
        sizes, bits = np.zeros(len(texts), np.int64), np.zeros((powers, len(self.languages), len(texts)))
        places: list[int] = []
        parts: list[np.ndarray] = []

        def settle() -> None:
            if parts:
                codes = np.concatenate(parts)
                distinct = np.unique(codes)
                costs, at = self.costs(distinct), np.searchsorted(distinct, codes)
                lengths = np.array([len(p) for p in parts])
                first = np.cumsum(lengths) - lengths
                for i in range(len(self.languages)):
                    cost = costs[i][at]
                    for power in range(powers):
                        np.add.at(bits[power, i], places, np.add.reduceat(cost if not power else cost ** (power + 1), first))
                np.add.at(sizes, places, lengths)
                places.clear()
                parts.clear()

        held = 0
        for place, text in enumerate(texts):
            for codes in windows(text, order):
                places.append(place)
                parts.append(codes)
                held += len(codes)
                if held > AT_ONCE:
                    settle()
                    held = 0
        settle()
        return sizes, *(bits / np.maximum(sizes, 1))

    def limits(self, best: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entropy beyond which a text of a language and size is rejected."""
        own = self.deviation[best] ** 2 + self.spread[best] ** 2 / np.maximum(sizes, 1)
        return self.entropy[best] + DEVIATIONS * np.sqrt(own)


@dataclass
class Met(Model):
    """A model that knows the costs of some sorted grams only."""

    codes: np.ndarray | None = None
    bits: np.ndarray | None = None

    def costs(self, codes: np.ndarray) -> np.ndarray:
        return self.bits[:, np.searchsorted(self.codes, codes)]


@dataclass
class Tables(Model):
    """The same model in tables, an order each: (code, shares) of the grams and (context, weights) of their
    contexts, maps by a language's place."""

    shares: list[DataFrame] | None = None
    weights: list[DataFrame] | None = None

    def probabilities(self, codes: DataFrame) -> DataFrame:
        """(code, p) of distinct grams: the probability of the newest symbol, an array over the languages. Each
        order takes the next lower one's from its own distinct grams, so a key meets at most as many rows as
        there are symbols."""
        found = None
        for k, (shares, weights) in enumerate(zip(self.shares, self.weights, strict=True), 1):
            here = codes.select(_low("code", k).alias("code")).distinct().withColumn("context", _context("code", k))
            here = here.join(shares, "code", "left").join(F.broadcast(weights) if k == 1 else weights, "context", "left")
            if found is None:
                here = here.withColumn("below", F.array_repeat(F.lit(1.0 / self.alphabet), len(self.languages)))
            else:
                here = here.withColumn("lower", _low("code", k - 1)).join(found.select(F.col("code").alias("lower"), F.col("p").alias("below")), "lower")
            at = lambda name, i, missing: F.coalesce(F.try_element_at(name, i), F.lit(missing))
            p = F.transform("below", lambda x, i: at(F.col("shares"), i, 0.0) + at(F.col("weights"), i, 1.0) * x)  # noqa: B023
            found = checkpointed(here.select("code", p.alias("p")))
        return found


def _low(code: str, order: int) -> Column:
    return F.col(code) if order >= 4 else F.col(code).bitwiseAND(F.lit((1 << (16 * order)) - 1).cast("long"))


def _context(code: str, order: int) -> Column:
    """What stands before the newest symbol of a gram."""
    return F.shiftrightunsigned(code, 16).bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1).cast("long"))


def tables_of(counts: DataFrame, order: int) -> Tables:
    """What ``levels_of`` computes, of all languages in grouped sums and joins."""
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    places = counts.sparkSession.createDataFrame(list(enumerate(languages)), "at int, lang string")
    by_place = lambda value: F.map_from_entries(F.collect_list(F.struct("at", value)))
    counts = checkpointed(counts.join(F.broadcast(places), "lang").select("at", "code", F.col("n").cast("double").alias("n")))
    shares, weights, letters = [], [], 2
    for k in range(order, 0, -1):
        met = counts.groupBy("at").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count("*")).collect()
        discount = F.create_map(*[x for at, once, twice, _ in met for x in (F.lit(at), F.lit(discount_of(once, twice)))])[F.col("at")]
        counts = counts.withColumn("context", _context("code", k))
        sums = checkpointed(counts.groupBy("at", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")))
        share = counts.join(sums, ["at", "context"]).select("code", "at", ((F.col("n") - discount) / F.col("total")).alias("share"))
        shares.append(checkpointed(share.groupBy("code").agg(by_place("share").alias("shares"))))
        weight = sums.withColumn("weight", discount * F.col("types") / F.col("total"))
        weights.append(checkpointed(weight.groupBy("context").agg(by_place("weight").alias("weights"))))
        if k == 1:
            letters = max(letters, 1 + max(n for *_, n in met))
        counts = checkpointed(counts.groupBy("at", _low("code", k - 1).alias("code")).agg(F.count("*").cast("double").alias("n")))
    return Tables(languages, [], letters, shares=shares[::-1], weights=weights[::-1])


def model_of(counts: DataFrame, order: int) -> Model:
    frame = counts.toPandas()
    languages, levels, letters = sorted(frame["lang"].unique()), [], 2
    for lang in languages:
        rows = frame[frame["lang"] == lang]
        levels.append(levels_of(rows["code"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(float), order))
        letters = max(letters, len(levels[-1][0].grams) + 1)
    return Model(languages, levels, letters)


def fit(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> Model:
    """The models of all languages of (doc_id, lang, text), counted over every row with a language and a text;
    others teach nothing. The rejection is calibrated on the entropies of all these rows. Up to ``model_rows``
    distinct grams, which are counted first, come to the driver; more stay in tables. Beyond that the driver gets a
    few numbers a language."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = checkpointed(count_rows(texts, order))
    known = counts.count()
    model = model_of(counts, order) if known <= max(model_rows, 0) or not known else tables_of(counts, order)
    languages = model.languages
    model.entropy, model.deviation, model.spread = (np.zeros(len(languages)) for _ in range(3))
    if languages:
        own = entropy_rows(texts.where("lang is not null and text is not null"), model, order).where("best = lang")
        spread = F.sqrt(F.sum(F.col("variance") * F.col("size")) / F.sum("size"))
        for lang, *found in own.groupBy("lang").agg(F.avg("bits"), F.coalesce(F.stddev("bits"), F.lit(0.0)), spread).collect():
            place = languages.index(lang)
            model.entropy[place], model.deviation[place], model.spread[place] = found
    return model


#: Columns that are computed for the texts of a batch.
Judge = Callable[[Model, list[str | None], int], list[pa.Array]]


def with_judged(docs: DataFrame, model: Model, order: int, judge: Judge, added: list[T.StructField]) -> DataFrame:
    """Documents and the columns that ``judge`` adds to them."""
    schema = T.StructType([*docs.schema.fields, *added])
    names = [f.name for f in added]
    place = docs.columns.index("text")
    if isinstance(model, Tables):
        return _joined(docs, model, order, judge, schema, names)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = judge(held.value, batch.column(place).to_pylist(), order)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _joined(docs: DataFrame, model: Tables, order: int, judge: Judge, schema: T.StructType, names: list[str]) -> DataFrame:
    """Documents are cut into blocks (one beyond a block's characters is a block), which are packed whole and have
    the distinct grams beside them. The distinct grams of all blocks meet the tables, and each block the costs of
    its grams."""
    place, at_once = docs.columns.index("text"), max(AT_ONCE, min(8 * AT_ONCE, BLOCK_COSTS // len(model.languages)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(place).to_pylist()
            ends = np.cumsum([len(t or "") for t in texts]) // at_once
            starts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                found = [np.unique(codes) for t in texts[a:b] for codes in windows(t, order)]
                codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                packed = [pa.array([block]), pa.array([sink.getvalue().to_pybytes()]), pa.array([codes.view(np.int64)], pa.list_(pa.int64()))]
                block += 1
                yield pa.RecordBatch.from_arrays(packed, names=["block", "rows", "codes"])

    packed = checkpointed(docs.mapInArrow(cut, "block long, rows binary, codes array<long>"))
    met = packed.select(F.col("block").alias("of"), F.explode("codes").alias("code"))
    costs = met.join(model.probabilities(checkpointed(met.select("code").distinct())), "code")
    languages, alphabet, limits = model.languages, model.alphabet, (model.entropy, model.deviation, model.spread)

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        codes = known.column("code").to_numpy().view(np.uint64)
        by_code = np.argsort(codes)
        p = known.column("p").combine_chunks().flatten().to_numpy().reshape(len(codes), len(languages))
        seen = Met(languages, [], alphabet, *limits, codes[by_code], -np.log2(p[by_code].T))
        rows = pa.ipc.open_stream(block.column("rows")[0].as_buffer()).read_all()
        columns = judge(seen, rows.column(place).to_pylist(), order)
        return pa.Table.from_arrays([*rows.columns, *columns], names=[*rows.column_names, *names])

    return packed.select("block", "rows").groupBy("block").cogroup(costs.groupBy("of")).applyInArrow(run, schema)


def entropy_rows(texts: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """(lang, best, bits, variance, size): the language of the lowest entropy, that entropy, the variance of the
    bits of a symbol and the number of symbols, of the texts with a letter."""

    def judge(model: Model, texts: list[str | None], order: int) -> list[pa.Array]:
        sizes, bits, squares = model.moments(texts, order)
        at = bits.argmin(axis=0), np.arange(len(texts))
        best = [model.languages[i] if n else None for i, n in zip(at[0], sizes, strict=True)]
        variance = np.maximum(squares[at] - bits[at] ** 2, 0.0)
        return [pa.array(best, pa.string()), pa.array(bits[at]), pa.array(variance), pa.array(sizes, pa.int64())]

    added = [T.StructField("best", T.StringType()), T.StructField("bits", T.DoubleType())]
    added += [T.StructField("variance", T.DoubleType()), T.StructField("size", T.LongType())]
    return with_judged(texts.select("lang", "text"), model, order, judge, added).drop("text").where("best is not null")


def predict(
    docs: DataFrame, model: Model, order: int = ORDER, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")
) -> DataFrame:
    """Adds three columns to the documents: ``lang_pred``, the language of the lowest entropy a character over the whole text
    (ties: the first by name); ``score``, its share (0 to 1) among all; ``accepted``, false for texts that are
    null, have no letter or are beyond the entropy that the language's own texts have. Texts without a letter
    are ``und`` with score 0, as are all if no language was learned. Columns of the same ``names`` are replaced."""
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())

    def judge(model: Model, texts: list[str | None], order: int) -> list[pa.Array]:
        return [pa.array(c, k) for c, k in zip(judged(model, texts, order), (pa.string(), pa.float64(), pa.bool_()), strict=True)]

    return with_judged(docs.drop(*names), model, order, judge, list(map(T.StructField, names, kinds)))


def judged(model: Model, texts: list[str | None], order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray]:
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    sizes, bits = model.entropies(texts, order)
    best, known = bits.argmin(axis=0), sizes > 0
    least = bits.min(axis=0)
    share = 1.0 / np.exp2((least - bits) * np.minimum(sizes, 20)).sum(axis=0)
    langs = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
    return langs, np.where(known, share, 0.0), known & (least <= model.limits(best, sizes))
