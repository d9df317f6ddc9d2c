"""SimHash fingerprints of whole texts and their near copies, found with the pigeonring principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, look_up
from plumbline.llm.hashing import xxh64_slices
from plumbline.plans.scale import checkpointed, is_small

SHINGLE = 3
MAX_BITS = 2
#: Shingles hashed at once, and words of a text that are looked at together.
AT_ONCE = 200_000
#: Members of a bucket that one task compares; a larger bucket is dealt out in pairs of parts of this size.
PART = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprint_of(counts: np.ndarray, n: int) -> int:
    """The signed 64-bit number whose bits are those set in over half of ``n`` hashes."""
    number = sum(1 << i for i, c in enumerate(counts.tolist()) if 2 * c > n)
    return number - (1 << 64) if number >> 63 else number


def text_fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> list[int]:
    """Fingerprints of whole texts: ASCII letters lower-cased, words between ASCII white space, hashes of all
    shingles with their repeats. A text of fewer words is one shingle; without words it is zero."""
    out: list[int] = []
    waiting: list[tuple[int, np.ndarray, np.ndarray, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not waiting:
            return
        buffer, base, starts, ends, sizes = [], 0, [], [], []
        for _, first, last, joined in waiting:
            buffer.append(joined)
            starts.append(first + base)
            ends.append(last + base)
            sizes.append(len(first))
            base += len(joined)
        hashes = xxh64_slices(b"".join(buffer), np.concatenate(starts), np.concatenate(ends))
        at = 0
        for (place, *_), n in zip(waiting, sizes, strict=True):
            out[place] = fingerprint_of(shingle_bits(hashes[at : at + n]), n)
            at += n
        waiting.clear()
        held = 0

    for place, text in enumerate(texts):
        out.append(0)
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            continue
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        last = np.cumsum(sizes + 1) - 1
        first, joined = last - sizes, b" ".join(words)
        span = min(shingle, len(words))
        first, last = first[: len(words) - span + 1], last[span - 1 :]
        if len(first) > AT_ONCE:
            counts = np.zeros(64, np.int64)
            for at in range(0, len(first), AT_ONCE):
                low, high = first[at : at + AT_ONCE], last[at : at + AT_ONCE]
                counts += shingle_bits(xxh64_slices(joined[low[0] : high[-1]], low - low[0], high - low[0]))
            out[place] = fingerprint_of(counts, len(first))
            continue
        waiting.append((place, first, last, joined))
        held += len(first)
        if held > AT_ONCE:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(text_fingerprints(batch.column(1).to_pylist(), shingle), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of a fingerprint: one more than the distance."""
    edges = [round(i * 64 / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def ring_passes(difference: np.ndarray, start: int, max_bits: int) -> np.ndarray:
    """Which differences survive the chains that begin at segment ``start`` of the ring: with m segments, the
    first l segments from there may differ in l * max_bits // m bits in all, for every l up to m.

    Two fingerprints within ``max_bits`` have such a start, so nothing is lost; a chain of length 1 is the
    bucket itself, the chain of all m segments is the full Hamming check.
    """
    parts = segments(max_bits)
    alive, seen = np.ones(difference.shape, bool), np.zeros(difference.shape, np.uint8)
    for l in range(1, len(parts) + 1):
        first, width = parts[(start + l - 1) % len(parts)]
        seen += np.bitwise_count((difference >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.uint8)
        alive &= seen <= l * max_bits // len(parts)
    return alive


def forest(fps: np.ndarray, others: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what the links between two lists connect, at most one for each member."""
    same = fps is others
    nodes = fps if same else np.concatenate([fps, others])
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found, shift = [], 0 if same else len(fps)
    for at in range(0, len(fps), 256):
        rows = fps[at : at + 256, None]
        linked = ring_passes(rows ^ others[None, :], start, max_bits)
        if same:
            linked &= np.arange(len(others))[None, :] > np.arange(at, at + len(rows))[:, None]
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(at + int(i)), find(shift + int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((at + int(i), shift + int(j)))
    return [(int(nodes[i]), int(nodes[j])) for i, j in found]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, part: int = PART) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all those within ``max_bits`` bits.

    Fingerprints meet in buckets, one for each segment value (a chain of length one). Buckets are dealt over
    tasks, where chains are checked and only a spanning forest of the links leaves. A bucket of more than
    ``part`` members is cut into parts by a hash, each pair of parts is a bucket of its own.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("start"), segment(F.col("fp"), a, w).alias("value")) for i, (a, w) in enumerate(segments(max_bits))])
    rows = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    sizes = rows.groupBy("start", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, ["start", "value"])
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), parts).cast("int")
    met = met.withColumns({"parts": parts, "mine": mine})
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("fp", "start", "value", "mine", other.alias("with"))
    met = met.select(
        "fp", "start", "value", F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"),
        (F.col("mine") > F.col("with")).alias("side"),
    )
    cell = ["start", "value", "low", "high"]
    # the cells of a task come one after the other
    sorted_cells = met.repartition(*cell).sortWithinPartitions(*cell, "side", "fp")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = (frame[cell] != frame[cell].shift()).any(axis=1).to_numpy()
            last = int(np.flatnonzero(new)[-1]) if len(frame) else 0
            held = frame.iloc[last:]
            yield within(frame.iloc[:last], new[:last])
        if held is not None and len(held):
            yield within(held.reset_index(drop=True), np.arange(len(held)) == 0)

    def within(frame: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        fps, start = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["start"].to_numpy()
        side, diagonal = frame["side"].to_numpy(), (frame["low"] == frame["high"]).to_numpy()
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(frame)))
        found: list[tuple[int, int]] = []
        small = np.repeat((size <= 16) & diagonal[first], size) if len(first) else np.zeros(0, bool)
        group = np.cumsum(new)
        for step in range(1, 16):  # neighbours at a fixed distance, of all small cells at once
            if step >= len(fps):
                break
            pair = small[step:] & (group[step:] == group[:-step])
            at = np.flatnonzero(pair)
            for s in np.unique(start[at]) if len(at) else []:
                these = at[start[at] == s]
                passed = these[ring_passes(fps[these] ^ fps[these + step], int(s), max_bits)]
                found += zip(fps[passed].tolist(), fps[passed + step].tolist(), strict=True)
        for a, n in zip(first.tolist(), size.tolist(), strict=True):
            if n <= 16 and diagonal[a]:
                continue
            mine = fps[a : a + n]
            if diagonal[a]:
                found += forest(mine, mine, int(start[a]), max_bits)
            else:
                left = side[a : a + n]
                found += forest(mine[~left], mine[left], int(start[a]), max_bits)
        pairs = np.asarray(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return sorted_cells.mapInPandas(compare, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: (doc_id, fp, component_id), the component being the smallest doc_id that links of
    at most ``max_bits`` differing bits reach, the document itself included.

    Null texts and texts without words have fingerprint zero and link like any other. Copies share a
    fingerprint and count once in every join; repeated rows stay repeated. A null doc_id takes part in no
    component's name: it gets the smallest id of its group, null if there is none.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = components(links(distinct.select("fp"), max_bits))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = checkpointed(grouped.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    names = checkpointed(grouped.join(named, "root").select("fp", "component_id"))
    return look_up(rows, names, ["fp"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without the near copies: of each component the document of the smallest id stays. Rows that
    repeat an id count once (the smallest row); rows without an id stay, as nothing names them.

    The texts move only where the ids to drop are too many to broadcast.
    """
    found = checkpointed(near_copies(docs, shingle, max_bits).where("doc_id is not null"))
    by_id = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c")))
    dropped = by_id.where("c <> doc_id").select(F.col("doc_id").alias("__id"))
    repeated = checkpointed(by_id.where("c = doc_id and n > 1").select(F.col("doc_id").alias("__id")))
    same = docs["doc_id"].cast("long") == F.col("__id")
    kept = docs.join(_hint(checkpointed(dropped)), same, "left_anti")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    again = docs.join(_hint(repeated), same, "left_semi").select(docs["doc_id"], row)
    single = again.groupBy("doc_id").agg(F.min("__row").alias("__row")).select("__row.*")
    return kept.join(_hint(repeated), same, "left_anti").union(single)


def _hint(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if is_small(ids, 2_000_000) else ids
