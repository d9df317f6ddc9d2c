"""Phrase collocations of a corpus: suffix pointers routed by their leading words, three-way quicksort in tasks."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.plans.scale import checkpointed

LEAST = 100
LONGEST = 5
#: Words that a task works on at once, and distinct ones that it counts before it hands them on.
WORDS_AT_ONCE = 2_000_000
WORDS_KEPT = 800_000
#: Words for each route; a route is what one task sorts.
ROUTE_WORDS = 1_500_000
#: Words looked at together for one draw, the windows drawn out of them, and the most that choose routes' bounds.
DRAW_WORDS = 200_000
DRAWN = 64
DRAWN_IN_ALL = 200_000
#: A filter of frequent words or pairs has two to this power of bits (8 MB).
FILTER_BITS = 26
#: Parts of a language that are ranked before their first rows are ranked together.
RANK_PARTS = 64
# fixed values: letters to lower, signs that end a piece (as an octet that UTF-8 never holds)
END = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
SUFFIXES = "route int, part binary"


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, with END between pieces."""
    return text.translate(_TABLE).replace(END, b" " + END + b" ").split()


def word_hash(lang: str, words: list[bytes], seed: int) -> list[int]:
    """Unsigned 64-bit hashes of a language's words, as ``hash_column`` gives them signed."""
    start = xxhash.xxh64_intdigest(f"{seed} {lang}".encode(), 42)
    return [xxhash.xxh64_intdigest(w, start) for w in words]


def hash_column(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{seed} "), lang), word)


def _texts(docs: DataFrame) -> DataFrame:
    """(lang, text as octets) of all documents that hold a text."""
    text = docs["text"].cast("string")
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    return docs.where(F.length(text) > 0).select(lang.alias("lang"), text.cast("binary").alias("text"))


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Lists of (lang, words) of about ``most`` words; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            held.append((lang, words))
            size += len(words)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def units(docs: DataFrame, longest: int = LONGEST, at_once: int = DRAW_WORDS) -> DataFrame:
    """(lang, word, n): how often each word occurs in each language. Rows whose ``word`` holds spaces are drawn
    windows of words; they choose bounds of routes and nothing else."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Counter] = defaultdict(Counter)
        for group in _batches(batches, at_once):
            drawn = set()
            step = max(1, sum(len(w) for _, w in group) // DRAWN)
            for lang, words in group:
                kept[lang].update(words)
                for at in range(step // 2 if len(words) > step else first_place(words, step), len(words), step):
                    window = words[at : at + longest]
                    window = window[: window.index(END)] if END in window else window
                    if len(window) > 1:
                        drawn.add((lang, b" ".join(window)))
            if drawn:
                yield _rows([(lang, w, 1) for lang, w in drawn])
            if sum(map(len, kept.values())) > WORDS_KEPT:
                yield _counted(kept)
                kept.clear()
        if kept:
            yield _counted(kept)

    rows = _texts(docs).mapInArrow(counted, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def first_place(words: list[bytes], step: int) -> int:
    """Where the first window of a short text is drawn, if any: by its length and first word, so that texts
    shorter than a step are drawn from in proportion."""
    return xxhash.xxh64_intdigest(words[0] if words else b"", len(words)) % step


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    lang, word, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"]
    )


def _counted(kept: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, w, n) for lang, counts in kept.items() for w, n in counts.items() if w != END]
    return _rows(rows or [("und", b"", 0)])


def frequent_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Whether a hash's lowest bits are those of any row, as bits: an array of fixed size, whatever the corpus."""
    low = F.col("hash").bitwiseAND((1 << bits) - 1)
    blocks = hashes.select(F.shiftright(low, 15).cast("int").alias("block"), low.bitwiseAND(32767).alias("bit"))
    out = np.zeros((1 << max(0, bits - 15), 4096), np.uint8)
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        out[row.block] = np.frombuffer(row["map"], np.uint8)
    return out.reshape(-1)[: 1 << max(0, bits - 3)]


def passes(kept: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through: all that it was made of, and a few others."""
    low = hashes & np.uint64(8 * len(kept) - 1)
    return (kept[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    mixed = (first ^ (second * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def bounds_of(drawn: DataFrame, words: np.ndarray, pairs: np.ndarray, total: int, route_words: int, seed: int, longest: int = LONGEST) -> np.ndarray:
    """Windows of hashes, in order, that part all windows into about equal shares of ``route_words`` of ``total``
    words. They come from at most about ``DRAWN_IN_ALL`` drawn windows and decide balance only, never a result."""
    rows = drawn.count()
    if rows > DRAWN_IN_ALL:
        share = int(DRAWN_IN_ALL / rows * 1_000_000) + 1
        drawn = drawn.where(F.pmod(F.xxhash64("word", "lang"), F.lit(1_000_000)) < share)
    windows, every = [], 0
    for row in drawn.collect():
        hashes = np.array(word_hash(row.lang, row.word.encode().split(b" "), seed), np.uint64)
        go_on = np.append(passes(pairs, pair_hash(hashes[:-1], hashes[1:])) & passes(words, hashes[:-1]) & passes(words, hashes[1:]), False)
        keep = int(go_on.argmin()) + 1
        every += row.n
        if keep > 1:
            windows += [(*hashes[:keep].tolist(), *[0] * (longest - keep))] * row.n
    windows.sort()
    routes = max(1, -(-total * len(windows) // max(1, every * route_words)))
    bounds = {windows[len(windows) * i // routes] for i in range(1, routes)} if windows else set()
    return np.array(sorted(bounds), np.uint64).reshape(-1, longest)


def route_of(windows: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """How many of the ``bounds`` are not above each window (columns of hashes), word by word."""
    low = np.searchsorted(bounds[:, 0], windows[0], "left")
    high = np.searchsorted(bounds[:, 0], windows[0], "right")
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        above = np.zeros(len(open_), bool)
        level = np.ones(len(open_), bool)
        for d in range(1, bounds.shape[1]):
            bound, own = bounds[middle, d], windows[d][open_]
            above |= level & (bound > own)
            level &= bound == own
        high[open_] = np.where(above, middle, high[open_])
        low[open_] = np.where(above, low[open_], middle + 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def codes_of(group: list[tuple[str, list[bytes]]], kept: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts that pass the filter: their hashes in order (0 first, no word), and a code for every word,
    0 for others and between pieces and texts."""
    number = count(1)
    ids: list[int] = []
    of_lang: dict[str, defaultdict] = {}
    for lang, words in group:
        if lang not in of_lang:
            of_lang[lang] = defaultdict(number.__next__, {END: 0})
        ids.extend(map(of_lang[lang].__getitem__, words))
        ids.append(0)
    hashes = np.zeros(next(number), np.uint64)
    for lang, places in of_lang.items():
        del places[END]
        hashes[np.fromiter(places.values(), np.int64, len(places))] = np.array(word_hash(lang, list(places), seed), np.uint64)
    hashes[~passes(kept, hashes)] = 0
    ordered = np.unique(hashes)
    ordered = ordered if ordered[0] == 0 else np.concatenate([np.zeros(1, np.uint64), ordered])
    return ordered, np.searchsorted(ordered, hashes).astype(np.uint32)[np.array(ids, np.int64)]


def pair_hashes(hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the pairs of neighbours in a piece."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    return at, pair_hash(hashes[codes[at]], hashes[codes[at + 1]])


def windows_of(hashes: np.ndarray, codes: np.ndarray, pairs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all suffixes, up to the first pair that does not pass the filter, each distinct one once and in
    order: codes (a column each place, 0 after the end of a window) and how often each occurs."""
    at, found = pair_hashes(hashes, codes)
    first = at[passes(pairs, found)]
    goes_on = np.zeros(len(codes) + longest, bool)
    goes_on[first] = True
    codes = np.concatenate([codes, np.zeros(longest, np.uint32)])
    table = np.zeros((longest, len(first)), np.uint32)
    on = np.ones(len(first), bool)
    for d in range(longest):
        table[d] = np.where(on, codes[first + d], 0)
        on &= goes_on[first + d]
    table = table[:, in_order(table, len(hashes))]
    new = np.ones(table.shape[1], bool)
    new[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return table[:, starts], np.diff(np.append(starts, table.shape[1])).astype(np.uint32)


def in_order(table: np.ndarray, codes: int) -> np.ndarray:
    """The order of windows by their codes below ``codes``, as many columns a key as 64 bits hold."""
    bits = max(1, int(codes - 1).bit_length())
    keys = []
    for at in range(0, len(table), 63 // bits):
        key = np.zeros(table.shape[1], np.int64)
        for column in table[at : at + 63 // bits]:
            key = (key << bits) | column
        keys.append(key)
    return np.lexsort(keys[::-1])


def packed(hashes: np.ndarray, table: np.ndarray, times: np.ndarray) -> bytes:
    """Windows in order as octets: the hashes they hold, the most frequent first, codes into them with their lower
    and higher octets apart, how often each occurs; all of it compressed."""
    used, codes, often = np.unique(table, return_inverse=True, return_counts=True)
    place = np.empty(len(used), np.uint32)
    place[np.argsort(-often, kind="stable")] = np.arange(len(used), dtype=np.uint32)
    words = np.empty(len(used), "<u8")
    words[place] = hashes[used]
    width = 2 if len(used) < 65536 else 4
    planes = place[codes.reshape(table.shape)].astype("<u4").view(np.uint8).reshape(*table.shape, 4)[..., :width]
    counts = times.astype("<u4").view(np.uint8).reshape(-1, 4)
    body = b"".join([words.tobytes(), np.moveaxis(planes, -1, 1).tobytes(), counts.T.tobytes()])
    head = np.array([table.shape[1], len(used), width, len(body)], "<u4")
    return head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(part: bytes, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, width, size = np.frombuffer(part, "<u4", 4).tolist()
    body = pa.decompress(part[16:], decompressed_size=size, codec="zstd", asbytes=True)
    hashes = np.frombuffer(body, "<u8", m)
    planes = np.frombuffer(body, np.uint8, longest * width * n, 8 * m).reshape(longest, width, n).astype(np.uint32)
    counts = np.frombuffer(body, np.uint8, 4 * n, 8 * m + longest * width * n).reshape(4, n).astype(np.uint32)
    codes = sum(planes[:, i] << np.uint32(8 * i) for i in range(width))
    return hashes, codes, sum(counts[i] << np.uint32(8 * i) for i in range(4))


def planes(values: np.ndarray) -> bytes:
    """Numbers as octets, the lowest of all first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").reshape(-1)


def frequent_pairs(docs: DataFrame, words: np.ndarray, least: int, routes: int, seed: int, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(hash) of the pairs of words whose hash occurs at least ``least`` times. Their hashes go to routes by their
    highest bits, each distinct one of a task once, as sorted differences."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _batches(batches, at_once):
            found, times = np.unique(pair_hashes(*codes_of(group, words, seed))[1], return_counts=True)
            cuts = np.searchsorted(found, np.array([(i << 64) // routes for i in range(routes)], np.uint64)).tolist()
            for route, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(found)], strict=True)):
                if a < b:
                    part = planes(np.diff(found[a:b], prepend=np.uint64(0))) + planes(times[a:b])
                    part = np.array([b - a], "<u4").tobytes() + pa.compress(part, codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([route], pa.int32()), pa.array([part], pa.binary())], names=["route", "part"])

    def count_up(key: tuple, rows: pa.Table) -> pa.Table:
        found, times = [], []
        for part in rows.column("part").to_pylist():
            n = int(np.frombuffer(part, "<u4", 1)[0])
            body = pa.decompress(part[4:], decompressed_size=16 * n, codec="zstd", asbytes=True)
            found.append(np.cumsum(from_planes(body, n), dtype=np.uint64))
            times.append(from_planes(body, n, 8 * n))
        found, place = np.unique(np.concatenate(found), return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, place, np.concatenate(times).astype(np.int64))
        return pa.table({"hash": pa.array(found[sums >= least].astype(np.int64))})

    return _texts(docs).mapInArrow(routed, SUFFIXES).groupBy("route").applyInArrow(count_up, "hash long")


def suffixes(
    docs: DataFrame, words: np.ndarray, pairs: np.ndarray, bounds: np.ndarray, seed: int, longest: int = LONGEST, at_once: int = WORDS_AT_ONCE
) -> DataFrame:
    """All suffixes as windows of up to ``longest`` words, by route."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _batches(batches, at_once):
            hashes, codes = codes_of(group, words, seed)
            table, times = windows_of(hashes, codes, pairs, longest)
            if not len(times):
                continue
            route = route_of([hashes[column] for column in table], bounds)
            order = np.argsort(route, kind="stable")
            route, table, times = route[order], table[:, order], times[order]
            starts = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(route)], strict=True):
                part = packed(hashes, table[:, a:b], times[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([int(route[a])], pa.int32()), pa.array([part], pa.binary())], names=["route", "part"])

    return _texts(docs).mapInArrow(routed, SUFFIXES)


def frequent_groups(table: np.ndarray, times: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to windows: (words, a pointer of the group, occurrences) for every
    group of equal first words that occurs at least ``least`` times. A part that occurs less often is abandoned."""
    stack = [(np.arange(table.shape[1]), 0)]
    while stack:
        at, depth = stack.pop()
        total = int(times[at].sum(dtype=np.int64))
        if total < least or not len(at):
            continue
        keys = table[depth][at]
        pivot = np.sort(keys[:: max(1, len(keys) // 9)])
        pivot = pivot[len(pivot) // 2]
        below, above = keys < pivot, keys > pivot
        equal = at[~(below | above)]
        stack.append((at[below], depth))
        stack.append((at[above], depth))
        if pivot and len(equal):  # code 0: the windows end here
            total = int(times[equal].sum(dtype=np.int64))
            if total >= least:
                yield depth + 1, int(equal[0]), total
                if depth + 1 < len(table):
                    stack.append((equal, depth + 1))


def route_groups(parts: list[bytes], lower: np.ndarray | None, upper: np.ndarray | None, least: int, longest: int) -> list[tuple[bytes, int]]:
    """(words as hashes of eight octets, occurrences) of the groups of a route. Groups that hold a bound of the
    route may go on beyond it and come whatever their number here."""
    read = [unpacked(part, longest) for part in parts]
    hashes = np.unique(np.concatenate([np.zeros(1, np.uint64), *[h for h, _, _ in read]]))
    table = np.concatenate([np.searchsorted(hashes, h).astype(np.uint32)[codes] for h, codes, _ in read], axis=1)
    times = np.concatenate([t for _, _, t in read]).astype(np.int64)
    cut = {bound[:d].astype(">u8").tobytes() for bound in (lower, upper) if bound is not None for d in range(2, longest + 1) if bound[d - 1]}
    out = []
    for depth, at, total in frequent_groups(table, times, least):
        key = hashes[table[:depth, at]].astype(">u8").tobytes()
        if depth > 1 and key not in cut:
            out.append((key, total))
    for key in cut:
        words = np.frombuffer(key, ">u8").astype(np.uint64)
        codes = np.searchsorted(hashes, words)
        if (codes < len(hashes)).all() and (hashes[codes] == words).all():
            total = int(times[(table[: len(words)] == codes[:, None]).all(axis=0)].sum())
            if total:
                out.append((key, total))
    return out


def phrase_counts(parts: DataFrame, bounds: np.ndarray, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(key, a) of all phrases of two words or more that occur ``least`` times."""

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        route = key[0].as_py()
        lower = bounds[route - 1] if route else None
        upper = bounds[route] if route < len(bounds) else None
        found = route_groups(rows.column("part").to_pylist(), lower, upper, least, longest)
        return pa.table({"key": pa.array([k for k, _ in found], pa.binary()), "a": pa.array([n for _, n in found], pa.int64())})

    rows = parts.groupBy("route").applyInArrow(sort, "key binary, a long")
    return rows.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _key(hash_: Column) -> Column:
    return F.unhex(F.lpad(F.hex(hash_), 16, "0"))


def _part(key: str, first: Column, words: Column) -> Column:
    """``words`` words of a key from word number ``first`` (0 is the first)."""
    return F.substring(F.col(key), (first * 8 + 1).cast("int"), (words * 8).cast("int"))


def mine(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, route_words: int = ROUTE_WORDS, at_once: int = WORDS_AT_ONCE, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to ``longest`` words that occur at least ``least``
    times in their language (``docs``: text, lang, any more columns) and that no longer phrase holds that occurs as
    often. The score is that of the lowest-scoring cut into two parts, the first of equals: 1000 a n / (l r),
    rounded down.

    Words are counted first, then pairs of frequent words, by their hashes. Each suffix of a piece, as a window of
    its words up to the first infrequent word or pair, goes by its leading words to a route, a range in the order of
    windows, so that a hot word or phrase spreads over many routes; equal windows of a task travel once. Bounds of routes come from a bounded draw of windows, which
    decides balance only: groups that hold a bound are summed over their routes. Words stand for their 64-bit
    hashes once these are proven to differ; if two agree, another seed is taken. The filters of frequent words and
    pairs have a fixed size; what they let through in error costs volume, never a result.

    Null texts, empty texts and texts without words hold nothing; a null language is ``und``; repeated rows count
    each time; other columns are ignored. Empty tables give empty tables. Counts are exact up to 10^15 words.
    """
    known = checkpointed(units(docs, longest, min(at_once, DRAW_WORDS)))
    words = known.where("n > 0 and instr(word, ' ') = 0")
    seed = 0
    while True:
        hashed = words.withColumn("hash", hash_column(F.col("lang"), F.col("word"), seed))
        clash = hashed.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1 or hash = 0")
        if clash.isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = hashed.where(F.col("n") >= least).select("lang", "word", "hash", F.col("n").alias("f"))
    total = frequent.agg(F.sum("f")).first()[0] or 0
    kept = frequent_filter(frequent, filter_bits)
    routes = max(1, -(-total // (4 * route_words)))
    pairs = frequent_filter(frequent_pairs(docs, kept, least, routes, seed, at_once), filter_bits)
    bounds = bounds_of(known.where("instr(word, ' ') > 0"), kept, pairs, total, route_words, seed, longest)
    counts = phrase_counts(suffixes(docs, kept, pairs, bounds, seed, longest, at_once), bounds, least, longest)
    counts = checkpointed(counts.withColumn("words", (F.octet_length("key") / 8).cast("int")))
    single = frequent.withColumn("key", _key(F.col("hash")))

    # a phrase goes if a phrase one word longer holds it and occurs as often
    longer = counts.where("words > 2")
    ends = [_part("key", F.lit(at), F.col("words") - 1).alias("key") for at in (0, 1)]
    inside = longer.select(F.explode(F.array(*ends)).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    left = counts.join(inside, "key", "left").where("most is null or most < a").drop("most")

    parts = counts.select("key", "a").union(single.select("key", "f"))
    cuts = left.select("key", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _part("key", F.lit(0), F.col("k")), "rest": _part("key", F.col("k"), F.col("words") - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("key").alias("first"), F.col("a").alias("l")), "first")
    cuts = cuts.join(parts.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")

    spelled = left.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: _part("key", i, F.lit(1)))).alias("at", "one"))
    spelled = spelled.join(single.select(F.col("key").alias("one"), "lang", "word"), "one").groupBy("key").agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    found = cuts.join(spelled, "key").join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r", "n")}
    found = found.withColumns({f"__{c}": value for c, value in whole.items()}).withColumn(
        "score", F.expr("(cast(1000 as decimal(4,0)) * __a * __n) div (__l * __r)")
    )
    lowest = found.groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(phrases: DataFrame, most: int, parts: int = RANK_PARTS) -> DataFrame:
    """The first ``most`` phrases of each language with their ``rank`` from 1: the highest score first, then the
    most frequent, then the first phrase. Parts of a language are ranked on their own before their first rows meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = phrases.withColumn("__part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order)))
    first = first.where(F.col("rank") <= most).drop("__part", "rank")
    ranks = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranks.where(F.col("rank") <= most)
