"""URL rules and block lists in sorted digest arrays."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.hashing import xxh64_slices
from plumbline.plans.scale import checkpointed, is_small

#: Entries that a worker maps whole at most; more are cut into shards that meet the URLs' keys by a shuffle.
SHARD_ENTRIES = 200_000
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def digests(strings: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
    return xxh64_slices(b"".join(strings), ends - np.fromiter(map(len, strings), np.int64, len(strings)), ends)


class DigestArray:
    """Strings as sorted 64-bit xxhash keys in a memory-mapped file, followed by where each stored string lies
    and by the strings. A probe is a vectorised binary search; a key that is found is confirmed on the string."""

    def __init__(self, path: str):
        count = int(np.memmap(path, "<u8", "r", shape=(1,))[0])
        self.keys = np.memmap(path, "<u8", "r", offset=8, shape=(count,)) if count else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, "<u8", "r", offset=8 + 8 * count, shape=(count + 1,))
        self.order = np.memmap(path, "<u8", "r", offset=16 + 16 * count, shape=(count,)) if count else np.zeros(0, np.uint64)
        size = int(self.ends[-1])
        self.strings = np.memmap(path, np.uint8, "r", offset=16 + 24 * count, shape=(size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def packed(strings: list[bytes]) -> bytes:
        """The file of distinct strings; a probe answers with a string's place in this list."""
        keys = digests(strings) if strings else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        held = [strings[i] for i in order.tolist()]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in held], dtype=np.int64)]) if held else np.zeros(1)
        parts = [np.array([len(held)], "<u8"), keys[order].astype("<u8"), ends.astype("<u8"), order.astype("<u8")]
        return b"".join([*(p.tobytes() for p in parts), *held])

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """The place of each string in the list that was packed, -1 if it is not there."""
        out = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return out
        keys = digests(strings)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.strings[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == strings[i]:
                    out[i] = int(self.order[j])
                    break
                j += 1
        return out


def mapped(data: bytes) -> DigestArray:
    """The array of packed bytes, mapped from a worker's own scratch file, which goes with the mapping."""
    handle, path = tempfile.mkstemp(suffix=".digests")
    with os.fdopen(handle, "wb") as file:
        file.write(data)
    array = DigestArray(path)
    os.unlink(path)
    return array


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All entries that could fit: the host and each domain above it, with the path's beginning of each length
    that an entry's path has (0: the host alone)."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    joined = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p))))
    return F.when(host != "", joined).otherwise(F.array().cast("array<string>"))


def judged(pages: DataFrame, entries: DataFrame, url: str = "url", shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to pages. ``entries`` (key, verdict, rule): a key is a
    host and the beginning of a path (possibly none), fitting the host and its subdomains; ``rule`` tells rules
    from a block list.

    The longest rule that fits decides. Without one, a page whose host and path the list has is blocked, all
    others are allowed. Null URLs and those without :// have an empty host, which nothing fits. Repeated
    entries count once (a block goes before an allow); null keys are left out. Columns of the four names are
    replaced.
    """
    entries = entries.where("key is not null").groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("rule").alias("rule"))
    entries = checkpointed(entries)
    lengths = sorted(r[0] for r in entries.select((F.length("key") - F.length(F.substring_index("key", "/", 1))).alias("n")).distinct().collect())
    kept = pages.drop("host", "path", "rule", "verdict")
    row = F.struct(*[kept[c] for c in kept.columns]).alias("__row")
    split = kept.select(row, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    split = split.withColumn("__keys", keys_of(F.col("host"), F.col("path"), lengths or [0]))
    found = _mapped_hits(split, entries) if is_small(entries, shard_entries) else _shuffled_hits(split, entries, shard_entries)
    rules = F.filter("__hits", lambda h: h["rule"])
    best = F.array_max(F.transform(rules, lambda h: F.struct(F.length(h["key"]).alias("n"), h["key"].alias("key"), h["verdict"].alias("verdict"))))
    listed = F.exists("__hits", lambda h: ~h["rule"] & (h["verdict"] == BLOCK))
    verdict = F.coalesce(best["verdict"], F.when(listed, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return found.select("__row.*", "host", "path", best["key"].alias("rule"), verdict.alias("verdict"))


HIT = "array<struct<key:string,verdict:string,rule:boolean>>"


def _mapped_hits(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Few entries: each worker maps them all."""
    held = entries.toArrow().to_pylist()
    data = rows.sparkSession.sparkContext.broadcast((DigestArray.packed([e["key"].encode() for e in held]), held))
    place = rows.columns.index("__keys")
    hit = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("rule", T.BooleanType())]))
    kind = pa.list_(pa.struct([("key", pa.string()), ("verdict", pa.string()), ("rule", pa.bool_())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = mapped(data.value[0])
        for batch in batches:
            keys = batch.column(place).to_pylist()
            found, hits, at = array.probe([k.encode() for row in keys for k in row]), [], 0
            for row in keys:
                hits.append([data.value[1][i] for i in found[at : at + len(row)].tolist() if i >= 0])
                at += len(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=[*batch.schema.names, "__hits"])

    return rows.mapInArrow(probe, T.StructType([*rows.schema.fields, T.StructField("__hits", hit)]))


def _shuffled_hits(rows: DataFrame, entries: DataFrame, shard_entries: int) -> DataFrame:
    """Many entries: shards of digests meet the distinct keys of the URLs; the keys found go back to the rows."""
    shards = max(1, -(-entries.count() // shard_entries))
    number = lambda key: F.pmod(F.xxhash64(key), F.lit(shards))
    wanted = rows.select(F.explode("__keys").alias("key")).distinct().withColumn("shard", number("key"))

    def confirm(probes: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        array = mapped(DigestArray.packed([k.encode() for k in stored["key"]]))
        at = array.probe([k.encode() for k in probes["key"]])
        return stored.iloc[at[at >= 0]][["key", "verdict", "rule"]]

    found = wanted.groupBy("shard").cogroup(entries.withColumn("shard", number("key")).groupBy("shard")).applyInPandas(confirm, "key string, verdict string, rule boolean")
    found = checkpointed(found)
    pairs = rows.select("host", "path", F.explode("__keys").alias("key")).distinct().join(found, "key")
    hits = pairs.groupBy("host", "path").agg(F.collect_list(F.struct("key", "verdict", "rule")).alias("__hits"))
    joined = rows.join(hits, ["host", "path"], "left")
    return joined.withColumn("__hits", F.coalesce("__hits", F.array().cast(HIT)))
