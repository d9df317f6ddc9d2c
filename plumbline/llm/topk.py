"""Exact top-k search by inner product: histograms of all scores locate each k-th value, then ties are broken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.vectors import BLOCK, blocks, each, same_width, unpack, usable
from plumbline.plans.scale import checkpointed

SCALE = 1024
K = 10
#: Bins that a round divides each query's range of scores into.
BINS = 512
#: Queries of a block; a task holds the scores of one such block against one block of vectors.
QUERIES = 512
_EXACT = float(1 << 53)
_LONG = np.iinfo(np.int64)


def quantised(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of usable vectors with components floor(scale * x)."""
    return usable(table).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact while every sum stays below 2 ** 53; beyond it Python's
    integers are, and what a long cannot hold is held at its ends."""
    queries, vectors = same_width(queries, vectors)
    most = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(1, queries.shape[1])
    if most < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(vectors).T, _LONG.min, _LONG.max).astype(np.int64)


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    count = rows.count()
    return rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // size)))))


def _numbers(rows: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with a gapless number ``no``, and how many they are."""
    numbers = rows.select("block", (F.row_number().over(W.orderBy("block")) - 1).alias("no"))
    numbered = checkpointed(rows.join(numbers.hint("merge"), "block"))
    return numbered, max(1, numbered.count())


def _pairs(queries: DataFrame, vectors: DataFrame, n: tuple[int, int], state: DataFrame | None) -> DataFrame:
    """Every block of queries beside every block of vectors, and beside it what is known of its queries."""
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "no", "n", "width", "ids", "data")])
    if state is not None:
        known = state.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "high"))).alias("known"))
        q = q.join(known.select("q_block", F.col("known.low").alias("low"), F.col("known.high").alias("high")), "q_block")
    left = q.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(n[1] - 1))))
    right = vectors.withColumn("q_no", F.explode(F.sequence(F.lit(0), F.lit(n[0] - 1))))
    return left.hint("merge").join(right, ["q_no", "no"])


def _scored(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, scores) of a pair of blocks; a query's own row is marked by the lowest long."""
    qi, q = unpack(row.q_n, row.q_width, row.q_ids, row.q_data, "<f8")
    vi, v = unpack(row.n, row.width, row.ids, row.data, "<f8")
    return qi, vi, scores_of(q, v)


def search(table: DataFrame, queries: DataFrame, k: int = K, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each row of ``queries`` (vec_id, v) among
    the other rows of ``table`` (vec_id, v), ties to the smaller vec_id; all, if fewer.

    Every round scores everything block by block and counts, for each query, how many scores fall into each
    bin of the range that is still open; the counts of all tasks together tell the bin that holds the k-th
    value. A task reports a query's bins from the top until it has counted k itself: what lies below cannot
    hold the k-th value. Rounds go on until a bin is one score wide. The last one keeps the scores from the
    k-th value upwards, at most k of a query from each task, and ranks them.

    A shorter vector counts as ending in zeros. Empty tables give empty results.
    """
    vectors, n_vectors = _numbers(checkpointed(blocks(_numbered(table, BLOCK), "<f8")))
    asked, n_asked = _numbers(checkpointed(blocks(_numbered(queries, QUERIES), "<f8")))
    n = n_asked, n_vectors

    def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in each(frames):
            qi, vi, scores = _scored(row)
            own = qi[:, None] == vi[None, :]
            high = np.where(own, _LONG.min, scores).max(axis=1, initial=_LONG.min)
            low = np.where(own, _LONG.max, scores).min(axis=1, initial=_LONG.max)
            n = (~own).sum(axis=1)
            yield pd.DataFrame({"q_block": row.q_block, "query_id": qi, "low": low, "high": high, "n": n})[n > 0]

    found = _pairs(asked, vectors, n, None).mapInPandas(extremes, "q_block long, query_id long, low long, high long, n long")
    state = checkpointed(found.groupBy("q_block", "query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))
    state = state.withColumn("left", F.least(F.lit(k).cast("long"), "n")).drop("n")
    while (state.agg(F.max(F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)"))).first()[0] or 0) > 0:
        counted = _pairs(asked, vectors, n, state).mapInPandas(_histogram(k, bins), "q_block long, query_id long, bin int, n long")
        counted = counted.groupBy("q_block", "query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("q_block", "query_id").orderBy(F.desc("bin")))
        hit = counted.withColumn("above", above).join(state.hint("merge"), ["q_block", "query_id"])
        hit = hit.where((F.col("above") >= F.col("left")) & (F.col("above") - F.col("n") < F.col("left")))
        # the bin's ends; ends of ranges wider than a long's half are computed in decimals
        low, high = F.col("low").cast("decimal(38,0)"), F.col("high").cast("decimal(38,0)")
        step = F.ceil((high - low + 1) / F.lit(bins)).cast("decimal(38,0)")
        start = low + step * F.col("bin")
        state = checkpointed(hit.select(
            "q_block", "query_id", start.cast("long").alias("low"),
            F.least(high, start + step - 1).cast("long").alias("high"),
            (F.col("left") - (F.col("above") - F.col("n"))).alias("left"),
        ))
    best = _pairs(asked, vectors, n, state).mapInPandas(_best(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _histogram(k: int, bins: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in each(frames):
            qi, vi, scores = _scored(row)
            rows = []
            for query, own, low, high in zip(qi.tolist(), scores, row.low.tolist(), row.high.tolist(), strict=True):
                own = own[(vi != query) & (own >= low) & (own <= high)]
                step = -(-(high - low + 1) // bins)
                at = (own - low) // step if high - low < _LONG.max else np.array([(int(x) - low) // step for x in own], int)
                n = np.bincount(at.astype(int), minlength=1)[::-1]
                top = int(np.searchsorted(np.cumsum(n), k)) + 1
                for i in np.flatnonzero(n[:top]).tolist():
                    rows.append((row.q_block, query, len(n) - 1 - i, int(n[i])))
            yield pd.DataFrame(rows, columns=["q_block", "query_id", "bin", "n"])

    return run


def _best(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in each(frames):
            qi, vi, scores = _scored(row)
            rows = []
            for query, own, low in zip(qi.tolist(), scores, row.low.tolist(), strict=True):
                at = np.flatnonzero((own >= low) & (vi != query))
                at = at[np.lexsort((vi[at], -own[at].astype(float), -own[at]))][:k] if len(at) > k else at
                rows += zip([query] * len(at), vi[at].tolist(), own[at].tolist(), strict=True)
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run
