"""Near-duplicate embeddings: every pair within an angle, found by cover trees of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import components
from plumbline.llm.covertree import CoverTree, added_up, dual
from plumbline.llm.vectors import BLOCK, each, matrix, packed, same_width
from plumbline.plans.scale import bounded, checkpointed

COSINE = 0.95
#: Vectors, drawn by a hash, whose cells gather what is near before blocks are cut.
PIVOTS = 256
#: Bytes of the blocks of a shelf, which tasks read as a whole, and the least number of shelves, if there are so many blocks.
SHELF, SHELVES = 32 << 20, 12
#: Repeated ids that are broadcast.
REPEATS = 200_000
#: Rows of a task's results that are kept before they are added up.
KEPT = 1 << 20


def vectors_of(table: DataFrame) -> DataFrame:
    """(vec_id, v) as ``vectors.usable`` has them, without zero vectors. Components stay single if they are, and only
    the rows of repeated ids move, unless these are many."""
    kind = table.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    smallest = lambda some: some.groupBy("vec_id").agg(F.min("v").alias("v"))
    repeated = bounded(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), REPEATS)
    if repeated is None:
        rows = smallest(rows)
    elif not repeated.isEmpty():
        few = F.broadcast(repeated)
        rows = rows.join(few, "vec_id", "left_anti").unionByName(smallest(rows.join(few, "vec_id", "left_semi")))
    return rows.where(F.exists("v", lambda x: x != 0))


def trees(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, n, center, radius, tree): cover trees of blocks of about ``size`` vectors. Each vector goes to the
    nearest of at most PIVOTS pivots; a cell of more than a block is dealt out by a hash. Blocks of a cell have
    consecutive numbers and a partition, which is a shelf, has a range of them. Vectors move once."""
    count = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, max(1, count // size))).toPandas()
    kind = vectors.schema["v"].dataType.simpleString()
    data = "<f4" if kind == "array<float>" else "<f8"
    pivots = _whole(packed([np.asarray(v, float) for v in drawn["v"]], "<f8"))

    def nearest(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, marks = same_width(_whole(matrix(batch.column("v"), "<f8")), pivots)
            cell = pa.array((unit @ marks.T).argmax(axis=1).astype(np.int32))
            columns = {"cell": cell, "vec_id": batch.column("vec_id"), "v": batch.column("v")} if whole else {"cell": cell}
            yield pa.RecordBatch.from_pydict(columns)

    sizes = dict(vectors.mapInArrow(lambda batches: nearest(batches, False), "cell int").groupBy("cell").count().collect())
    first, at = {}, 0
    for cell in sorted(sizes):
        parts = -(-sizes[cell] // size)
        first[cell], at = (at, parts), at + parts
    celled = vectors.mapInArrow(lambda batches: nearest(batches, True), f"cell int, vec_id long, v {kind}")
    number = lambda i: F.create_map(*[F.lit(x) for cell, v in first.items() for x in (cell, v[i])])[F.col("cell")]
    place = number(0) + F.pmod(F.xxhash64("vec_id"), number(1)) if first else F.lit(0)
    # a cell that was not counted, as scores may tie elsewhere, is no reason to lose a vector
    celled = celled.select(F.coalesce(place, F.lit(0)).cast("long").alias("b"), "vec_id", "v")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        vectors = packed([np.asarray(v, data) for v in frame["v"]], data)
        tree = CoverTree(frame["vec_id"].to_numpy(np.int64), _unit(vectors))
        center, radius = tree.unit[tree.levels[0][0][0]], tree.levels[0][1].max()
        return pd.DataFrame({"block": [int(frame["b"].iloc[0])], "n": [len(frame)], "center": [center.tolist()], "radius": [radius], "tree": [tree.packed(vectors)]})

    row = pivots.shape[1] * np.dtype(data).itemsize + 128
    shelves = max(1, min(at, max(SHELVES, -(-count * row // SHELF))))
    built = celled.repartitionByRange(shelves, "b").groupBy("b").applyInPandas(build, "block long, n long, center array<double>, radius double, tree binary")
    return built.coalesce(shelves)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range of a double."""
    m = m.astype(float, copy=False)
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _whole(m: np.ndarray) -> np.ndarray:
    """Rows of about the same length in whole numbers, whose products are exact in any order and on any machine."""
    return np.rint(_unit(m) * (1 << 20))


def near(center: str, radius: str, center_2: str, radius_2: str, cosine: float) -> Column:
    """Whether the covering radii of two roots don't rule out that vectors of theirs are near."""
    squares = F.zip_with(center, center_2, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), 2.0))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return apart <= F.col(radius) + F.col(radius_2) + float(np.sqrt(2.0 - 2.0 * cosine)) + 1e-6


def links(table: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """The usable vectors (vec_id), and for them (vec_id, n, to): shares of the number of links, and a vector
    that is connected. No pair is listed: a task reports a row for each of its vectors that has a link.

    A task reads two shelves of written blocks and compares their near blocks, so that no block is copied for those
    it meets: nothing is shuffled, and what is read again and again is never written again."""
    vectors = vectors_of(table)
    blocks = checkpointed(trees(vectors))
    left = blocks.select(F.col("block").alias("low"), F.col("center").alias("c1"), F.col("radius").alias("r1"), "tree")
    right = blocks.select(F.col("block").alias("high"), F.col("center").alias("c2"), F.col("radius").alias("r2"), F.col("tree").alias("other"))
    meet = (F.col("low") <= F.col("high")) & ((F.col("low") == F.col("high")) | near("c1", "r1", "c2", "r2", cosine))
    both = left.hint("shuffle_replicate_nl").join(right, meet).select("low", "tree", "high", "other")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, CoverTree] = {}
        rows, kept = [], 0
        for row in each(frames):
            for block, data in ((row.low, row.tree), (row.high, row.other)):
                if block not in held:
                    held[block] = CoverTree.unpacked(data, _unit)
            a, b = held[row.low], held[row.high]
            if a is not b and a.unit.shape[1] != b.unit.shape[1]:
                a.unit, b.unit = same_width(a.unit, b.unit)
            rows.append(dual(a, b, cosine).rows())
            kept += len(rows[-1][0])
            if kept > KEPT:
                rows = [added_up(rows)]
                kept = len(rows[0][0]) // 2
        if rows:
            ids, n, to = added_up(rows)
            yield pd.DataFrame({"vec_id": ids, "n": n, "to": to})

    return vectors, both.mapInPandas(compare, "vec_id long, n long, to long")


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vec_id of ``table`` (vec_id, embedding): (vec_id, n_links, component_id, kept), the links being
    all other vectors of at least ``cosine`` and the component the smallest vec_id that links reach.

    Null and zero vectors and those with null or non-finite components link with nothing. Rows that repeat a
    vec_id are one vector (the smallest that is usable); rows without one are left out. A shorter vector
    counts as ending in zeros. Empty tables give empty tables.
    """
    _, found = links(table, cosine)
    found = checkpointed(found)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    roots = components(found, "vec_id", "to").withColumnRenamed("node", "vec_id")
    marked = checkpointed(counts.join(roots, "vec_id", "left"))
    every = table.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    joined = every.join(marked, "vec_id", "left").withColumn("component_id", F.coalesce("root", "vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
