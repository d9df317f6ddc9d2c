"""Blocks of vectors, which two operators compare block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 4096


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): one row for each id whose vector is not null and holds finite components only. Rows that
    repeat an id count once, with the smallest of their vectors; rows without an id take no part."""
    v = F.col("v")
    rows = table.select(table[vec_id].cast("long").alias("vec_id"), table[embedding].cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


def packed(vectors: list[np.ndarray], kind: str) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The matrix of an Arrow column of lists."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1).astype(kind)
    return packed(np.split(flat, np.cumsum(lengths)[:-1]), kind)


def blocks(rows: DataFrame, kind: str, size: int = BLOCK) -> DataFrame:
    """(block, n, width, ids, data): the rows of each block number ``b`` of (b, vec_id, v) as one row, ids and
    components in binaries. Callers number blocks so that none has many more than ``size`` rows."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        data = packed([np.asarray(v, float) for v in frame["v"]], kind)
        ids = frame["vec_id"].to_numpy("<i8").tobytes()
        return pd.DataFrame({"block": [int(frame["b"].iloc[0])], "n": [len(frame)], "width": [data.shape[1]], "ids": [ids], "data": [data.tobytes()]})

    return rows.groupBy("b").applyInPandas(build, "block long, n long, width long, ids binary, data binary")


def unpack(n: int, width: int, ids: bytes, data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(n, width)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices, the narrower one widened by zeros."""
    width = max(a.shape[1], b.shape[1])
    widen = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return widen(a), widen(b)


def each(frames: Iterator[pd.DataFrame]) -> Iterator:
    for frame in frames:
        yield from frame.itertuples(index=False)
