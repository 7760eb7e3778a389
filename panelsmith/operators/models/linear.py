"""Shared pieces of the linear models: sums per cell and scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

# Running sums a task keeps before it hands them on.
_SUMS_BYTES = 128 * 2**20


def cell_groups(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row positions) of each key combination in a batch."""
    codes = np.stack([batch[k].to_numpy() for k in keys], axis=1)
    unique, inverse = np.unique(codes, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    for i, key in enumerate(unique):
        yield tuple(int(v) for v in key), np.flatnonzero(inverse == i)


def rows_of(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """The given rows of a list column as a matrix (rows of one cell are equally long)."""
    picked = column.take(pa.array(at))
    return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def cell_means(train: DataFrame) -> DataFrame:
    """(slot, K, n1, n0, m1, m0): class sizes and mean vectors of the training rows of a cell."""
    sums = train.select("slot", "K", "is_pos", array_to_vector("x").alias("_v")).groupBy("slot", "K").agg(
        F.count_if("is_pos").alias("n1"), F.count_if(~F.col("is_pos")).alias("n0"),
        Summarizer.mean(F.col("_v"), F.when(F.col("is_pos"), 1.0).otherwise(0.0)).alias("m1"),
        Summarizer.mean(F.col("_v"), F.when(F.col("is_pos"), 0.0).otherwise(1.0)).alias("m0"),
    )
    return sums.withColumns({"m1": vector_to_array("m1"), "m0": vector_to_array("m0")})


def within_scatter(train: DataFrame, means: DataFrame) -> DataFrame:
    """(slot, K, …means, ss): upper triangle of the pooled within-class scatter of each cell."""
    mean = F.when(F.col("is_pos"), F.col("m1")).otherwise(F.col("m0"))
    centred = train.join(means.select("slot", "K", "m1", "m0"), ["slot", "K"]).select(
        "slot", "K", F.zip_with("x", mean, lambda a, b: a - b).alias("x")
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            for key, at in cell_groups(batch, "slot", "K"):
                x = rows_of(batch["x"], at)
                ss = x.T @ x
                if key in sums:
                    sums[key] += ss
                else:
                    sums[key] = ss
                    held += ss.nbytes
            if held > _SUMS_BYTES:
                yield _triangles(sums)
                sums, held = {}, 0
        if sums:
            yield _triangles(sums)

    partials = centred.mapInArrow(partial, "slot int, K int, ss array<double>")
    totals = partials.groupBy("slot", "K").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("ss")))).alias("ss")
    )
    return means.join(totals, ["slot", "K"])


def _triangles(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    packed = [m[np.triu_indices(len(m))] for m in sums.values()]
    return pa.RecordBatch.from_pydict({
        "slot": pa.array([k[0] for k in sums], pa.int32()),
        "K": pa.array([k[1] for k in sums], pa.int32()),
        "ss": pa.array(packed, pa.list_(pa.float64())),
    })


def unpacked(triangle: np.ndarray) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    p = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = triangle
    return out + np.triu(out, 1).T


def dot(x: str | Column, coef: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
