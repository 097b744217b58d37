"""Helpers of the vector operators: which vectors are whole, and matrices of
integers from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable

#: Integer components must stay below this, so that sums of squares or products fit 64 bits.
COMPONENT_LIMIT = 1 << 26


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def whole(vector: Column) -> Column:
    """The vector is there, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def width(rows: DataFrame, vector: str) -> int:
    """The longest vector's length (0 for an empty table); shorter ones count as padded with zeros."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def integer_matrix(column: pa.Array | pa.ChunkedArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of the vectors of a list column, one row each, padded to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), np.int64)
    scaled = np.floor(np.asarray(column.flatten(), np.float64) * scale)
    if len(scaled) and np.abs(scaled).max() >= COMPONENT_LIMIT:
        raise ValueError(f"a vector component exceeds {COMPONENT_LIMIT} / {scale}; scale the vectors down")
    if len(lengths) and (lengths == width).all():
        return scaled.astype(np.int64).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths),
        np.arange(len(scaled)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = scaled
    return out
