"""Vectors between Arrow and NumPy, for the two embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there, not empty, finite throughout and not all zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A binary column of float64 vectors of one size as rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def packed(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """usable rows as (vec_id, dim, vec), vec holding little-endian doubles."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            size = lists.value_lengths().to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["vec_id", "dim", "vec"])

    rows = usable(df.where(F.col(id_col).isNotNull()), column)
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "vec_id bigint, dim int, vec binary")
