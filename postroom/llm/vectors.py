"""Vectors in tables: which of them count, and their way to numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vec) of the rows whose vector is neither null nor empty and holds finite numbers only."""
    good = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.coalesce(good, F.lit(False)))


def of_one_length(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length, of equals the greatest, and that length; 0 without rows."""
    first = df.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first["d"] if first else 0
    return df.filter(F.size("vec") == d), d


def matrix(column, d: int) -> np.ndarray:
    """An Arrow column of lists of length ``d`` as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
