"""Whitening of embeddings by a tall-skinny QR, without forming a covariance.

1. One pass sums every dimension exactly, in whole numbers.
2. A second pass centres the rows by those sums and reduces each partition to the
   R factor of a QR, block by block, so that a task holds one block and one square
   matrix.  R factors are merged in a tree: ``FAN`` of them, stacked, have one R.
3. The SVD of the last R, one square matrix as wide as a vector, gives singular values
   and right vectors of all rows: eigenvalues are the squares over n, and a
   row's whitened coordinates are its products with the vectors over the roots.
4. A third pass measures the covariance of the coordinates themselves.

Entries are counted in whole numbers (``GRAIN`` to one, shifted by ``SHIFT``), so sums and
distances to the mean are exact and do not depend on how rows are dealt.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries, or entries of 2^40 or more, are dropped; of vectors of several
lengths those of the commonest length stay (of equals the longest); null and repeated
ids and equal rows are rows of their own; vectors of any length are whole, a
task's memory being the square of the length; equal eigenvalues have
the vectors that the SVD gives, each with its largest entry positive; a component
without spread (under 1e-12 of the greatest eigenvalue) has null for whitened and is
left out of the identity's error; a deviation beyond 64 bits is null; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import table
from postroom.llm.vectors import finite, matrix, of_one_length

GRAIN, SHIFT = 1024, 100_000
MOST = 2**40  # entries from here on would leave the whole numbers that doubles hold
COMPONENTS = 8
FAN = 8  # R factors that one task stacks
BLOCK = 4096  # rows of a QR
FLAT = 1e-12  # of the greatest eigenvalue: no spread


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(GRAIN * rows).astype(np.int64) + SHIFT


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = whole(matrix(batch.column("vec"), d))
            n += len(x)
            # halves of the numbers apart: neither sum can leave 64 bits
            high, low = (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)
            total = [t + (int(h) << 26) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": list(range(d)), "n": [n] * d, "total": pa.array([str(t) for t in total])})

    return run


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension: d rows reach the driver."""
    parts = vectors.select("vec").mapInArrow(_sums(d), "dim long, n long, total string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums, exact: in 64 bits where these suffice, else in Python's whole numbers."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factors(d: int, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, rows = np.zeros((0, d)), [], 0
        for batch in batches:
            y = from_mean(whole(matrix(batch.column("vec"), d)), n, sums) / n
            waiting.append(y.astype(np.float64))
            rows += len(y)
            if rows >= BLOCK:
                r, waiting, rows = _r(np.vstack([r, *waiting])), [], 0
        if waiting:
            r = _r(np.vstack([r, *waiting]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})

    return run


def _merge(d: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r = _r(np.vstack([np.frombuffer(b).reshape(-1, d) for b in group["r"]]))
        return pd.DataFrame({"node": [key[0]], "r": [r.tobytes()]})

    return run


def tsqr(vectors: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: factors of the partitions merged ``FAN`` at a time."""
    parts = vectors.select("vec").mapInArrow(_factors(d, n, sums), "r binary").withColumn("node", F.spark_partition_id().cast("long"))
    left = max(1, vectors.rdd.getNumPartitions())
    while left > 1:
        left = -(-left // FAN)
        parts = parts.groupBy(F.floor(F.col("node") / FAN).alias("node")).applyInPandas(_merge(d), "node long, r binary")
    found = parts.select("r").collect()  # one matrix
    return np.frombuffer(found[0]["r"]).reshape(-1, d)


class Whitener:
    """What whitens a row: the mean in whole numbers, the right vectors and the eigenvalues."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, most: int):
        _, s, v = np.linalg.svd(r, full_matrices=True)
        e = np.zeros(r.shape[1])
        e[: len(s)] = s**2 / n
        self.n, self.sums, self.trace = n, sums, float(e.sum())
        self.e = e[:most]
        v = v[:most]
        top = v[np.arange(len(v)), np.abs(v).argmax(axis=1)]
        self.v = v * np.where(top < 0, -1.0, 1.0)[:, None]
        self.flat = self.e <= FLAT * e[0]

    def rows(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n*x - sums and the whitened coordinates; NaN for components without spread."""
        off = from_mean(whole(vectors), self.n, self.sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = (off / self.n).astype(np.float64) @ self.v.T / np.sqrt(self.e)
        w[:, self.flat] = np.nan
        return off, w


def fit(vectors: DataFrame, d: int, most: int = COMPONENTS) -> Whitener | None:
    """The whitener of all rows of ``vectors`` (vec, of length ``d``); None without rows."""
    n, sums = exact_sums(vectors, d)
    return Whitener(n, sums, tsqr(vectors, d, n, sums), most) if n else None


def _spread(w: Whitener, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, 0.0, 0.0
        for batch in batches:
            y = w.rows(matrix(batch.column("vec"), d))[1][:, ~w.flat]
            if len(y):
                n, mean, m2 = _joined((n, mean, m2), (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tobytes()], "m2": [m2.tobytes()]})

    return run


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows as those of both."""
    n = a[0] + b[0]
    off = b[1] - a[1]
    return n, a[1] + off * b[0] / n, a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def _gather(k: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = (0, np.zeros(k), np.zeros((k, k)))
        for n, mean, m2 in group[["n", "mean", "m2"]].itertuples(index=False):
            found = _joined(found, (int(n), np.frombuffer(mean), np.frombuffer(m2).reshape(k, k)))
        return pd.DataFrame({"node": [key[0]], "n": [found[0]], "mean": [found[1].tobytes()], "m2": [found[2].tobytes()]})

    return run


def identity_error(vectors: DataFrame, d: int, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    k = int((~w.flat).sum())
    if not k:
        return 0.0
    parts = vectors.select("vec").mapInArrow(_spread(w, d), "n long, mean binary, m2 binary").withColumn("node", F.spark_partition_id().cast("long"))
    left = max(1, vectors.rdd.getNumPartitions())
    while left > 1:
        left = -(-left // (FAN * FAN))
        parts = parts.groupBy(F.floor(F.col("node") / (FAN * FAN)).alias("node")).applyInPandas(_gather(k), "node long, n long, mean binary, m2 binary")
    found = parts.collect()[0]
    return float(np.abs(np.frombuffer(found["m2"]).reshape(k, k) / found["n"] - np.eye(k)).max())


def _whitened(w: Whitener, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, y = w.rows(matrix(batch.column("vec"), d))
            if off.dtype == object or d * int(np.abs(off).max(initial=0)) ** 2 >= 2**63:
                dev = [int(x) if x < 2**63 else None for x in (off.astype(object) ** 2).sum(axis=1)]
            else:
                dev = (off**2).sum(axis=1)
            y = y.astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dev, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return run


def whitened(rows: DataFrame, id_column: str, vector_column: str, most: int = COMPONENTS) -> tuple[DataFrame, Whitener | None, float]:
    """(vec_id, deviation, whitened: array of at most ``most``) of the rows that count, the whitener, the identity's error."""
    small = F.forall("vec", lambda c: F.abs(c) < MOST)
    vectors, d = of_one_length(finite(rows, id_column, vector_column).filter(small))
    w = fit(vectors, d, most) if d else None
    if w is None:
        return vectors.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None, 0.0
    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.mapInArrow(_whitened(w, d), f"vec_id {kind}, deviation long, whitened array<double>"), w, identity_error(vectors, d, w)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    rows, w, error = whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    share = F.array(*(F.lit(float(e / w.trace)) if w.trace else F.lit(None).cast("double") for e in w.e)) if w else F.array().cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
