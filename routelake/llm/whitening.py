"""Embedding whitening: principal components of unit variance, from an exactly centred Gram matrix.

Entries become integers on a fixed grid, so that sums over all rows are exact and do not depend
on the order in which tasks end.  The sums centre the rows, MLlib's RowMatrix adds up their
outer products in the JVM, the driver solves the small eigenproblem, and every row is projected
where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.llm.common import lean, table

COMPONENTS = 32
GRID, SHIFT = 64, 1_000_000
#: Entries beyond are taken as these, so that sums stay within a long.
MOST = float(2**31)
#: Components whose variance is under this share of the trace have none but rounding.
LEAST = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def on_grid(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry, as long."""
    clipped = lambda c: F.greatest(F.least(c.cast("double"), F.lit(MOST)), F.lit(-MOST))
    return F.transform(vector, lambda c: F.floor(clipped(c) * GRID).cast("long") + SHIFT)


@dataclass
class Whitening:
    """What is fitted: rows, exact sums of each dimension, eigenvectors as columns, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S exactly, and the same over n; of a block of rows."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        d = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return d, d.astype(np.float64) / self.n

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def _ready(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    return vectors.where(usable(F.col(vector))).select(F.col(id_col).alias("id"), on_grid(F.col(vector)).alias("x"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of longs; shorter ones end in entries of zero."""
    out = np.full((len(column), width), SHIFT, dtype=np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (x: array<long>); None if there is no row."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not width:
        return None
    summed = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("k"))
    sums = [0] * width
    for i, s, k in summed.collect():  # a row for each dimension
        sums[i] = s + (n - k) * SHIFT
    held = F.split(F.lit(",".join(map(str, sums))), ",").cast("array<bigint>")
    whole = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    centred = F.zip_with(whole, held, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n) - s).cast("double") / F.lit(float(n)) if n * MOST * GRID >= 2**63 else (x * F.lit(n) - s).cast("double") / F.lit(float(n)))
    dense = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    gram = RowMatrix(dense, n, width).computeGramianMatrix().toArray()
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(gram) / n)
    kept = min(components, int((values > LEAST * max(trace, 0)).sum()) if trace > 0 else 0)
    fitted = Whitening(n, sums, vectors[:, :kept].copy(), values[:kept].copy(), trace)
    fitted.identity_error = _identity_error(rows, fitted) if kept else 0.0
    return fitted


def _identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: sums by task, of one short row each."""
    kept, width = len(fitted.values), len(fitted.sums)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square = np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            w = fitted.whitened(fitted.centred(_matrix(batch["x"], width))[1])
            total, square = total + w.sum(axis=0), square + w.T @ w
        yield pd.DataFrame({"sums": [np.concatenate([total, square.ravel()])]})

    parts = rows.select("x").mapInPandas(lean(summed), "sums array<double>")
    added = dict(parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect())
    found = np.array([added[i] for i in range(kept + kept * kept)]) / fitted.n
    mean, square = found[:kept], found[kept:].reshape(kept, kept)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(kept)).max())


def whiten(rows: DataFrame, fitted: Whitening | None) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    kept, width = len(fitted.values), len(fitted.sums)
    explained = fitted.values / fitted.trace

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            exact, centred = fitted.centred(_matrix(batch["x"], width))
            small = exact.dtype != object and width * int(np.abs(exact).max(initial=0)) ** 2 < 2**63
            squares = ((exact if small else exact.astype(object)) ** 2).sum(axis=1)
            deviation = pd.array([int(s) if s < 2**63 else None for s in squares], dtype="Int64")
            out = pd.DataFrame({"id": batch["id"].repeat(kept).array, "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(batch))})
            out["n"], out["deviation"] = fitted.n, deviation.repeat(kept)
            out["whitened"], out["explained"] = fitted.whitened(centred).ravel(), np.tile(explained, len(batch))
            yield out.assign(identity_error=fitted.identity_error)

    return rows.mapInPandas(lean(project), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding in up to 32 components.

    Vectors that are null, or hold a null, NaN or infinite entry, are left out; others of
    fewer dimensions than the longest end in zeros, and entries beyond 2**31 are taken as that.
    Repeated rows count and come out each on their own, null ids as well.  A table without a
    usable row, or whose rows are all equal, has no component and gives no row.  A deviation
    over a long's range is null.
    """
    rows = _ready(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whiten(rows, fit(rows)).withColumnRenamed("id", "vec_id")
