"""Embedding whitening: exact centring, RowMatrix's Gramian, a local eigendecomposition, whitening in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize

#: Fixed values of the integer grid: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components whose eigenvalue is this part of the largest or less are noise of rounding and are not divided by.
LEAST_EIGENVALUE = 1e-11
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all entries finite numbers."""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT))


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, sum of each dimension) over the vectors of the most frequent width (of two, the larger one): sums of
    whole numbers, so the order of rows does not matter. The driver gets one row a dimension."""
    cells = rows.select(F.size("v").alias("width"), F.posexplode(grid(F.col("v"))).alias("at", "x"))
    sums = materialize(cells.groupBy("width", "at").agg(F.count("*").alias("n"), F.sum("x").alias("s")), "sums")
    most = sums.filter("at = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return 0, []
    return most.n, [r.s for r in sums.filter(F.col("width") == most.width).orderBy("at").collect()]


def gramian(rows: DataFrame, values: Column) -> np.ndarray:
    """Sum of the outer products of the rows' values, added up by RowMatrix in the tasks and by a tree of them."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(values).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns, each with its largest entry positive)."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)


def deviations(numerators: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each row; Python's whole numbers where 64 bits might not do."""
    if not numerators.size or int(np.abs(numerators).max()) ** 2 * numerators.shape[1] < 1 << 63:
        return (numerators * numerators).sum(axis=1)
    return np.array([sum(x * x for x in map(int, row)) for row in numerators], dtype=np.int64)


def whiten(docs: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per vector and component: row_id, component (from 1, by falling eigenvalue), n (vectors fitted),
    deviation (exact sum of squares of n*x - S), whitened, explained (share of the trace) and identity_error (largest
    absolute entry of the whitened covariance less the identity).

    x is floor(64 * c) + 1000000 for each entry c. All covariances are over all vectors, divided by n and centred
    before they are multiplied: rows are (n*x - S) / n, whose numerator is exact. RowMatrix adds the Gramian up,
    the driver decomposes one matrix of width x width, and the tasks project their rows on it (it is broadcast with
    the function; its size is that of width * components numbers).

    Vectors that are null, empty or hold a null, a NaN or an infinity take no part; so do those whose width is not the
    most frequent one. A null row_id stays; repeated rows count and come back as often as they come. Equal
    eigenvalues come in the order of the decomposition, the same for all rows. A component without spread (eigenvalue
    under 1e-11 of the largest: constant or dependent dimensions, fewer vectors than dimensions) has null
    `whitened` and is left out of identity_error. Where all vectors are equal, `explained` and identity_error are null.
    An empty table gives no rows. Other columns are ignored. A deviation beyond 64 bits is an error.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    n, sums = exact_sums(rows)
    kind = docs.schema[row_id].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"{row_id} {kind}, {RESULT}")
    width = len(sums)
    rows = rows.filter(F.size("v") == width)
    centred = F.zip_with(grid(F.col("v")), F.lit(sums), lambda x, s: (x * F.lit(n) - s).cast("double") / F.lit(float(n)))
    values, vectors = eigen(gramian(rows, centred) / n)
    shown = min(components, width)
    sound = int((values[:shown] > max(values[0], 0.0) * LEAST_EIGENVALUE).sum())
    basis = spark.sparkContext.broadcast((np.array(sums, dtype=np.int64), vectors[:, :sound] / np.sqrt(values[:sound])))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, towards = basis.value
        for frame in frames:
            if len(frame):
                numerators = (np.floor(np.stack(frame.v.to_numpy()) * SCALE).astype(np.int64) + SHIFT) * n - total
                yield pd.DataFrame({"id": frame.id, "deviation": deviations(numerators), "w": list((numerators / n) @ towards)})

    whitened = materialize(rows.mapInPandas(project, f"id {kind}, deviation long, w array<double>"), "whitened")
    error = None
    if sound:
        means = list(whitened.agg(*[F.avg(F.col("w")[i]) for i in range(sound)]).first())
        again = gramian(whitened, F.zip_with("w", F.lit(means), lambda w, m: w - m)) / n
        error = float(np.abs(again - np.eye(sound)).max())
    spread = float(values.sum())
    explained = [max(float(v), 0.0) / spread if sound else None for v in values[:shown]]
    at = F.explode(F.sequence(F.lit(1), F.lit(shown)))
    return whitened.select("id", "deviation", "w", at.alias("component")).select(
        F.col("id").alias(row_id), F.col("component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.try_element_at("w", F.col("component")).alias("whitened"),
        F.try_element_at(F.array(*[F.lit(x).cast("double") for x in explained]), F.col("component")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
