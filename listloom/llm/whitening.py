"""Whitening of embeddings: principal components by a Gramian of exactly centred rows.

Each entry c becomes the whole number x = floor(1024 c) + 100000. Sums S of each dimension over all n vectors are exact, so
n x - S is an exact whole number, and a row handed to RowMatrix is that number divided by n: centring costs one rounding.
computeGramianMatrix, divided by n, is the covariance; its eigenvectors are found on the driver (dim x dim numbers, whatever
n is) and broadcast; mapInPandas projects the rows. What is broadcast and collected depends on the dimension alone.

Defined cases: vectors that are null or hold a null, NaN or infinite entry are left out; so are vectors of another length
than the commonest (of equally common lengths the shortest counts), as no covariance covers both, and empty vectors. Equal
rows, equal ids and null ids each give their own rows. A component without variance (fewer than two different vectors, or
dimensions that depend on each other) has a null `whitened` and explained 0; without any variance explained and
identity_error are null. Components of equal eigenvalues are any orthonormal choice, the same for all rows. An empty table
gives no rows. Other columns are ignored. Vectors so far apart that the squared deviation of a row doesn't fit a long raise an
error; unit vectors do so from about 3 million on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = 2.0**40  # of an entry; larger ones leave no room for exact sums
TOO_FAR = "deviations don't fit 64 bits"
NO_VARIANCE = 1e-12  # eigenvalues below this share of the trace are rounding
KIND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part."""
    v = F.col("v")
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = typed.where((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = fine.groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(v, F.abs))).alias("far")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return typed.where("false").select("vec_id", F.lit(None).cast("array<long>").alias("x"))
    if common["far"] > LARGEST:
        raise ArithmeticError(f"an entry of {common['far']} is too large for exact sums")
    return fine.where(F.size(v) == common["dim"]).select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def gramian(rows: DataFrame, column: Column) -> np.ndarray:
    """The sum of outer products of an array<double> column, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """n and exact sums of each dimension; an error if one dimension's squared deviation leaves 64 bits."""
    at = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    found = at.orderBy("at").collect()  # one row a dimension
    n = found[0]["n"]
    if max(max(n * r["high"] - r["s"], r["s"] - n * r["low"]) ** 2 for r in found) >= 1 << 63:
        raise ArithmeticError(TOO_FAR)
    return n, np.array([r["s"] for r in found], np.int64)


def squared(far: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of whole numbers below 2^31.5; None for a sum that doesn't fit 64 bits."""
    about = np.square(far.astype(float)).sum(1)
    exact = (far * far).sum(1).tolist()
    return [d if a < 2.0**62 or sum(v * v for v in row.tolist()) < 1 << 63 else None for d, a, row in zip(exact, about.tolist(), far, strict=True)]


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and eigenvectors over their square roots as columns (NaN without variance)."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    some = values > NO_VARIANCE * np.trace(covariance)
    return np.where(some, values, 0.0), vectors / np.sqrt(np.where(some, values, np.nan))


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, up to k), n, deviation, whitened, explained, identity_error."""
    spark, rows = vectors.sparkSession, written(whole_numbers(vectors), "whole-numbers")
    if rows.isEmpty():
        return spark.createDataFrame([], KIND)
    n, s = sums(rows)
    offset = F.zip_with("x", F.array(*(F.lit(int(i)) for i in s)), lambda x, t: (x * F.lit(n).cast("long") - t).cast("double") / n)
    covariance = gramian(rows, offset) / n
    values, projection = principal(covariance, k)
    shared = spark.sparkContext.broadcast((n, s, projection))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, projection = shared.value
        for f in frames:
            far = n * np.array(f["x"].to_list(), np.int64).reshape(len(f), len(s)) - s
            yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": pd.Series(squared(far), f.index, "Int64"), "w": list(far / n @ projection)})

    done = written(rows.mapInPandas(project, "vec_id long, deviation long, w array<double>"), "whitened")
    if not done.where("deviation IS NULL").isEmpty():
        raise ArithmeticError(TOO_FAR)
    some = int((values > 0).sum())
    explained, error = [None] * len(values), None
    if some:
        explained = [float(v / np.trace(covariance)) for v in values]
        mean = done.select(F.posexplode(F.slice("w", 1, some)).alias("at", "w")).groupBy("at").agg(F.avg("w").alias("m")).orderBy("at").collect()
        centred = F.zip_with(F.slice("w", 1, some), F.array(*(F.lit(r["m"]) for r in mean)), lambda w, m: w - m)
        error = float(np.abs(gramian(done, centred) / n - np.eye(some)).max())
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "w"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        F.get(F.array(*(F.lit(e).cast("double") for e in explained)), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
