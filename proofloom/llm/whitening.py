"""11. Embedding whitening with Spark MLlib's BlockMatrix.

The kept vectors are numbered and written once.  Their centred rows become a
distributed BlockMatrix A; A'A / n is the covariance, whose eigenvectors are
taken on the driver (a matrix of dimension x dimension, whatever the number of
rows); A times the whitening matrix projects the rows.  A second scatter, of
the projected rows, measures how far they are from white.

Entries are scaled to integers, so the sums, the centred rows and the distance
from the mean rest on exact numbers.

Vectors that are null, empty, or hold a null, NaN, infinity or an entry of
2^42 or more take no part, nor do vectors of another length than the commonest
one (the longer of two equally common).  Repeated rows and repeated or null ids
are rows of their own.  A component without variance (a constant dimension, one
row, fewer rows than components) has no white scale: its values are null and
it is left out of the identity error.  Nothing else in the table is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, table

SCALE, SHIFT = 1024, 100000
LOW_BITS = 26


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    v = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    v = v.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce(F.abs(c) < 2.0**42, F.lit(False))))
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.where(F.size("v") == (lengths["d"] if lengths else 0))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def totals(x: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sum per dimension).  High and low parts are summed apart,
    so 64 bits hold them for 2^36 rows; one row per dimension comes back."""
    at = x.select(F.posexplode("x").alias("d", "c"))
    high, low = F.shiftright("c", LOW_BITS), F.col("c").bitwiseAND((1 << LOW_BITS) - 1)
    rows = at.groupBy("d").agg(F.count("*").alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low")).collect()
    rows.sort(key=lambda r: r["d"])
    return (rows[0]["n"] if rows else 0), [(r["high"] << LOW_BITS) + r["low"] for r in rows]


def block_matrix(rows: DataFrame, n: int, d: int, block_rows: int = 1024) -> BlockMatrix:
    """The rows (i, v array of double) as blocks of all ``d`` columns.  Blocks
    grow with n so that their number, which MLlib plans with on the driver,
    stays below 2^20."""
    block_rows = max(block_rows, -(-n >> 20))
    vectors = rows.select(F.col("i").alias("index"), array_to_vector("v").alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(block_rows, d)


def scatter(a: BlockMatrix) -> np.ndarray:
    """A'A as a local matrix of dimension x dimension.  The product has one
    block; splitting the middle dimension lets every partition of A multiply
    its own blocks before the sums meet."""
    java = a.transpose()._java_matrix_wrapper
    product = java.call("multiply", a._java_matrix_wrapper._java_model, max(1, a.blocks.getNumPartitions()))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def times(a: BlockMatrix, small: np.ndarray) -> DataFrame:
    """(i, v): the rows of A times a local matrix."""
    d, k = small.shape
    spark = SparkSession.getActiveSession()
    block = ((0, 0), DenseMatrix(d, k, small.ravel(order="F")))
    w = BlockMatrix(spark.sparkContext.parallelize([block], 1), d, k, d, k)
    rows = a.multiply(w).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select(F.col("index").alias("i"), vector_to_array("vector").alias("v"))


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), by falling eigenvalue; each
    vector's entry of largest magnitude is positive.  Eigenvalues below 1e-12
    of the largest are within rounding of the scatter and count as 0."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1], v[:, ::-1]
    noise = 1e-12 * max(e[0], 0.0)
    e = np.where(e > noise, e, 0.0)[:most]
    v = v[:, : len(e)]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return e, v * np.where(sign == 0, 1.0, sign)


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, n, deviation (sum over dimensions of
    (n*x-S)^2; null where 64 bits do not hold it), whitened and explained (arrays
    by component) and identity_error.  The eigenvectors follow from all kept
    vectors; the work is done when this is called, and read from the shared
    folder."""
    x = numbered(scaled(vectors, vec_id, vector), [], "i")
    n, s = totals(x)
    if not n:
        none = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
        return x.select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    # S = whole * n + rest: x - whole is exact, and n*x-S is n*(x-whole)-rest.
    whole = F.array(*[F.lit(t // n).cast("long") for t in s])
    rest = F.array(*[F.lit(t % n).cast("long") for t in s])
    moved = F.zip_with(F.zip_with("x", whole, lambda c, w: c - w), rest, lambda c, r: F.try_subtract(F.try_multiply(c, F.lit(n).cast("long")), r))
    square = F.aggregate(moved, F.lit(0).cast("long"), lambda acc, c: F.try_add(acc, F.try_multiply(c, c)))
    centred = F.zip_with(F.zip_with("x", whole, lambda c, w: c - w), rest, lambda c, r: c - r / F.lit(float(n)))
    a = block_matrix(x.select("i", centred.alias("v")), n, len(s))
    covariance = scatter(a) / n
    e, basis = principal(covariance, components)
    alive = e > 0
    scale = np.where(alive, 1.0 / np.sqrt(np.where(alive, e, 1.0)), 0.0)
    projected = cut(times(a, basis * scale), "whiten-rows")

    # How white the rows are: their own covariance, centred again.
    means = projected.select(F.posexplode("v").alias("d", "c")).groupBy("d").agg(F.avg("c").alias("mean")).collect()
    mean = [r["mean"] for r in sorted(means, key=lambda r: r["d"])]
    about = F.zip_with("v", F.array(*[F.lit(float(m)) for m in mean]), lambda c, m: c - m)
    spread = scatter(block_matrix(projected.select("i", about.alias("v")), n, len(e))) / n
    error = np.abs(spread - np.eye(len(e)))[np.ix_(alive, alive)]
    share = [float(t) for t in e / max(np.trace(covariance), np.finfo(np.float64).tiny)]
    white = F.transform("v", lambda c, k: F.when(F.get(F.array(*[F.lit(bool(t)) for t in alive]), k), c))
    return (
        x.select("i", "vec_id", square.alias("deviation"))
        .join(projected, "i")
        .select(
            "vec_id",
            F.lit(n).cast("long").alias("n"),
            "deviation",
            white.alias("whitened"),
            F.array(*[F.lit(t) for t in share]).alias("explained"),
            F.lit(float(error.max()) if error.size else None).cast("double").alias("identity_error"),
        )
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whiten(table(spark, sf_dir, "embeddings"), 8)
    w = w.select("*", F.posexplode("whitened").alias("at", "value"))
    return w.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error")


QUERIES = {"op11_whitening": op11_whitening}
#: Eigenvectors have no SQL; the tests compare with numpy.
ORACLES: dict[str, str] = {}
