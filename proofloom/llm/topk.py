"""6. Exact top-k search by multi-resolution segment statistics.

Every vector is summarised at a few resolutions (4, 8, 16 ... segments) by the
mean and the deviation of each segment.  For two vectors cut into segments of
width w, the distance obeys

    |q - x|^2 >= sum of w * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

so the inner product (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most the sum of
w * (mean_q * mean_x + dev_q * dev_x).  Blocks of candidates are searched
coarse to fine: a pair whose bound falls below the query's k-th best exact
score so far is dropped, and survivors of the finest level are scored exactly
in integers.

Candidates and queries are numbered by the signs of their coarsest segment
means, then by length, and cut into blocks of equal size, so a block's vectors
are alike.  A block's envelope (the range of each segment mean, the largest
deviation) bounds every pair of two blocks.  Each query block first meets the
candidate block of highest bound; the worst k-th score found there is its floor,
and only blocks whose bound reaches the floor are dealt to it after that.  The
best k of a query are a ranking that each task cuts at k.  Equal rows are
counted before they are dealt, and searched once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, small_batches, table

#: Segments of the blocks' envelopes.
SEGMENTS = 4
RESULT = "query_id long, vec_id long, score long, copies long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) per component, x as double.  Rows
    whose id or vector is null, or whose vector holds a null or a non-finite
    component, are left out; so are empty vectors."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"),
    )


def segment_statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(w) * (means, deviations) of each segment, side by side, so that a
    plain inner product of two rows is the bound."""
    edges = np.linspace(0, m.shape[1], min(segments, m.shape[1]) + 1).astype(int)
    width = np.diff(edges).astype(float)
    mean = np.add.reduceat(m, edges[:-1], axis=1) / width
    var = np.add.reduceat(m * m, edges[:-1], axis=1) / width - mean**2
    return np.hstack([mean, np.sqrt(np.maximum(var, 0))]) * np.sqrt(np.hstack([width, width]))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q, clamped to a long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.size < 2**53:
        return np.rint(x @ q).astype(np.int64)
    qs = [int(c) for c in q]
    low, high = -(2**63), 2**63 - 1
    return np.array([min(max(sum(a * int(b) for a, b in zip(qs, row)), low), high) for row in x], np.int64)


def search_block(q_ids, q, q_copies, x_ids, x, x_copies, k: int, levels=(4, 8, 16)) -> pd.DataFrame:
    """The k best rows of one candidate block for each query of one block, and
    how many pairs (at most k) each stands for.  The rows of either side are
    distinct."""
    levels = [s for s in levels if s < x.shape[1]]
    qs, xs = [segment_statistics(q, s) for s in levels], [segment_statistics(x, s) for s in levels]
    slack = 1e-6 * (1.0 + np.linalg.norm(x, axis=1))
    order = np.argsort(x_ids, kind="stable")
    out = []
    for i, qid in enumerate(q_ids):
        mine = x_ids[order] != qid
        alive = order[mine]
        if not len(alive):
            continue
        tolerance = slack[alive] * (1.0 + np.linalg.norm(q[i]))
        floor_score = -np.inf
        for level in range(len(levels)):
            bound = xs[level][alive] @ qs[level][i] + tolerance
            if len(alive) > k:
                best = alive[np.argpartition(-bound, k - 1)[:k]]
                floor_score = max(floor_score, float(exact_scores(q[i], x[best]).min()))
            keep = bound >= floor_score
            alive, tolerance = alive[keep], tolerance[keep]
        score = exact_scores(q[i], x[alive])
        top = np.lexsort((x_ids[alive], -score))[:k]
        copies = np.minimum(np.minimum(x_copies[alive][top], k) * min(int(q_copies[i]), k), k)
        out.append(pd.DataFrame({"query_id": qid, "vec_id": x_ids[alive][top], "score": score[top], "copies": copies}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copies": []}, dtype="int64")


def in_blocks(vectors: DataFrame, block: str, block_rows: int) -> DataFrame:
    """(dim, block, vec_id, v, copies, seg, size): the distinct rows in blocks of
    ``block_rows``; seg holds sum and sum of squares of each coarse segment,
    size the vector's length."""
    d = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    edge = lambda i: F.floor(i * F.col("dim") / F.lit(SEGMENTS)).cast("int")
    total = lambda part, f: F.aggregate(part, F.lit(0.0), lambda acc, c: acc + f(c))

    def segment(i):
        part = F.slice("v", edge(i) + 1, edge(i + 1) - edge(i))
        return F.struct(i.alias("s"), (edge(i + 1) - edge(i)).alias("w"), total(part, lambda c: c).alias("sum"), total(part, lambda c: c * c).alias("square"))

    d = d.withColumn("seg", F.filter(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), segment), lambda g: g["w"] > 0))
    d = d.withColumn("size", F.sqrt(F.aggregate("seg", F.lit(0.0), lambda acc, g: acc + g["square"])))
    signs = F.transform("seg", lambda g: g["sum"] > 0)
    d = numbered(d, [signs, F.col("size"), F.col("vec_id"), F.xxhash64("v")], "place", group=["dim"])
    return d.select("dim", F.expr(f"place div {int(block_rows)}").alias(block), "vec_id", "v", "copies", "seg", "size")


def envelopes(blocks: DataFrame, block: str, name: str) -> DataFrame:
    """One row per block and segment: range of the mean, largest deviation and
    length, columns named after ``name``."""
    g = blocks.select("dim", block, "size", F.inline("seg"))
    mean = F.col("sum") / F.col("w")
    dev = F.sqrt(F.greatest(F.col("square") / F.col("w") - mean * mean, F.lit(0.0)))
    e = g.groupBy("dim", block, "s", "w").agg(F.min(mean), F.max(mean), F.max(dev), F.max("size"))
    return e.toDF("dim", block, "s", "w", *[f"{name}_{c}" for c in ("low", "high", "dev", "size")])


def pair_bounds(q: DataFrame, c: DataFrame) -> DataFrame:
    """(dim, qb, cb, bound): what no inner product of the two blocks exceeds.
    Blocks meet blocks: as many rows as there are pairs of blocks."""
    x = lambda a, b: F.col(f"q_{a}") * F.col(f"c_{b}")
    mean = F.greatest(x("low", "low"), x("low", "high"), x("high", "low"), x("high", "high"))
    slack = 1e-6 * (1 + F.max("c_size")) * (1 + F.max("q_size"))
    both = envelopes(q, "qb", "q").join(envelopes(c, "cb", "c").drop("w"), ["dim", "s"])
    return both.groupBy("dim", "qb", "cb").agg((F.sum(F.col("w") * (mean + x("dev", "dev"))) + slack).alias("bound"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every
    query with all candidates but rows of its own id, ties to the smaller id.

    ``queries`` and ``candidates`` are (vec_id, v) as ``quantised`` gives.
    Only vectors of the query's length are compared.  Every row counts: a
    candidate that stands m times takes m ranks, and a query that stands m
    times meets every candidate m times.  Blocks hold ``block_rows`` distinct
    rows at most, whatever the size of the tables.
    """
    small_batches(candidates.sparkSession, 4096)
    c, q = in_blocks(candidates, "cb", block_rows), in_blocks(queries, "qb", block_rows)
    pairs = cut(pair_bounds(q, c), "topk-pairs")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copies": []}, dtype="int64")
        rows = lambda side, *names: (side[names[0]].to_numpy(), np.stack(side[names[1]].to_numpy()), side[names[2]].to_numpy())
        return search_block(*rows(left, "vec_id", "v", "copies"), *rows(right, "c_id", "c_v", "c_copies"), k)

    def found(met: DataFrame) -> DataFrame:
        """The search over the given pairs of blocks, a group for each."""
        met = met.select("dim", "qb", "cb")
        left = q.select("dim", "qb", "vec_id", "v", "copies").join(met, ["dim", "qb"])
        # Renamed on one side: both may come from one table.
        right = c.select("dim", "cb", "vec_id", "v", "copies").join(met, ["dim", "cb"])
        right = right.select("dim", "cb", "qb", "vec_id", "v", "copies").toDF("c_dim", "c_cb", "c_qb", "c_id", "c_v", "c_copies")
        return left.groupBy("dim", "cb", "qb").cogroup(right.groupBy("c_dim", "c_cb", "c_qb")).applyInPandas(search, RESULT)

    # The candidate block of highest bound first; then those that can still count.
    first = pairs.groupBy("dim", "qb").agg(F.max_by("cb", F.struct("bound", -F.col("cb"))).alias("cb"))
    some = cut(found(first), "topk-first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    kth = some.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    floors = q.select("dim", "qb", "vec_id").join(kth, F.col("vec_id") == F.col("query_id"), "left").groupBy("dim", "qb")
    floors = floors.agg(F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("floor"))
    rest = pairs.join(first, ["dim", "qb", "cb"], "left_anti").join(floors, ["dim", "qb"]).where("bound >= floor")
    # A ranking cut at k: each task keeps k rows of a query before any meet.
    every = some.unionByName(found(cut(rest, "topk-rest"))).withColumn("place", place).where(F.col("place") <= k)
    best = every.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "copies"))).alias("best"))  # at most k rows
    each = F.slice(F.flatten(F.transform("best", lambda b: F.array_repeat(b, b["copies"].cast("int")))), 1, k)
    return best.select("query_id", F.posexplode(each).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v.where(F.col("vec_id") % 50 == 0), v, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op6_exact_top_k": op6_exact_top_k}
ORACLES = {"op6_exact_top_k": ORACLE}
