"""Exact order statistics without a task that holds all values.

The values are counted once per distinct value, dealt out by ranges and written
to the shared folder together with the number of their range.  One total per
range, added up in order, tells the range that holds a wanted rank; only that
range is then added up value by value.  Nothing returns to the driver, and both
steps read the same files, so they agree also when executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def range_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, v, c, part), written: how often each value (as a double) stands
    with each combination of ``keys``, by ranges of the value; a null is a
    value, first.  Partial counts come before the shuffle, so a value that
    many rows share is one row per task."""
    spark = df.sparkSession
    counts = df.select(*keys, F.col(value).cast("double").alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id())
    path = scratch_path(spark, "counts")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def quantiles(counts: DataFrame, probs: dict[str, float]) -> DataFrame:
    """One row over ``range_counts``: for every name of ``probs`` the linearly
    interpolated quantile at that probability, rank ``p * (n - 1)``.  Nulls and
    NaN take no part; 0.0 where nothing is left."""
    if any(not 0 <= p <= 1 for p in probs.values()):
        raise ValueError("a quantile's probability lies between 0 and 1")
    known = counts.where("v IS NOT NULL AND NOT isnan(v)")
    # One total per range, as one array: as many entries as there are ranges.
    totals = known.groupBy("part").agg(F.sum("c").alias("c")).agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("t"))
    totals = totals.selectExpr("t", "aggregate(t, 0L, (a, x) -> a + x.c) AS n").where("n > 0")
    # Two ranks per name, below and above: 2 * len(probs) rows.
    sides = [(2 * i + k, f"{p!r}D * (n - 1)", side) for i, p in enumerate(probs.values()) for k, side in enumerate(("floor", "ceil"))]
    ranks = ", ".join(f"struct({i} AS id, {side}({at}) AS rank, {at} - floor({at}) AS share)" for i, at, side in sides)
    wanted = totals.selectExpr("t", f"inline(array({ranks}))")
    # The range that holds a rank, and what of the rank is left inside it.
    walk = (
        "aggregate(t, named_struct('part', -1, 'left', rank), "
        "(a, x) -> if(a.part >= 0, a, if(a.left < x.c, named_struct('part', x.part, 'left', a.left), named_struct('part', -1, 'left', a.left - x.c))))"
    )
    wanted = wanted.selectExpr("id", "share", f"{walk} AS at").selectExpr("id", "share", "at.part AS part", "at.left AS left")
    inside = known.select("part", "v", "c").join(F.broadcast(wanted), "part").groupBy("id", "share", "left", "v").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("upto", F.sum("c").over(w)).where("upto > left AND upto - c <= left")
    out = []
    for i, name in enumerate(probs):
        low, high, share = (f"max(if(id = {k}, {c}, NULL))" for k, c in ((2 * i, "v"), (2 * i + 1, "v"), (2 * i, "share")))
        out.append(F.expr(f"coalesce(if({high} > {low}, {low} + ({high} - {low}) * {share}, {low}), 0.0D)").alias(name))
    return found.agg(*out)
