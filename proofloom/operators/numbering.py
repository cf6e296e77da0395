"""Dense numbers 0, 1, 2, ... over a whole frame or inside groups, without a
window over the rows.

The rows are dealt out by ranges of the wanted order, so one group, however
large, lies in as many tasks as it needs.  Each task numbers its own rows by
their position, one total per task (and group) is added up, and a row's number
is its task's offset plus its position.  The numbered rows are written to the
shared folder before they are counted: counts and rows come from the same
files, also when executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_column, scratch_path

#: monotonically_increasing_id is (partition << 33) + position in it.
POSITION_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], out: str, *, group: Sequence[str] = (), total: str | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with ``out``: the row's place from 0 in ``order``, within its
    group (null is a group of its own).  ``total`` names a column for the
    size of the group, ``tasks`` how many tasks number (``shuffle.partitions``
    if not given).  Without ``order`` and ``group`` the rows keep the
    layout they have.

    Rows that are equal in ``order`` are numbered in any order, so add what
    tells them apart.  They still spread over tasks: the position in the input
    ends the order.  ``df`` is read twice (range bounds, rows): give it a scan
    or a written table.
    """
    spark = df.sparkSession
    at, part, run, before, size = (free_column(df, c) for c in ("_at", "_part", "_run", "_before", "_size"))
    of = [free_column(df, f"_group{i}") for i in range(len(group))]
    if order or group:
        tie = free_column(df, "_tie")
        keys = [*[F.col(f"`{g}`") for g in group], *order, F.col(tie)]
        n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(tie)
    path = scratch_path(spark, "numbered")
    marked = df.withColumn(at, F.monotonically_increasing_id())
    marked.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path).withColumn(part, F.shiftright(at, POSITION_BITS))

    groups = [F.col(f"`{g}`").alias(o) for g, o in zip(group, of)]
    runs = rows.groupBy(*groups, F.col(part).alias(run)).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per task (and group in it): bounded by tasks and groups.
    whole = Window.partitionBy(*of)
    earlier = whole.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    runs = runs.select(*of, run, offset.alias(before), F.sum("n").over(whole).alias(size))
    same = F.col(part) == F.col(run)
    for g, o in zip(group, of):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(o))
    if not group:
        runs = F.broadcast(runs)  # one row per task of the write
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, total)]
    added = [(F.col(at) + F.col(before)).alias(out)] + ([F.col(size).alias(total)] if total else [])
    return rows.join(runs, same).select(*kept, *added)
