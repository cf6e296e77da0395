"""Evaluation metrics over an item-evaluation table (section 2.9).

The item table is read once: it is counted by (attempts, success, success
attempt, time), and these counts, written by ranges of the time, give all
metrics.  Counts, rates and means are one global aggregate (partial per task);
attempts take few values, so their median and p90 come from Spark's
``percentile``, whose buffer counts distinct values; item times may all differ,
and their order statistics come from ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .profile import one_row
from .quantiles import quantiles, range_counts
from .results import normalize_pass_k

TIME_QUANTILES = {"time_median": 0.5, "time_p90": 0.9}


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast("double")


def metric_columns(pass_k: Sequence[int]) -> list[Column]:
    """All metrics but the order statistics of the times, over the counts
    ``c`` of (attempts, success, success_attempt, v)."""
    ks = normalize_pass_k(pass_k)
    c, att = F.col("c"), F.col("attempts").cast("double")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, c)), F.lit(0))

    def mean(x: Column) -> Column:
        return _zero(F.try_divide(F.sum(x * c), F.sum(F.when(x.isNotNull(), c))))

    n = F.coalesce(F.sum(c), F.lit(0))
    within = lambda k: _zero(F.try_divide(count(F.col("success_attempt") <= k), n))
    return [
        n.alias("total_items"),
        count(F.col("success")).alias("success_count"),
        _zero(F.try_divide(count(F.col("success")), n)).alias("success_rate"),
        *[within(k).alias(f"pass_at_{k}") for k in ks],
        (within(1) if 1 in ks else F.lit(0.0)).alias("compile_rate_at_1"),
        mean(att).alias("attempts_mean"),
        _zero(F.percentile(att, F.lit(0.5), c)).alias("attempts_median"),
        _zero(F.percentile(att, F.lit(0.9), c)).alias("attempts_p90"),
        mean(F.col("v")).alias("time_mean"),
    ]


def compute_metrics(item_eval: DataFrame, pass_k: Sequence[int] = S.DEFAULT_PASS_K) -> DataFrame:
    """One row: total_items, success_count, success_rate, pass_at_<k>...,
    compile_rate_at_1, attempts mean/median/p90, time mean/median/p90.
    Zeros on empty input.  The counts are made and written when this is called."""
    counts = range_counts(item_eval, "total_time", ["attempts", "success", "success_attempt"])
    return one_row(counts.agg(*metric_columns(pass_k)), quantiles(counts, TIME_QUANTILES))


def pass_at_k_map(metrics: DataFrame, pass_k: Sequence[int]) -> Column:
    ks = normalize_pass_k(pass_k)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[metrics[f"pass_at_{k}"] for k in ks]))
