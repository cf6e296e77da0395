"""Keeping expensive computed columns computed once.

Catalyst pushes a filter below the projection that computes the columns it
tests, substituting every alias.  For cheap predicates that is what we want
(it reaches the parquet scan).  For predicates over expensive derived
columns -- extracted code, validation errors, classified errors -- the pushed
condition re-evaluates the whole expression tree (a filter gets no common
subexpression elimination), once per reference, and can even sink below the
exchange that spreads a small scan over all cores.

``where_computed`` filters on such columns in place: the predicate also
references a nondeterministic column of the same projection, and Catalyst
never pushes a filter through a nondeterministic projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_computed(df: DataFrame, condition: Column | str) -> DataFrame:
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return (
        df.withColumn("_computed_at", F.spark_partition_id())
        .where(cond & (F.col("_computed_at") >= 0))
        .drop("_computed_at")
    )
