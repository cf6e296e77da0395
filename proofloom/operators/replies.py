"""Reply post-processing job (section 2.5): a reply table becomes a
candidate table.  Map-only: every stage is a native column expression, so
the job is one scan plus one projection per partition -- no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def candidates_from_replies(replies: DataFrame, reply: str = "response") -> DataFrame:
    """Adds ``code``, ``is_valid`` and ``errors`` to a reply table."""
    with_code = replies.withColumn("code", TX.extract_code(F.col(reply)))
    errs = TX.code_errors(F.col("code"))
    return with_code.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def invalid_reason(df: DataFrame) -> DataFrame:
    """``compile_stderr`` of a candidate that is not checked: its errors
    joined by ``'; '`` (null when it has none)."""
    return df.withColumn(
        "invalid_reason", F.when(F.size("errors") > 0, F.array_join("errors", "; "))
    )


def reply_quality(candidates: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Per attempt and violation: how many replies have it, next to the
    attempt's reply count and share of structurally valid replies.

    Two partial/final aggregates over bounded keys (attempt; attempt x
    message) -- the group count does not grow with the data."""
    per_attempt = candidates.groupBy(attempt).agg(
        F.count(F.lit(1)).alias("replies"),
        F.avg(F.col("is_valid").cast("double")).alias("valid_share"),
    )
    per_error = (
        candidates.select(attempt, F.explode("errors").alias("error"))
        # the unicode message lists the characters; group on its kind
        .withColumn("error", F.regexp_replace("error", r"(?s): \{.*\}$", ""))
        .groupBy(attempt, "error")
        .agg(F.count(F.lit(1)).alias("error_count"))
    )
    # both sides have one row per attempt (or attempt x message); AQE
    # broadcasts them at run time when they are small
    return per_error.join(per_attempt, attempt, "right").select(
        attempt, F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"), "replies", "valid_share",
    )
