"""Checker-output classification job (section 2.6).

Input: a table with a ``stderr`` column and its order keys.  Output: one row
per classified stderr line, the primary error per row, and aggregates.
Classification is a native array expression per row (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors as ER
from .stages import where_computed


def error_lines(df: DataFrame, stderr: str = "stderr") -> DataFrame:
    """One row per non-blank stripped stderr line with its 0-based position,
    category, line number and fix suggestions (the error table)."""
    exploded = df.select("*", F.posexplode(ER.stderr_lines(F.col(stderr))).alias("pos", "line"))
    staged = exploded.withColumn("category", ER.classify_line(F.col("line")))
    return staged.select(
        "*",
        ER.line_number(F.col("line")).alias("line_number"),
        ER.fix_suggestions(F.col("category"), F.col("line")).alias("suggested_fixes"),
    )


def with_classified(df: DataFrame, stderr: str = "stderr") -> DataFrame:
    """Adds ``errors``: ARRAY<STRUCT> of classified errors (no explode)."""
    return ER.with_classified(df, stderr)


def with_primary_error(df: DataFrame, stderr: str = "stderr") -> DataFrame:
    """Adds ``primary_error`` (struct, null when the stderr is blank)."""
    return ER.with_primary_error(df, stderr)


def errors_encountered(df: DataFrame, stderr: str = "stderr", failed: Column | None = None) -> DataFrame:
    """Primary errors of failing checks with a non-blank stderr, one row each,
    keeping the order keys of the input (attempt, beam/seq) for ordering."""
    rows = df if failed is None else df.where(failed)
    return where_computed(with_primary_error(rows, stderr), F.col("primary_error").isNotNull())


def error_context(
    df: DataFrame,
    *,
    item: str = "item_id",
    attempt: str = "attempt",
    order: tuple[str, ...] = ("seq",),
    stderr: str = "stderr",
    attempts: Column | None = None,
) -> DataFrame:
    """The error fed to each attempt: the last primary error of any earlier
    attempt (carried over attempts that yield none); null for the first.

    1. per (item, attempt): last primary error by the order keys (max_by), a
       partial/final aggregate, so a hot item is one row per task and attempt;
    2. per item: these errors as one array in attempt order, at most one entry
       per attempt of the item; each attempt takes the last one before it.
    ``attempts`` (an ARRAY<INT> column) lists the attempts to report; by
    default the attempts present in the input.  Items without any error are
    reported too, a null item like any other; rows without an attempt count
    for none.
    """
    e = F.col("primary_error")
    key = F.when(e.isNotNull(), F.struct(*[F.col(c) for c in order]))
    rows = with_primary_error(df, stderr).where(F.col(attempt).isNotNull())
    last = rows.groupBy(item, attempt).agg(F.max_by(e, key).alias("_error"))
    known = last.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(attempt).alias("at"), F.col("_error").alias("error")))).alias("_known"))
    wanted = attempts if attempts is not None else F.transform("_known", lambda k: k["at"])

    def before(a: Column) -> Column:
        earlier = F.filter("_known", lambda k: (k["at"] < a) & k["error"].isNotNull())
        return F.get(earlier, F.size(earlier) - 1)["error"]

    told = F.transform(wanted, lambda a: F.struct(a.alias(attempt), before(a).alias("error_context")))
    return known.select(item, F.inline(told))


def error_histogram(lines: DataFrame, by: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """Error lines per category (and ``by`` keys); partial aggregation makes a
    hot category cheap."""
    return lines.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n_errors"))


def error_histogram_wide(lines: DataFrame, by: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """One row per ``by`` key, one count column per category.  The category
    list is fixed, so ``pivot`` needs no extra job to find its values."""
    from .. import schema as S

    cats = [S.SYNTAX_ERROR, S.UNKNOWN_IDENTIFIER, S.TYPE_MISMATCH, S.TACTIC_FAILED, S.MISSING_PREMISE, S.OTHER]
    wide = lines.groupBy(*by).pivot("category", cats).agg(F.count(F.lit(1)))
    return wide.select(*by, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cats])
