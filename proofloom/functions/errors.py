"""Column functions that classify checker output (stderr) into the error
taxonomy.  Everything is a native expression over arrays of lines, so the
classification of a record needs no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .text import ColumnOrName, _c, py_strip

LINE_NUMBER = r":([0-9]+):[0-9]+:"
QUOTED_NAME = r"'([^']+)'"


def line_number(line: ColumnOrName) -> Column:
    """First ``:<line>:<col>:`` of a line as INT, else null."""
    c = _c(line)
    return F.when(c.rlike(LINE_NUMBER), F.regexp_extract(c, LINE_NUMBER, 1).try_cast("int"))


def _alternations() -> list[tuple[str, str]]:
    """(category, one pattern) per run of patterns of one category, in order:
    the first run with a match is the run of the first pattern that matches."""
    runs: list[tuple[str, list[str]]] = []
    for category, pattern in S.ERROR_PATTERNS:
        if not runs or runs[-1][0] != category:
            runs.append((category, []))
        runs[-1][1].append(pattern)
    return [(category, "|".join(f"(?:{p})" for p in patterns)) for category, patterns in runs]


def classify_line(line: ColumnOrName) -> Column:
    """Category of the first pattern (in pattern order) that matches; ``.``
    stops at a line feed only.  Patterns of one category stand together, so a
    line is matched once per category."""
    c = _c(line)
    expr = None
    for category, pattern in _alternations():
        expr = (F.when if expr is None else expr.when)(c.rlike("(?d)" + pattern), F.lit(category))
    return expr.otherwise(F.lit(S.OTHER))


def priority(category: ColumnOrName) -> Column:
    """0 for the category fixed first (syntax) ... 5 for ``other``."""
    c = _c(category)
    expr = None
    for rank, cat in enumerate(S.PRIORITY):
        expr = (F.when if expr is None else expr.when)(c == cat, F.lit(rank))
    return expr.otherwise(F.lit(len(S.PRIORITY)))


def quoted_name(message: ColumnOrName) -> Column:
    """First single-quoted name in a message, or null."""
    m = _c(message)
    return F.when(m.rlike(QUOTED_NAME), F.regexp_extract(m, QUOTED_NAME, 1))


def fix_suggestions(category: ColumnOrName, message: ColumnOrName) -> Column:
    """ARRAY<STRING> of suggested fixes for a classified line."""
    cat = _c(category)
    ident = quoted_name(message)

    def lits(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    with_ident = F.array(
        *[
            F.concat(F.lit(t.split("{identifier}")[0]), ident, F.lit(t.split("{identifier}")[1]))
            for t in S.FIXES_WITH_IDENTIFIER
        ]
    )
    expr = F.when(
        cat == S.UNKNOWN_IDENTIFIER,
        F.when(ident.isNotNull(), with_ident).otherwise(lits(S.FIXES_NO_IDENTIFIER)),
    )
    for name, values in S.FIXES.items():
        expr = expr.when(cat == name, lits(values))
    return expr.otherwise(lits([]))


def stderr_lines(stderr: ColumnOrName) -> Column:
    """Non-blank stripped lines of a stderr, in order (ARRAY<STRING>)."""
    return F.filter(
        F.transform(F.split(F.coalesce(_c(stderr), F.lit("")), "\n", -1), py_strip),
        lambda ln: ln != "",
    )


def _error_struct(line: Column, category: Column, stderr: Column) -> Column:
    return F.struct(
        category.alias("category"),
        line.alias("message"),
        line_number(line).alias("line_number"),
        F.lit(S.SEVERITY_ERROR).alias("severity"),
        fix_suggestions(category, line).alias("suggested_fixes"),
        stderr.alias("original_stderr"),
    )


# The DataFrame-level forms below compute in stages (lines, then categories,
# then structs) so that each line is matched against the pattern list once:
# Catalyst keeps a projection separate when merging it would duplicate an
# expensive expression, and each stage references the previous one's column.


def with_error_arrays(df: DataFrame, stderr: str = "stderr", prefix: str = "_e") -> DataFrame:
    """Adds ``<prefix>_lines`` and ``<prefix>_cats`` (aligned arrays)."""
    lines = f"{prefix}_lines"
    return df.withColumn(lines, stderr_lines(F.col(stderr))).withColumn(
        f"{prefix}_cats", F.transform(F.col(lines), classify_line)
    )


def with_classified(df: DataFrame, stderr: str = "stderr", out: str = "errors") -> DataFrame:
    """Adds ``out``: ARRAY<LEAN_ERROR> with one struct per non-blank line."""
    staged = with_error_arrays(df, stderr)
    zipped = F.arrays_zip(F.col("_e_lines").alias("line"), F.col("_e_cats").alias("category"))
    return staged.withColumn(
        out, F.transform(zipped, lambda z: _error_struct(z["line"], z["category"], F.col(stderr)))
    ).drop("_e_lines", "_e_cats")


def with_primary_error(df: DataFrame, stderr: str = "stderr", out: str = "primary_error") -> DataFrame:
    """Adds ``out``: the first error of the most important category (null
    for a blank stderr)."""
    staged = with_error_arrays(df, stderr)
    keyed = F.transform(
        F.arrays_zip(F.col("_e_lines").alias("line"), F.col("_e_cats").alias("category")),
        lambda z, i: F.struct(
            priority(z["category"]).alias("prio"), i.alias("pos"), z["line"].alias("line"),
            z["category"].alias("category"),
        ),
    )
    best = staged.withColumn("_e_best", F.array_min(keyed))
    b = F.col("_e_best")
    return best.withColumn(
        out, F.when(b.isNotNull(), _error_struct(b["line"], b["category"], F.col(stderr)))
    ).drop("_e_lines", "_e_cats", "_e_best")


def classify_stderr(stderr: ColumnOrName) -> Column:
    """Column form of ``with_classified`` (evaluates the patterns more than
    once per line; prefer the DataFrame form on large inputs)."""
    s = _c(stderr)
    return F.transform(stderr_lines(s), lambda ln: _error_struct(ln, classify_line(ln), s))
