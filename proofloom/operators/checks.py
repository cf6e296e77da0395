"""Row checks, quarantine, filters and previews (section 2.2).  All map-only
except the ordered limits, which use Spark's per-partition top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnOrName, _c, cut_with_ellipsis, py_strip
from ..session import free_column, scratch_path

MIN_STEP_CHARS = 5
ID_SEPARATORS = "_-."


def steps_error(steps: ColumnOrName) -> Column:
    """First violation of the step rules, or null: at least one step; no
    blank step; each stripped step at least 5 code points (1-based index)."""
    s = _c(steps)
    indexed = F.transform(s, lambda x, i: F.struct((i + 1).alias("i"), py_strip(x).alias("t")))
    bad = F.try_element_at(F.filter(indexed, lambda e: F.length(e["t"]) < MIN_STEP_CHARS), F.lit(1))
    msg = (
        F.when(bad["t"] == "", F.concat(F.lit("Step "), bad["i"].cast("string"), F.lit(" cannot be empty")))
        .otherwise(F.concat(F.lit("Step "), bad["i"].cast("string"), F.lit(" is too short: '"), bad["t"], F.lit("'")))
    )
    return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, F.lit("English proof must have at least one step")).when(
        bad.isNotNull(), msg
    )


def theorem_error(theorem: ColumnOrName) -> Column:
    t = py_strip(_c(theorem))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("Theorem cannot be empty")).when(
        ~(t.startswith("theorem ") | t.startswith("lemma ")),
        F.lit("Theorem must start with 'theorem' or 'lemma'"),
    )


def id_error(item_id: ColumnOrName) -> Column:
    """Non-empty and alphanumeric once '_', '-' and '.' are removed (an id of
    separators only is invalid)."""
    i = _c(item_id)
    stripped = F.translate(i, ID_SEPARATORS, "")
    return F.when(F.coalesce(i, F.lit("")) == "", F.lit("ID cannot be empty")).when(
        ~stripped.rlike(r"^[\p{L}\p{N}]+\z"), F.concat(F.lit("Invalid ID format: '"), i, F.lit("'"))
    )


def violations(item_id: ColumnOrName, steps: ColumnOrName, theorem: ColumnOrName) -> Column:
    """All violations of an item (ARRAY<STRING>, empty when valid)."""
    return F.filter(
        F.array(steps_error(steps), theorem_error(theorem), id_error(item_id)), lambda v: v.isNotNull()
    )


def with_violations(items: DataFrame, id_col: str = "id", steps: str = "steps", theorem: str = "theorem") -> DataFrame:
    """``items`` with ``violations`` (empty when valid): one pass."""
    return items.withColumn("violations", violations(id_col, steps, theorem))


def quarantine(items: DataFrame, id_col: str = "id", steps: str = "steps", theorem: str = "theorem") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows carry ``violations``.  The checks
    run once, when this is called: the tagged rows are written by outcome, and
    each frame reads its own folder."""
    spark = items.sparkSession
    kept = free_column(items, "_accepted")
    path = scratch_path(spark, "quarantine")
    tagged = with_violations(items, id_col, steps, theorem)
    tagged.withColumn(kept, F.size("violations") == 0).write.partitionBy(kept).parquet(path)
    back = spark.read.schema(tagged.schema.add(kept, "boolean")).parquet(path)
    return back.where(F.col(kept)).drop(kept, "violations"), back.where(~F.col(kept)).drop(kept)


def filter_topic(items: DataFrame, topic: str, col: str = "topic") -> DataFrame:
    """Exact topic match; pushed down to the parquet scan as a predicate."""
    return items.where(F.col(col) == F.lit(topic))


def distinct_topics(items: DataFrame, col: str = "topic") -> DataFrame:
    return items.select(F.col(col).alias("topic")).distinct()


def limit_first_n(items: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """First ``n`` rows in ``seq`` order (TakeOrderedAndProject: per-partition
    top-n, then a merge of n rows per partition)."""
    return items.orderBy(seq).limit(n)


def sample_preview(items: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Preview of the first ``n`` items: theorem cut at 80 characters."""
    return limit_first_n(items, n, seq).select(
        "id", "topic", "statement",
        cut_with_ellipsis(F.col("theorem"), 80).alias("theorem_preview"),
        F.when(F.size("imports") > 0, F.array_join("imports", ", ")).alias("imports"),
    )


def item_struct(df: DataFrame) -> Column:
    """Nested item record (id, topic, english{statement, steps}, lean{imports,
    theorem}) from either nested (``english``/``lean``) or flat columns."""
    if "english" in df.columns and "lean" in df.columns:
        english, imports, theorem = F.col("english"), F.col("lean.imports"), F.col("lean.theorem")
    else:
        english = F.struct(F.col("statement"), F.col("steps"))
        imports = F.col("imports") if "imports" in df.columns else F.lit(None)
        theorem = F.col("theorem")
    return F.struct(
        F.col("id"),
        F.col("topic"),
        english.alias("english"),
        F.struct(F.coalesce(imports, F.array().cast("array<string>")).alias("imports"), theorem.alias("theorem")).alias("lean"),
    )


def item_dump(df: DataFrame) -> DataFrame:
    """Compact JSON per item; null fields are omitted by ``to_json``."""
    return df.select("id", F.to_json(item_struct(df)).alias("json"))
