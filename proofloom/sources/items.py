"""JSONL item sources (section 2.1).

* ``scan_items``     -- typed read with the declared schema (never inferred).
* ``scan_numbered``  -- one row per physical line with its 1-based number, in
                        its file or in the file that a folder's parts make up.
* ``scan_checked``   -- numbered lines parsed as VARIANT with strict type
                        and rule checks: each line gets its ``reasons``.
* ``scan_strict``    -- fail fast with the first bad line's number.
* ``scan_corrupt``   -- the rejected lines with reasons (tolerant twin).
* ``scan_union_files`` -- several files in one read, tagged by file.

Line numbers without a window over a whole file: the text source splits a
file into blocks; per (file, block) we count lines and take the minimum row
id (a small written table, one row per block: the line-offset index), and
number rows inside their block from ``monotonically_increasing_id``, which is
contiguous inside a partition.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.checks import violations
from ..operators.stages import where_computed
from ..session import scratch_path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm  # noqa: SLF001 -- Hadoop FileSystem handles every scheme
    if jvm is None:  # Spark Connect: let the read itself fail
        return True
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return bool(fs.exists(hpath)) or bool(fs.globStatus(hpath))


def require_path(spark: SparkSession, path: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(f"Dataset file not found: {path}")


def _normalize_items(df: DataFrame) -> DataFrame:
    """A missing ``imports`` key means an empty list."""
    return df.withColumn(
        "lean",
        F.struct(
            F.coalesce(F.col("lean.imports"), F.array().cast("array<string>")).alias("imports"),
            F.col("lean.theorem").alias("theorem"),
        ),
    )


def scan_items(spark: SparkSession, path: str) -> DataFrame:
    """Typed items (blank lines are skipped by the JSON source).  Malformed
    JSON aborts the read; use ``scan_strict`` for line numbers and the full
    rule check."""
    require_path(spark, path)
    df = spark.read.schema(S.ITEM).option("mode", "FAILFAST").json(path)
    return _normalize_items(df)


def _raw_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    name, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.text(path).select(
        (F.regexp_extract(name, "(?s)^(.*)/", 1) if parts else name).alias("file"),
        (F.struct(name.alias("part"), start.alias("start")) if parts else start).alias("_block"),
        F.monotonically_increasing_id().alias("_rid"),
        "value",
    )


def _block_index(raw: DataFrame, *extra: Column) -> DataFrame:
    """The line-offset index, written: one row per file block with ``_rid0``
    (its first row id), ``_before`` (lines of the file before it) and what
    ``extra`` aggregates over its lines.  One pass over the files."""
    blocks = raw.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_rid0"), *extra)
    # one row per file block: a bounded window
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    path = scratch_path(raw.sparkSession, "line-index")
    index.write.parquet(path)
    return raw.sparkSession.read.schema(index.schema).parquet(path)


def _numbered(raw: DataFrame, index: DataFrame) -> DataFrame:
    """``file, line_number, value`` of every line: its block's offset plus its
    place in the block.  The index is a table of known size, so Spark's own
    threshold decides whether it is broadcast."""
    place = F.col("_before") + (F.col("_rid") - F.col("_rid0")) + 1
    return raw.join(index.select("file", "_block", "_rid0", "_before"), ["file", "_block"]).select("file", place.alias("line_number"), "value")


def scan_numbered(spark: SparkSession, path: str, *, parts: bool = False) -> DataFrame:
    """``file, line_number, value``: every physical line (blank ones too).  The
    files are read twice: for the index when this is called, and for the rows.

    With ``parts`` the files of a folder, in the order of their names, are one
    file, named by the folder: the numbers run on from part to part, so that no
    task need write or hold a whole file."""
    require_path(spark, path)
    raw = _raw_lines(spark, path, parts)
    return _numbered(raw, _block_index(raw))


def _type_reasons(v: Column) -> list[Column]:
    """Strict types through VARIANT: Spark's JSON reader would coerce
    ``{"id": 5}`` to ``'5'``; the item model does not."""

    def typ(path: str) -> Column:
        return F.schema_of_variant(F.variant_get(v, path, "variant"))

    def need_string(path: str, name: str) -> Column:
        return F.when(F.coalesce(typ(path), F.lit("MISSING")) != "STRING", F.lit(f"{name}: expected a string"))

    imports_t = typ("$.lean.imports")
    steps_t = typ("$.english.steps")
    # an empty list is typed ARRAY<VOID>; emptiness is a rule check, not a type error
    lists = ["ARRAY<STRING>", "ARRAY<VOID>"]
    return [
        need_string("$.id", "id"),
        need_string("$.topic", "topic"),
        need_string("$.english.statement", "english.statement"),
        F.when(~F.coalesce(steps_t, F.lit("MISSING")).isin(lists), F.lit("english.steps: expected a list of strings")),
        need_string("$.lean.theorem", "lean.theorem"),
        # a missing key gives [], an explicit null or a mixed list is an error
        F.when(imports_t.isNotNull() & ~imports_t.isin(lists), F.lit("lean.imports: expected a list of strings")),
    ]


def _blank() -> Column:
    return F.btrim(F.col("value"), F.lit(S.WS_CHARS)) == ""


def _checked(lines: DataFrame) -> DataFrame:
    """Lines with the typed item and ``reasons``, one parse each: the VARIANT
    serves the type checks and is then cast to the item."""
    parsed = lines.withColumn("_v", F.try_parse_json(F.col("value")))
    typed = parsed.withColumn("_item", F.try_variant_get(F.col("_v"), "$", S.ITEM.simpleString()))
    v = F.col("_v")
    type_errs = F.when(v.isNull(), F.array(F.lit("Invalid JSON"))).otherwise(
        F.filter(F.array(*_type_reasons(v)), lambda x: x.isNotNull())
    )
    item = F.col("_item")
    rules = violations(item["id"], item["english"]["steps"], item["lean"]["theorem"])
    reasons = F.when(F.size(type_errs) > 0, type_errs).otherwise(rules)
    out = typed.select(
        *[c for c in lines.columns],
        item["id"].alias("id"), item["topic"].alias("topic"), item["english"].alias("english"),
        item["lean"].alias("lean"), reasons.alias("reasons"),
    )
    return _normalize_items(out)


def scan_checked(spark: SparkSession, path: str) -> DataFrame:
    """Numbered non-blank lines with the typed item and ``reasons`` (empty
    when the line is a valid item)."""
    return _checked(scan_numbered(spark, path).where(~_blank()))


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """Typed items; raises ``ValueError("Invalid JSON on line N: ...")`` for
    the first bad line (per file order).

    The files are read twice.  The first pass checks every line and leaves one
    row per file block: its lines and the row id and reasons of its first bad
    one; the least of those, numbered, is the only row that comes back.  The
    second pass reads the items, all of them good."""
    require_path(spark, path)
    raw = _raw_lines(spark, path)
    reasons = F.when(~_blank() & (F.size("reasons") > 0), F.col("reasons"))
    checked = _checked(raw).select("file", "_block", "_rid", reasons.alias("_reasons"))
    place = F.when(F.col("_reasons").isNotNull(), F.col("_rid"))
    index = _block_index(checked, F.min(place).alias("_bad"), F.min_by("_reasons", place).alias("_reasons"))
    line = F.col("_before") + (F.col("_bad") - F.col("_rid0")) + 1
    row = index.where("_bad IS NOT NULL").select("file", line.alias("line_number"), "_reasons").orderBy("file", "line_number").first()
    if row:
        name = os.path.basename(row["file"])
        raise ValueError(f"Invalid JSON on line {row['line_number']} of {name}: {'; '.join(row['_reasons'])}")
    return _checked(_numbered(raw, index).where(~_blank())).select("id", "topic", "english", "lean", "file", "line_number")


def scan_corrupt(spark: SparkSession, path: str) -> DataFrame:
    """The lines a strict load would reject, with all reasons."""
    return where_computed(scan_checked(spark, path), F.size("reasons") > 0).select(
        "file", "line_number", "value", "id", "reasons"
    )


def scan_union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several item files in one read, tagged with the file name (``file``)
    and the requested path it was read for (``path``)."""
    for p in paths:
        require_path(spark, p)
    df = spark.read.schema(S.ITEM).option("mode", "FAILFAST").json(paths)
    read = F.col("_metadata.file_path")
    # The longest requested path that the file lies at or below.
    tags = [
        F.when(read.endswith(p.rstrip("/")) | read.contains(p.rstrip("/") + "/"), F.lit(p))
        for p in sorted(set(paths), key=len, reverse=True)
    ]
    return _normalize_items(df.withColumn("file", F.col("_metadata.file_name")).withColumn("path", F.coalesce(*tags)))
