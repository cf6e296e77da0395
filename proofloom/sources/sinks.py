"""Sinks (section 2.1): JSONL items, per-split outputs and reports.

A report is one JSON document in part files: the parts, joined in the order of
their names, are the document, and no task or driver holds more of it than its
own part.  The parts appear together when the write is committed, so a failed
task leaves no half document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checks import item_struct
from ..operators.numbering import numbered
from ..operators.profile import repeated, summary, topics, verification_summary
from ..operators.reports import CHUNK, item_fields, item_text, nested_items
from ..session import written


def items_as_json(df: DataFrame) -> DataFrame:
    """``value`` = compact JSON of the nested item; null fields omitted,
    non-ASCII kept as is."""
    return df.select(F.to_json(item_struct(df)).alias("value"))


def sink_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite", compression: str = "none") -> None:
    """Items as JSON lines (the writer creates parent folders)."""
    items_as_json(df).write.mode(mode).option("compression", compression).text(path)


def sink_rows_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Any frame as JSON lines (nested columns kept)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def sink_splits(tagged: DataFrame, out_dir: str, *, mode: str = "overwrite") -> None:
    """One output folder per split (``split=train`` ...), written in one pass."""
    body = tagged.select(F.col("split"), F.to_json(item_struct(tagged)).alias("value"))
    body.write.mode(mode).partitionBy("split").text(out_dir)


def sink_document(parts: Sequence[str | DataFrame], path: str, *, mode: str = "overwrite") -> None:
    """One JSON document from ``parts``, in order: a text; a frame with one
    ``text``; or a list's elements as a frame (n, text) or (n, chunk, text),
    where n counts the elements from 0 (a comma goes before each but the first)
    and chunk the pieces of an element.  The lines are written before they are
    dealt out by ranges: the ranges' bounds and the rows come from the same
    files, and no part is made twice."""
    spark = next(p.sparkSession for p in parts if isinstance(p, DataFrame))
    lines = []
    for i, part in enumerate(parts):
        if isinstance(part, str):
            part = spark.range(1).select(F.lit(part).alias("text"))
        chunk = F.col("chunk").cast("long") if "chunk" in part.columns else F.lit(0).cast("long")
        n = F.col("n").cast("long") if "n" in part.columns else F.lit(0).cast("long")
        comma = F.when((n > 0) & (chunk == 0), ",").otherwise("")
        lines.append(part.select(F.lit(i).alias("part"), n.alias("n"), chunk.alias("chunk"), F.concat(comma, F.col("text")).alias("value")))
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "n", "chunk"]
    every = written(every, "document-lines")
    every.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)


def elements(df: DataFrame, order: Sequence[str], text: Column) -> DataFrame:
    """(n, text): the rows of ``df`` as list elements in the given order."""
    lines = df.select(*[F.col(c).alias(f"by{i}") for i, c in enumerate(order)], text.alias("text"))
    return numbered(written(lines, "elements"), [F.col(f"by{i}") for i in range(len(order))], "n").select("n", "text")


def _open(fields: Column, rest: str) -> Column:
    """The JSON object of ``fields``, left open and followed by ``rest``."""
    head = F.to_json(fields, {"ignoreNullFields": "false"})
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(rest)).alias("text")


def sink_report(head: DataFrame, items: DataFrame, errors: DataFrame, records: DataFrame, pass_k: Sequence[int], path: str, *, chunk: int = CHUNK, mode: str = "overwrite") -> None:
    """The evaluation report as one document: the fields of ``head`` (one row:
    dataset_path, metrics, pass_k, config), then ``items``: one row per item
    (evaluation and final_code), nested with its errors and candidate records
    in the order of the ids.  ``items`` and ``records`` are read several times:
    give written tables."""
    placed = numbered(items, [F.col("item_id")], "n")
    rows = nested_items(placed, errors, records, chunk)
    body = rows.select("n", "chunk", item_text(item_fields(pass_k), chunk).alias("text"))
    sink_document([head.select(_open(F.struct(*head.columns), ',"items":[')), body, "]}"], path, mode=mode)


def sink_validation_report(found: DataFrame, copies: DataFrame, checked: DataFrame | None, path: str, *, mode: str = "overwrite") -> None:
    """The validation report as one document: total_items, topics, duplicates
    (both lists and the counts) and, given ``checked`` (id, ok, stderr and the
    order ``seq``), compilation with the result of every item.  ``found`` are
    the ``findings`` of the data set and ``copies`` its items of repeated
    content (id, and the order ``seq``)."""
    told = summary(found)
    json = lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    value = lambda c: F.regexp_extract(json(c), r"(?s)^\{\"v\":(.*)\}$", 1)
    name = F.coalesce(value("topic"), F.lit("null"))
    topic = F.concat(F.when(name == "null", F.lit('"null"')).otherwise(name), F.lit(":"), F.col("n").cast("string"))
    ids = repeated(found, "id").select("key")
    parts: list[str | DataFrame] = [
        told.select(_open(F.struct("total_items"), ',"topics":{')),
        elements(topics(found), ["topic"], topic),
        '},"duplicates":{"duplicate_ids":[',
        elements(ids, ["key"], value("key")),
        '],"duplicate_lean_items":[',
        elements(copies.select("id", "seq"), ["seq"], value("id")),
        told.select(F.concat(F.lit("],"), F.substring(F.to_json(F.struct("total_items", "unique_ids")), F.lit(2), F.lit(1 << 20))).alias("text")),
    ]
    if checked is not None:
        parts += [
            verification_summary(checked).select(F.concat(F.lit(',"compilation":'), _open(F.struct("total_checked", "successful", "failed", "success_rate"), ',"results":[')).alias("text")),
            elements(checked.select("id", "ok", "stderr", "seq"), ["seq"], F.to_json(F.struct("id", "ok", "stderr"), {"ignoreNullFields": "false"})),
            "]}",
        ]
    sink_document([*parts, "}"], path, mode=mode)
