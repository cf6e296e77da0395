"""Nested reports (sections 2.8, 2.9): an item with its errors and candidate
records.

The lists of an item are as long as its run, so they are nested in chunks: the
entries of an item (errors first, then records) are numbered, and every
``chunk`` of them make one row.  An item of fewer entries is one row, and no
row, task or list holds more than a chunk, however hot the item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_length
from ..session import free_column, written
from .results import pass_map, piece_rank

CHUNK = 256
ERROR_TYPE = "struct<category: string, message: string, line_number: int, severity: string, suggested_fixes: array<string>>"
RECORD_TYPE = (
    "struct<attempt: int, beam_index: int, compiled: boolean, compile_ok: boolean, compile_stderr: string, "
    "is_valid: boolean, generation_time: double, code_length: int, errors: array<string>>"
)
KEYS = ("attempt", "beam_index", "seq")


def _error() -> Column:
    e = F.col("primary_error")
    return F.struct(e["category"], e["message"], e["line_number"], e["severity"], e["suggested_fixes"]).cast(ERROR_TYPE)


def _record(records: DataFrame) -> Column:
    """Record fields for export; ``compile_ok`` null when not checked, and null
    for what the records do not have."""
    known = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    return F.struct(
        "attempt", "beam_index", "compiled", F.when(F.col("compiled"), F.col("compile_ok")), known("compile_stderr", "string"),
        known("is_valid", "boolean"), F.col("generation_time").cast("double"), code_length(F.col("code")), known("errors", "array<string>"),
    ).cast(RECORD_TYPE)


def nested_items(items: DataFrame, errors: DataFrame, records: DataFrame, chunk: int = CHUNK, item: str = "item_id") -> DataFrame:
    """The rows of ``items`` (one per item) with chunk, chunks, n_errors (of the
    item), errors and candidate_records: one row per started ``chunk`` of the
    item's entries, one row with empty lists for an item without any.

    ``errors`` is (item, attempt, beam_index, seq, primary_error), ``records``
    the candidate records; entries of other items, or of none, are left out.
    The entries are written when this is called: they are counted by piece,
    placed and joined from the same files."""
    none = lambda kind: F.lit(None).cast(kind)
    e = errors.select(item, F.lit(0).alias("kind"), *KEYS, _error().alias("error"), none(RECORD_TYPE).alias("record"))
    r = records.select(item, F.lit(1).alias("kind"), *KEYS, none(ERROR_TYPE).alias("error"), _record(records).alias("record"))
    entries = written(e.unionByName(r).where(F.col(item).isNotNull()), "report-entries")
    placed = piece_rank(entries, "place", [item], ["kind", "attempt"], ["beam_index", "seq"])
    placed = placed.withColumn("chunk", F.expr(f"(place - 1) div {int(chunk)}"))
    listed = F.array_sort(F.collect_list(F.struct("place", "kind", "error", "record")))  # at most a chunk
    of, at, errs, recs, many, total = (free_column(items, c) for c in ("_item", "_chunk", "_errors", "_records", "_chunks", "_total"))
    rows = placed.groupBy(F.col(item).alias(of), F.col("chunk").alias(at)).agg(listed.alias("all"))
    rows = rows.select(
        of, at,
        F.transform(F.filter("all", lambda x: x["kind"] == 0), lambda x: x["error"]).alias(errs),
        F.transform(F.filter("all", lambda x: x["kind"] == 1), lambda x: x["record"]).alias(recs),
    )
    whole = Window.partitionBy(of)  # a row per chunk
    rows = rows.withColumn(many, F.max(at).over(whole) + 1).withColumn(total, F.sum(F.size(errs)).over(whole))
    made = ("chunk", "chunks", "n_errors", "errors", "candidate_records")
    return items.join(rows, F.col(item) == F.col(of), "left").select(
        *[items[c] for c in items.columns if c not in made],
        F.coalesce(at, F.lit(0)).cast("long").alias("chunk"),
        F.coalesce(many, F.lit(1)).cast("long").alias("chunks"),
        F.coalesce(total, F.lit(0)).cast("long").alias("n_errors"),
        F.coalesce(errs, F.array().cast(f"array<{ERROR_TYPE}>")).alias("errors"),
        F.coalesce(recs, F.array().cast(f"array<{RECORD_TYPE}>")).alias("candidate_records"),
    )


def item_fields(pass_k: Sequence[int], item: str = "item_id") -> Column:
    """The fields of an item report ahead of its lists."""
    return F.struct(
        F.col(item).alias("id"), "success", "success_rank", "success_attempt", "attempts", "total_time",
        pass_map(F.col("success_attempt"), pass_k).alias("pass_at_k"), "final_code",
    )


KEEP_NULLS = {"ignoreNullFields": "false"}


def item_text(fields: Column, chunk: int = CHUNK) -> Column:
    """The JSON text of a row of ``nested_items`` (made with this ``chunk``):
    the rows of an item, joined in order, are its report."""
    at = F.col("chunk")
    turn = F.least(F.expr(f"n_errors div {int(chunk)}"), F.col("chunks") - 1)  # where the records begin
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.to_json(x, KEEP_NULLS)), ",")
    comma = lambda c, more: F.when(more & (F.size(c) > 0), ",").otherwise("")
    head = F.to_json(fields, KEEP_NULLS)
    return F.concat(
        F.when(at == 0, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"errors":['))).otherwise(""),
        comma("errors", at > 0), lines("errors"),
        F.when(at == turn, '],"candidate_records":[').otherwise(""),
        comma("candidate_records", at > turn), lines("candidate_records"),
        F.when(at == F.col("chunks") - 1, "]}").otherwise(""),
    )
