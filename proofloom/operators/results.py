"""Per-item results from a candidate-record table (section 2.8).

A record table has one row per candidate: ``item_id, attempt, beam_index,
seq, compiled, compile_ok, generation_time, code`` (+ optional ``is_valid,
errors, compile_stderr``).  Record order is ``(attempt, beam_index, seq)``.

A record without an item id or attempt number belongs to no run of an item and
has no part in first successes and evaluations.

Plan shape used throughout: one partial/final aggregate per (item, attempt)
gives its records, its time and its least passing key.  These small rows tell
the attempt that decides an item; all attempts before it count as a whole, and
only the records of the deciding attempt are looked at again.  No window or
group spans the records of an item, so a hot item never lands whole in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.text import code_length
from ..session import free_column

ORDER = ("attempt", "beam_index", "seq")


def passed() -> Column:
    return F.coalesce(F.col("compiled") & F.col("compile_ok"), F.lit(False))


def sort_records(records: DataFrame) -> DataFrame:
    """Stable record order: attempt, beam index, arrival (``seq``)."""
    return records.orderBy("item_id", *ORDER)


def first_success(records: DataFrame, item: str = "item_id") -> DataFrame:
    """``(item, first_ok)``: key of the first passing record, items with one only."""
    ok = attempt_outcomes(records, item).where(F.col("ok").isNotNull() & (F.col("attempt") == F.col("success_attempt")))
    return ok.select(item, _first_ok().alias("first_ok"))


def _first_ok() -> Column:
    return F.struct(F.col("attempt").alias("attempt"), F.col("ok.beam_index").alias("beam_index"), F.col("ok.seq").alias("seq"))


def _per_attempt(records: DataFrame, item: str) -> DataFrame:
    return _placed(records, item).groupBy(item, "attempt").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("generation_time").alias("time"),
        F.min(F.when(passed(), F.struct("beam_index", "seq"))).alias("ok"),
    )


def attempt_outcomes(records: DataFrame, item: str = "item_id") -> DataFrame:
    """One row per (item, attempt) that a run with a stop at the first success
    makes: n, time, ok (beam_index and seq of its first passing record, or
    null) and the item's success_attempt (null when nothing passed).

    The window spans the attempts of one item, one row each."""
    per = _per_attempt(records, item)
    decided = F.min(F.when(F.col("ok").isNotNull(), F.col("attempt"))).over(Window.partitionBy(item))
    per = per.withColumn("success_attempt", decided)
    return per.where(F.col("success_attempt").isNull() | (F.col("attempt") <= F.col("success_attempt")))


def stop_at_first_success(records: DataFrame, item: str = "item_id") -> DataFrame:
    """Drop every record after an item's first passing record.

    Adds ``first_ok`` (null for items that never pass).  Records meet the
    outcome of their own attempt, so a hot item is spread by attempt."""
    decides = F.col("attempt") == F.col("success_attempt")
    first = F.max(F.when(decides, _first_ok())).over(Window.partitionBy(item))
    told = attempt_outcomes(records, item).select(
        F.col(item).alias("_item"), F.col("attempt").alias("_attempt"), F.when(decides, F.col("ok")).alias("_last"), first.alias("_first")
    )
    return _kept(records, told, item).select(*[records[c] for c in records.columns], F.col("_first").alias("first_ok"))


def _placed(records: DataFrame, item: str) -> DataFrame:
    return records.where(F.col(item).isNotNull() & F.col("attempt").isNotNull())


def _kept(records: DataFrame, told: DataFrame, item: str) -> DataFrame:
    """Records of the told attempts, up to the attempt's last one."""
    j = _placed(records, item).join(told, (F.col(item) == F.col("_item")) & (F.col("attempt") == F.col("_attempt")))
    return j.where(F.col("_last").isNull() | (F.struct("beam_index", "seq") <= F.col("_last")))


def success_metadata(records: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item: 1-based rank of the first passing record in record order and
    its attempt; null for both when nothing passed."""
    return _outcomes(records, item).select(item, "success_rank", "success_attempt")


def _outcomes(records: DataFrame, item: str) -> DataFrame:
    """(item, success_rank, success_attempt, total_time, candidate_total): the
    attempts before the deciding one as they are, and the deciding one's
    records up to the first passing one.  Where nothing passed, the last attempt
    stands for the deciding one and counts whole, so every item is joined."""
    records = records.select(item, *ORDER, "compiled", "compile_ok", "generation_time")
    of_item = Window.partitionBy(item)  # a row per attempt
    won = F.min(F.when(F.col("ok").isNotNull(), F.col("attempt"))).over(of_item)
    per = _per_attempt(records, item).withColumn("success_attempt", won)
    per = per.withColumn("last", F.coalesce("success_attempt", F.max("attempt").over(of_item)))
    earlier, decides = F.col("attempt") < F.col("last"), F.col("attempt") == F.col("last")
    told = per.groupBy(F.col(item).alias("_item"), F.col("last").alias("_attempt")).agg(
        F.max(F.when(decides, F.col("ok"))).alias("_last"),
        F.sum(F.when(earlier, F.col("n"))).alias("_n"),
        F.sum(F.when(earlier, F.col("time"))).alias("_time"),
    )
    # Both readings of the records need the same columns, so that Spark shuffles
    # them once: the second confirms the success it counts up to.
    kept = _kept(records, told, item).groupBy(item).agg(
        (F.count(F.lit(1)) + F.coalesce(F.max("_n"), F.lit(0))).alias("candidate_total"),
        F.sum("generation_time").alias("_t"),
        F.max("_time").alias("_b"),
        F.max(F.when(passed(), F.col("attempt"))).cast("int").alias("success_attempt"),
    )
    time = F.when(F.col("_t").isNotNull() | F.col("_b").isNotNull(), F.coalesce("_t", F.lit(0)) + F.coalesce("_b", F.lit(0))).cast("double")
    rank = F.when(F.col("success_attempt").isNotNull(), F.col("candidate_total")).cast("int")
    return kept.select(item, rank.alias("success_rank"), "success_attempt", time.alias("total_time"), "candidate_total")


def final_code(records: DataFrame, item: str = "item_id") -> DataFrame:
    """Code of the first passing record with non-empty code (null when none)."""
    ok = passed() & (F.coalesce(F.col("code"), F.lit("")) != "")
    return records.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.min(F.when(ok, F.struct(*[F.col(c) for c in ORDER], F.col("code")))).getField("code").alias("final_code")
    )


def pass_flags(success_attempt: Column, pass_k: Sequence[int]) -> list[Column]:
    """``pass_at_<k>`` booleans: succeeded within k attempts."""
    return [F.coalesce(success_attempt <= k, F.lit(False)).alias(f"pass_at_{k}") for k in pass_k]


def pass_map(success_attempt: Column, pass_k: Sequence[int]) -> Column:
    """``MAP<INT, BOOLEAN>`` form of the pass flags."""
    ks = F.array(*[F.lit(int(k)) for k in pass_k])
    return F.map_from_arrays(ks, F.transform(ks, lambda k: F.coalesce(success_attempt <= k, F.lit(False))))


def normalize_pass_k(pass_k: Sequence[int]) -> tuple[int, ...]:
    ks = tuple(sorted(dict.fromkeys(int(k) for k in pass_k)))
    if not ks:
        raise ValueError("pass_k must not be empty")
    if any(k <= 0 for k in ks):
        raise ValueError("All pass@K values must be positive integers")
    return ks


def item_evaluation(
    records: DataFrame,
    items: DataFrame | None = None,
    *,
    max_attempts: int = S.DEFAULT_MAX_ATTEMPTS,
    pass_k: Sequence[int] = S.DEFAULT_PASS_K,
    item: str = "item_id",
) -> DataFrame:
    """One row per item: success, success_rank, success_attempt, attempts,
    total_time, candidate_total and ``pass_at_<k>`` flags.

    Records after the first success are dropped first (they cannot exist in a
    real run).  ``total_time`` is the sum of the kept records' stage times:
    the wall time of one item has no meaning inside a bulk round.  ``items``
    (a frame with an ``item`` column) keeps items that have no record.
    """
    ks = normalize_pass_k(pass_k)
    per_item = _outcomes(records, item).withColumn("success", F.col("success_attempt").isNotNull())
    if items is not None:
        per_item = items.select(item).join(per_item, on=item, how="left").select(
            item,
            F.coalesce(F.col("success"), F.lit(False)).alias("success"),
            "success_rank",
            "success_attempt",
            F.coalesce(F.col("total_time"), F.lit(0.0)).alias("total_time"),
            F.coalesce(F.col("candidate_total"), F.lit(0)).alias("candidate_total"),
        )
    att = F.col("success_attempt")
    return per_item.select(
        item,
        "success",
        "success_rank",
        "success_attempt",
        F.coalesce(att, F.lit(int(max_attempts))).cast("int").alias("attempts"),
        "total_time",
        "candidate_total",
        *pass_flags(att, ks),
    )


def record_report(records: DataFrame) -> DataFrame:
    """Record fields for export; ``compile_ok`` null when not checked."""
    cols = [
        "item_id", "attempt", "beam_index", "compiled",
        F.when(F.col("compiled"), F.col("compile_ok")).alias("compile_ok"),
    ]
    for optional in ("compile_stderr", "is_valid"):
        if optional in records.columns:
            cols.append(optional)
    cols += ["generation_time", code_length(F.col("code")).alias("code_length")]
    if "errors" in records.columns:
        cols.append("errors")
    return records.select(*cols)


def generation_log(
    records: DataFrame,
    items: DataFrame,
    schedule: Column,
    item: str = "item_id",
    chunk: int = 256,
) -> DataFrame:
    """Per item and scheduled attempt: beam size, temperature and the
    attempt's candidates ordered by beam index; attempts without records
    appear with an empty list.

    ``schedule`` is the literal schedule column (``rounds.schedule_column``):
    each item row is expanded by ``inline`` -- a generator, not a join.  An
    attempt may hold more records than its beam size, so its list comes in
    chunks: one row (``chunk`` from 0) per ``chunk`` candidates.
    """
    entry_fields = [
        F.col("beam_index").alias("index"),
        *([F.col("is_valid")] if "is_valid" in records.columns else []),
        F.col("generation_time"),
        code_length(F.col("code")).alias("code_length"),
        *([F.col("errors")] if "errors" in records.columns else []),
        F.col("compiled"),
        F.when(F.col("compiled"), F.col("compile_ok")).alias("compile_ok"),
        *([F.col("compile_stderr")] if "compile_stderr" in records.columns else []),
    ]
    place = F.row_number().over(Window.partitionBy(item, "attempt").orderBy(*ORDER[1:]))
    entries = records.select(F.col(item).alias("_item"), F.col("attempt").alias("_attempt"), place.alias("_place"), F.struct(*entry_fields).alias("entry"))
    entry_type = entries.schema["entry"].dataType
    entries = entries.withColumn("_chunk", F.expr(f"(_place - 1) div {int(chunk)}"))
    lists = entries.groupBy("_item", "_attempt", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_place", "entry"))).alias("_c"))  # at most a chunk
    slots = items.select(item, F.inline(schedule)).select(item, "attempt", "beam_size", "temperature")
    empty = F.array().cast(T.ArrayType(entry_type))
    same = (F.col(item) == F.col("_item")) & (F.col("attempt") == F.col("_attempt"))
    return slots.join(lists, same, "left").select(
        item,
        "attempt",
        "beam_size",
        "temperature",
        F.coalesce("_chunk", F.lit(0)).cast("long").alias("chunk"),
        F.coalesce(F.transform("_c", lambda s: s["entry"]), empty).alias("candidates"),
    )


def record_rank(records: DataFrame, item: str = "item_id") -> DataFrame:
    """Adds ``record_rank``: 1-based position of each record in its item's
    record order (a null item or attempt counts as a value, first)."""
    return piece_rank(records, "record_rank", [item], ["attempt"], ORDER[1:])


def piece_rank(df: DataFrame, out: str, group: Sequence[str], piece: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``out``: 1-based place of each row in its group, by ``piece`` and
    then ``order``; nulls come first.  The place is the number of rows of
    earlier pieces, from one row per (group, piece), plus the place inside the
    piece: no window spans the rows of a group."""
    keys = [*group, *piece]
    of = {c: free_column(df, f"_of_{c}") for c in keys}
    n, place, before = (free_column(df, c) for c in ("_n", "_place", "_before"))
    earlier = Window.partitionBy(*[of[c] for c in group]).orderBy(*[of[c] for c in piece]).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*[F.col(c).alias(of[c]) for c in keys]).agg(F.count(F.lit(1)).alias(n))
    offsets = counts.select(*of.values(), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    placed = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # Rows without nulls join by plain equality: they keep the partitioning of
    # their window.  The others, if any, join null-safe.
    whole = None
    for c in keys:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()

    def joined(rows: DataFrame, equal) -> DataFrame:
        same = None
        for c in keys:
            same = equal(c) if same is None else same & equal(c)
        return rows.join(offsets, same).select(*[F.col(c) for c in df.columns if c != out], (F.col(before) + F.col(place)).cast("int").alias(out))

    return joined(placed.where(whole), lambda c: F.col(c) == F.col(of[c])).unionByName(
        joined(placed.where(~whole), lambda c: F.col(c).eqNullSafe(F.col(of[c])))
    )
