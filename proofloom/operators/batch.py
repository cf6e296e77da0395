"""The two pluggable batch stages: model generation and checking.

Both are ``mapInPandas`` functions: Arrow batches in, Arrow batches out, one
client (or checker) built per partition by a factory.  Only the external
call happens in Python; code extraction, validation and classification run
as native column expressions before/after the stage.  ``concurrency``
repartitions the work list to bound the number of simultaneous callers.

Outputs must be written (``rounds`` does this) before they are reused, so a
retried downstream stage never calls the model or the checker twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as TX
from ..session import free_column

GEN_SCHEMA = "gen_key string, reply string, gen_error string, generation_time double"
CHECK_SCHEMA = "content_key string, ok boolean, stderr string, check_error string, check_time double"


class ModelClient(Protocol):
    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7, **kw: Any) -> str: ...


Checker = Callable[[str], tuple[bool, str]]


def generate_batch(
    work: DataFrame,
    client_factory: Callable[[], ModelClient],
    *,
    key: str = "gen_key",
    prompt: str = "prompt",
    max_tokens: str = "max_tokens",
    temperature: str = "temperature",
    seed: str = "seed",
    concurrency: int | None = None,
) -> DataFrame:
    """``gen_key, reply, gen_error, generation_time`` per work row.  A
    failing call never raises: it yields ``gen_error``."""
    src = work.select(
        F.col(key).alias("k"), F.col(prompt).alias("p"), F.col(max_tokens).cast("int").alias("mt"),
        F.col(temperature).cast("double").alias("t"), F.col(seed).cast("int").alias("s"),
    )
    if concurrency:
        src = src.repartition(int(concurrency))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        try:
            for pdf in batches:
                keys, replies, errs, times = [], [], [], []
                for k, p, mt, t, s in zip(pdf["k"], pdf["p"], pdf["mt"], pdf["t"], pdf["s"]):
                    t0 = time.perf_counter()
                    try:
                        reply, err = client.generate(p, max_tokens=int(mt), temperature=float(t), seed=int(s)), None
                    except Exception as exc:  # noqa: BLE001 -- a failed call becomes a failed candidate
                        reply, err = None, str(exc)
                    keys.append(k)
                    replies.append(reply)
                    errs.append(err)
                    times.append(time.perf_counter() - t0)
                yield pd.DataFrame({"gen_key": keys, "reply": replies, "gen_error": errs, "generation_time": times})
        finally:
            close = getattr(client, "close", None)
            if callable(close):
                close()

    return src.mapInPandas(run, GEN_SCHEMA)


def recorded_replies(work: DataFrame, replies: DataFrame, on: list[str], missing: str = "no reply recorded") -> DataFrame:
    """The generation stage over replies kept in a table: each work row takes
    the reply with its key; without one it fails as a call that raised would.
    One row per work row: of several replies to one key the least text counts,
    a null reply only if there is no other.  A null in a key answers nothing.
    Adds ``reply, gen_error, generation_time``."""
    found, text = free_column(work, "_found"), free_column(work, "_reply")
    kept = replies.groupBy(*on).agg(F.min("reply").alias(text), F.lit(True).alias(found))
    added = ("reply", "gen_error", "generation_time")
    return work.join(kept, on, "left").select(
        *[work[c] for c in work.columns if c not in added],
        F.col(text).alias("reply"),
        F.when(F.col(found).isNull(), F.lit(missing)).alias("gen_error"),
        F.lit(0.0).alias("generation_time"),
    )


def recorded_verdicts(work: DataFrame, verdicts: DataFrame, missing: str = "no verdict recorded") -> DataFrame:
    """The checking stage over verdicts kept in a table (``content_key, ok,
    stderr``); a code without one fails as a checker that raised would.  One row
    per work row: of several verdicts on one key a failing one counts, with the
    least of its messages."""
    kept = one_verdict(verdicts, "content_key")
    return work.select("content_key").join(kept, "content_key", "left").select(
        "content_key",
        F.coalesce("_ok", F.lit(False)).alias("ok"),
        "stderr",
        F.when(F.col("_found").isNull(), F.lit(missing)).alias("check_error"),
        F.lit(0.0).alias("check_time"),
    )


def one_verdict(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, _ok, stderr, _found) with one row per key: a failing verdict before
    a passing one (a null one fails), then the least message."""
    passed = F.coalesce("ok", F.lit(False))
    first = F.min(F.struct(passed.alias("ok"), F.col("stderr").isNull().alias("none"), F.col("stderr").alias("stderr")))
    return verdicts.groupBy(key).agg(first.alias("_v")).select(key, F.col("_v.ok").alias("_ok"), F.col("_v.stderr").alias("stderr"), F.lit(True).alias("_found"))


def candidate_columns(df: DataFrame, reply: str = "reply", gen_error: str = "gen_error") -> DataFrame:
    """Adds ``code, errors, is_valid`` from a reply (or a generation error):
    extraction and validation are native expressions."""
    failed = F.col(gen_error).isNotNull()
    staged = df.withColumn("code", F.when(failed, F.lit("")).otherwise(TX.extract_code(F.col(reply))))
    errs = F.when(
        failed, F.array(F.concat(F.lit(S.MSG_GENERATION_FAILED_PREFIX), F.col(gen_error)))
    ).otherwise(TX.code_errors(F.col("code")))
    return staged.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def check_batch(
    work: DataFrame,
    checker_factory: Callable[[], Checker],
    *,
    key: str = "content_key",
    code: str = "code",
    concurrency: int | None = None,
) -> DataFrame:
    """``content_key, ok, stderr, check_error, check_time`` per work row.  A
    checker exception is reported in ``check_error`` (the item then fails)."""
    src = work.select(F.col(key).alias("k"), F.col(code).alias("c"))
    if concurrency:
        src = src.repartition(int(concurrency))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check = checker_factory()
        for pdf in batches:
            rows = []
            for k, c in zip(pdf["k"], pdf["c"]):
                t0 = time.perf_counter()
                try:
                    ok, stderr = check(c)
                    rows.append((k, bool(ok), stderr, None, time.perf_counter() - t0))
                except Exception as exc:  # noqa: BLE001
                    rows.append((k, False, None, str(exc), time.perf_counter() - t0))
            yield pd.DataFrame(rows, columns=["content_key", "ok", "stderr", "check_error", "check_time"])

    return src.mapInPandas(run, CHECK_SCHEMA)


def check_records(cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidate records from candidates (``checkable``, ``errors``,
    ``content_key``) and checker verdicts keyed by content key.

    A checkable candidate is compiled unless its check raised (``run_error``);
    ``compile_stderr`` is the checker's stderr (null when empty) for compiled
    candidates and, for the others, their validation errors joined by
    ``'; '`` (null when there are none)."""
    v = verdicts.select("content_key", "ok", "stderr", "check_error", "check_time")
    rec = cands.join(v, "content_key", "left")
    compiled = F.col("checkable") & F.col("check_error").isNull()
    return rec.select(
        *[c for c in cands.columns if c not in ("checkable",)],
        compiled.alias("compiled"),
        (compiled & F.coalesce(F.col("ok"), F.lit(False))).alias("compile_ok"),
        F.when(compiled, F.when(F.col("stderr") != "", F.col("stderr"))).otherwise(
            F.when(F.size("errors") > 0, F.array_join("errors", "; "))
        ).alias("compile_stderr"),
        F.when(F.col("checkable"), F.col("check_error")).alias("run_error"),
        F.coalesce(F.when(compiled, F.col("check_time")), F.lit(0.0)).alias("check_time"),
    )
