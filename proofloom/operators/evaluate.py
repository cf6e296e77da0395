"""The evaluation harness (section 2.9, ``run_evaluation``): load, limit,
bulk retry rounds, item table, metrics, report -- a composition of the
operators, each stage a DataFrame job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rounds as RD
from .metrics import compute_metrics
from .numbering import numbered
from .reports import nested_items
from .results import final_code, normalize_pass_k, pass_flags, pass_map

@dataclass
class EvaluationReport:
    metrics: DataFrame  # one row
    items: DataFrame  # item reports, nested in chunks (``reports.nested_items``)
    evaluation: DataFrame  # one row per item, with its final code
    records: DataFrame  # kept candidate records
    errors: DataFrame  # primary errors of failing checks
    pass_k: tuple[int, ...]
    config: dict = field(default_factory=dict)
    dataset_path: str | None = None

    def write(self, path: str) -> None:
        """The report as one JSON document in part files (``sink_report``)."""
        from ..sources.sinks import sink_report

        c = self.config
        config = F.struct(
            F.lit(c["max_attempts"]).alias("max_attempts"),
            F.array(*[F.lit(b) for b in c["beam_schedule"]]).alias("beam_schedule"),
            F.array(*[F.lit(t) for t in c["temperature_schedule"]]).alias("temperature_schedule"),
            F.lit(c["max_tokens"]).alias("max_tokens"),
        )
        head = self.metrics.select(
            F.lit(self.dataset_path).alias("dataset_path"),
            F.struct(*self.metrics.columns).alias("metrics"),
            F.array(*[F.lit(k) for k in self.pass_k]).alias("pass_k"),
            config.alias("config"),
        )
        sink_report(head, self.evaluation, self.errors, self.records, self.pass_k, path)


def run_evaluation(
    spark: SparkSession,
    dataset: str | DataFrame,
    client_factory: Callable,
    checker_factory: Callable,
    *,
    schedule: RD.RetrySchedule | None = None,
    pass_k: Sequence[int] = (1, 5),
    limit: int | None = None,
    model: str = "model",
    work_dir: str | None = None,
    memo_dir: str | None = None,
) -> EvaluationReport:
    """Evaluate a data set of items (a JSONL path, loaded strictly, or a frame
    with ``id, english, lean``).  ``limit`` keeps the first N items in file
    order.  Raises ``ValueError`` when no item is left."""
    from ..sources.items import scan_strict

    ks = normalize_pass_k(pass_k)
    sch = schedule or RD.RetrySchedule()
    items = scan_strict(spark, dataset) if isinstance(dataset, str) else dataset
    if limit is not None:
        # a frame without line numbers is taken in its own order
        if "line_number" not in items.columns:
            items = numbered(items, [], "line_number").withColumn("file", F.lit(""))
        order = ["file", "line_number"]
        items = items.orderBy(*order).limit(int(limit))
    if items.limit(1).count() == 0:
        raise ValueError("Dataset is empty; nothing to evaluate.")
    round_items = items.select(
        F.col("id").alias("item_id"),
        F.col("english.statement").alias("statement"),
        F.coalesce(F.col("english.steps"), F.array().cast("array<string>")).alias("steps"),
    )
    res = RD.retry_rounds(
        spark, round_items, client_factory, checker_factory, sch, model=model, work_dir=work_dir, memo_dir=memo_dir
    )
    ev = RD.rounds_item_results(res, round_items, sch)
    ev = ev.select(*[c for c in ev.columns if not c.startswith("pass_at_")], *pass_flags(F.col("success_attempt"), ks))
    ev = ev.join(final_code(res.records), "item_id", "left")
    report = nested_items(ev.withColumn("pass_at_k", pass_map(F.col("success_attempt"), ks)), res.errors, res.records)
    return EvaluationReport(
        metrics=compute_metrics(ev, ks),
        items=report.withColumnRenamed("item_id", "id"),
        evaluation=ev,
        records=res.records,
        errors=res.errors,
        pass_k=ks,
        dataset_path=dataset if isinstance(dataset, str) else None,
        config=sch.summary(),
    )
