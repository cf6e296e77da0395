"""Bounded samples of labelled documents, for models trained on the driver.

A sample is bounded in documents and in characters, both parameters.  Documents
that have a label and a text are ordered by a hash of the id, so the sample does
not depend on layout; each class fills half, and rows carry the weight that
restores the class shares.  Should a class's documents hold too many characters,
its longest ones are left out: one long text never takes the place of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trainable, documents: int, characters: int, text: str = "text") -> DataFrame:
    """(doc_id, text, label, weight): at most ``documents`` rows and
    ``characters`` characters, half of each for either class (one text at
    least).  ``trainable`` is a filter on doc_id.  A document labelled more
    than once counts with its largest label; rows without label, id or text
    take no part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & trainable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = cut(known.join(docs.where(F.col(text).isNotNull()).select("doc_id"), "doc_id", "left_semi"), "labelled")
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = [known.where(F.col("label") == c).orderBy(*order).limit(documents // 2) for c in (0, 1)]
    chosen = half[0].unionByName(half[1]).select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select("doc_id", F.col(text).alias("text")).join(chosen, F.col("doc_id") == F.col("_id")).where("text IS NOT NULL")
    # Of several texts under one id, the one with the least digest: one row
    # per id, at most ``documents`` rows from here on.
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    shortest = Window.partitionBy("label").orderBy(F.length("text"), *order)
    running = F.sum(F.length("text")).over(shortest.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(shortest)
    texts = texts.withColumn("_sum", running).withColumn("_at", place).where((F.col("_sum") <= characters // 2) | (F.col("_at") == 1))
    share = F.col("_total") / F.max("_at").over(Window.partitionBy("label"))
    return texts.withColumn("_total", F.when(F.col("label") == 1, float(total.get(1, 0))).otherwise(float(total.get(0, 0)))).select("doc_id", "text", "label", share.alias("weight"))
