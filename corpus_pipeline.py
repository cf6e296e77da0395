"""The corpus pipeline: documents in, SentencePiece ids out.

Stages, each over all its predecessor kept, written as Parquet and read again:

1. quality classifier: documents predicted 0 go;
2. SimHash near-dedup: one document of each component stays;
3. PII: spans are masked in the text;
4. mixing: each source gives the words its target asks for;
5. SentencePiece: ids, their number, and the decoded text of every document.

The labels come from the tables beside documents.  Quality is learned from all
labelled rows of the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import mixing, passages, personal, pieces, simhash
from proofloom.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = passages.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=3, max_bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pieces.default_model()
    d = pieces.decode_documents(pieces.encode_documents(docs, model), model)
    return d.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier is trained in floating point: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
