"""Duplicate detection, profiles and validation aggregates (section 2.3).

Every aggregate here is partial/final (map-side combine), so a hot id, hash
or topic costs one small partial row per task.  Sets of offending keys are
returned as frames, never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import normalized_digest, normalized_hash
from ..session import free_column
from .batch import one_verdict

MAX_FAILURES = 5


def duplicate_ids(items: DataFrame, id_col: str = "id", seq: str | None = None) -> DataFrame:
    """Ids occurring more than once, with their count (and, given ``seq``,
    the position of their first occurrence) -- one partial/final aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(seq).alias(seq)] if seq else [])
    return items.groupBy(id_col).agg(*aggs).where(F.col("n") > 1)


def with_hash(items: DataFrame, text: str, out: str = "hash") -> DataFrame:
    return items.withColumn(out, normalized_hash(F.col(text)))


def duplicate_content_items(items: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """Every item whose normalized text occurs more than once (all members),
    with 16 hex digits of its hash; the whole digest decides.

    Repeated hashes come from a partial/final aggregate; the members are
    found by a left-semi join, which AQE can split when one hash is hot."""
    # Null texts cannot repeat anything; dropping them first makes the key
    # non-nullable, so no inferred ``isnotnull(hash)`` filter re-evaluates
    # the hash below the projection.
    hashed = items.where(F.col(text).isNotNull()).withColumn(
        "_digest", F.coalesce(normalized_digest(F.col(text)), F.lit(""))
    )
    repeated = hashed.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("_digest")
    members = hashed.join(repeated, "_digest", "left_semi")
    return members.withColumn("hash", F.substring("_digest", 1, 16)).drop("_digest")


def findings(items: DataFrame, text: str, id_col: str = "id", topic: str | None = "topic") -> DataFrame:
    """(kind, key, n): how often every id, normalized text and topic stands,
    from one scan and one aggregate.  ``kind`` is 'id', 'content' (key: the
    whole digest) or 'topic'; a null id or topic is a value, a null text is
    none (it repeats nothing)."""
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    pairs = [pair("id", F.col(id_col)), pair("content", normalized_digest(F.col(text)))]
    if topic is not None:
        pairs.append(pair("topic", F.col(topic)))
    tagged = items.select(F.inline(F.array(*pairs)))
    return tagged.where("kind <> 'content' OR key IS NOT NULL").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def repeated(found: DataFrame, kind: str) -> DataFrame:
    """(key, n): the ids ('id') or texts ('content', 16 digits of their digest)
    that stand more than once, as a frame."""
    key = F.substring("key", 1, 16) if kind == "content" else F.col("key")
    return found.where((F.col("kind") == kind) & (F.col("n") > 1)).select(key.alias("key"), "n")


def topics(found: DataFrame) -> DataFrame:
    """(topic, n) of every topic."""
    return found.where("kind = 'topic'").select(F.col("key").alias("topic"), "n")


def summary(found: DataFrame) -> DataFrame:
    """One row over ``findings``: total_items, unique_ids, n_duplicate_ids,
    n_duplicate_content_items, n_topics (a null topic is not counted)."""
    n, is_id, content = F.col("n"), F.col("kind") == "id", F.col("kind") == "content"
    total = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")
    return found.agg(
        total(is_id).alias("total_items"),
        F.count_if(is_id).alias("unique_ids"),
        F.count_if(is_id & (n > 1)).alias("n_duplicate_ids"),
        total(content & (n > 1)).alias("n_duplicate_content_items"),
        F.count_if((F.col("kind") == "topic") & F.col("key").isNotNull()).alias("n_topics"),
    )


def report_rows(found: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """A report as rows (section, key, n, rate): the totals, every repeated id
    and text, every topic and, given ``checked`` verdicts, their totals.  Lists
    are rows, so none is ever held whole."""
    none = lambda kind: F.lit(None).cast(kind)

    def totals(one: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("section"), none("string").alias("key"), F.col(c).cast("long").alias("n"), none("double").alias("rate")) for c in one.columns if c != "success_rate"]
        if "success_rate" in one.columns:
            cells.append(F.struct(F.lit("success_rate").alias("section"), none("string").alias("key"), none("long").alias("n"), F.col("success_rate").alias("rate")))
        return one.select(F.inline(F.array(*cells)))

    listed = {"id": "duplicate_ids", "content": "duplicate_content", "topic": "topics"}
    section = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])[F.col("kind")]
    key = F.when(F.col("kind") == "content", F.substring("key", 1, 16)).otherwise(F.col("key"))
    lists = found.where((F.col("n") > 1) | (F.col("kind") == "topic")).select(section.alias("section"), key.alias("key"), "n", none("double").alias("rate"))
    rows = totals(summary(found)).unionByName(lists)
    return rows if checked is None else rows.unionByName(totals(verification_summary(checked)))


def duplicate_summary(items: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """One row: total_items, unique_ids, n_duplicate_ids, n_duplicate_content_items.
    ``report_rows(findings(...))`` has the lists behind the counts."""
    return summary(findings(items, text, id_col, None)).drop("n_topics")


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates into one row (union + max; no join)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def topic_distribution(items: DataFrame, topic: str = "topic") -> DataFrame:
    return items.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def topic_distribution_by_file(items: DataFrame, file: str = "file", topic: str = "topic") -> DataFrame:
    """Per-file topic counts, pooled topic counts and the grand total, in one
    aggregate: ``GROUPING SETS ((file, topic), (topic), ())``."""
    df = items.select(F.col(file).alias("file"), F.col(topic).alias("topic"))
    f, t = F.col("file"), F.col("topic")
    return df.groupingSets([[f, t], [t], []], f, t).agg(F.count(F.lit(1)).alias("n"))


def cross_file_duplicates(pooled: DataFrame, text: str = "text", file: str = "file", id_col: str = "id") -> DataFrame:
    """Ids and content repeated over pooled files: ``kind`` ('id' or
    'content'), ``key`` (the id, or the normalized hash), the number of
    items and the distinct files; a null id or text repeats nothing.  Two
    partial/final aggregates; the file set per key is bounded by the number of
    input files."""

    def over_files(key: Column, kind: str) -> DataFrame:
        return (
            pooled.select(key.alias("key"), F.col(file))
            .where(F.col("key").isNotNull())
            .groupBy("key")
            .agg(
                F.count(F.lit(1)).alias("n_items"),
                F.array_join(F.array_sort(F.collect_set(F.col(file))), ",").alias("files"),
            )
            .where(F.col("n_items") > 1)
            .select(F.lit(kind).alias("kind"), (F.substring("key", 1, 16) if kind == "content" else F.col("key")).alias("key"), "n_items", "files")
        )

    return over_files(F.col(id_col).cast("string"), "id").unionByName(over_files(normalized_digest(F.col(text)), "content"))


def length_profile(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct("topic").alias("n_topics"),
        F.avg(F.length("statement")).alias("avg_statement_length"),
        F.avg(F.length("theorem")).alias("avg_theorem_length"),
    )


# ---------------------------------------------------------------------------
# verification
# ---------------------------------------------------------------------------
def verification_rows(items: DataFrame, verdicts: DataFrame, key: str, *, seq: str = "seq") -> DataFrame:
    """One row per item: ok, stderr only when failing.  ``verdicts`` has
    ``key, ok, stderr``; of several verdicts on one key a failing one counts
    (``batch.one_verdict``).  An item without a verdict, or without a key, is a
    failed row with an exception message (the check raised)."""
    ok_, err, has = (free_column(items, c) for c in ("_ok", "_stderr", "_has"))
    v = one_verdict(verdicts, key).select(F.col(key), F.col("_ok").alias(ok_), F.col("stderr").alias(err), F.col("_found").alias(has))
    j = items.join(v, key, "left")
    ok = F.coalesce(F.col(ok_), F.lit(False))
    stderr = F.when(~ok, F.when(F.col(has).isNull(), F.lit(S.COMPILE_EXCEPTION_PREFIX + "no verdict")).otherwise(F.col(err)))
    return j.select(*[items[c] for c in items.columns if c not in ("ok", "stderr")], ok.alias("ok"), stderr.alias("stderr"))


def verification_early_stop(rows: DataFrame, max_failures: int = MAX_FAILURES, seq: str = "seq") -> DataFrame:
    """Rows up to and including the ``max_failures``-th failure in ``seq``
    order.  The cut comes from an ordered limit over the failing rows (top-N
    per partition, then one merge of N rows per partition) -- no global
    window -- and is applied as a filter through a scalar subquery."""
    cut = (
        rows.where(~F.col("ok"))
        .select(seq)
        .orderBy(seq)
        .limit(max_failures)
        .agg(F.max(seq).alias("_cut"), F.count(F.lit(1)).alias("_n"))
    )
    # a scalar subquery: computed once, then compared like a literal
    bound = cut.select(F.when(F.col("_n") >= max_failures, F.col("_cut"))).scalar()
    return rows.where(bound.isNull() | (F.col(seq) <= bound))


def verification_summary(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("ok"))
    return rows.agg(
        n.alias("total_checked"),
        ok.alias("successful"),
        (n - ok).alias("failed"),
        F.coalesce(F.try_divide(ok, n).cast("double"), F.lit(0.0)).alias("success_rate"),
    )


def validate_dataset(items: DataFrame, text: str, *, checked: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """All checks in one row: counts, duplicates, topics and (optionally)
    the verification summary of ``checked`` rows."""
    report = summary(findings(items, text, id_col))
    return report if checked is None else one_row(report, verification_summary(checked))


def dataset_verdict(report: DataFrame) -> DataFrame:
    """Valid iff no duplicate ids, no duplicate content, no failed checks."""
    failed = F.coalesce(F.col("failed"), F.lit(0)) if "failed" in report.columns else F.lit(0)
    return report.select(
        ((F.col("n_duplicate_ids") == 0) & (F.col("n_duplicate_content_items") == 0) & (failed == 0)).alias("is_valid")
    )


def issue_samples(
    dup_ids: DataFrame, failures: DataFrame, *, id_col: str = "id", seq: str = "seq", n_ids: int = 5, n_failures: int = 3
) -> DataFrame:
    """Report lines: the first 5 duplicate ids, the first 3 failures with
    stderr cut at 60 characters, and the number of further failures."""
    ids = dup_ids.orderBy(seq).limit(n_ids).select(
        F.lit("duplicate_id").alias("kind"), F.col(id_col).cast("string").alias("id"), F.lit(None).cast("string").alias("detail")
    )
    fails = failures.orderBy(seq).limit(n_failures).select(
        F.lit("failure").alias("kind"), F.col(id_col).cast("string").alias("id"),
        # the report always appends "..." after the first 60 characters
        F.concat(F.substring(F.col("stderr"), 1, 60), F.lit("...")).alias("detail"),
    )
    more = failures.agg(F.greatest(F.count(F.lit(1)) - n_failures, F.lit(0)).cast("string").alias("detail")).select(
        F.lit("more_failures").alias("kind"), F.lit(None).cast("string").alias("id"), "detail"
    )
    return ids.unionByName(fails).unionByName(more)
