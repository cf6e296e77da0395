"""1. Quality rules with risk-controlled thresholds, DataFrame functions only.

Base counts come first: words, symbols, repeated lines, and words inside
8-word windows that a text holds twice.  Each further rule rejects a document
whose signal (a share in thousandths) exceeds a cutoff.  Cutoffs are chosen
per stratum (language) on labelled good documents: for a fixed grid, the
number of good documents that a cutoff would reject is held against the exact
binomial tail.  A cutoff counts as safe where, if the true rate of false
rejections were above ``risk / number of signals``, so few rejections would be
seen with a probability of at most ``error / (strata * signals)`` (Bonferroni
over strata and signals; within a signal, cutoffs are tested from loose to
tight in a fixed order, which needs no further correction).  The tightest
safe cutoff is used; without one the rule is off in that stratum.  So with
probability 1 - error, no stratum loses more than ``risk`` of its good
documents by these rules.

Null text: no words (base_failed).  Null language: the stratum of the empty
string.  A document labelled more than once counts as good if any label is 1.
Repeated rows are judged one by one; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, cut, table

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Signals in thousandths, each with its cutoffs (ascending).
SIGNALS = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "capitals": "n_capitals * 1000 div greatest(word_chars, 1)",
    "marks": "n_marks * 1000 div greatest(n_words, 1)",
}
CUTOFFS = [5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700]


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the
    array of window hashes: sorted, those equal to a neighbour are marked, and
    the union of the marked windows is measured in text order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s):
        at = lambda k: F.get(s, k)["h"]
        i = F.transform(s, lambda x, k: F.when((at(k - 1) == x["h"]) | (at(k + 1) == x["h"]), x["i"]))
        return F.sort_array(F.filter(i, lambda v: v.isNotNull()))

    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("e"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["e"], i)).alias("n"), (i + WINDOW).alias("e"))
    covered = F.aggregate(bind(ordered, marked), zero, step)["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered).cast("long")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks (long)."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
    keep = [c for c in docs.columns if c not in (text, *added)]
    t = F.col("_t")
    only = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("long")
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(*keep, t, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    w = F.col("_w")
    # Sequence starts beyond its end for short texts: an empty array instead.
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    d = d.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        only("A-Z").alias("n_capitals"),
        only("!?").alias("n_marks"),
        F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW))).alias("_h"),
    )
    return d.select(*keep, *[repeated_words(F.col("_h")).alias(c) if c == "n_repeat_words" else F.col(c) for c in added])


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed term by term in logarithms.
    Where k exceeds n * rate it is above one half's neighbourhood and never
    certifies; 1 is returned without the sum."""
    odds = F.lit(rate / (1 - rate))
    first = n * F.log1p(F.lit(-rate))
    zero = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))

    def add(acc, j):
        t = acc["t"] + F.log((n - j + 1) / j * odds)
        return F.struct(t.alias("t"), (acc["s"] + F.log1p(F.exp(t - acc["s"]))).alias("s"))

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), zero, add)["s"]).otherwise(first)
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.exp(total))


def cutoffs(good: DataFrame, risk: float = 0.05, error: float = 0.05, grid: list[int] | None = None) -> DataFrame:
    """One row per stratum with the cutoff of each signal (null: off), from
    good documents with a stratum column and the signal columns."""
    grid = sorted(grid or CUTOFFS)
    strata = good.select("stratum").distinct().count()
    if not strata:
        return good.sparkSession.createDataFrame([], "stratum string, " + ", ".join(f"cut_{s} long" for s in SIGNALS))
    rate, level = risk / len(SIGNALS), error / (strata * len(SIGNALS))
    values = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in SIGNALS]))
    # level: how many cutoffs, counted from the tightest, reject the value.
    levels = F.size(F.filter(F.array(*[F.lit(c) for c in grid]), lambda c: c < F.col("x.v")))
    hist = good.select("stratum", values.alias("x")).groupBy("stratum", F.col("x.signal").alias("signal"), levels.alias("level")).count()
    per = hist.groupBy("stratum", "signal").agg(F.sum("count").alias("n"), F.collect_list(F.struct("level", "count")).alias("bars"))
    per = per.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    seen = F.aggregate(F.filter("bars", lambda b: b["level"] > F.col("at")), F.lit(0).cast("long"), lambda a, b: a + b["count"])
    per = per.withColumn("k", seen).withColumn("cut", F.element_at(F.array(*[F.lit(c).cast("long") for c in grid]), F.col("at") + 1))
    safe = per.where(binomial_tail(F.col("n"), F.col("k"), rate) <= level)
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("signal") == s, F.col("cut"))).alias(f"cut_{s}") for s in SIGNALS])


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", salts: int = 32, **options) -> DataFrame:
    """The counts of every document with base_failed, kept and the rejecting
    rule (null if none): columns doc_id, stratum, the counts, ..."""
    d = docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), text)
    d = counts(d, text)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    d = d.withColumn("base_failed", failed)
    d = cut(d.select("*", *[F.expr(e).cast("long").alias(s) for s, e in SIGNALS.items()]), "quality-counts")
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_q")).where("_q = 1").select("doc_id")
    cuts = cutoffs(d.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"), **options)
    # One stratum may hold most rows: deal it over salts.
    cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("stratum", "_st")
    salted = d.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    j = salted.join(cuts, (F.col("stratum") == F.col("_st")) & (salted["_salt"] == cuts["_salt"]), "left")
    rule = F.coalesce(F.when(F.col("base_failed"), "base"), *[F.when(F.col(s) > F.col(f"cut_{s}"), s) for s in SIGNALS])
    return j.withColumn("rule", rule).withColumn("kept", F.col("rule").isNull()).drop("_salt", "_st")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    grid = ", ".join(f"({c})" for c in CUTOFFS)
    values = " UNION ALL ".join(f"SELECT rid, stratum, '{s}' AS signal, {e.replace(' div ', ' // ')} AS v FROM judged" for s, e in SIGNALS.items())
    rate = 0.05 / len(SIGNALS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT rid, i, list_slice(w, i, i + 7) AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT rid, x FROM win GROUP BY rid, x HAVING count(*) > 1
), rep AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM win JOIN twice USING (rid, x) CROSS JOIN (SELECT unnest(range(8)) AS o) GROUP BY rid
), counted AS (
  SELECT d.rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(regexp_replace(t, '[^!?]+', '', 'g')) AS BIGINT) AS n_marks
  FROM d LEFT JOIN rep ON d.rid = rep.rid
), judged AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM counted
), signals AS ({values}),
good AS (
  SELECT rid FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)
), tests AS (
  SELECT stratum, signal, cut, count(*) AS n, count(*) FILTER (v > cut) AS k
  FROM signals JOIN good USING (rid) CROSS JOIN (VALUES {grid}) g(cut) GROUP BY stratum, signal, cut
), tails AS (
  SELECT stratum, signal, cut, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r}))) AS tail
  FROM (SELECT *, unnest(range(k + 1)) AS j FROM tests WHERE k <= n * {rate!r}) GROUP BY stratum, signal, cut
), cuts AS (
  SELECT stratum, signal, min(cut) AS cut FROM tails
  WHERE tail <= 0.05 / ((SELECT count(DISTINCT stratum) FROM tests) * {len(SIGNALS)}) GROUP BY stratum, signal
), broken AS (
  SELECT DISTINCT rid FROM signals JOIN cuts USING (stratum, signal) WHERE v > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM broken) AS kept
FROM judged
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
