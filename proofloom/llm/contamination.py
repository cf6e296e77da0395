"""13. Benchmark decontamination over a distributed positional inverted index,
with DataFrame functions only.

The index is one written table of postings (term_id, document row, position) of
the terms that the items hold, sorted by term inside each file, so a term's list
is a filter that skips most of a file.  How often each term stands in the
documents is counted from it.

A window (``window`` consecutive words of an item, or the whole of a shorter
one) is searched from its rarest word: that word's list, less the word's place
in the item, gives the diagonals (document row, position - place) on which the
window can lie.  The second rarest word's list is intersected next, by an
equi-join on (row, term, expected position).  Only diagonals that survive meet
the lists of the other words.  Runs of met words of at least a window are exact
phrase matches.

The same joins look ``slop`` places to either side of a word's place.  A window
is a proximity match on a diagonal if its rarest word (the first of equally
rare ones) stands at its place and every other word within ``slop`` places of
its own.

Null texts have no words, and items without words no windows.  Repeated rows
and repeated or null doc_ids are documents of their own.  Rows of one item_id
are searched one by one and counted as one item; a null item_id is an item
named by the empty string.  No other column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, table
from .licenses import LOWER, UPPER, lowered, words

MARK = -1


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, size, q, term): every word of every item; ``item`` is
    the row's own number."""
    w = words(lowered(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = numbered(items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), w.alias("w")), [], "item")
    return cut(rows.select("item", "item_id", F.size("w").alias("size"), F.posexplode("w").alias("q", "term")), "bench-words")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, vocabulary).  postings: term_id, row, pos, sorted by term in
    each file; a row of term ``MARK`` per document holds its doc_id and n_words.
    ``terms`` holds the distinct terms to index."""
    spark = docs.sparkSession
    vocabulary = cut(numbered(terms, [], "term_id").unionByName(spark.createDataFrame([("", MARK)], "term string, term_id long")), "bench-terms")
    # The empty string is no word: put first, it stands for the document.
    w = F.concat(F.array(F.lit("")), words(lowered(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), w.alias("w"))
    d = d.select("row", "doc_id", F.size("w").alias("n"), F.posexplode("w").alias("at", "term")).join(vocabulary, "term")
    first = F.col("term_id") == MARK
    postings = d.select(
        "term_id", "row", (F.col("at") - 1).alias("pos"), F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n") - 1).cast("long").alias("n_words")
    )
    return cut(postings.sortWithinPartitions("term_id", "row", "pos"), "bench-postings"), vocabulary


def rarest_first(placed: DataFrame, window: int) -> DataFrame:
    """(item, s, length, q, term_id, q2, term2): every window whose words all
    stand in the documents, with its rarest and second rarest word (null for a
    window of one word).  ``placed`` is (item, size, q, term_id, n)."""
    length = F.least(F.col("size"), F.lit(window))
    s = F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - length + 1), F.least(F.col("q"), F.col("size") - length)))
    each = placed.select("item", length.alias("length"), s.alias("s"), F.struct("n", "q", "term_id").alias("w"))
    order = F.sort_array(F.collect_list("w"))  # at most ``window`` words
    w = each.groupBy("item", "s", "length").agg(order.alias("o")).where(F.col("o")[0]["n"] > 0)
    second = F.get("o", F.lit(1))
    return w.select("item", "s", "length", F.col("o")[0]["q"].alias("q"), F.col("o")[0]["term_id"].alias("term_id"), second["q"].alias("q2"), second["term_id"].alias("term2"))


def runs(met: DataFrame) -> DataFrame:
    """(item, row, diagonal, low, high) of consecutive places q.  The window
    spans the words of one item on one diagonal."""
    at = Window.partitionBy("item", "row", "diagonal").orderBy("q")
    met = met.withColumn("run", F.col("q") - F.row_number().over(at))
    return met.groupBy("item", "row", "diagonal", "run").agg(F.min("q").alias("low"), F.max("q").alias("high")).drop("run")


def find(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, exact, near).  documents: row, doc_id, n_words of every row.
    exact: row, item, item_id, pos, q, length: the longest runs of item words
    (place ``q`` in the item, ``pos`` in the document) of a window or more.
    near: row, item, item_id, pos, q, length: every window that matches within
    ``slop``, the exact ones among them."""
    iw = item_words(items, item_id, item_text)
    postings, vocabulary = build_index(docs, iw.select("term").distinct(), doc_id, text)
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    placed = iw.join(vocabulary, "term").join(counts, "term_id", "left").select("item", "size", "q", "term_id", F.coalesce("n", F.lit(0)).alias("n"))
    placed = cut(placed, "bench-placed")
    windows = cut(rarest_first(placed, window), "bench-windows")

    # The two rarest lists.
    anchors = windows.select("item", F.col("q").alias("q1"), "term_id", "q2", "term2").distinct()
    lists = postings.select("term_id", "row", "pos")
    one = lists.join(anchors, "term_id").select("item", "row", (F.col("pos") - F.col("q1")).alias("diagonal"), "q1", "q2", "term2")
    around = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    expected = one.where("term2 IS NOT NULL").withColumn("off", around)
    expected = expected.select("item", "row", "diagonal", "q1", F.col("term2").alias("term_id"), (F.col("diagonal") + F.col("q2") + F.col("off")).alias("pos"))
    second = lists.join(windows.select(F.col("term2").alias("term_id")).distinct(), "term_id", "left_semi")
    two = expected.join(second, ["row", "term_id", "pos"], "left_semi").select("item", "row", "diagonal", "q1")
    alone = one.where("term2 IS NULL").select("item", "row", "diagonal", "q1")
    found = cut(two.unionByName(alone).distinct(), "bench-diagonals")

    # The other lists, on the diagonals that are left.
    near_by = F.sequence(F.greatest(F.lit(0), F.col("q1") - window + 1), F.col("q1") + window - 1)
    wanted = found.select("item", "row", "diagonal", F.explode(near_by).alias("q")).distinct().join(placed.select("item", "q", "term_id"), ["item", "q"])
    wanted = wanted.withColumn("off", around).withColumn("pos", F.col("diagonal") + F.col("q") + F.col("off"))
    rest = lists.join(found.select("row").distinct(), "row", "left_semi")
    met = wanted.join(rest, ["row", "term_id", "pos"]).groupBy("item", "row", "diagonal", "q").agg(F.max(F.col("off") == 0).alias("there"))
    met = cut(met, "bench-met")

    sizes = iw.select("item", "item_id", F.least("size", F.lit(window)).alias("least")).distinct()
    exact = runs(met.where("there")).join(sizes, "item").where("high - low + 1 >= least")
    exact = exact.select("row", "item", "item_id", (F.col("diagonal") + F.col("low")).alias("pos"), F.col("low").alias("q"), (F.col("high") - F.col("low") + 1).alias("length"))
    close = runs(met).join(sizes, "item").where("high - low + 1 >= least")
    close = close.select("item", "item_id", "row", "diagonal", F.explode(F.expr("sequence(low, high - least + 1)")).alias("s"))
    close = close.join(windows.select("item", "s", "length", "q"), ["item", "s"]).join(met.where("there").select("item", "row", "diagonal", "q"), ["item", "row", "diagonal", "q"], "left_semi")
    near = close.select("row", "item", "item_id", (F.col("diagonal") + F.col("s")).alias("pos"), F.col("s").alias("q"), "length")
    documents = postings.where(F.col("term_id") == MARK).select("row", "doc_id", "n_words")
    return documents, exact, near


def marked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit (words inside exact matches), items (their
    item_ids, sorted) and near_items (number of items with a proximity match) of
    every document."""
    documents, exact, near = find(docs, items, **options)
    hit = exact.select("row", F.explode(F.expr("sequence(pos, pos + length - 1)")).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    held = exact.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    by = near.select("row", "item_id").distinct().groupBy("row").agg(F.count("*").alias("near_items"))
    out = documents.join(hit, "row", "left").join(held, "row", "left").join(by, "row", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", F.lit(0)).alias("near_items"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slop=2)
    return m.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("near_items").alias("n_near_items"),
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), tok AS (
  SELECT rid, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d
), cf AS (
  SELECT term, count(*) AS n FROM tok GROUP BY term
), b AS (
  SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT item, item_id, w, s, least(len(w), 10) AS size FROM (SELECT *, unnest(range(len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)
), word AS (
  SELECT item, s, k, w[s + k + 1] AS term, size FROM (SELECT *, unnest(range(size)) AS k FROM win)
), anchor AS (
  SELECT item, s, size, min_by(k, (coalesce(n, 0), k)) AS k, min_by(word.term, (coalesce(n, 0), k)) AS term FROM word LEFT JOIN cf ON word.term = cf.term GROUP BY item, s, size
), cand AS (
  SELECT item, s, size, rid, pos - k AS p0 FROM anchor JOIN tok USING (term)
), met AS (
  SELECT c.item, c.s, c.size, c.rid, c.p0, count(DISTINCT word.k) AS near, count(DISTINCT word.k) FILTER (WHERE tok.pos = c.p0 + word.k) AS exact
  FROM cand c JOIN word ON c.item = word.item AND c.s = word.s
  JOIN tok ON tok.rid = c.rid AND tok.term = word.term AND tok.pos BETWEEN c.p0 + word.k - 2 AND c.p0 + word.k + 2
  GROUP BY ALL
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(p0, p0 + size)) AS p FROM met WHERE exact = size) GROUP BY rid
), held AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM met JOIN b USING (item) WHERE exact = size) GROUP BY rid
), close AS (
  SELECT rid, count(DISTINCT item_id) AS n FROM met JOIN b USING (item) WHERE near = size GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(close.n, 0) AS n_near_items
FROM d LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid) LEFT JOIN close USING (rid)
"""

QUERIES = {"op13_decontamination": op13_decontamination}
ORACLES = {"op13_decontamination": ORACLE}
