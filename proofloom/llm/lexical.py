"""12. Ranked lexical search over a length-stratified index.

A document's score for an item is a sum over the item's terms of
``w * impact(tf, m)``, and m depends on the document's length alone.  So
documents of equal m form a stratum, its postings are grouped by (term, tf),
and an impact is computed once per tf of a stratum.  A stratum is cut into
parts of bounded postings and documents; a part is one row of the index.

The largest tf of each term bounds what any document of a part can score.  For
every item the parts of highest bound are visited first; the k-th best score
found there is the item's floor, and after that only parts whose bound reaches
the floor are scored.  A bound is never below a score of its part, so nothing
is lost.

Items meet the index in blocks of at most ``BLOCK_ITEMS`` items and about
``BLOCK_TERMS`` terms.

Null texts and texts without a term are in no stratum.  Repeated rows and
repeated or null doc_ids are documents of their own; null ids come last among
equal scores.  Items without terms, or whose terms no document has, give no
rows; a repeated item_id (null is one too) is one item with the terms of all
its rows.  No other column is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, small_batches, table

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NATIVE_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART_POSTINGS, PART_DOCS = 1 << 14, 2048
BLOCK_ITEMS, BLOCK_TERMS = 256, 1 << 16
#: Posting-item products that one step of the scoring holds.
STEP = 1 << 20
VISITS = 8
NO_ID = 2**63 - 1


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) to (rid, doc_id, n, term, tf); first one row with an
    empty term per document, which keeps documents without any wanted term in
    the counts."""
    for batch in batches:
        rid, doc_id, texts = batch.columns
        which, ns, terms, tfs = [], [], [], []

        def packed():
            at = pa.array(np.repeat(np.asarray(which, np.int64), [s for s, _ in ns]))
            n = pa.array(np.repeat(np.asarray([x for _, x in ns], np.int64), [s for s, _ in ns]))
            return pa.RecordBatch.from_arrays([rid.take(at), doc_id.take(at), n, pa.array(terms, pa.binary()), pa.array(tfs, pa.int32())], ["rid", "doc_id", "n", "term", "tf"])

        for row, text in enumerate(texts):
            found = TERM.findall(text.as_buffer().to_pybytes().lower()) if text.is_valid else []
            count = Counter(found)
            which.append(row)
            ns.append((len(count) + 1, len(found)))
            terms.append(b"")
            tfs.append(0)
            terms.extend(count)
            tfs.extend(count.values())
            if len(terms) > 1 << 16:
                yield packed()
                which, ns, terms, tfs = [], [], [], []
        if which:
            yield packed()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), upper, lower), F.lit(NATIVE_TERM), F.lit(0))
    return items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(words).alias("term")).distinct()


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """Impact of each tf in the stratum m, computed once per distinct tf."""
    some, which = np.unique(tf, return_inverse=True)
    each = np.array([1_000_000_000 * t // (1000 * t + 8 * m) for t in some.tolist()], np.int64)
    return each[which]


INDEX = pa.schema(
    [
        ("m", pa.int64()), ("part", pa.int32()), ("docs", pa.int32()),
        ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
    ]
)
INDEX_SQL = "m long, part int, docs int, ids array<bigint>, terms array<int>, tfs array<int>, sizes array<int>, places array<int>"


def pack_part(postings: pa.Table) -> pa.Table:
    """The postings of one part as one row: document ids, and runs of equal
    (term, tf) with the documents of each run as places in ``ids``."""
    rid, first, place = np.unique(postings["rid"].to_numpy(), return_index=True, return_inverse=True)
    ids = postings["doc_id"].combine_chunks().take(pa.array(first))
    term, tf = postings["term_id"].to_numpy().astype(np.int32), postings["tf"].to_numpy()
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    sizes = np.diff(np.r_[new, len(term)])
    row = [[postings["m"][0].as_py()], [postings["part"][0].as_py()], [len(rid)], [ids.to_pylist()], [term[new]], [tf[new]], [sizes], [place.astype(np.int32)]]
    return pa.table([pa.array(c, f.type) for c, f in zip(row, INDEX)], schema=INDEX)


class Weights:
    """The (item, term, weight) triples of one block of items, by term."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.item, self.weight = items[order], weights[order]
        self.term, self.first, self.n = np.unique(terms[order], return_index=True, return_counts=True)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, n) of each term's pairs; n is 0 for terms of no item."""
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        return self.first[at], np.where(self.term[at] == terms, self.n[at], 0)


def add_up(rows: int, items: int, place: np.ndarray, impact: np.ndarray, first: np.ndarray, n: np.ndarray, w: Weights) -> np.ndarray:
    """Integer scores [row, item]: impact * weight of every posting and item
    that holds its term, in steps of bounded size."""
    acc = np.zeros(rows * items, np.int64)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        k = n[a:b]
        pair = np.repeat(first[a:b] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
        np.add.at(acc, np.repeat(place[a:b].astype(np.int64) * items, k) + w.item[pair], np.repeat(impact[a:b], k) * w.weight[pair])
        a = b
    return acc.reshape(rows, items)


def flat(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    values = batch.column(name)[row].values
    if values.null_count:
        values = values.fill_null(NO_ID)  # ids only
    return values.to_numpy(zero_copy_only=False)


def part_and_block(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, Weights]:
    m = batch.column("m")[row].as_py()
    terms, tfs = flat(batch, "terms", row), flat(batch, "tfs", row)
    return terms, impacts(tfs, m), Weights(flat(batch, "pair_terms", row), flat(batch, "pair_items", row), flat(batch, "pair_weights", row))


def bound_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows with a block of items to (block, item, m, part, docs, bound):
    an item's bound in the part is its score if one document had every term as
    often as any document of the part has."""
    names = ["block", "item", "m", "part", "docs", "bound"]
    for batch in batches:
        for row in range(batch.num_rows):
            terms, impact, w = part_and_block(batch, row)
            items = batch.column("items")[row].as_py()
            # runs are sorted by (term, tf): a term's last run has its peak
            last = np.flatnonzero(np.r_[terms[1:] != terms[:-1], True]) if len(terms) else np.zeros(0, np.int64)
            first, n = w.of(terms[last])
            bound = add_up(1, items, np.zeros(len(last), np.int64), impact[last], first, n, w)[0]
            some = np.flatnonzero(bound)
            same = [pa.array(np.full(len(some), batch.column(c)[row].as_py()), t) for c, t in (("block", pa.int64()), ("m", pa.int64()), ("part", pa.int32()), ("docs", pa.int32()))]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(some, pa.int32()), same[1], same[2], same[3], pa.array(bound[some])], names)


def best_rows(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows with a block of items and the floors of the wanted ones to
        (block, item, doc_id, score): the k best documents of the part that
        reach the item's floor, for each wanted item."""
        for batch in batches:
            for row in range(batch.num_rows):
                terms, impact, w = part_and_block(batch, row)
                items, docs = batch.column("items")[row].as_py(), batch.column("docs")[row].as_py()
                least = np.full(items, np.iinfo(np.int64).max)
                least[flat(batch, "wanted", row)] = np.maximum(flat(batch, "floors", row), 1)
                sizes, place = flat(batch, "sizes", row), flat(batch, "places", row)
                first, n = w.of(terms)
                acc = add_up(docs, items, place, np.repeat(impact, sizes), np.repeat(first, sizes), np.repeat(n, sizes), w)
                doc, item = np.nonzero(acc >= least)
                points, ids = acc[doc, item], flat(batch, "ids", row)[doc]
                order = np.lexsort((ids, -points, item))
                item, points, ids = item[order], points[order], ids[order]
                start = np.searchsorted(item, item)
                kept = np.arange(len(item)) - start < k
                item, points, ids = item[kept], points[kept], ids[kept]
                block = pa.array(np.full(len(item), batch.column("block")[row].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([block, pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(points)], ["block", "item", "doc_id", "score"])

    return score


def build_index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(index, weights), both written.  index: one row per part of a stratum
    with the postings of the items' terms; weights: item_id, term_id, weight."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = cut(item_terms(items, item_id, item_text), "lexical-items")
    vocabulary = numbered(wanted.select("term").distinct(), [], "term_id").select(F.encode("term", "UTF-8").alias("term"), "term_id")
    vocabulary = cut(vocabulary.unionByName(spark.createDataFrame([(b"", -1)], "term binary, term_id long")), "lexical-terms")
    here = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = here.mapInArrow(term_rows, "rid long, doc_id long, n long, term binary, tf int")
    postings = cut(rows.join(vocabulary, "term").drop("term"), "lexical-postings").where("n > 0")

    counts = postings.where("term_id = -1").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = counts["docs"], max(counts["terms"], 1)
    df = postings.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    known = wanted.select("item_id", F.encode("term", "UTF-8").alias("term")).join(vocabulary, "term").join(df, "term_id")
    weights = cut(known.select("item_id", "term_id", weight.alias("weight")), "lexical-weights")

    stratum = postings.withColumn("m", F.expr(f"10 + (90 * n * {n_docs}) div {n_terms}"))
    size = stratum.groupBy("m").agg(F.count_if(F.col("term_id") >= 0).alias("p"), F.count_if(F.col("term_id") < 0).alias("d"))
    parts = F.greatest(F.ceil(F.col("p") / PART_POSTINGS), F.ceil(F.col("d") / PART_DOCS), F.lit(1))
    size = cut(size.select("m", parts.alias("parts")), "lexical-strata")
    dealt = stratum.where("term_id >= 0").join(size, "m").select("m", F.expr("cast(pmod(xxhash64(rid), parts) as int)").alias("part"), "rid", "doc_id", "term_id", "tf")
    index = cut(dealt.groupBy("m", "part").applyInArrow(pack_part, INDEX_SQL), "lexical-index")
    return index, weights


def item_blocks(weights: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, places, number of blocks).  blocks: one row per block of items
    with its triples; places: item_id of (block, item).  An item with more
    terms than its share of a block is a block of its own."""
    share = BLOCK_TERMS // BLOCK_ITEMS
    items = numbered(weights.groupBy("item_id").agg(F.count("*").alias("terms")), [], "number")
    alone = F.col("terms") > share
    group = F.when(alone, -1 - F.col("number")).otherwise(F.expr(f"number div {BLOCK_ITEMS}"))
    items = items.select("item_id", group.alias("group"), F.when(alone, 0).otherwise(F.col("number") % BLOCK_ITEMS).cast("int").alias("item"))
    groups = numbered(items.select("group").distinct(), [], "block")
    places = cut(items.join(groups, "group").select("block", "item", "item_id"), "lexical-places")
    named = places.withColumnRenamed("item_id", "of")
    pairs = weights.join(named, F.col("item_id").eqNullSafe(F.col("of")))
    # bounded: BLOCK_TERMS triples, or those of one item
    triples = F.collect_list(F.struct("term_id", "item", "weight"))
    b = pairs.groupBy("block").agg(triples.alias("t"), (F.max("item") + 1).alias("items"))
    b = b.select("block", "items", F.col("t.term_id").alias("pair_terms"), F.col("t.item").alias("pair_items"), F.col("t.weight").alias("pair_weights"))
    return cut(b, "lexical-blocks"), places, groups.count()


def search(docs: DataFrame, items: DataFrame, k: int = 10, **names) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every
    item, scores above 0, equal scores by doc_id."""
    index, weights = build_index(docs, items, **names)
    blocks, places, n_blocks = item_blocks(weights)
    if not n_blocks:
        return weights.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = index.select("m", "part", "docs", "terms", "tfs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    bounds = cut(every.join(blocks, "block").mapInArrow(bound_rows, "block long, item int, m long, part int, docs int, bound long"), "lexical-bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = F.collect_list(F.struct("item", "floor"))  # at most the items of a block
        p = pairs.groupBy("block", "m", "part").agg(wanted.alias("w")).select("block", "m", "part", F.col("w.item").alias("wanted"), F.col("w.floor").alias("floors"))
        return index.join(p, ["m", "part"]).join(blocks, "block").mapInArrow(best_rows(k), "block long, item int, doc_id long, score long")

    of_item = Window.partitionBy("block", "item")
    visit = F.row_number().over(of_item.orderBy((F.col("docs") >= k).desc(), F.col("bound").desc(), "m", "part"))
    first = bounds.withColumn("visit", visit).where(F.col("visit") <= VISITS)
    first = cut(first.select("block", "item", "m", "part", F.lit(1).cast("long").alias("floor")), "lexical-visits")
    place = F.row_number().over(of_item.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    found = cut(scored(first).withColumn("rank", place).where(F.col("rank") <= k), "lexical-first")
    floors = found.where(F.col("rank") == k).select("block", "item", F.col("score").alias("floor"))
    rest = bounds.join(first.select("block", "item", "m", "part"), ["block", "item", "m", "part"], "left_anti")
    rest = rest.join(floors, ["block", "item"], "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    rest = cut(rest.where("bound >= floor").select("block", "item", "m", "part", "floor"), "lexical-rest")
    best = found.drop("rank").unionByName(scored(rest)).withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(places, ["block", "item"]).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), p AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term
), q AS (
  SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark
), f AS (
  SELECT term, count(*) AS df FROM p GROUP BY term
), wt AS (
  SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM q JOIN f USING (term), c
), s AS (
  SELECT item_id, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(d.w) AS BIGINT) * docs) // terms)))) AS BIGINT) AS score
  FROM wt JOIN p USING (term) JOIN d USING (rid), c GROUP BY item_id, rid
), r AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s JOIN d USING (rid) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": ORACLE}
