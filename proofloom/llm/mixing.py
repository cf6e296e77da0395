"""7. Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in a pseudorandom but fixed order, form one stream of
words, cut into blocks of ``block_words``.  Target words per source become a
number of block slots.  Output shards of ``shard_slots`` slots draw their
counts per source from one multinomial (a slot's draw is a hash of its
number); running counts then give every slot its index within its source, cut
or topped up where the draws miss the source's number of slots.  An index
maps to a block through a keyed permutation of the source's blocks, a new one
for each pass over the source, so no block is taken more than once a pass.
Slots and blocks meet in an equi-join on (source, block).

No step holds a source in one task: a source's documents are numbered over
range partitions and cut into cells of ``cell_docs`` documents, with offsets
from one row per cell; rows of one id, or of none, fall in as many cells as they
fill.  Only
the table of sources (one row each, with its weight and target) is ordered as
a whole.  All hashes are integer arithmetic that any SQL engine repeats.

Null text: size 0.  Null source: a source of its own, last.  Repeated rows
are separate documents.  Documents of size 0 are kept with taken 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import free_column
from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
P1, P2, P3 = 2147483647, 2147483629, 2147483587


def mixed(x: str) -> str:
    """Integer hash of a number from 0 to 2^32 to 0..P1-1, as SQL text: three
    multiplications in three prime fields."""
    return f"(((({x}) % {P1} * 1812433253 + 1566083941) % {P2} * 1103515245 + 12345) % {P3} * 1566083941 + 907633409) % {P1}"


def permuted(x: str, a: str, key: str, div: str) -> str:
    """Keyed permutation of 0..a*a-1 as SQL text: three rounds of a balanced
    network on (x div a, x mod a)."""
    left, r0 = f"({x}) {div} {a}", f"({x}) % {a}"
    r1 = f"(({left}) + {mixed(f'{r0} + {key} + 11')}) % {a}"
    r2 = f"(({r0}) + {mixed(f'{r1} + {key} + 22')}) % {a}"
    r3 = f"(({r1}) + {mixed(f'{r2} + {key} + 33')}) % {a}"
    return f"(({r2}) * {a} + ({r3}))"


def source_targets(sized: DataFrame, cap: float, cycle: int) -> DataFrame:
    """One row per source: s (rank by code point, null last), source_size,
    docs, target.  Targets share the sum of sizes by weight; the level at which
    the capped ones stop is the largest of the levels reached when sources are
    capped one after another in the order of cap / weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    src = src.withColumn("s", F.row_number().over(by_name).cast("long")).withColumn("weight", ((F.col("s") - 1) % cycle + 1).cast("double"))
    src = src.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    after = Window.orderBy(F.col("most") / F.col("weight"), "s")
    whole = Window.partitionBy()
    before = after.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    src = src.withColumn("level", left / F.sum("weight").over(after.rowsBetween(0, Window.unboundedFollowing)))
    return src.withColumn("target", F.least("most", F.max("level").over(whole) * F.col("weight"))).drop("level", "most", "weight")


def mix(docs: DataFrame, text: str = "text", block_words: int = 64, shard_slots: int = 65536, cell_docs: int = 4096, cap: float = 3.0, cycle: int = 3, seed: int = 17, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, picks).  documents: doc_id, source, s, size, source_size,
    target, start (of its words in the source's stream), and ``row`` (a column
    of ``docs`` that names its rows), if given.  picks: s, block, times (how
    often the mix takes the block; only blocks that it takes)."""
    spark = docs.sparkSession
    named = [row] if row else []
    sized = cut(
        docs.select(*named, "doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    )
    src = source_targets(sized, cap, cycle)
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    wanted = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)
    src = src.withColumn("slots", F.when(F.col("source_size") > 0, F.least((F.col("blocks") * cap).cast("long"), wanted)).otherwise(0))
    src = src.withColumn("upto", F.sum("slots").over(Window.orderBy("s")))
    src = cut(src, "mix-sources")

    # Documents in the order of (key, doc_id, size), cell by cell.
    unsigned = f"((coalesce(doc_id, -1) % {P1}) + {P1}) % {P1}"
    d = sized.join(src.select(F.col("source").alias("of"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    d = numbered(d, [F.expr(mixed(unsigned)), F.col("doc_id"), F.col("size")], "place", group=["s"])
    d = d.withColumn("cell", F.expr(f"place div {int(cell_docs)}"))
    cells = d.groupBy("s", "cell").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(inside)).join(cells, ["s", "cell"])
    documents = d.select(*named, "doc_id", "source", "s", "size", "source_size", "target", (F.col("base") + F.col("inside") - F.col("size")).alias("start"))

    # Draws: a slot's number falls in one source's range of 0..P1-1.  Ranges
    # meet slots over a grid of 4096 cells, by equality.
    total = src.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    edge = lambda c: f"cast(floor(cast({c} as double) / {max(total, 1)} * {P1}) as bigint)"
    ranges = src.where("slots > 0").select("s", "slots", F.expr(edge("upto - slots")).alias("low"), F.expr(edge("upto")).alias("high"))
    step = P1 // 4096
    ranges_at = ranges.withColumn("g", F.explode(F.expr(f"sequence(low div {step}, high div {step})")))
    slots = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), F.expr(mixed(f"(id + {seed} * 7919) % {P1}")).alias("u"))
    drawn = slots.withColumn("g", F.expr(f"u div {step}")).join(ranges_at.drop("slots"), "g").where("u >= low AND u < high")
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("n"))
    running = Window.partitionBy("s").orderBy("shard")
    # Index ranges within the source, up to its number of slots ...
    runs = counts.withColumn("end", F.sum("n").over(running)).join(src.select("s", "slots"), "s")
    taken = runs.select("s", F.least(F.col("end") - F.col("n"), F.col("slots")).alias("low"), F.least("end", "slots").alias("high"))
    # ... and what the draws left open, in pieces of at most a shard.
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    rest = src.where("slots > 0").join(got, "s", "left").select("s", F.least(F.coalesce("got", F.lit(0)), F.col("slots")).alias("got"), "slots").where("got < slots")
    rest = rest.withColumn("low", F.explode(F.expr(f"sequence(got, slots - 1, {shard_slots})"))).select("s", "low", F.least(F.col("low") + shard_slots, F.col("slots")).alias("high"))
    pieces = taken.unionByName(rest).where("low < high").repartition("s", "low")
    index = pieces.withColumn("j", F.explode(F.expr("sequence(low, high - 1)"))).join(src.select("s", "blocks"), "s")
    index = index.select("s", "blocks", F.expr("j % blocks").alias("i"), F.expr("cast(ceil(sqrt(cast(blocks as double))) as bigint)").alias("a"), F.expr(f"(s * 104729 + (j div blocks) * 1299709 + {seed}) % {P1}").alias("k"))
    once = index.withColumn("x", F.expr(permuted("i", "a", "k", "div")))
    # Values outside the blocks walk on along the permutation; a*a - blocks
    # is below 2a+1, so forty steps leave none (odds below (2/sqrt(n))^40).
    walk = f"aggregate(sequence(1, 40), x, (v, t) -> if(v < blocks, v, {permuted('v', 'a', 'k', 'div')}))"
    picks = once.select("s", F.expr(f"if(x < blocks, x, {walk})").alias("block")).groupBy("s", "block").agg(F.count("*").alias("times"))
    return documents, picks


def overlaps(documents: DataFrame, picks: DataFrame, block_words: int = 64) -> DataFrame:
    """Documents with words, joined to the picked blocks they touch: one row
    per document and block, with low and high (words of the document, from 0,
    end exclusive) and times (0 for a block that is not taken)."""
    d = documents.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    return d.join(picks, ["s", "block"], "left").select(
        *documents.columns,
        F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).alias("low"),
        F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")).alias("high"),
        F.coalesce("times", F.lit(0)).cast("long").alias("times"),
    )


def taken_words(docs: DataFrame, block_words: int = 64, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    documents, picks = mix(docs, block_words=block_words, **options)
    out = ["doc_id", "size", "source_size", "target"]
    some = overlaps(documents, picks, block_words).groupBy("s", "start", *out).agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    none = documents.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return some.select(*out, "taken").unionByName(none)


def mixed_documents(docs: DataFrame, block_words: int = 64, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``; a document of which
    words are taken holds them pass by pass, on a line each (the whole text as
    it was where a pass takes all of it); the others go.  Every row is a
    document, also rows that are equal: rows are named in a written copy."""
    row, words, spans_ = (free_column(docs, c) for c in ("_mix_row", "_mix_words", "_mix_spans"))
    here = cut(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    documents, picks = mix(here, block_words=block_words, row=row, **options)
    spans = F.sort_array(F.collect_list(F.struct("low", "high", "times")))  # blocks of one document
    per = overlaps(documents, picks, block_words).groupBy(row).agg(spans.alias(spans_))
    j = here.join(per.where(f"exists({spans_}, p -> p.times > 0)"), row)
    j = j.withColumn(words, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    passes = F.expr(
        f"transform(sequence(1, array_max(transform({spans_}, p -> int(p.times)))), t -> if(forall({spans_}, p -> p.times >= t), text, "
        f"array_join(flatten(transform(filter({spans_}, p -> p.times >= t), p -> slice({words}, int(p.low) + 1, int(p.high - p.low)))), ' ')))"
    )
    j = j.withColumn("text", F.array_join(passes, "\n"))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), src0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source
), src1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM src0
), src2 AS (
  SELECT *, CAST((s - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM src1
), src3 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY most / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src2
), src4 AS (
  SELECT source, s, source_size, docs, least(most, max(level) OVER () * weight) AS target, CAST(ceil(source_size / 64.0) AS BIGINT) AS blocks FROM src3
), src5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(blocks * 3, CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) ELSE 0 END AS slots FROM src4
), src AS (
  SELECT *, CAST(sum(slots) OVER (ORDER BY s) AS BIGINT) AS upto, CAST(sum(slots) OVER () AS BIGINT) AS total FROM src5
), keyed AS (
  SELECT rid, doc_id, size, s, source_size, target, {mixed(f"((coalesce(doc_id, -1) % {P1}) + {P1}) % {P1}")} AS key FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source
), placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY s ORDER BY key, doc_id NULLS FIRST, size, rid) AS BIGINT) - size AS start FROM keyed
), slot AS (
  SELECT g.id // 65536 AS shard, {mixed(f"(g.id + 17 * 7919) % {P1}")} AS u FROM (SELECT unnest(range((SELECT coalesce(max(total), 0) FROM src))) AS id) g
), bounds AS (
  SELECT s, slots, blocks, CAST(floor(CAST(upto - slots AS DOUBLE) / total * {P1}) AS BIGINT) AS low, CAST(floor(CAST(upto AS DOUBLE) / total * {P1}) AS BIGINT) AS high FROM src WHERE slots > 0
), counts AS (
  SELECT s, shard, count(*) AS n FROM slot JOIN bounds ON u >= low AND u < high GROUP BY s, shard
), numbered AS (
  SELECT s, blocks, unnest(range(slots)) AS j FROM bounds
), seeds AS (
  SELECT s, blocks, j % blocks AS i, CAST(ceil(sqrt(CAST(blocks AS DOUBLE))) AS BIGINT) AS a, (s * 104729 + (j // blocks) * 1299709 + 17) % {P1} AS k FROM numbered
), walk AS (
  SELECT s, blocks, a, k, {permuted("i", "a", "k", "//")} AS x FROM seeds
  UNION ALL
  SELECT s, blocks, a, k, {permuted("x", "a", "k", "//")} AS x FROM walk WHERE x >= blocks
), picks AS (
  SELECT s, x AS block, count(*) AS times FROM walk WHERE x < blocks GROUP BY s, x
), touched AS (
  SELECT rid, s, start, size, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT rid, CAST(sum((least(start + size, (t.block + 1) * 64) - greatest(start, t.block * 64)) * times) AS BIGINT) AS taken
  FROM touched t JOIN picks p ON t.s = p.s AND t.block = p.block GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (rid)
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": ORACLE}
