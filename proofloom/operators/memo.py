"""Memo tables instead of caches (section 2.7).

A memo is a table ``key -> result``.  A run looks up its requests by an
equi-join on whole digests; the work list is the distinct requested keys
left-anti-joined to the memo, so each distinct key is computed once per run and
never again in later runs.  Distinct-ing is a partial/final aggregate, so a hot
key costs one partial row per task.

``BucketedMemo`` keeps the table on disk hashed by key into buckets: a lookup
shuffles the requests to the buckets and never the memo, however large it is.

A request without a key cannot be remembered: it is always a miss, stays in the
work list by itself, and no row of a memo answers it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest
from ..session import free_column


def params_json(**params: Column) -> Column:
    """JSON of generation parameters with sorted keys (the params hash input)."""
    return F.to_json(F.struct(*[params[k].alias(k) for k in sorted(params)]))


def generation_key(prompt: Column, **params: Column) -> Column:
    """Whole digests of prompt and sorted params, joined by ``_``; null for a
    null prompt.  ``shown_key`` is its short form for display."""
    return F.concat(digest(prompt), F.lit("_"), digest(params_json(**params)))


def shown_key(key: Column) -> Column:
    """The first 16 hex digits of each digest of a generation key."""
    return F.concat(F.substring(key, 1, 16), F.lit("_"), F.substring(key, 66, 16))


def work_list(requests: DataFrame, key: str, memo: DataFrame | None, payload: list[str] | None = None) -> DataFrame:
    """Distinct requested keys (with one payload row each) not in the memo,
    and every request without a key."""
    cols = [key, *(payload or [])]
    known = requests.where(F.col(key).isNotNull()).select(*cols).dropDuplicates([key])
    if memo is not None:
        known = known.join(memo.select(key), key, "left_anti")
    return known.unionByName(requests.where(F.col(key).isNull()).select(*cols))


def mark_repeats(requests: DataFrame, key: str, order: list[str], out: str = "from_memo") -> DataFrame:
    """Within one run: the first request of a key (in ``order``) is a miss,
    every later request of the same key a hit, and a request without a key a
    miss.  The first request per key comes from a partial/final aggregate
    joined back on the key (AQE splits a hot key on the request side)."""
    first, mine = free_column(requests, "_first"), F.struct(*[F.col(c) for c in order])
    firsts = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(mine).alias(first))
    marked = requests.join(firsts, key, "left")
    repeat = F.coalesce(~mine.eqNullSafe(F.col(first)) & F.col(first).isNotNull(), F.lit(False))
    return marked.select(*[requests[c] for c in requests.columns if c != out], repeat.alias(out))


class BucketedMemo:
    """A memo on disk: parquet files hashed by ``key`` into ``buckets``.

    The folder is declared as a bucketed table in the session's catalog, so a
    join on the key reads the memo bucket by bucket without an exchange; give
    it at least as many buckets as ``spark.sql.shuffle.partitions`` of the
    sessions that look up.  The number of buckets belongs to the folder: open
    it with the one it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "memo_" + hashlib.sha256(f"{self.path} {self.buckets}".encode()).hexdigest()[:16]

    def rows(self) -> DataFrame:
        """All rows, as a bucketed scan."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}) USING parquet "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, results: DataFrame) -> None:
        """Append results (one exchange of the new rows, one file per bucket)."""
        self.rows()
        new = results.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).repartition(self.buckets, self.key)
        new.write.format("parquet").mode("append").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def lookup(self, requests: DataFrame, usable: Column, order: list[str]) -> DataFrame:
        """One row per requested key that has a usable result: the first in
        ``order``.  Neither the join nor the aggregate shuffles the memo."""
        rest = F.struct(*[f.name for f in self.schema if f.name != self.key])
        hits = self.rows().where(usable).join(requests.select(self.key).distinct(), self.key, "left_semi")
        return hits.groupBy(self.key).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select(self.key, "_r.*")


def memo_stats(requests: DataFrame, key: str, memo: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """One row: requests, hits, misses, hit_rate (0.0 with no requests),
    memo size before and after.  misses = distinct requested keys not yet in
    the memo and requests without a key; hits = requests - misses; the size
    grows by the new keys."""
    p = prefix
    if memo is None:
        # one pass: every distinct key is a miss, every repeat a hit
        return run_stats(requests, {p: key})
    req = requests.select(key)
    n_req = req.agg(F.count(F.lit(1)).alias("r"))
    new_keys = work_list(req, key, memo).agg(F.count(F.lit(1)).alias("m"), F.count(key).alias("g"))
    before = memo.select(key).where(F.col(key).isNotNull()).dropDuplicates([key]).agg(F.count(F.lit(1)).alias("b"))
    parts = n_req.unionByName(new_keys, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in ("r", "m", "g", "b")])
    return row.select(
        F.col("r").alias(f"{p}requests"),
        (F.col("r") - F.col("m")).alias(f"{p}hits"),
        F.col("m").alias(f"{p}misses"),
        F.coalesce(F.try_divide(F.col("r") - F.col("m"), F.col("r")).cast("double"), F.lit(0.0)).alias(f"{p}hit_rate"),
        F.col("b").alias(f"{p}size_before"),
        (F.col("b") + F.col("g")).alias(f"{p}size_after"),
    )


def run_stats(requests: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Stats of one run without an earlier memo, for several memo levels in
    one aggregate (``{prefix: key column}``): misses are the distinct keys."""
    n = F.count(F.lit(1))
    cols = []
    for p, key in keys.items():
        new = F.count_distinct(F.col(key))
        m = new + F.count_if(F.col(key).isNull())
        cols += [
            n.alias(f"{p}requests"),
            (n - m).alias(f"{p}hits"),
            m.alias(f"{p}misses"),
            F.coalesce(F.try_divide(n - m, n).cast("double"), F.lit(0.0)).alias(f"{p}hit_rate"),
            F.lit(0).cast("long").alias(f"{p}size_before"),
            new.alias(f"{p}size_after"),
        ]
    return requests.agg(*cols)
