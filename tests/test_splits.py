"""Stratified split invariants (2.4), including a hot topic."""

import pytest
from pyspark.sql import functions as F

from proofloom.operators import splits as SP


def _items(spark, sizes):
    rows = [(f"{t}_{i}", t) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, topic string")


def test_split_invariants(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 10, "e": 29, "hot": 3000}
    df = SP.assign_splits(_items(spark, sizes))
    rows = df.collect()
    assert len(rows) == sum(sizes.values()) == len({r.id for r in rows})
    per = {}
    for r in rows:
        per.setdefault(r.topic, {}).setdefault(r.split, 0)
        per[r.topic][r.split] += 1
        assert 1 <= r.topic_rank <= sizes[r.topic]
    assert per["a"] == {"train": 1}
    assert per["b"] == {"train": 1, "dev": 1}
    assert per["c"] == {"train": 1, "dev": 1, "test": 1}
    assert per["d"] == {"train": 6, "dev": 2, "test": 2}
    assert per["e"] == {"train": int(29 * 0.6), "dev": int(29 * 0.2), "test": 29 - int(29 * 0.6) - int(29 * 0.2)}
    assert per["hot"] == {"train": 1800, "dev": 600, "test": 600}
    # ranks inside a topic are a permutation of 1..n
    hot = sorted(r.topic_rank for r in rows if r.topic == "hot")
    assert hot == list(range(1, 3001))


def test_rank_follows_hash_order(spark):
    import hashlib

    df = SP.assign_splits(_items(spark, {"t": 50}))
    got = [r.id for r in df.orderBy("topic_rank").collect()]
    want = sorted((f"t_{i}" for i in range(50)), key=lambda x: (hashlib.sha256(f"42:{x}".encode()).hexdigest(), x))
    assert got == want


def test_deterministic_and_seeded(spark):
    it = _items(spark, {"t": 40})
    a = {r.id: r.split for r in SP.assign_splits(it).collect()}
    b = {r.id: r.split for r in SP.assign_splits(it.repartition(7)).collect()}
    c = {r.id: r.split for r in SP.assign_splits(it, seed=7).collect()}
    assert a == b and a != c


def test_ratio_check(spark):
    with pytest.raises(ValueError):
        SP.assign_splits(_items(spark, {"t": 3}), 0.5, 0.2, 0.2)


def test_quota_uses_doubles(spark):
    q = {r.topic: r for r in SP.split_quotas(_items(spark, {"t": 100}), 0.29, 0.21, 0.5).collect()}
    assert q["t"].n_train == int(100 * 0.29) == 28


def test_hot_copies_of_one_id(spark):
    rows = [("dup", "t")] * 2000 + [(f"u{i}", "t") for i in range(1000)]
    df = SP.assign_splits(spark.createDataFrame(rows, "id string, topic string"))
    got = df.collect()
    assert sorted(r.topic_rank for r in got) == list(range(1, 3001))
    counts = {}
    for r in got:
        counts[r.split] = counts.get(r.split, 0) + 1
    assert counts == {"train": 1800, "dev": 600, "test": 600}
    # the copies occupy one contiguous block of ranks
    dup = sorted(r.topic_rank for r in got if r.id == "dup")
    assert dup == list(range(dup[0], dup[0] + 2000))


def test_repeated_ids_in_any_layout(spark):
    """Layouts of 1, 7 and 16 partitions give the same rows, and none is lost."""
    from pyspark.sql import functions as F

    from proofloom.operators import splits as SP

    rows = spark.range(4000).select((F.col("id") % 900).cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("topic"), F.col("id").alias("n"))
    found = []
    for parts in (1, 7, 16):
        out = SP.assign_splits(rows.repartition(parts), 0.6, 0.2, 0.2, seq="n").select("n", "topic", "topic_rank", "split").collect()
        found.append(sorted(map(tuple, out)))
    assert len(found[0]) == 4000 and found[0] == found[1] == found[2]
    for topic in ("a", "b"):
        ranks = sorted(r for _, t, r, _ in found[0] if t == topic)
        assert ranks == list(range(1, len(ranks) + 1))
    same = spark.range(500).select(F.lit("x").alias("id"), F.lit("t").alias("topic")).repartition(5)
    assert sorted(r.topic_rank for r in SP.assign_splits(same).collect()) == list(range(1, 501))


def test_null_ids_and_topics_and_clashing_columns_lose_no_row(spark):
    """Ten rows in, ten out: null topics are one topic, null ids are dealt by
    their own rows, and columns named like working columns come back."""
    rows = [(f"i{i}" if i % 4 else None, "t" if i % 3 else None, i, "keep") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, topic string, _key int, _at string").withColumn("_tie", F.lit(1)).withColumn("split", F.lit("old"))
    got = SP.assign_splits(df).collect()
    assert sorted(r._key for r in got) == list(range(10)) and {r._at for r in got} == {"keep"} and {r._tie for r in got} == {1}
    for topic, n in (("t", 6), (None, 4)):
        part = [r for r in got if r.topic == topic]
        assert sorted(r.topic_rank for r in part) == list(range(1, n + 1))
        want = sorted(["train"] * max(1, int(n * 0.6)) + ["dev"] * max(1, int(n * 0.2)) + ["test"] * (n - max(1, int(n * 0.6)) - max(1, int(n * 0.2))))
        assert sorted(r.split for r in part) == want
    frames = SP.create_splits(df)
    assert sum(f.count() for f in frames) == 10
    assert sum(r.n for r in SP.split_summary(SP.assign_splits(df)).collect() if r.topic is None and r.split) >= 4
    assert SP.assign_splits(df.limit(0)).count() == 0


def test_numbering_spreads_a_hot_group(spark):
    """A third of the rows equal in every column still lie in many tasks."""
    import glob
    import os

    from proofloom.operators.numbering import numbered
    from proofloom.session import scratch_folder

    df = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"), F.lit("g").alias("g"), F.lit(0).alias("_total"))
    out = numbered(df, [F.col("k")], "n", group=["g"], total="size")
    rows = out.collect()
    assert sorted(r.n for r in rows) == list(range(9000)) and {r.size for r in rows} == {9000}
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] == sorted(r.k for r in rows)
    written = max(glob.glob(f"{scratch_folder(spark)}/numbered-*"), key=os.path.getmtime)
    hot = spark.read.parquet(written).where("k = -1").select(F.input_file_name().alias("f")).distinct().count()
    assert hot >= 2 and len(glob.glob(f"{written}/part-*")) >= 6
    assert "_total" in out.columns
    plain = numbered(spark.range(100).repartition(7), [], "n").collect()
    assert sorted(r.n for r in plain) == list(range(100)) and sorted(r.id for r in plain) == list(range(100))
