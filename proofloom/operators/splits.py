"""Deterministic topic-stratified train/dev/test split (section 2.4).

Order inside a topic is by ``sha256("<seed>:<id>")`` then id: deterministic
and independent of partitioning (the exact Python shuffle order is not a
goal; determinism and quotas are).

Rows are numbered inside their topic over range partitions (``numbering``), so
a hot topic, a hot id and a row that stands many times all spread over tasks.
Every row keeps its place: a null topic is a topic, and rows without an id are
shuffled among the others of their topic by a digest of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_column
from .numbering import numbered

TRAIN, DEV, TEST = "train", "dev", "test"


def check_ratios(train: float, dev: float, test: float) -> None:
    total = train + dev + test
    if not 1 - 1e-6 <= total <= 1 + 1e-6:
        raise ValueError(f"train, dev and test shares add up to {total:g}, not to 1")


def shuffle_key(item_id: Column, seed: int) -> Column:
    """Null for a null id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), item_id.cast("string")), 256)


def quotas(n: Column, train_ratio: float, dev_ratio: float) -> tuple[Column, Column]:
    """(n_train, n_dev) as used for slicing; the rest of the topic is test.
    ``int(n * ratio)`` on doubles, raised to 1 for topics of 3 or more;
    1 item -> train; 2 items -> one train, one dev."""
    nt = F.floor(n.cast("double") * F.lit(float(train_ratio))).cast("long")
    nd = F.floor(n.cast("double") * F.lit(float(dev_ratio))).cast("long")
    n_train = F.when(n >= 3, F.greatest(F.lit(1), nt)).otherwise(F.lit(1))
    n_dev = F.when(n >= 3, F.greatest(F.lit(1), nd)).when(n == 2, F.lit(1)).otherwise(F.lit(0))
    return n_train, n_dev


def split_quotas(items: DataFrame, train_ratio: float = 0.6, dev_ratio: float = 0.2, test_ratio: float = 0.2, topic: str = "topic") -> DataFrame:
    check_ratios(train_ratio, dev_ratio, test_ratio)
    counts = items.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    n_train, n_dev = quotas(F.col("n"), train_ratio, dev_ratio)
    return counts.select(
        topic, "n", n_train.alias("n_train"), n_dev.alias("n_dev"),
        (F.col("n") - n_train - n_dev).alias("n_test"),
    )


def assign_splits(
    items: DataFrame,
    train_ratio: float = 0.6,
    dev_ratio: float = 0.2,
    test_ratio: float = 0.2,
    seed: int = 42,
    *,
    id_col: str = "id",
    topic: str = "topic",
    seq: str | None = None,
) -> DataFrame:
    """Adds ``split`` (train/dev/test) and ``topic_rank`` (1-based).

    Rows of one id are ordered by ``seq`` (a column that is unique within an
    id) or by a digest of their own columns: no partition position decides, so
    a frame in another layout gives the same rows.  Rows equal in every column
    are interchangeable.  The numbered rows are written to the shared folder
    when this is called."""
    check_ratios(train_ratio, dev_ratio, test_ratio)
    rank, n = free_column(items, "topic_rank_"), free_column(items, "topic_size_")
    digest = F.col(seq) if seq else F.xxhash64(*[F.col(f"`{c}`") for c in items.columns])
    # a row without an id is dealt by its digest, like the others by their id
    key = F.coalesce(shuffle_key(F.col(id_col), seed), shuffle_key(digest, seed))
    rows = numbered(items, [key, F.col(id_col), digest], rank, group=[topic], total=n)
    n_train, n_dev = quotas(F.col(n), train_ratio, dev_ratio)
    place = F.col(rank) + 1
    split = F.when(place <= n_train, F.lit(TRAIN)).when(place <= n_train + n_dev, F.lit(DEV)).otherwise(F.lit(TEST))
    return rows.select(*[F.col(f"`{c}`") for c in items.columns if c not in ("topic_rank", "split")], place.alias("topic_rank"), split.alias("split"))


def create_splits(
    items: DataFrame,
    train_ratio: float = 0.6,
    dev_ratio: float = 0.2,
    test_ratio: float = 0.2,
    seed: int = 42,
    **kw,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, dev, test) frames over one written assignment."""
    tagged = assign_splits(items, train_ratio, dev_ratio, test_ratio, seed, **kw)
    return tuple(tagged.where(F.col("split") == s).drop("split") for s in (TRAIN, DEV, TEST))


def split_summary(tagged: DataFrame, topic: str = "topic") -> DataFrame:
    """Split sizes and per-split topic counts: ``GROUPING SETS ((split), (split, topic))``."""
    df = tagged.select(F.col("split"), F.col(topic).alias("topic"))
    s, t = F.col("split"), F.col("topic")
    return df.groupingSets([[s], [s, t]], s, t).agg(F.count(F.lit(1)).alias("n"))
