"""Shared helpers: table reads, lineage cuts, Arrow batch views of texts.

Rules that hold for every operator here unless its docstring says otherwise:
a null text counts as the empty text, repeated rows are handled one by one,
columns that an operator adds replace columns of the same name, all other
columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Word separators of the contracts: space and U+0009..U+000D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Send the package to the executors and bound the Arrow batches of this session: Python workers hold one batch
    at a time, and a row may be a very long text."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder below ``spark.checkpoint.dir``,
    which all executors share (``session.scratch_folder``)."""
    return scratch_path(spark, f"llm-{name}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: work that follows
    starts from the files, also after executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, m: int):
    """crc32(id as text) mod m; a null id is in class 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % m, F.lit(0))


def bind(value, body):
    """A native let: ``body(v)`` with ``v`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows that hold about ``most`` of what
    ``off`` counts (one row at least)."""
    at, n = 0, len(off) - 1
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1), n)
        yield at, end
        at = end


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most``
    bytes (one row at least), which bounds the temporaries per run."""
    raw, off = utf8(column)
    for at, end in runs(off, most):
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]


def lanes(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian integer (zeros
    beyond the end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    view = np.lib.stride_tricks.as_strided(padded, (len(raw), 8), (1, 1))
    return np.ascontiguousarray(view).view("<u8").ravel()


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
