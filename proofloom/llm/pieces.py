"""8. SentencePiece encoding and decoding with a distinct-chunk table.

In the vocabulary used here no piece holds a whitespace marker after another
character, so no merge crosses the start of a marked word.  A text is cut
before each run of markers, every distinct chunk is segmented once by the
library, and ids are joined back to the chunks' positions by an index gather.

The chunk table lives in the Python worker and serves all batches of a task.
It holds at most ``TABLE_CHUNKS`` chunks and starts anew when full, so memory
is bounded whatever the text.  A global table joined by shuffles would move
every word position twice, some six times the input's bytes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, runs, small_batches, table

TABLE_CHUNKS = 150_000
#: A worker takes the texts of a batch in runs of so many bytes, and the ids in
#: runs of so many: a batch may hold very long texts.
RUN_BYTES, RUN_IDS = 1 << 19, 1 << 17
MARK = "▁"

_processors: dict[str, object] = {}


def processor(model: str):
    """The library's processor, one for each worker and model file."""
    if model not in _processors:
        import sentencepiece

        _processors[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _processors[model]


def words_apart(model: str) -> bool:
    """Whether texts may be cut before each run of markers: no piece holds a
    marker after another character, and texts are normalised to themselves
    but for the marker (with one put in front)."""
    sp = processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(p.lstrip(MARK).count(MARK) for p in pieces):
        return False
    probes = ("a  b ", " a", "ﬁ①Ａ é", "a\tb\n\nc")
    return all(sp.normalize(t) == MARK + t.replace(" ", MARK) for t in probes)


class _Numbers(dict):
    """Chunk -> number; a new chunk gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkTable:
    """Distinct chunk -> ids, filled on demand by the library.  A chunk is
    held without its first marker, which the library puts in front itself."""

    def __init__(self, model: str, most: int = TABLE_CHUNKS):
        self.sp, self.most = processor(model), most
        self.apart = words_apart(model)
        # The library puts no marker before the empty string.
        self.lone = self.sp.encode("a ")[len(self.sp.encode("a")) :]
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def fill(self) -> None:
        """Segment the chunks noted as new."""
        new, self.numbers.new = self.numbers.new, []
        lists = self.sp.encode(new, num_threads=1)
        if "" in new:
            lists[new.index("")] = self.lone
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lengths.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        if not self.apart:
            lists = self.sp.encode(texts, num_threads=1)
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lengths.sum()))
            return np.concatenate([[0], np.cumsum(lengths)]), flat
        if len(self.numbers) > self.most or len(self.ids) > 16 * self.most:
            self.clear()
        chunks = [marked_words(t) for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        if self.numbers.new:
            self.fill()
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        gather = np.arange(int(size.sum())) + np.repeat(self.starts[at] - (ends - size), size)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return offsets, self.ids[gather]


def marked_words(text: str) -> list[str]:
    """The text with a marker in front, cut before each run of markers, each
    chunk without its first marker; a marker character in the text is a marker
    as a space is.  The empty text has no chunk."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1))
    return out


_tables: dict[str, ChunkTable] = {}


def encode_column(text, model: str):
    """Column of ids (array<int>); null counts as the empty text."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        if model not in _tables:
            _tables[model] = ChunkTable(model)
        chunk_table = _tables[model]
        parts = []
        for at, end, _, _ in blocks(column, RUN_BYTES):
            texts = [t or "" for t in column.slice(at, end - at).to_pylist()]
            offsets, ids = chunk_table.encode(texts)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(F.coalesce(text, F.lit("")))


def decode_column(ids, model: str):
    """Column of texts; null ids count as none."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        sp = processor(model)
        out = []
        column = column.fill_null([])
        ids, off = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths())])
        for at, end in runs(off, RUN_IDS):
            part, ends = ids[off[at] : off[end]].tolist(), (off[at : end + 1] - off[at]).tolist()
            texts = sp.decode([part[a:b] for a, b in zip(ends, ends[1:])], num_threads=1)
            out.append(pa.array(texts, pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, as the library's encode()
    gives them without begin and end ids."""
    small_batches(docs.sparkSession, 250)
    return docs.withColumn(ids, encode_column(F.col(text).cast("string"), model))


def decode_documents(docs: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the library's decode() of the ids."""
    small_batches(docs.sparkSession, 250)
    return docs.withColumn(decoded, decode_column(F.col(ids), model))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    model = model or default_model()
    d = decode_documents(encode_documents(docs.select("doc_id", "text"), model), model)
    return d.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
