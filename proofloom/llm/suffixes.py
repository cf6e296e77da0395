"""10. Suffix-array dedup: removes every byte that lies in a ``length``-byte
string which also starts in a document with a smaller doc_id.

Which strings can repeat is found by anchors.  Every window of ``length``
bytes is named by its leftmost smallest 16-byte gram (by hash); equal windows
have equal anchors at equal offsets.  Only anchors whose gram occurs in two
documents go on.  For those, the bytes of the windows that an anchor names
are one record, and records of one gram meet in one bucket.

In a bucket, records with the same bytes are one; the smallest document keeps
them.  The suffixes that start at the anchors of what remains are sorted by
the deep-shallow method: a multikey quicksort (eight bytes as one character)
down to a shallow depth, then one blind trie per group that is still tied.  The
same sort orders the bytes before the anchors, read backwards.  With the
longest common prefixes of neighbours in both orders, two windows at offset o
are equal exactly where both agree to the depths length - o and o.

Spark deals anchors and records to buckets by gram, texts to parts by doc_id;
the number of both grows with the bytes.  Before each shuffle a batch keeps one entry per gram
(or per record) of its smallest document and resolves its other documents
itself, so a gram that a third of all documents hold sends one entry per batch
only.  Texts are shuffled once: both times they are needed they are grouped by
part in the same way.

A gram with very many different surroundings would still fill its bucket.  The
anchors' shuffle also counts, for each bucket, the records it would get; where
they exceed ``hot_load``, the bucket's records are sent as single windows
instead, each to the bucket of its own bytes.  Equal windows still meet, and no
bucket then gets more than one record per block and distinct window.  The list of such
buckets holds at most (records / hot_load) numbers.

Null text: empty.  Rows with one doc_id are one document to each other: they
remove nothing from one another, and each loses its own bytes.  Rows without a doc_id keep all bytes, and
take none from others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, lanes, small_batches, table

GRAM = 16
SHALLOW = 24
PART_BYTES = 16 << 20  # text for each part and bucket
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- anchors ---------------------------------------------------------------


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """48-bit hash of the GRAM bytes from each position on (zeros beyond the
    end).  It chooses and groups; bytes decide what is equal."""
    x = lanes(raw)
    y = np.concatenate([x[8:], np.zeros(min(8, len(x)), np.uint64)])
    h = x * M1
    h ^= h >> np.uint64(29)
    h += y * M2
    h ^= h >> np.uint64(32)
    h *= M1
    return (h ^ (h >> np.uint64(31))) & np.uint64(0xFFFFFFFFFFFF)


def anchors(raw: np.ndarray, off: np.ndarray, length: int):
    """(document, anchor, first window start, last window start, hash) of all
    runs of windows with one anchor, for documents laid end to end."""
    none = np.zeros(0, np.int64)
    span = length - GRAM + 1  # gram positions in a window
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64)
    h = gram_hashes(raw)
    value, at = (h >> np.uint64(16)).astype(np.uint32), np.arange(len(h), dtype=np.int32)
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = value[:-step], value[step:]
        at = np.where(right < left, at[step:], at[:-step])
        value = np.minimum(left, right)
        width += step
    sizes = np.diff(off)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(raw) - length + 1)
    whole = start + length <= off[doc[: len(start)] + 1]
    start = start[whole]
    at = at[: len(whole)][whole].astype(np.int64)
    if not len(start):
        return none, none, none, none, none.view(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(start) - 1]])
    return doc[start[new]], at[new], start[new], start[last], h[at[new]]


# --- deep-shallow sort -----------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, common prefix of each with its predecessor) by a blind trie:
    inner nodes hold a depth and branch on one byte (-1: the end), leaves hold
    the numbers of equal strings.  A descent looks at branching bytes only; one
    comparison with the leaf it ends in shows where the new string leaves."""
    root: list | tuple = ("leaf", [0])
    for n in range(1, len(strings)):
        s = strings[n]
        node = root
        while node[0] != "leaf":
            byte = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(n)
            continue
        up, node = None, root
        while node[0] != "leaf" and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        mine = s[depth] if depth < len(s) else -1
        if node[0] == depth:
            node[1][mine] = ("leaf", [n])
            continue
        split = (depth, {(other[depth] if depth < len(other) else -1): node, mine: ("leaf", [n])})
        if up is None:
            root = split
        else:
            up[1][s[up[0]]] = split
    order, lcp, todo = [], [], [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if node[0] == "leaf":
            size = len(strings[node[1][0]])
            order += node[1]
            lcp += [shared] + [size] * (len(node[1]) - 1)
        else:
            children = [node[1][b] for b in sorted(node[1])]
            todo += [(c, node[0] if i else shared) for i, c in reversed(list(enumerate(children)))]
    return order, lcp


def deep_shallow(group: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and the common prefix of each
    with its predecessor (-1 at the start of a group)."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n, np.int64)
    g = group[order]
    lcp[0:1] = -1
    lcp[1:][g[1:] != g[:-1]] = -1
    tied = np.concatenate([[False], g[1:] == g[:-1]])  # with its predecessor, so far
    head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), np.uint8).reshape(n, shallow) if n else np.zeros((0, shallow), np.uint8)
    for depth in range(0, shallow, 8):
        run = np.cumsum(~tied)
        busy = tied.copy()
        busy[:-1] |= tied[1:]
        rows = np.flatnonzero(busy)
        if not len(rows):
            return order, lcp
        piece = np.ascontiguousarray(head[order[rows], depth : depth + 8]).view(">u8").ravel()
        by = np.lexsort((sizes[order[rows]], piece, run[rows]))
        order[rows], piece = order[rows][by], piece[by]
        word = np.zeros(n, np.uint64)
        word[rows] = piece
        left, right = order[:-1], order[1:]
        split = tied[1:] & ((word[1:] != word[:-1]) | (np.minimum(sizes[left], sizes[right]) < depth + 8))
        at = np.flatnonzero(split) + 1
        x = word[at] ^ word[at - 1]
        same = np.full(len(at), 8)
        for b in range(8):
            same = np.minimum(same, np.where((x >> np.uint64(56 - 8 * b)) & np.uint64(255), b, 8))
        shorter = np.minimum(sizes[order[at]], sizes[order[at - 1]])
        equal = (x == 0) & (sizes[order[at]] == sizes[order[at - 1]])
        lcp[at] = np.where(equal, shorter, np.minimum(depth + same, shorter))
        tied[at] = False
    edges = np.flatnonzero(np.concatenate([~tied, [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            rows = order[a:b]
            by, shared = blind_trie_order([strings[i] for i in rows])
            order[a:b] = rows[by]
            lcp[a + 1 : b] = shared[1:]
    return order, lcp


def covered_offsets(group, doc, left, right, length):
    """For records (gram group, document, bytes before the anchor, bytes from
    the anchor on): arrays (record, offset) of the windows that a smaller
    document's record of the group holds too."""
    n = len(doc)
    lefts = np.fromiter(map(len, left), np.int64, n)
    rights = np.fromiter(map(len, right), np.int64, n)
    orders = []
    for strings in (right, [x[::-1] for x in left]):
        order, lcp = deep_shallow(group, strings)
        orders.append((order, lcp))
    out = []
    for o in range(int(lefts.max(initial=-1)) + 1):
        fits = (lefts >= o) & (rights >= length - o)
        if fits.sum() < 2:
            continue
        classes = []
        for (order, lcp), depth in zip(orders, (length - o, o)):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum((lcp < depth) | (lcp < 0))
            classes.append(c)
        rows = np.flatnonzero(fits)
        key = classes[0][rows] * (n + 2) + classes[1][rows]
        by = np.lexsort((doc[rows], key))
        key, rows = key[by], rows[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(doc[rows[first]], np.diff(np.concatenate([first, [len(key)]])))
        hit = rows[doc[rows] > least]
        out.append((hit, np.full(len(hit), o)))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- Spark stages ----------------------------------------------------------
#
# What moves between stages is packed: one row holds arrays of many entries
# for one bucket (a hash of the gram) or one part (a hash of the document).


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value."""
    import zstandard

    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(x) for x in raw], np.int64).tobytes() + b"".join(raw))


def unpack(column: pa.ChunkedArray, *kinds) -> list:
    """The arrays of all packed values of a column, each joined; a kind of
    None gives bytes, 6 gives the numbers of six bytes each."""
    import zstandard

    parts: list[list] = [[] for _ in kinds]
    for value in column.to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(value)
        ends = np.cumsum(np.frombuffer(raw, np.int64, len(kinds))) + 8 * len(kinds)
        for own, x, y in zip(parts, [8 * len(kinds), *ends.tolist()], ends.tolist()):
            own.append(raw[x:y])
    return [b"".join(x) if k is None else widened(b"".join(x)) if k == 6 else np.frombuffer(b"".join(x), k) for x, k in zip(parts, kinds)]


def narrowed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def part_of(ids, parts: int):
    """A document's part, in numpy as in SQL (``part_column``)."""
    return np.mod(ids, 2147483647) * 48271 % 2147483647 % parts


def part_column(parts: int):
    """Documents by a hash of the id; without one, by a hash of the text."""
    return F.coalesce(F.expr(f"pmod(doc_id, 2147483647L) * 48271 % 2147483647 % {parts}"), F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int")


SENT = pa.schema([("bucket", pa.int32()), ("told", pa.bool_()), ("packed", pa.binary())])
TOLD = pa.schema([("part", pa.int32()), ("packed", pa.binary())])


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)


def _by(place: np.ndarray, make) -> list[tuple[int, bytes]]:
    """(place, packed) for each place, from the rows that go there."""
    order = np.argsort(place, kind="stable")
    cuts = _cuts(place[order])
    return [(int(place[order[x]]), make(order[x:y])) for x, y in zip(cuts[:-1], cuts[1:])]


def _sent(rows: list[tuple[int, bool, bytes]]) -> pa.Table:
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(SENT.names)}, SENT)


def _told(group: pa.Table, rows: list[tuple[int, bytes]]) -> pa.Table:
    """Rows for parts: those that passed through, and new ones."""
    own = group.filter(group["told"])
    found = pa.table({"part": [r[0] for r in rows], "packed": [r[1] for r in rows]}, TOLD)
    return pa.concat_tables([pa.table([own["bucket"], own["packed"]], TOLD), found])


def surroundings(raw: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each distinct gram (ascending), how many different surroundings it
    has in the block, by the eight bytes on either side."""
    if not len(at):
        return np.zeros(0, np.int64)
    x = lanes(raw)
    near = x[np.maximum(at - 8, 0)] * M1 ^ x[np.minimum(at + GRAM, len(x) - 1)] * M2
    order = np.lexsort((near, key))
    k, n = key[order], near[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
    return np.add.reduceat(new.astype(np.int64), _cuts(k)[:-1])


def send_anchors(length: int, parts: int):
    """Grams by bucket, each with the smallest document of the block that
    holds it, and how many records the block may send there; documents that
    share a gram within the block are told now."""

    def send(batches):
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, raw, off in blocks(batch.column(1)):
                doc, at, _, _, key = anchors(raw, off, length)
                load = surroundings(raw, at, key)
                ids = names[a:b][doc]
                order = np.lexsort((ids, key))
                ids, key = ids[order], key[order]
                cuts = _cuts(key)
                first = cuts[:-1]
                told = np.repeat(ids[first] != ids[cuts[1:] - 1], np.diff(cuts)) if len(key) else np.zeros(0, bool)
                own, shared = ids[told], key[told]
                rows = [(p, True, x) for p, x in _by(part_of(own, parts), lambda r: pack(own[r], narrowed(shared[r])))]  # noqa: B023
                ids, key = ids[first], key[first]
                rows += [(p, False, x) for p, x in _by((key % np.uint64(parts)).astype(np.int64), lambda r: pack(ids[r], narrowed(key[r]), load[r].sum(keepdims=True)))]  # noqa: B023
                yield from _sent(rows).to_batches()

    return send


def meet_anchors(parts: int, hot_load: int):
    """Which documents share which grams, by part; for a bucket that would get
    more than ``hot_load`` records, a row with part -1 - bucket."""

    def meet(group: pa.Table) -> pa.Table:
        ids, key, load = unpack(group.filter(pa.compute.invert(group["told"]))["packed"], np.int64, 6, np.int64)
        order = np.lexsort((ids, key))
        ids, key = ids[order], key[order]
        cuts = _cuts(key)
        many = np.repeat(ids[cuts[:-1]] != ids[cuts[1:] - 1], np.diff(cuts)) if len(key) else np.zeros(0, bool)
        ids, key = ids[many], key[many]
        hot = [(-1 - group["bucket"][0].as_py(), b"")] if load.sum() > hot_load else []
        return _told(group, hot + _by(part_of(ids, parts), lambda r: pack(ids[r], narrowed(key[r]))))

    return meet


def first_of_equal(ids, keys, data: list[bytes]):
    """Which records are the smallest document's among those with the same
    gram and bytes (all its places), and which belong to a larger document."""
    code = pa.array(data, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((ids, code, keys))
    k, c = keys[order], code[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    least = np.repeat(ids[order][first], np.diff(np.concatenate([first, [len(order)]])))
    later = np.zeros(len(order), bool)
    later[order] = ids[order] > least
    return np.flatnonzero(~later), later


def bases(names: np.ndarray, texts: list[str]) -> np.ndarray:
    """Where each row's text begins in its document's coordinates: 0, or,
    should a doc_id stand on rows with other texts, after the texts before it
    (in their own order).  A part holds all rows of an id."""
    out = np.zeros(len(names), np.int64)
    order = np.argsort(names, kind="stable")
    cuts = _cuts(names[order])
    for k in np.flatnonzero(np.diff(cuts) > 1):
        rows = order[cuts[k] : cuts[k + 1]]
        at, begin = 0, {}
        for t in sorted({texts[i] for i in rows}):
            begin[t] = at
            at += len(t.encode()) + 1
        out[rows] = [begin[texts[i]] for i in rows]
    return out


def window_hashes(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each start on."""
    x, h = lanes(raw), np.zeros(len(start), np.uint64)
    for k in (*range(0, length - 8, 8), length - 8):
        h = (h ^ x[start + k]) * M1
        h ^= h >> np.uint64(29)
    return h


def by_window(raw, doc, at, low, high, key, length: int, parts: int, hot: np.ndarray):
    """The records with their buckets; those of hot buckets cut into single
    windows, each in the bucket of its own bytes."""
    bucket = (key % np.uint64(parts)).astype(np.int64)
    if not len(hot):
        return doc, at, low, high, key, bucket
    split = hot[np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)] == bucket
    times = np.where(split, high - low + 1, 1)
    row = np.repeat(np.arange(len(doc)), times)
    step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    cut_up, start = split[row], low[row] + step
    bucket = bucket[row]
    bucket[cut_up] = (window_hashes(raw, start[cut_up], length) % np.uint64(parts)).astype(np.int64)
    return doc[row], at[row], start, np.where(cut_up, start, high[row]), key[row], bucket


def send_records(length: int, parts: int, hot: np.ndarray):
    """From a part's texts and shared grams: records of the shared anchors by
    bucket of their gram (of their window, in ``hot`` buckets).  Within a
    block, equal records of larger documents are resolved to spans at once."""

    def send(texts: pa.Table, told: pa.Table) -> pa.Table:
        spread = lambda k, d: k ^ (d.astype(np.uint64) * M2)
        shared = np.unique(spread(*unpack(told["packed"], np.int64, 6)[::-1]))
        rows = []
        texts = texts.filter(pa.compute.is_valid(texts["doc_id"]))
        begin = bases(texts["doc_id"].to_numpy(), texts["text"].to_pylist()) if len(texts) else None
        done = 0
        for batch in texts.to_batches():
            names, base = batch.column("doc_id").to_numpy(zero_copy_only=False), begin[done : done + len(batch)]
            done += len(batch)
            for a, b, raw, off in blocks(batch.column("text")):
                doc, at, low, high, key = anchors(raw, off, length)
                mine = spread(key, names[a:b][doc])
                keep = np.zeros(len(mine), bool)
                if len(shared):
                    keep = shared[np.minimum(np.searchsorted(shared, mine), len(shared) - 1)] == mine
                doc, at, low, high, key = (x[keep] for x in (doc, at, low, high, key))
                if not len(doc):
                    continue
                doc, at, low, high, key, bucket = by_window(raw, doc, at, low, high, key, length, parts, hot)
                whole = raw.tobytes()
                data = [whole[x:y] for x, y in zip(low.tolist(), (high + length).tolist())]
                ids, heads, lefts = names[a:b][doc], (low - off[doc] + base[a:b][doc]).astype(np.int32), (at - low).astype(np.uint8)
                sizes = (high - low + length).astype(np.int32)
                first, later = first_of_equal(ids, key, data)
                if later.any():
                    rows.append((int(part_of(ids[:1], parts)[0]), True, pack(*joined(ids[later], heads[later], (heads + sizes)[later]))))

                def record(r):
                    f = first[r]  # noqa: B023
                    return pack(ids[f], narrowed(key[f]), heads[f], sizes[f].astype(np.uint16), lefts[f], b"".join([data[i] for i in f]))  # noqa: B023

                rows += [(p, False, x) for p, x in _by(bucket[first], record)]
        return _sent(rows)

    return send


def meet_records(length: int, parts: int):
    """Windows of a bucket's records that a smaller document has too, as spans
    by part."""

    def meet(group: pa.Table) -> pa.Table:
        sent = group.filter(pa.compute.invert(group["told"]))
        ids, key, heads, sizes, lefts, whole = unpack(sent["packed"], np.int64, 6, np.int32, np.uint16, np.uint8, None)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        data = [whole[x:y] for x, y in zip([0, *ends], ends)]
        first, later = first_of_equal(ids, key, data)
        spans = [(ids[later], heads[later], (heads + sizes)[later].astype(np.int32))]
        # Grams of one document are done.
        by = first[np.argsort(key[first], kind="stable")]
        cuts = _cuts(key[by])
        one = np.minimum.reduceat(ids[by], cuts[:-1]) == np.maximum.reduceat(ids[by], cuts[:-1]) if len(by) else np.zeros(0, bool)
        gram = np.repeat(np.arange(len(one)), np.diff(cuts))
        rest = ~np.repeat(one, np.diff(cuts))
        r, gram = by[rest], gram[rest]
        if len(r):
            left, right = [data[i][: lefts[i]] for i in r], [data[i][lefts[i] :] for i in r]
            hit, offset = covered_offsets(gram, ids[r], left, right, length)
            start = (heads[r[hit]] + lefts[r[hit]] - offset).astype(np.int32)
            spans.append((ids[r[hit]], start, start + np.int32(length)))
        doc, low, high = joined(*(np.concatenate(x) for x in zip(*spans)))
        return _told(group, _by(part_of(doc, parts), lambda r: pack(doc[r], low[r], high[r])))

    return meet


def joined(doc, low, high):
    """Spans of each document merged where they touch, ordered."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order].astype(np.int64), high[order].astype(np.int64)
    if not len(doc):
        return doc, low.astype(np.int32), high.astype(np.int32)
    # Ends so far within the document: documents are laid far apart.
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    apart = rank * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + apart)
    new = np.concatenate([[True], low[1:] + apart[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], low[first].astype(np.int32), (reach[last] - apart[last]).astype(np.int32)


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def remove_spans(texts: pa.Table, told: pa.Table) -> pa.Table:
    """(doc_id, n_bytes, spans, kept) of a part's documents."""
    doc, low, high = joined(*unpack(told["packed"], np.int64, np.int32, np.int32))
    rows, names, values = [], texts["doc_id"].to_pylist(), texts["text"].to_pylist()
    known = [i for i, n in enumerate(names) if n is not None]
    begin = dict(zip(known, bases(np.array([names[i] for i in known], np.int64), [values[i] for i in known]).tolist()))
    for i, (name, text) in enumerate(zip(names, values)):
        raw, base = text.encode(), begin.get(i, 0)
        a, b = (0, 0) if name is None else np.searchsorted(doc, [name, name + 1])
        runs = [(x - base, y - base) for x, y in zip(low[a:b].tolist(), high[a:b].tolist()) if base <= x < base + len(raw)]
        kept = b"".join(raw[x:y] for x, y in zip([0, *(h for _, h in runs)], [*(l for l, _ in runs), len(raw)])) if runs else raw
        rows.append({"doc_id": name, "n_bytes": len(raw), "spans": [{"start": x, "end": y} for x, y in runs], "kept": kept})
    return pa.Table.from_pylist(rows, KEPT)


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", part_bytes: int = PART_BYTES, hot_load: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs: start, end in bytes), kept (the
    remaining bytes) of every row.  ``length`` is from 24 to 200.  A bucket is
    hot above ``hot_load`` records; by default that is one for 12 bytes of
    ``part_bytes``, some one and a half times the mean at 50 bytes."""
    if not 24 <= length <= 200:
        raise ValueError("length must be from 24 to 200 bytes")
    small_batches(docs.sparkSession, 500)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-total // part_bytes))
    sent, told = "bucket int, told boolean, packed binary", "part int, packed binary"
    limit = part_bytes // 12 if hot_load is None else hot_load
    shared = cut(d.mapInArrow(send_anchors(length, parts), sent).groupBy("bucket").applyInArrow(meet_anchors(parts, limit), told), "shared-grams")
    hot = np.array(sorted(-1 - r["part"] for r in shared.where("part < 0").select("part").collect()), np.int64)
    shared = shared.where("part >= 0")
    # Texts are shuffled by part once: both cogroups use the same exchange.
    texts = d.select(part_column(parts).alias("part"), "doc_id", "text").groupBy("part")
    records = texts.cogroup(shared.groupBy("part")).applyInArrow(send_records(length, parts, hot), sent)
    spans = records.groupBy("bucket").applyInArrow(meet_records(length, parts), told)
    return texts.cogroup(spans.groupBy("part")).applyInArrow(remove_spans, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
