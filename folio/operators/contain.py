"""Texts that lie within longer ones of their document, found by hashes of stretches of bytes.

A text of n bytes is two stretches of the largest power of two up to n, one at its start and one at its end. Hashes of
stretches of 2, 4, 8, ... bytes at all places of a text come from those of half the length, so a longer text holds a
shorter one where both of its hashes stand at the right distance. Texts move once, to their document; the shorter ones
come as (length, two hashes).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 16
#: A document of more bytes than CELL_BYTES is dealt to up to CELLS cells, each of which meets all its keys; one of more
#: texts than CELL_KEYS has its keys dealt, and its texts sent to each share.
CELL_BYTES, CELLS, CELL_KEYS = 8 << 20, 16, 2_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_31, _29 = np.uint64(31), np.uint64(29)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, z = x * _A, y >> _31
    z ^= y
    z *= _B
    h += z
    np.right_shift(h, _29, out=z)
    h ^= z
    return h


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros beyond the end."""
    return np.ndarray(len(data), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _first(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of at most eight bytes."""
    return _mix(words & np.uint64((1 << 8 * size) - 1) if size < 8 else words, np.full_like(words, size))


def _levels(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Size and hashes of the stretches of 1, 2, 4, ... bytes at all places where one fits."""
    words, size = np.ascontiguousarray(_words(data)), 1
    while size <= min(8, most, len(data)):
        h = _first(words[: len(data) - size + 1], size)
        yield size, h
        size *= 2
    while 8 < size <= min(most, len(data)):
        h = _mix(h[: -(size // 2)], h[size // 2 :])
        yield size, h
        size *= 2


def _stretches(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the stretches of one size at some places, as :func:`_levels` has them."""
    h = _first(words[at[:, None] + np.arange(0, max(size, 8), 8)], min(size, 8))
    while h.shape[1] > 1:
        h = _mix(h[:, 0::2], h[:, 1::2])
    return h[:, 0]


def _size(n: np.ndarray) -> np.ndarray:
    return np.left_shift(1, np.log2(np.maximum(n, 1)).astype(np.int64))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes, and the ends of the texts in them, of about CHUNK bytes each."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i + 1 : j + 1] - at[i]
        i = j


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, hash of the first and of the last stretch of each text."""
    n, head, tail = (np.zeros(len(texts), t) for t in (np.int64, np.uint64, np.uint64))
    for i, j, data, ends in _parts(texts):
        n[i:j] = np.diff(ends, prepend=0)
        size, words = _size(n[i:j]), _words(data)
        for s in np.unique(size).tolist():
            own = np.flatnonzero((size == s) & (n[i:j] > 0))
            step = max(1, CHUNK // s)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                head[i + some], tail[i + some] = _stretches(words, ends[some] - n[i + some], s), _stretches(words, ends[some] - s, s)
    return n, head, tail


_SENT = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("is_text", T.BooleanType()),
    T.StructField("n", T.LongType()), T.StructField("head", T.LongType()), T.StructField("tail", T.LongType()),
])


def _send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text a row with its key and one with the text, or as many as there are cells for them to meet in."""
    for b in batches:
        doc, deal, rows, columns = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5))
        n, head, tail = _keys(b.column(2))
        row = np.arange(len(n))
        # Keys are dealt to rows of a grid, texts to its columns.
        key, text = np.repeat(row, columns), np.repeat(row, rows)
        across, down = (np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c) for r, c in ((key, columns), (text, rows)))
        at = [(head % rows.astype(np.uint64)).astype(np.int64)[key] * columns[key] + across, down * columns[text] + (deal % columns)[text]]
        for what, (r, cell) in enumerate(zip((key, text), at)):
            own = [x[r] if not what else None for x in (n, head.view(np.int64), tail.view(np.int64))]
            hashes = [pa.nulls(len(r), pa.int64()) if x is None else pa.array(x) for x in own]
            ids, texts = b.column(1).take(pa.array(r)), b.column(2).take(pa.array(r)) if what else pa.nulls(len(r), b.column(2).type)
            yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(cell), pa.array(np.full(len(r), bool(what))), *hashes, ids, texts], [*_SENT.names, "id", "t"])


class _Index:
    """Keys of one size of stretch: heads with the lengths that go with them, and whole keys."""

    def __init__(self, size: int, n: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.size = size
        self.whole, self.of = np.unique(_mix(_mix(head, tail), n.astype(np.uint64)), return_inverse=True)
        self.found = np.zeros(len(self.whole), bool)
        order = np.lexsort((n, head))
        head, n = head[order], n[order]
        new = np.ones(len(n), bool)
        new[1:] = (head[1:] != head[:-1]) | (n[1:] != n[:-1])
        self.lengths = n[new]
        self.heads, self.begin, self.many = np.unique(head[new], return_index=True, return_counts=True)
        # A table of first bits rules out most places before keys are looked up.
        bits = min(24, 5 + len(self.heads).bit_length())
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.bits[self.heads >> self.shift] = True

    def probe(self, h: np.ndarray, doc: np.ndarray, ends: np.ndarray, n: np.ndarray) -> None:
        k = h ^ doc[: len(h)]
        at = np.flatnonzero(self.bits.take((k >> self.shift).view(np.int64)))
        k, text = k[at], np.searchsorted(ends, at, "right")
        i = np.minimum(np.searchsorted(self.heads, k), len(self.heads) - 1)
        hit = np.flatnonzero((self.heads[i] == k) & (at + self.size <= ends[text]))
        at, k, text, i = at[hit], k[hit], text[hit], i[hit]
        many = self.many[i]
        r = np.repeat(np.arange(len(at)), many)
        length = self.lengths[np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + self.begin[i][r]]
        fits = np.flatnonzero((at[r] + length <= ends[text[r]]) & (length < n[text[r]]))
        r, length = r[fits], length[fits]
        last = at[r] + length - self.size
        whole = _mix(_mix(k[r], h[last] ^ doc[last]), length.astype(np.uint64))
        i = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
        self.found[i[self.whole[i] == whole]] = True


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and ids of the keys that longer texts of the cell hold; keys come first."""
    keys: list[pa.RecordBatch] = []
    index: dict[int, tuple[_Index, np.ndarray]] | None = None
    for b in batches:
        texts_from = len(b) - b.column(2).true_count
        if texts_from:
            keys.append(b.slice(0, texts_from).select([0, 3, 4, 5, 6]))
        if texts_from == len(b) or not keys:
            continue
        if index is None:
            have = pa.Table.from_batches(keys).combine_chunks()
            doc, n, head, tail = (have.column(i).to_numpy() for i in range(4))
            head, tail, size, index = (head ^ doc).view(np.uint64), (tail ^ doc).view(np.uint64), _size(n), {}
            for s in np.unique(size[n > 0]).tolist():
                own = np.flatnonzero((size == s) & (n > 0))
                index[s] = _Index(s, n[own], head[own], tail[own]), own
        rest = b.slice(texts_from)
        docs = rest.column(0).to_numpy().view(np.uint64)
        for i, j, data, ends in _parts(rest.column(7)):
            n = np.diff(ends, prepend=0)
            doc = np.repeat(docs[i:j], n)
            for s, h in _levels(data, min(max(index, default=0), int(n.max()))):
                if s in index:
                    index[s][0].probe(h, doc, ends, n)
    if index:
        for x, own in index.values():
            rows = pa.array(own[x.found[x.of]])
            yield pa.RecordBatch.from_arrays([have.column(i).combine_chunks().take(rows) for i in (0, 4)], ["doc", "id"])


def within(rows: DataFrame, doc: str, id: str, text: Column) -> DataFrame:  # noqa: A002
    """``id`` of the rows whose text lies within a longer one of the same ``doc``; rows without either are left out.

    Texts are the same if they agree in length and in two 64-bit hashes that cover them.
    """
    rows = rows.where(F.col(doc).isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy(F.xxhash64(doc).alias("doc")).agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("k"))
    sizes = sizes.where(f"b > {CELL_BYTES} OR k > {CELL_KEYS}").selectExpr("doc", f"CAST(ceil(k / {CELL_KEYS}) AS BIGINT) AS key_cells", f"CAST(least({CELLS}, ceil(b / {CELL_BYTES})) AS BIGINT) AS text_cells")
    t = rows.select(F.xxhash64(doc).alias("doc"), F.col(id).alias("id"), text.alias("t"), F.expr(f"xxhash64(`{id}`) & {2**62 - 1}").alias("deal"))
    t = t.join(F.broadcast(sizes), "doc", "left").select("doc", "id", "t", "deal", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("key_cells", "text_cells")])
    kind = rows.schema[id].dataType
    sent = t.mapInArrow(_send, T.StructType([*_SENT.fields, T.StructField("id", kind), T.StructField("t", T.StringType())]))
    met = sent.repartition("doc", "cell").sortWithinPartitions("is_text").mapInArrow(_meet, T.StructType([T.StructField("doc", T.LongType()), T.StructField("id", kind)]))
    return met.distinct().select(F.col("id").alias(id))
