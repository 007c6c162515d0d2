"""Byte-level BPE encoding of a corpus (problem 8).

Pre-tokens are merged with a hierarchical-bitmap rank queue: one bucket of positions for each merge
rank (a linked list threaded through the positions), and three levels of 64-bit words that say which
buckets hold something. Find-first-set gives the next rank in three steps whatever the length of the
pre-token; an entry whose pair has changed since is stale and skipped. So a pre-token of n bytes takes
O(n) merges of constant cost, where rescanning takes O(n^2).
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the published pre-token pattern of this vocabulary. White space is spelled out, as engines differ in it.
_S = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + "]+"
)
#: Cuts a text where the pattern above always cuts it as well, so that whole words can be looked up.
COARSE = r" ?[^" + _S + r"]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + "]+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
CACHE_ENTRIES = 400_000


class RankQueue:
    """Priority queue over ranks; positions of one rank come out from left to right. The top level is one word of as many
    bits as the ranks need (below 64**3 one of 64)."""

    __slots__ = ("low", "mid", "top", "head", "at", "link")

    def __init__(self, ranks: int = 1 << 18) -> None:
        self.low: dict[int, int] = {}
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.head: dict[int, int] = {}
        self.at: list[int] = []
        self.link: list[int] = []

    def reset(self) -> None:
        self.at.clear()
        self.link.clear()

    def push(self, rank: int, pos: int) -> None:
        w = rank >> 6
        m = rank >> 12
        self.link.append(self.head.get(rank, -1))
        self.head[rank] = len(self.at)
        self.at.append(pos)
        self.low[w] = self.low.get(w, 0) | 1 << (rank & 63)
        self.mid[m] |= 1 << (w & 63)
        self.top |= 1 << m

    def first(self) -> int:
        """The lowest rank that has entries, or -1."""
        if not self.top:
            return -1
        m = (self.top & -self.top).bit_length() - 1
        b = self.mid[m]
        w = m << 6 | (b & -b).bit_length() - 1
        b = self.low[w]
        return w << 6 | (b & -b).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty the bucket of a rank; its positions in ascending order."""
        w = rank >> 6
        m = rank >> 12
        if b := self.low[w] & ~(1 << (rank & 63)):
            self.low[w] = b
        else:
            del self.low[w]
            self.mid[m] &= ~(1 << (w & 63))
            if not self.mid[m]:
                self.top &= ~(1 << m)
        e, at, link = self.head.pop(rank), self.at, self.link
        out = [at[e]]
        while (e := link[e]) >= 0:
            out.append(at[e])
        if len(out) > 1:
            out.sort()
        return out


class Encoder:
    """Encodes pre-tokens by merge ranks; the rank of a merged pair is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        split, pieces = regex.compile(PATTERN).findall, _Memo(lambda p: self._bytes(p))
        self.cache = _Memo(lambda w: b"".join(map(pieces.__getitem__, split(w))))
        self.split = re.compile(COARSE).findall
        self.pieces = pieces

    def _bytes(self, piece: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.piece(piece.encode("utf-8", "replace")))

    def piece(self, b: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, get, queue = len(b), self.ranks.get, self.queue
        if n == 1:
            return [self.ranks[b]]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = nxt[:]  # end[i]: where the part that starts at i ends; 0 once the part is merged into another
        rank = [-1] * n  # rank of the pair that starts at i
        queue.reset()
        for i in range(n - 1):
            r = get(b[i : i + 2], -1)
            if r >= 0:
                rank[i] = r
                queue.push(r, i)
        while (r := queue.first()) >= 0:
            todo = queue.take(r)
            for k, i in enumerate(todo):
                if rank[i] != r:  # stale
                    continue
                j = nxt[i]
                end[i], nxt[i], rank[j] = end[j], nxt[j], -1
                if nxt[j] < n:
                    prv[nxt[j]] = i
                    new = get(b[i : end[nxt[j]]], -1)
                else:
                    new = -1
                rank[i] = new
                lower = False
                if new >= 0:
                    queue.push(new, i)
                    lower = new <= r
                if (h := prv[i]) >= 0:
                    new = get(b[h : end[i]], -1)
                    if new != rank[h]:
                        rank[h] = new
                        if new >= 0:
                            queue.push(new, h)
                            lower = lower or new <= r
                if lower:  # a lower rank has come up: the rest of this bucket waits
                    for p in reversed(todo[k + 1 :]):
                        if rank[p] == r:
                            queue.push(r, p)
                    break
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = nxt[i]
        return out

    def text(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        for memo in (self.cache, self.pieces):
            if len(memo) > CACHE_ENTRIES:
                memo.clear()
        return b"".join(map(self.cache.__getitem__, self.split(text)))


class _Memo(dict):
    """Results of a function of a string; those of long strings are not kept."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> bytes:
        value = self.function(key)
        if len(key) <= 32:
            self[key] = value
        return value


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(r) for a, r in (line.split() for line in data.splitlines() if line)}


_ENCODERS: dict[int, Encoder] = {}


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row, without special tokens; strings of special tokens are ordinary text.

    An empty text and a NULL text both have the empty list; blanks are encoded as they are. A NULL key
    stays NULL, repeated rows stay repeated, extra columns are dropped, an empty table gives an empty table.
    No shuffle: every split is encoded where it is read. The vocabulary file is broadcast (its size is
    checked against MAX_VOCABULARY_BYTES; it doesn't grow with the data).
    """
    data = Path(vocabulary).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(data)} bytes is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)
    mark = hash((vocabulary, len(data)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        if mark not in _ENCODERS:
            _ENCODERS[mark] = Encoder(parse_vocabulary(shared.value))
        enc = _ENCODERS[mark].text
        for batch in batches:
            parts = [enc(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets, total = [0], 0
            for p in parts:
                total += len(p) >> 2
                offsets.append(total)
            values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
