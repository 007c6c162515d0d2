"""Evaluation texts leaking into training text (problem 9).

A BM25 inverted index of the test items is queried with every training passage by block-max WAND. The
threshold loses nothing: a passage with twelve consecutive words of an item scores at least the least sum
of BM25 impacts that any twelve consecutive words of that item have, so each item has its own bound.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.llm.glyphs import words

K1, B = 1.2, 0.75
BLOCK = 16
#: An index is sent to every worker, where it has some 5 bytes for each character of its items; items beyond so many
#: characters are searched in blocks, each with its own index.
MAX_INDEX_TEXT = 24_000_000
#: Runs of words that are looked at together while an index is made.
_AT_ONCE = 100_000


def _hashes(ids: np.ndarray, run: int) -> np.ndarray:
    """64-bit hash of each ``run`` consecutive word numbers."""
    out = np.zeros(max(0, len(ids) - run + 1), np.uint64)
    factor = 1
    for k in range(run):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        out += (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(factor)
    return out


class Index:
    """BM25 postings of items, ordered by item, with the largest impact of each block and of each list.

    Everything but the vocabulary is a flat array: word numbers of all items one after the other, postings of all words
    one after the other, and the hashes of all runs of words in order, each with its place.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = 12):
        self.run = run
        self.vocabulary: dict[str, int] = {}
        self.ids: list = []
        tokens, starts, get = array("i"), array("q", [0]), self.vocabulary.setdefault
        for i, text in items:
            w = words(text or "")
            if len(w) >= run:
                self.ids.append(i)
                tokens.extend(get(x, len(self.vocabulary)) for x in w)
                starts.append(len(tokens))
        self.tokens, self.starts = tokens, starts
        n, ids, begin = len(self.ids), np.frombuffer(tokens, np.int32) if tokens else np.zeros(0, np.int32), np.array(starts)
        size = np.diff(begin)
        item = np.repeat(np.arange(n, dtype=np.int64), size)
        key, back, count = np.unique(ids.astype(np.int64) * max(1, n) + item, return_inverse=True, return_counts=True)
        word, docs = key // max(1, n), key % max(1, n)
        offsets = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))
        df = np.diff(offsets)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        relative = size / (size.mean() if n else 1)
        impact = (idf[word] * count * (K1 + 1) / (count + K1 * (1 - B + B * relative[docs]))).astype(np.float32)
        self.offsets, self.docs, self.impacts = array("q", offsets.tolist()), array("i", docs.astype(np.int32).tobytes()), array("f", impact.tobytes())
        self.most = array("f", np.maximum.reduceat(impact, offsets[:-1]).tobytes()) if len(impact) else array("f")
        first = np.concatenate([[0], np.cumsum(-(-df // BLOCK))]).astype(np.int64)
        of = np.repeat(np.arange(len(df)), df)
        block = first[of] + (np.arange(len(of)) - offsets[of]) // BLOCK
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        self.first, self.blocks = array("q", first.tolist()), array("f", np.maximum.reduceat(impact, edges).tobytes()) if len(edges) else array("f")
        # Runs that lie within one item, their hashes, and the least score that one of an item's has.
        here = np.flatnonzero(np.arange(len(ids)) + run <= begin[1:][item]) if n else np.zeros(0, np.int64)
        bound = np.full(n, np.inf)
        score = impact[back.reshape(-1)].astype(np.float64)
        for a in range(0, len(here), _AT_ONCE):
            at = here[a : a + _AT_ONCE, None] + np.arange(run)
            order = np.argsort(ids[at], axis=1, kind="stable")
            own, gain = np.take_along_axis(ids[at], order, 1), np.take_along_axis(score[at], order, 1)
            gain[:, 1:][own[:, 1:] == own[:, :-1]] = 0
            np.minimum.at(bound, item[at[:, 0]], gain.sum(axis=1))
        self.bound = array("d", (bound - 1e-9).tobytes())
        self.threshold = min(self.bound, default=np.inf)
        hashes = _hashes(ids, run)[here]
        order = np.argsort(hashes, kind="stable")
        self.grams, self.places = hashes[order], here[order].astype(np.uint32 if len(ids) < 1 << 32 else np.uint64)

    def wand(self, terms: set[int]) -> list[int]:
        """Items whose score for these terms reaches their bound."""
        docs, impacts, offsets, most, least, found, end = self.docs, self.impacts, self.offsets, self.most, self.threshold, [], len(self.ids)
        lists = sorted([docs[offsets[t]], t, offsets[t]] for t in terms)
        while lists:
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                total += most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
                pivot += 1
            head = lists[: pivot + 1]
            where = [self._at(t, at, doc) for _, t, at in head]
            if sum(self.blocks[self.first[c[1]] + b] for c, b in zip(head, where)) >= least:
                score = 0.0
                for c in head:
                    at, stop = c[2], offsets[c[1] + 1]
                    while at < stop and docs[at] < doc:
                        at += 1
                    if at < stop and docs[at] == doc:
                        score += impacts[at]
                        at += 1
                    c[2] = at
                    c[0] = docs[at] if at < stop else end
                if score >= self.bound[doc]:
                    found.append(doc)
            else:
                # No item before the nearest block border can reach the bound with these lists.
                to = min(self._border(t, b) for (_, t, _), b in zip(head, where))
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to = max(to, doc + 1)
                for c in head:
                    at, stop = c[2], offsets[c[1] + 1]
                    while at < stop and docs[at] < to:
                        at += 1
                    c[2] = at
                    c[0] = docs[at] if at < stop else end
            lists = sorted(c for c in lists if c[0] < end)
        return found

    def _at(self, t: int, at: int, doc: int) -> int:
        """The block of a list, from position ``at`` on, where ``doc`` would be."""
        begin, stop, docs = self.offsets[t], self.offsets[t + 1], self.docs
        b = (min(at, stop - 1) - begin) // BLOCK
        while (nxt := begin + (b + 1) * BLOCK) < stop and docs[nxt] <= doc:
            b += 1
        return b

    def _border(self, t: int, b: int) -> int:
        at = self.offsets[t] + (b + 1) * BLOCK
        return self.docs[at] if at < self.offsets[t + 1] else len(self.ids)

    def shared(self, passage: list[int], hits: set[int]) -> set[int]:
        """Those of ``hits`` that have ``run`` consecutive words of the passage: by hash, then word by word."""
        run, out = self.run, set()
        hashes = _hashes(np.array(passage), run)
        low, high = np.searchsorted(self.grams, hashes, "left"), np.searchsorted(self.grams, hashes, "right")
        for k in np.flatnonzero(high > low):
            wanted = array("i", passage[k : k + run])
            for place in self.places[low[k] : high[k]].tolist():
                d = bisect_right(self.starts, place) - 1
                if d in hits and d not in out and self.tokens[place : place + run] == wanted:
                    out.add(d)
        return out

    def search(self, text: str) -> set[int]:
        """Ids of the items of which the text has ``run`` consecutive words.

        A passage is up to twice ``run`` consecutive words that the index knows; passages overlap by ``run``.
        """
        get, run, most, found = self.vocabulary.get, self.run, self.most, set()
        ids = [get(w, -1) for w in words(text)]
        for m in self.known(bytes([t >= 0 for t in ids])):
            for start in range(m.start(), m.end() - run + 1, run):
                passage = ids[start : min(m.end(), start + 2 * run)]
                terms = set(passage)
                if sum(most[t] for t in terms) < self.threshold:
                    continue
                if hits := {d for d in self.wand(terms) if self.ids[d] not in found}:
                    found.update(self.ids[d] for d in self.shared(passage, hits))
        return found

    def known(self, flags: bytes):
        """Stretches of ``run`` or more words that all are in the index: a leak can't be anywhere else."""
        return re.finditer(b"\x01{%d,}" % self.run, flags)


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", run: int = 12,
) -> DataFrame:
    """``key, item_key``, once each, where the document has ``run`` or more consecutive words of the item.

    Case, punctuation, blanks, line breaks and look-alike characters don't matter. NULL or empty texts match
    nothing; items of fewer than ``run`` words can't match; a repeated row matches as often as it is there,
    each pair of ids is given once; an empty table on either side gives an empty result.

    The corpus is read once for each block of items and never shuffled; only the pairs found are.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = chosen.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = -(-size // MAX_INDEX_TEXT) or 1
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_key].dataType)
    result = None
    for b in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.expr(f"pmod(xxhash64(i), {blocks}) = {b}"))
        index = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in part.collect()], run))

        def probe(batches, index=index):
            search = index.value.search
            for batch in batches:
                out = defaultdict(list)
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for i in search(t) if t else ():
                        out["k"].append(k)
                        out["i"].append(i)
                yield pa.RecordBatch.from_pydict(
                    {key: pa.array(out["k"], batch.schema.field(0).type), item_key: pa.array(out["i"], item_type)}
                )

        found = docs.select(key, text).mapInArrow(probe, f"`{key}` {kind}, `{item_key}` {item_kind}")
        result = found if result is None else result.unionByName(found)
    return result.distinct()
