"""Splitting oversized items at natural boundaries (problem 2).

Dynamic programming over boundary positions: the cuts chosen have the least sum of cut penalties and of
squared deviations from even pieces, with every piece (its overlap included) under the limit.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.sentences import simple_starts

KINDS = ("paragraph", "sentence", "word", "char")
PENALTY = (0.0, 1.0, 10.0, 100.0)
IMBALANCE = 4.0

_BLANK_LINE = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*")
_GAP = re.compile(r"\s+")


def _bounds(text: str, level: int) -> list[int]:
    """Where a piece may begin, of one kind of boundary."""
    if level == 0:
        return [m.end() for m in _BLANK_LINE.finditer(text)]
    if level == 1:
        return simple_starts(text)[1:]
    return [m.end() for m in _GAP.finditer(text)] if level == 2 else []


def _characters(text: str, a: int, b: int, room: int, overlap: int) -> list[int]:
    """Cuts between characters as a reader sees them; where possible the overlap begins between such as well.

    A letter and the marks combined with it, or a joined emoji, is one. One that is longer than a piece may be cut.
    """
    if text[a:b].isascii():
        return list(range(a + 1, b))
    import regex

    begin = max(0, a - overlap)
    whole = [begin + m.end() for m in regex.finditer(r"\X", text[begin:b])]
    known = set(whole)
    at = [x for x in whole if a < x < b]
    both = [x for x in at if x - overlap <= begin or x - overlap in known]
    for chosen in (both, at):
        if all(q - p <= room for p, q in pairwise([a, *chosen, b])):
            return chosen
    return list(range(a + 1, b))


def coarsest(text: str, limit: int) -> tuple[int, list[list[int]]]:
    """The coarsest kind of boundary that leaves no piece over the limit, and the boundaries of each kind up to it."""
    found: list[list[int]] = []
    for level in range(3):
        found.append(_bounds(text, level))
        ends = sorted({0, len(text), *(b for f in found for b in f)})
        if all(b - a <= limit or len(text[a:b].strip()) <= limit for a, b in pairwise(ends)):
            return level, found
    return 3, found


def cuts(text: str, limit: int = 2500, overlap: int = 200) -> tuple[str, list[int]]:
    """The kind of cut the text needs, and the positions where its pieces begin anew (their overlap comes before)."""
    n, room = len(text), limit - overlap
    if n <= limit:
        return KINDS[0], []
    level, found = coarsest(text, limit)
    kind = {b: k for k in range(len(found) - 1, -1, -1) for b in found[k] if 0 < b < n}
    finer = level
    while True:  # stretches that are too long beside an overlap get finer boundaries, down to characters
        at = [0, *sorted(kind), n]
        wide = [(a, b) for a, b in pairwise(at) if b - a > room]
        if not wide or finer > 3:
            break
        finer += 1
        if finer < 3:
            more = _bounds(text, finer)
            kind |= {x: finer for a, b in wide for x in more if a < x < b}
        else:
            kind |= {x: 3 for a, b in wide for x in _characters(text, a, b, room, overlap)}
    at = np.array([0, *sorted(kind), n])
    fine = np.array([0.0, *(PENALTY[kind[x]] for x in sorted(kind)), 0.0])
    pieces = max(2, -(-(n - overlap) // room))
    even = n / pieces
    best, last = np.full(len(at), np.inf), np.zeros(len(at), int)
    best[0] = 0.0
    low = np.searchsorted(at, at - room)
    low[at <= limit] = 0  # the first piece has no overlap
    for i in range(1, len(at)):
        lo = low[i]
        size = at[i] - at[lo:i]
        cost = best[lo:i] + IMBALANCE * ((size - even) / even) ** 2
        if lo == 0 and at[i] > room:  # only the piece from the beginning may be longer than the room
            cost[1:][size[1:] > room] = np.inf
        j = int(np.argmin(cost))
        best[i], last[i] = cost[j] + fine[i], lo + j
    out, i = [], len(at) - 1
    while i > 0:
        i = last[i]
        out.append(int(at[i]))
    return KINDS[level], out[::-1][1:]


def split_oversized(df: DataFrame, key: str = "block_id", text: str = "text", limit: int = 2500, overlap: int = 200) -> DataFrame:
    """``key, cut, pieces`` for each row whose text is longer than ``limit`` characters.

    ``pieces`` is array<struct<start int, piece string>>: each but the first begins with the last ``overlap``
    characters of the piece before it, none is longer than ``limit``, and without overlaps they are the text.
    ``cut`` is the coarsest kind of boundary (paragraph, sentence, word, char) that leaves no piece over the
    limit. NULL and shorter texts give no row, a NULL key is kept, repeated rows are split as often; an empty
    table gives an empty one. The length filter runs before any text reaches Python; no shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kind = df.schema[key].dataType.simpleString()
    piece = pa.struct([("start", pa.int32()), ("piece", pa.string())])

    def run(batches):
        for batch in batches:
            cut, out = [], []
            for t in batch.column(1).to_pylist():
                k, at = cuts(t, limit, overlap)
                cut.append(k)
                ends = [0, *at, len(t)]
                starts = [0, *(max(p, b - overlap) for p, b in pairwise(ends[:-1]))]
                out.append([{"start": s, "piece": t[s:e]} for s, e in zip(starts, ends[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cut, pa.string()), pa.array(out, pa.list_(piece))], names=[key, "cut", "pieces"]
            )

    long = df.select(F.col(key), F.col(text).alias("t")).where(F.length("t") > limit)
    return long.mapInArrow(run, f"`{key}` {kind}, cut string, pieces array<struct<start:int,piece:string>>")
