"""Sentence alignment in bilingual documents (problem 1).

A sentence is a vector over concepts that both languages share: all paired documents, hashed into a fixed number
of concepts (a word is near the documents whose text has it, in either language), and tokens that both sides write
alike (numbers, codes, names). Words are counted in Spark over all pairs; cosines come from whole vectors inside
each block; then mutual best spans are selected, two merged sentences of one side being a span as well.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.glyphs import look_py
from folio.llm.sentences import simple_starts
from folio.sources.lineage import cut

#: Concepts over which all paired documents are hashed; a name is in one of so many texts at most to count in full.
CONCEPTS, NAMES = 512, 160
#: Numbers of word vectors that are sent to the workers at once, and counts a worker holds before it passes them on.
CELLS, COUNTED = 1 << 23, 200_000
#: Side under which sounds are counted, which both sides share.
SOUNDS = 2
#: Weights of literal tokens beside a concept vector of length 1; least cosine of a pair.
LITERAL, NAME, LEAST = 1.0, 0.8, 0.34
#: Gain in cosine of a merged span over its parts; least cosine of a part.
MERGE_GAIN, PART = 0.03, 0.15
#: Least share of a sentence's vector that lies in the longer sentence that holds it.
INSIDE = 0.5

#: Fixed value: Cyrillic letters by sound; vowels are left out of names.
_SOUND = dict(zip("бвгджзклмнпрстфхцчшщ", "bvgdjzklmnprstfhssss"))
_LATIN = [("qu", "kv"), ("th", "t"), ("ph", "f"), ("ch", "h"), ("sh", "s"), ("x", "ks"), ("w", "v"), ("c", "k"), ("q", "k"), ("y", "")]
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_CODE = re.compile(r"[A-Z]{2,}-\d+")
_CJK = re.compile(r"[㐀-鿿぀-ヿ฀-๿]+")
_WORD = re.compile(r"[^\W\d_㐀-鿿぀-ヿ฀-๿]+(?:['’][^\W\d_]+)*")


def _sound(word: str) -> str:
    """Consonants of a name as both scripts write them."""
    if re.search("[а-яё]", word):
        return "".join(_SOUND.get(c, "") for c in word)
    for a, b in _LATIN:
        word = word.replace(a, b)
    return "".join(c for c in word if c in "bvgdjzklmnprstfh")


def terms(text: str) -> tuple[list[str], list[tuple[str, float]]]:
    """Words of a sentence, and its literal tokens with their weights."""
    text = look_py(text) if not re.search("[а-яё]", text) else text
    codes = _CODE.findall(text)
    literal = [(f"c{c}", 1.6 * LITERAL) for c in codes]
    rest = _CODE.sub(" ", text)
    literal += [(f"n{n.replace(',', '.')}", LITERAL) for n in _NUMBER.findall(rest)]
    words = [w.lower() for w in _WORD.findall(rest)]
    for w in words:
        if len(w) >= 5 and len(s := _sound(w)) >= 3:
            literal.append((f"s{s}", 0.0))
    for run in _CJK.findall(rest):
        words += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return words, literal


class Concepts:
    """What all document pairs say of words: a row a pair of languages, and the counts of :func:`count_words`."""

    def __init__(self, pairs: list, words: DataFrame | None = None):
        self.pairs = {r["pair"]: r for r in pairs}
        self.words = words

    def parts(self) -> Iterator[Part]:
        """Vectors of all words, about CELLS numbers at a time; one part without words if there are none."""
        cells = 0 if self.words is None else self.words.agg(F.sum(1 + F.coalesce(F.size("cells"), F.lit(0)))).first()[0] or 0
        parts = max(1, math.ceil(cells / CELLS))
        for i in range(parts):
            yield Part(self.pairs, None if self.words is None else self.words.where(F.expr(f"pmod(xxhash64(word, 11), {parts}) = {i}")).toArrow())


class Part:
    """Vectors of some words of each side and pair of languages, and how rare the sounds among them are.

    A word's count in a concept, less what chance would give it there, tells the word's documents from others
    however many share a concept. Words of many concepts have a row of ``dense``; of the others the concepts they
    have are kept, and the factor of the shares that chance takes off.
    """

    def __init__(self, pairs: dict, table: pa.Table | None):
        self.lengths = {p: r["ratio"] for p, r in pairs.items()}
        self.shares = {p: r["shares"] for p, r in pairs.items()}
        self.rows: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
        self.rare: dict[str, dict[str, float]] = defaultdict(dict)
        dense, concepts, weights, sizes, chance = [], [], [], [], []
        for batch in table.to_batches() if table is not None else []:
            at = batch.column("cells").flatten()
            all_concepts, all_weights = at.field("concept").to_numpy(zero_copy_only=False), at.field("weight").to_numpy(zero_copy_only=False)
            end = 0
            for pair, side, word, docs, size in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "word", "docs")), pc.list_value_length(batch.column("cells")).to_pylist()):
                n = pairs[pair]["n"]
                if side == SOUNDS:
                    # A sound that many documents have is an ordinary word's, not a name's.
                    self.rare[pair][word] = min(1.0, max(0.0, math.log(2 * n / docs) / math.log(max(2, min(n, NAMES)))))
                    continue
                begin, end = end, end + size
                c, w, share = all_concepts[begin:end], all_weights[begin:end], self.shares[pair]
                total = w.sum()
                length = (w * w).sum() - 2 * total * (w * share[c]).sum() + total * total * (share * share).sum()
                if docs >= n or length <= 0:
                    continue
                scale = math.log(n / docs) / math.sqrt(length)
                if 4 * size > CONCEPTS:
                    v = -total * scale * share
                    v[c] += scale * w
                    self.rows[pair, side][word] = len(dense)
                    dense.append(v.astype(np.float32))
                else:
                    self.rows[pair, side][word] = ~len(sizes)
                    concepts.append(c.astype(np.int32))
                    weights.append((scale * w).astype(np.float32))
                    sizes.append(size)
                    chance.append(total * scale)
        self.dense = np.array(dense, np.float32).reshape(-1, CONCEPTS)
        self.concepts, self.weights = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.int32, concepts), (np.float32, weights)))
        self.ends, self.chance = np.cumsum([0, *sizes]), np.array(chance)

    def add(self, pair: str, hits: list[list[int]], sums: np.ndarray) -> None:
        """Adds the vectors of the words of each sentence, given by their rows."""
        rows, where = [], []
        for i, found in enumerate(hits):
            common = [r for r in found if r >= 0]
            if common:
                sums[i] += self.dense[common].sum(axis=0)
            rows += [~r for r in found if r < 0]
            where += [i] * (len(found) - len(common))
        if rows:
            rows, where = np.array(rows), np.array(where)
            begin, sizes = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
            cell = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
            flat = np.repeat(where * CONCEPTS, sizes) + self.concepts[cell]
            sums += np.bincount(flat, self.weights[cell], sums.size).reshape(sums.shape)
            sums -= np.outer(np.bincount(where, self.chance[rows], len(sums)), self.shares[pair])


def _usable(df: DataFrame, key: str) -> DataFrame:
    concept = F.expr(f"cast(pmod(xxhash64(`{key}`, 7), {CONCEPTS}) AS int)").alias("concept")
    return df.where("pair IS NOT NULL AND length(source) > 0 AND length(target) > 0").select("pair", "source", "target", concept)


def count_words(df: DataFrame, key: str = "block_id") -> DataFrame:
    """``pair, side, word, docs, cells``: in how many documents a word or sound is, and its weight in each concept.

    All documents count. A word of one document is left out, since it says nothing of any other; so is such a sound.
    """
    names = ["pair", "side", "word", "concept", "weight", "docs"]

    def rows(seen: dict) -> pa.RecordBatch:
        columns = [[k[i] for k in seen] for i in range(4)] + [[v[i] for v in seen.values()] for i in range(2)]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        seen: dict = {}
        for batch in batches:
            for pair, source, target, concept in zip(*(c.to_pylist() for c in batch.columns)):
                for side, text in enumerate((source, target)):
                    words, literal = terms(text)
                    entries = [((pair, side, w, concept), 1 + math.log(k)) for w, k in Counter(words).items()]
                    entries += [((pair, SOUNDS, k, 0), 0.0) for k in {k for k, _ in literal if k[0] == "s"}]
                    for k, w in entries:
                        old = seen.get(k, (0.0, 0))
                        seen[k] = (old[0] + w, old[1] + 1)
            if len(seen) > COUNTED:
                yield rows(seen)
                seen = {}
        if seen:
            yield rows(seen)

    counts = _usable(df, key).mapInArrow(run, "pair string, side int, word string, concept int, weight double, docs bigint")
    cells = counts.groupBy("pair", "side", "word", "concept").agg(F.sum("weight").alias("weight"), F.sum("docs").alias("docs"))
    words = cells.groupBy("pair", "side", "word").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("concept", "weight")).alias("cells"))
    return words.where("docs >= 2").withColumn("cells", F.when(F.col("side") != SOUNDS, F.col("cells")))


def learn_concepts(df: DataFrame, key: str = "block_id") -> Concepts:
    """Concepts from all pairs of ``source`` and ``target`` of each ``pair``."""
    by = _usable(df, key).groupBy("pair", "concept").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("source")).alias("s"), F.sum(F.length("target")).alias("t")
    )
    pairs: dict[str, dict] = {}
    for r in by.collect():
        p = pairs.setdefault(r["pair"], {"pair": r["pair"], "n": 0, "s": 0, "t": 0, "docs": np.zeros(CONCEPTS)})
        for c in ("n", "s", "t"):
            p[c] += r[c]
        p["docs"][r["concept"]] += r["n"]
    made = [{"pair": p["pair"], "n": p["n"], "ratio": p["s"] / p["t"], "shares": p["docs"] / p["n"]} for p in pairs.values()]
    return Concepts(made, count_words(df, key).persist())


def _read(model: Part, pair: str | None, side: int, text: str, spans: list[tuple[int, int]], sums: np.ndarray, rare: dict[str, float]) -> list[dict]:
    """Adds the part's words to the sums of the sentences and its sounds to ``rare``; literal tokens of each sentence."""
    known, sounds = model.rows.get((pair, side), {}), model.rare.get(pair, {})
    literals, hits = [], []
    for a, b in spans:
        words, literal = terms(text[a:b])
        hits.append([known[w] for w in words if w in known])
        rare.update((k, sounds[k]) for k, _ in literal if k in sounds)
        literals.append(literal)
    model.add(pair, hits, sums)
    return literals


def _literal(tokens: list[tuple[str, float]], rare: dict[str, float]) -> dict[str, float]:
    out: dict[str, float] = {}
    for k, w in tokens:
        if k[0] == "s":
            w = NAME * rare.get(k, 1.0) if rare.get(k, 1.0) > 0.55 else 0.0
        if w:
            out[k] = max(out.get(k, 0.0), w)
    return out


def _dots(vectors: list[np.ndarray], literals: list[list[dict]]) -> tuple[dict, tuple, tuple]:
    """Products of all sentences of two sides that :func:`select_spans` may ask for, norms, and norms of merged neighbours."""
    tokens: dict[str, int] = {}
    for x in literals[0] + literals[1]:
        for k in x:
            tokens.setdefault(k, len(tokens))
    full = []
    for v, lits in zip(vectors, literals):
        more = np.zeros((len(v), len(tokens)))
        for i, x in enumerate(lits):
            for k, w in x.items():
                more[i, tokens[k]] = w
        full.append(np.hstack([v, more]))
    norms = [(x * x).sum(axis=1) for x in full]
    merged = [((x[:-1] + x[1:]) ** 2).sum(axis=1) for x in full]
    d = full[0] @ full[1].T
    n0, n1 = norms[0][:, None], norms[1][None, :]
    asked = (d > 0) & ((d * d > PART * PART * n0 * n1) | (d > INSIDE * n0) | (d > INSIDE * n1))
    dots = {(int(i), int(j)): float(d[i, j]) for i, j in zip(*np.nonzero(asked))}
    return dots, tuple(x.tolist() for x in norms), tuple(x.tolist() for x in merged)


def select_spans(dots: dict, norms: tuple, merged: tuple, sizes: tuple) -> list[tuple[int, int]]:
    """Pairs of sentences: spans that are each other's best, from the best cosine down, each sentence in one pair of spans.

    ``norms``, ``merged`` and ``sizes`` hold a list for each side. Two merged sentences must be nearer to the other
    side's sentence in direction than either alone, and in length. A sentence left over joins the span beside it
    on the same terms, if the cosine doesn't suffer.
    """

    def cosine(i, j):
        d = dots.get((i, j), 0.0)
        return d / math.sqrt(norms[0][i] * norms[1][j]) if d > 0 and norms[0][i] and norms[1][j] else 0.0

    def fit(a, b):
        """How far the lengths of two spans are apart."""
        return abs(math.log(sum(sizes[0][i] for i in a) / sum(sizes[1][j] for j in b)))

    def merge(one, k, side):
        """Cosine of sentence ``one`` and the two from ``k`` on of ``side``."""
        pairs = [(one, k), (one, k + 1)] if side else [(k, one), (k + 1, one)]
        length = merged[side][k] * norms[1 - side][one]
        return sum(dots.get(p, 0.0) for p in pairs) / math.sqrt(length) if length > 0 else 0.0

    candidates = [(cosine(i, j), (i,), (j,)) for i, j in dots]
    for side in (0, 1):
        for one in range(len(norms[1 - side])):
            for k in range(len(merged[side])):
                pairs = [(one, k), (one, k + 1)] if side else [(k, one), (k + 1, one)]
                parts = [cosine(*p) for p in pairs]
                if min(parts) <= PART:
                    continue
                m = merge(one, k, side)
                a, b = ((one,), (k, k + 1)) if side else ((k, k + 1), (one,))
                single = min(fit((p[0],), (p[1],)) for p in pairs)
                if m > max(parts) + MERGE_GAIN and fit(a, b) < single:
                    candidates.append((m, a, b))
    candidates.sort(key=lambda c: (-c[0], c[1], c[2]))
    used: tuple[set, set] = (set(), set())
    spans = []
    for c, a, b in candidates:
        if c < LEAST:
            break
        if used[0].isdisjoint(a) and used[1].isdisjoint(b):
            used[0].update(a)
            used[1].update(b)
            spans.append((c, a, b))
    for n, (c, a, b) in enumerate(spans):
        if len(a) > 1 or len(b) > 1:
            continue
        best = None
        for side in (0, 1):
            mine, one = (a, b)[side][0], (a, b)[1 - side][0]
            for x in (mine - 1, mine + 1):
                if 0 <= x < len(norms[side]) and x not in used[side]:
                    part = cosine(one, x) if side else cosine(x, one)
                    wide = tuple(sorted((mine, x)))
                    na, nb = (a, wide) if side else (wide, b)
                    m = merge(one, wide[0], side)
                    if part > PART + 0.05 and m >= c - 0.02 and fit(na, nb) < fit(a, b) - 0.1 and (best is None or m > best[0]):
                        best = (m, na, nb)
        if best:
            spans[n] = best
            used[0].update(best[1])
            used[1].update(best[2])
    pairs = [(i, j) for _, a, b in spans for i in a for j in b]
    # A sentence left over that lies within a longer one of the other side, as far as that has room beside its partners.
    for side in (0, 1):
        for x in range(len(norms[side])):
            if x in used[side] or not norms[side][x]:
                continue
            best = None
            for y in range(len(norms[1 - side])):
                inside = dots.get((y, x) if side else (x, y), 0.0) / norms[side][x]
                taken = sum(sizes[side][p[side]] for p in pairs if p[1 - side] == y)
                if inside > INSIDE and sizes[1 - side][y] - taken > 0.6 * sizes[side][x] and (best is None or inside > best[0]):
                    best = (inside, y)
            if best:
                used[side].add(x)
                used[1 - side].add(best[1])
                pairs.append((best[1], x) if side else (x, best[1]))
    return pairs


def align(df: DataFrame, concepts: Concepts, key: str = "block_id") -> DataFrame:
    """``key, src_start, tgt_start`` of each two sentences that render each other, wholly or in part.

    ``df`` has ``key, pair, source, target``. NULL or empty texts align with nothing; a NULL pair of languages
    has only literal tokens; an empty table gives an empty one; keys must be unique (a repeated key is aligned as often).
    Omitted and added sentences stay alone; order doesn't matter.

    Words' vectors reach the workers a part at a time: sums of the sentences go from one pass over the texts to the
    next, and the last one compares the whole vectors of a block's two sides. A block's own concept is left out of
    its vectors, since all its words share it.
    """
    kind = df.schema[key].dataType.simpleString()
    concept = F.expr(f"cast(pmod(xxhash64(`{key}`, 7), {CONCEPTS}) AS int)")
    rows = df.where("length(source) > 0 AND length(target) > 0").select(
        key, "pair", "source", "target", concept.alias("concept"), F.lit(None).cast("binary").alias("state")
    )
    pair_type = pa.struct([("src_start", pa.int32()), ("tgt_start", pa.int32())])
    context = df.sparkSession.sparkContext

    def read(model, batch):
        """Of each row: pair, concept, starts and texts' lengths of both sides, state."""
        for pair, source, target, concept, state in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            sides = []
            for text in (source, target):
                starts = simple_starts(text)
                sides.append((text, starts, list(zip(starts, [*starts[1:], len(text)]))))
            sums, rare = pickle.loads(state) if state else ([np.zeros((len(x[1]), CONCEPTS)) for x in sides], {})
            literals = [_read(model, pair, k, sides[k][0], sides[k][2], sums[k], rare) for k in (0, 1)]
            yield pair, concept, sides, sums, rare, literals

    def add(shared):
        def run(batches):
            for batch in batches:
                states = [pickle.dumps((sums, rare)) for *_, sums, rare, _ in read(shared.value, batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(states, pa.binary())], names=batch.schema.names)

        return run

    def finish(shared):
        def run(batches):
            for batch in batches:
                out = []
                for pair, concept, sides, sums, rare, literals in read(shared.value, batch):
                    vectors = []
                    for x in sums:
                        x[:, concept] = 0
                        size = np.linalg.norm(x, axis=1, keepdims=True)
                        vectors.append(x / np.where(size > 0, size, 1))
                    dots, norms, merged = _dots(vectors, [[_literal(t, rare) for t in x] for x in literals])
                    scale = (1.0, shared.value.lengths.get(pair, 1.0))
                    sizes = tuple([max(1, len(t[a:b].strip())) * scale[k] for a, b in spans] for k, (t, _, spans) in enumerate(sides))
                    chosen = select_spans(dots, norms, merged, sizes)
                    out.append([{"src_start": sides[0][1][i], "tgt_start": sides[1][1][j]} for i, j in chosen])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pair_type))], names=[key, "pairs"])

        return run

    waiting = None
    for part in concepts.parts():
        if waiting is not None:
            rows = cut(rows.mapInArrow(add(waiting), rows.schema))
            waiting.unpersist()
        waiting = context.broadcast(part)
    found = rows.mapInArrow(finish(waiting), f"`{key}` {kind}, pairs array<struct<src_start:int,tgt_start:int>>")
    return found.select(key, F.inline("pairs"))
