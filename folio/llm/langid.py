"""Languages of documents and passages by prediction by partial matching (problem 10).

One variable-order byte context tree for each language, with escape probabilities (method C), trained on
a bounded sample of labelled texts and then frozen. A word's exact code length in every language is the
sum over its bytes; contexts begin at the blank before the word, so a word costs the same wherever it is,
and code lengths of words are looked up once they are known. A plain code of letters, which knows no context,
stands for every other language: where it is the shortest, no tree fits and the language is NULL. Sentences are
given languages together, by the least sum of code lengths and of a cost for each change of language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.glyphs import CYRILLIC_LOWER, CYRILLIC_UPPER, FULL_WIDTH, GREEK, LIGATURES, UNSEEN
from folio.llm.sentences import ABBREVIATIONS, simple_starts

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "pt", "ru", "th", "uk", "zh")
#: Names of the languages and codes of three letters.
NAMES = {
    "english": "en", "russian": "ru", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "italian": "it",
    "ukrainian": "uk", "chinese": "zh", "japanese": "ja", "thai": "th",
    "eng": "en", "rus": "ru", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it",
    "ukr": "uk", "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th",
}

#: Bounds of the training sample: texts for each language, and characters of a text that may be in it.
SAMPLE_TEXTS, SAMPLE_CHARS = 160, 6000
ORDER = 5
CACHE_ENTRIES = 300_000
#: A passage is given from so many consecutive full sentences on.
RUN = 2
#: Bits that a word costs beside the plain code of its letters where no tree codes it shorter (names, foreign words).
SPELLED = 5.0
#: Bits that a change of language between two sentences costs; bits of a letter that no training text has.
SWITCH, UNSEEN_LETTER = 16.0, 16.0
#: Every so many lines of the sample are left out of the trees, to fit the confidence.
HELD_OUT = 10

_FOLD = {ord(k): v for k, v in (FULL_WIDTH | LIGATURES).items()} | {c: None for c in UNSEEN}
_PAIRS = CYRILLIC_UPPER | CYRILLIC_LOWER
_TO_LATIN = {ord(k): v for k, v in (_PAIRS | GREEK).items()}
_TO_CYRILLIC = {ord(v): k for k, v in _PAIRS.items() if k not in "ѕһԛԝЅԚԜ"}
_TO_CYRILLIC |= {ord(k): _TO_CYRILLIC[ord(v)] for k, v in GREEK.items() if ord(v) in _TO_CYRILLIC}
_WORDS = r"[^\W\d_㐀-鿿぀-ヿ฀-๿]+(?:['’][^\W\d_]+)*"
_UNIT_ASCII = re.compile(r"[a-z]+(?:'[a-z]+)*", re.IGNORECASE)
_UNIT_CASED = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UNIT = re.compile(r"[぀-ヿ]{1,4}|[㐀-鿿]{1,4}|[฀-๿]{1,6}|" + _WORDS)
_NO_BLANKS = re.compile(r"[㐀-鿿぀-ヿ฀-๿]")
_NOT_LATIN = re.compile(r"[Ͱ-ӿ]")
_FOLDED = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "]")
_IS_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_ONLY_CYRILLIC = re.compile("(?![" + "".join(_PAIRS) + r"])[Ѐ-ӿ]")
_ONLY_LATIN = re.compile("(?![" + "".join(_PAIRS.values()) + r"])[A-Za-zÀ-ɏ]")
_REFERENCE = re.compile(r"\s*(?:\[\d+\]|\d+\.\s.*\(\d{4}\)\.?\s*$)")
_ENDS = re.compile(r"[.!?…。！？][\"'”»」』)\]]*\s*$")


def units(text: str) -> list[str]:
    """Words in small letters; runs of a few characters where a script has no blanks.

    Where letters of one script stand in for those of another that look the same, each word is brought to the
    script of its unmistakable letters; a word that has none, to that of most such letters of the text.
    """
    if text.isascii():
        return _UNIT_ASCII.findall(text.lower())
    if _FOLDED.search(text):
        text = text.translate(_FOLD)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if _NO_BLANKS.search(text):
        return _UNIT.findall(text.lower())
    if not (_NOT_LATIN.search(text) and _IS_LATIN.search(text)):
        return _UNIT_CASED.findall(text.lower())
    latin = len(_ONLY_LATIN.findall(text)) > len(_ONLY_CYRILLIC.findall(text))
    out = []
    for w in _UNIT_CASED.findall(text):
        lat, cyr = _ONLY_LATIN.search(w), _ONLY_CYRILLIC.search(w)
        if lat and not cyr or not lat and not cyr and latin:
            w = w.translate(_TO_LATIN)
        elif not w.isascii() or not lat:
            w = w.translate(_TO_CYRILLIC)
        out.append(w.lower())
    return out


def _bytes(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace") + b" "


class Model:
    """Frozen context trees of all languages, merged: each byte in context has its cost in bits in each language."""

    def __init__(self, texts: dict[str, Counter], order: int = ORDER):
        self.languages = tuple(sorted(texts))
        self.order = order
        n_lang = len(self.languages)
        letters: Counter = Counter()
        for words in texts.values():
            for word, times in words.items():
                for c in word + " ":
                    letters[c] += times
        total = sum(letters.values()) + len(letters) + 1
        #: Bits of each letter in the plain code, and how many bits of code length make one bit of confidence.
        self.letters = {c: float(-np.log2((k + 1) / total)) for c, k in letters.items()}
        self.temperature = 1.0
        trees: list[dict[bytes, Counter]] = []
        for lang in self.languages:
            tree: dict[bytes, Counter] = defaultdict(Counter)
            for word, times in texts[lang].items():
                b = _bytes(word)
                for i in range(1, len(b)):
                    for k in range(min(order, i) + 1):
                        tree[b[i - k : i]][b[i]] += times
            # The highest orders are kept where they have been seen twice.
            trees.append({c: s for c, s in tree.items() if len(c) < 3 or sum(s.values()) > 1})
        self.rows: dict[bytes, int] = {}
        self.escapes: dict[bytes, int] = {}
        matrix: list[np.ndarray] = []
        base = np.empty((256, n_lang), np.float32)
        for j, tree in enumerate(trees):
            s = tree.get(b"", Counter())
            n, d = sum(s.values()), max(1, len(s))
            base[:, j] = 8.0 + (np.log2((n + d) / d) if n else 0.0)
            for byte, c in s.items():
                base[byte, j] = -np.log2(c / (n + d))
        for byte in range(256):
            self.rows[bytes([byte])] = byte
            matrix.append(base[byte])
        contexts = sorted({c for t in trees for c in t if c}, key=len)
        for context in contexts:
            escape, seen = np.zeros(n_lang, np.float32), []
            for j, tree in enumerate(trees):
                s = tree.get(context)
                if s:
                    n, d = sum(s.values()), len(s)
                    escape[j] = -np.log2(d / (n + d))
                    seen.append((j, s, n + d))
            for byte in {b for _, s, _ in seen for b in s}:
                cost = matrix[self._shorter(context[1:], byte)] + escape
                for j, s, total in seen:
                    if byte in s:
                        cost[j] = -np.log2(s[byte] / total)
                self.rows[context + bytes([byte])] = len(matrix)
                matrix.append(cost)
            self.escapes[context] = len(matrix)
            matrix.append(escape)
        self.matrix = np.array(matrix, np.float32)
        self.cache: dict[str, int] = {}
        self.known = np.zeros((4096, n_lang + 1), np.float32)

    def _shorter(self, context: bytes, byte: int) -> int:
        tail = bytes([byte])
        while (r := self.rows.get(context + tail)) is None:
            context = context[1:]
        return r

    def word(self, word: str) -> np.ndarray:
        """Bits of a word in every language, and in the plain code of letters."""
        b, rows, escapes, at = _bytes(word), self.rows, self.escapes, []
        for i in range(1, len(b)):
            for k in range(min(self.order, i), -1, -1):
                if (r := rows.get(b[i - k : i + 1])) is not None:
                    at.append(r)
                    break
                if k and (r := escapes.get(b[i - k : i])) is not None:
                    at.append(r)
        get = self.letters.get
        plain = sum(get(c, UNSEEN_LETTER) for c in word) + get(" ", UNSEEN_LETTER)
        return np.append(np.minimum(self.matrix[at].sum(axis=0), plain + SPELLED), plain)

    def _at(self, words: list[str]) -> list[int]:
        """Rows of ``known`` that hold the code lengths of words."""
        cache = self.cache
        at = list(map(cache.get, words))
        if None in at:
            for i, r in enumerate(at):
                if r is None:
                    w = words[i]
                    r = cache.get(w)
                    if r is None:
                        r = cache[w] = len(cache)
                        if r >= len(self.known):
                            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
                        self.known[r] = self.word(w)
                    at[i] = r
        return at

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in every language."""
        return self.open_bits(texts)[:, :-1]

    def open_bits(self, texts: list[str]) -> np.ndarray:
        """The same, with the plain code of letters as the last column."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        at, sizes = [], []
        for t in texts:
            words = units(t)
            at += self._at(words)
            sizes.append(len(words))
        ends = np.cumsum(sizes)
        total = np.zeros((len(at) + 1, len(self.languages) + 1))
        if at:
            np.cumsum(self.known[at], axis=0, dtype=np.float64, out=total[1:])
        return total[ends] - total[ends - np.array(sizes, int)]

    def best(self, bits: np.ndarray) -> tuple[str | None, float]:
        """The language of the shortest code (NULL: the plain code's), and its confidence: its share of 2**-bits among all,
        the bits divided by the temperature that fits held-out pieces of lines."""
        j = int(bits.argmin())
        return self.name(j), float(1.0 / np.exp2(np.clip((bits[j] - bits) / self.temperature, -60, 0)).sum())

    def name(self, j: int) -> str | None:
        return self.languages[j] if j < len(self.languages) else None

    def calibrate(self, lines: list[tuple[str, list[str]]]) -> None:
        """Fits the temperature on pieces of one to six words of held-out lines by their likelihood."""
        rows, want = [], []
        for n, (lang, words) in enumerate(lines):
            k = n % 6 + 1
            for i in range(0, len(words) - k + 1, 7):
                rows.append(self.known[self._at(words[i : i + k])].sum(axis=0))
                want.append(self.languages.index(lang))
        if not rows:
            return
        bits, at = np.array(rows, float)[:, :-1], np.array(want)
        bits -= bits.min(axis=1, keepdims=True)
        own = bits[np.arange(len(at)), at]
        loss = {t: (own / t + np.log2(np.exp2(-bits / t).sum(axis=1))).mean() for t in np.geomspace(0.5, 32, 49)}
        self.temperature = float(min(loss, key=loss.get))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "known": np.zeros((4096, len(self.languages) + 1), np.float32)}


def named(lang: Column) -> Column:
    """Two-letter code that a label names, by a code of two or three letters, one with region or the English name; else NULL."""
    table = F.create_map(*[F.lit(x) for k, v in ({c: c for c in LANGUAGES} | NAMES).items() for x in (k, v)])
    clean = F.lower(F.trim(lang))
    return F.coalesce(F.try_element_at(table, clean), F.try_element_at(table, F.regexp_extract(clean, r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", 1)))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Context trees of all languages that labels name, from a bounded sample of labelled texts.

    The sample has about SAMPLE_TEXTS texts of at most SAMPLE_CHARS characters for each language, by hash of
    the key (so it is the same in any order). Labels are noisy: after a first round, lines whose shortest
    code isn't that of their label are left out, and the trees are grown anew.
    """
    labelled = df.select(F.col(key).alias("k"), F.col(text).alias("t"), named(F.col(lang)).alias("l")).where(
        f"t IS NOT NULL AND l IS NOT NULL AND length(t) BETWEEN 40 AND {SAMPLE_CHARS}"
    )
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("l") == c, F.lit(min(1.0, SAMPLE_TEXTS / n))) for c, n in counts.items()], F.lit(1.0))
    sample = labelled.where(F.expr("pmod(xxhash64(k, 11), 1000003) / 1000003.0D") < share).select("l", "t").collect()
    lines = [(r["l"], x) for r in sample for x in re.split(r"[\r\n]+", r["t"]) if x.strip()]
    return fit(lines)


#: Letters of the script that a language is written in; the others are written in Latin letters.
SCRIPTS = {"ru": "[Ѐ-ӿ]", "uk": "[Ѐ-ӿ]", "th": "[฀-๿]", "zh": "[㐀-鿿]", "ja": "[぀-ヿ]"}


def in_script(lang: str, line: str) -> bool:
    """Whether a line has a fair share of letters of the language's script (Japanese: of kana)."""
    letters = sum(map(str.isalpha, line)) or 1
    own = len(re.findall(SCRIPTS.get(lang, r"[A-Za-zÀ-ɏ]"), line))
    if lang == "zh" and re.search("[぀-ヿ]", line):
        return False
    return own > letters * (0.2 if lang == "ja" else 0.4)


def fit(labelled: list[tuple[str, str]]) -> Model:
    """Two rounds over (language, line): lines of another script, then lines nearer to another language, are left out."""
    lines = [(lang, units(x)) for lang, x in labelled if in_script(lang, x)]

    def grow(chosen, order):
        texts: dict[str, Counter] = defaultdict(Counter)
        for lang, words in chosen:
            texts[lang].update(words)
        return Model(texts or {"en": Counter()}, order)

    first = grow(lines, 3)
    kept = []
    for lang, words in lines:
        if len(words) >= 4:
            at = first._at(words)
            if first.best(first.known[at].sum(axis=0)[:-1])[0] == lang:
                kept.append((lang, words))
    kept = kept or lines
    seen: Counter = Counter()
    parts: tuple[list, list] = ([], [])
    for lang, words in kept:  # every HELD_OUT-th line of a language only fits the confidence
        seen[lang] += 1
        parts[seen[lang] % HELD_OUT == 0].append((lang, words))
    model = grow(parts[0], ORDER)
    model.calibrate([x for x in parts[1] if x[0] in model.languages])
    return model


_QUOTED = re.compile(r"[“”„«»「」『』\"]")
_STOP = re.compile(r"(?:[.!?…]+[\])'’]*\s+|[。！？]+\s*|[!?](?=[\u3040-\u9fff]))(?=\S)")
_ORDINAL = re.compile(r"\b(?:am|vom|zum|bis|der|die|das|dem|den) \d{1,2}$", re.IGNORECASE)
_LAST = re.compile(r"(\d\s?)?([^\s\d]{1,6})$")


def starts_of(line: str) -> list[int]:
    """Sentence starts of a line: :func:`simple_starts` where there are quotations, else one pass of a regex."""
    if _QUOTED.search(line) or _THAI.search(line):
        return simple_starts(line)
    out = [len(line) - len(line.lstrip())]
    for m in _STOP.finditer(line):
        e = m.end()
        c = line[e]
        if m.group()[0] == "." and (c.islower() or c.isdigit()):
            continue
        if m.group()[0] == "." and _ORDINAL.search(line, max(0, m.start() - 9), m.start()):
            continue
        if m.group()[0] == "." and (last := _LAST.search(line, max(0, m.start() - 8), m.start())):
            word = last.group(2).strip("([").lower()
            if not last.group(1) and (word in ABBREVIATIONS or len(word) == 1):
                continue
        if c.islower():
            continue
        out.append(e)
    return out


_THAI = re.compile(r"[฀-๿]")
#: Letters of a Thai stretch that counts as a sentence.
CLAUSE = 10


def full_sentence(text: str) -> bool:
    """Whether a piece is a full sentence: it has letters and an end mark and isn't an entry of a list of references."""
    return bool(_ENDS.search(text)) and not _REFERENCE.match(text) and any(map(str.isalpha, text))


def assign(bits: np.ndarray, switch: float = SWITCH) -> list[int]:
    """Column of each row: the least sum of the rows' bits and of ``switch`` for each change of column."""
    alone = bits.argmin(axis=1)
    if (alone == alone[0]).all():
        return alone.tolist()
    total, back = bits[0].copy(), []
    for row in bits[1:]:
        j = int(total.argmin())
        change = total[j] + switch
        stays = total <= change
        back.append(np.where(stays, np.arange(len(total)), j))
        total = np.where(stays, total, change) + row
    out = [int(total.argmin())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def passages(model: Model, text: str) -> list[tuple[int, int, str | None, float, int]]:
    """``(start, end, lang, confidence, sentences)`` of each run of consecutive sentences of one language (NULL: of none known).

    Lines without an end mark (headings, captions) and references aren't sentences; they don't interrupt a run.
    Thai, which has no end marks, counts its stretches between blanks from CLAUSE letters on.
    """
    found, pos = [], 0
    for line in re.split(r"(\r\n|\r|\n)", text):
        if line and not line.isspace() and not _REFERENCE.match(line):
            starts = starts_of(line)
            for a, b in zip(starts, [*starts[1:], len(line)]):
                piece = line[a:b]
                if full_sentence(piece) or len(_THAI.findall(piece)) > CLAUSE:
                    found.append((pos + a, pos + b, piece))
        pos += len(line)
    if not found:
        return []
    bits = model.open_bits([f[2] for f in found])
    out: list[list] = []
    for (a, b, _), j, row in zip(found, assign(bits), bits):
        if out and out[-1][2] == j:
            out[-1][1], out[-1][3], out[-1][4] = b, out[-1][3] + row, out[-1][4] + 1
        else:
            out.append([a, b, j, row, 1])
    return [(a, b, model.name(j), _share(row, j, model.temperature), n) for a, b, j, row, n in out]


def _share(bits: np.ndarray, j: int, temperature: float) -> float:
    return float(1.0 / np.exp2(np.clip((bits[j] - bits) / temperature, -60, 60)).sum())


_RESULT = "lang string, confidence double, passages array<struct<start:int,end:int,lang:string,confidence:double,sentences:int>>"


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang, confidence, passages`` of each row: the language of the whole text and of each run of sentences.

    A language that no training text is in is NULL. NULL texts and texts without a letter have NULL language and
    confidence 0, and no passages. Repeated rows
    are judged as often; a NULL key is kept; an empty table gives an empty one. No shuffle; the model (its size
    is bounded by the training sample) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    item = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]
    )

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, sure, runs = [], [], []
            for t in batch.column(1).to_pylist():
                found = passages(m, t) if t else []
                if t and any(map(str.isalpha, t)):
                    if found:
                        weight: dict[str | None, int] = defaultdict(int)
                        for a, b, lang, _, _ in found:
                            weight[lang] += b - a
                        whole = max(weight, key=lambda x: (weight[x], x or ""))
                        c = max(f[3] for f in found if f[2] == whole) * weight[whole] / sum(weight.values())
                    else:
                        whole, c = m.best(m.open_bits([t])[0])
                    langs.append(whole)
                    sure.append(c)
                else:
                    langs.append(None)
                    sure.append(0.0)
                runs.append([dict(zip(("start", "end", "lang", "confidence", "sentences"), f)) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(runs, pa.list_(item))],
                names=[key, "lang", "confidence", "passages"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_RESULT}")


def unnamed_languages(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, lang``, once each: languages of RUN or more consecutive full sentences of a text that its label doesn't name.

    A label that names no language names none of them; see :func:`identify` for odd rows.
    """
    labelled = df.select(F.struct(F.col(key).alias("k"), named(F.col(lang)).alias("label")).alias("id"), F.col(text).alias("t"))
    found = identify(labelled, model, "id", "t").select("id", F.explode("passages").alias("p"))
    return (
        found.where(f"p.sentences >= {RUN} AND p.lang IS NOT NULL AND NOT (p.lang <=> id.label)")
        .select(F.col("id.k").alias(key), F.col("p.lang").alias("lang")).distinct()
    )
