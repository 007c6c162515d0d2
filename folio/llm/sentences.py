"""Sentence boundaries across languages and scripts (problem 5).

A scanner finds every place where a sentence may begin. Most are certain (question marks, ideographic full
stops, blank lines, blanks between Thai clauses). A period followed by a blank is not: whether it ends a
sentence is decided by statistics learned without labels from the corpus, per language: abbreviations,
collocations over a period, and sentence starters, each by a log-likelihood ratio (Kiss and Strunk 2006).
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.lineage import share

#: Quotation marks that open and close, marks that end a sentence.
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‘": "’", '"': '"'}
CLOSERS = "”“»」』’\"')]）】"
OPENERS = "“„«「『‘\"'([（【¿¡"
MARKS = ".!?…。！？｡．"
IDEOGRAPHIC = "。！？｡．"
#: Fixed value: particles that carry a quotation on into its sentence.
QUOTATIVE = "とはがをにので、"

#: Parameters of the three tests, as published.
ABBREVIATION_SCORE, STARTER_SCORE, COLLOCATION_SCORE = 0.3, 30.0, 7.88

#: Abbreviations for :func:`simple_starts`, which has no statistics.
ABBREVIATIONS = frozenset(
    "e.g i.e dr mr mrs ms prof st vs approx cf fig eq ref bzw vgl abb ca d.h z.b u.a env éq sra sr dott sig ul "
    "т.е рис табл см ул проф соавт ок напр".split()
)

_EVENT = re.compile(
    r"[.!?…。！？｡．]+|[“”„«»「」『』\"]|\n[^\S\n]*\n\s*|(?<=\S)\s+(?=[฀-๿])"
)
_BLANK = re.compile(r"\s*")
_OPENING = "“„«「『\"'([¿¡"
_TOKEN = re.compile(r"[^\s]+")
_STRIP = "“”„«»「」『』‘’\"'()[]{}¿¡!?,;:…（）【】<>*•–—-"
THAI = re.compile(r"[฀-๿]")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def _quotes(text: str) -> dict[int, int]:
    """Opening position -> closing position of each quotation that is closed in the same paragraph."""
    if not any(q in text for q in "“„«「『\""):
        return {}
    out, stack = {}, []
    for m in re.finditer(r"[“”„«»「」『』\"]|\n[^\S\n]*\n", text):
        c, i = m.group(), m.start()
        if c[0] == "\n":
            stack.clear()
        elif stack and PAIRS[stack[-1][0]] == c:
            out[stack.pop()[1]] = i
        elif c in PAIRS and not (c == "“" and stack and stack[-1][0] == "„"):
            stack.append((c, i))
    return out


def _next(text: str, i: int) -> int:
    """First position from ``i`` that isn't a blank."""
    return _BLANK.match(text, i).end()


def _lower(text: str, i: int) -> bool:
    """Whether the first letter or digit from ``i`` on, after opening marks, is a small letter."""
    while i < len(text) and text[i] in OPENERS:
        i += 1
    return i < len(text) and text[i].islower()


def _carried(text: str, close: int, before: str) -> bool:
    """Whether the sentence goes on after the quotation that closes at ``close``."""
    i = _next(text, close + 1)
    if i >= len(text):
        return False
    c = text[i]
    if c in ",;:.!?、，；：":
        return True
    if i > close + 1:  # a blank follows
        return _lower(text, i) or c in "–—-"
    if CJK.match(c) or c == "「":
        return c in QUOTATIVE or before in ":：,，、"
    return c.isalnum() or c in ")]"


def scan(text: str) -> list[tuple[int, str, str, str]]:
    """``(start, kind, previous, next)`` of every place where a sentence begins or may begin.

    kind: ``sure``, or ``period`` with the types (lower case, without marks) of the words before and after.
    The first sentence is included. Nothing inside a quotation that belongs to a sentence is given.
    """
    n, first = len(text), _next(text, 0)
    if first >= n:
        return []
    quotes = _quotes(text)
    found, start, pos = [(first, "sure", "", "")], first, 0
    cased = any(map(str.isupper, text))
    while m := _EVENT.search(text, pos):
        i, pos, s = m.start(), m.end(), m.group()
        c = s[0]
        if i < first:
            continue
        if c in PAIRS or c in "”“»」』":
            if i not in quotes:
                continue
            close = quotes[i]
            j = i - 1
            while j > start and text[j].isspace():
                j -= 1
            whole = i == start or text[start:i].strip(OPENERS + " \n\t") == ""
            if not whole or _carried(text, close, text[j]):
                pos = close + 1  # a quotation inside a sentence
                k = close - 1
                while k > i and text[k].isspace():
                    k -= 1
                if text[k] in MARKS and not _carried(text, close, text[j]):
                    nxt = _next(text, close + 1)
                    if nxt < n and (nxt > close + 1 or CJK.match(text[nxt]) or text[nxt] in OPENERS):
                        found.append((nxt, "sure", "", ""))
                        start = nxt
            continue
        if c == "\n":
            if pos < n:
                found.append((pos, "sure", "", ""))
                start = pos
            continue
        if c.isspace():  # before a Thai letter
            prev = text[i - 1]
            if THAI.search(text, start, i) and prev not in ",;:(":
                found.append((pos, "sure", "", ""))
                start = pos
            continue
        end = pos
        while end < n and text[end] in CLOSERS:
            if text[end] in "“\"'‘" and end not in quotes.values() and text[end] != "'":
                break
            end += 1
        if end < n and text[end] == "\xa0" or end < n and text[end].isspace():
            gap = end
            while gap < n and text[gap].isspace():
                gap += 1
            if gap < n and text[gap] in "»!?" and text[gap] not in quotes:  # French spacing before a mark
                if text[gap] in "!?":
                    continue
                end = gap + 1
        nxt = _next(text, end)
        if nxt >= n:
            break
        touching = nxt == end
        wide = c in IDEOGRAPHIC or (c in "!?" and (CJK.match(text[nxt]) or CJK.match(text[i - 1] if i else " ")))
        if touching and not wide and not (c in "!?" and (text[nxt] in OPENERS or text[nxt].isupper())):
            continue
        if touching and text[nxt] in ",，、;；:：)）」』”":
            continue
        if not wide and cased and _lower(text, nxt):
            continue
        if c in "!?" or c in IDEOGRAPHIC:
            found.append((nxt, "sure", "", ""))
            start = pos = nxt
            continue
        j = i  # the whole word before the period, however long
        while j > start and not (text[j - 1].isspace() or text[j - 1] in _OPENING):
            j -= 1
        after = _TOKEN.match(text, nxt)
        before = text[j:i].strip(_STRIP).lower()
        lead = text[max(0, i - len(before) - 2) : i - len(before)]
        number_before = bool(before) and len(before) <= 2 and re.search(r"[\d%]\s?$", lead) is not None
        if number_before:
            before = "#unit " + before
        elif before[:1].isdigit():
            before = "#"
        word = after.group().strip(_STRIP).lower()
        if not (len(word) == 2 and word[0].isalpha() and word[1] == "."):  # an initial keeps its period
            word = "#" if word[:1].isdigit() else word.rstrip(".")
        found.append((nxt, "period", before, word))
    out, seen = [], set()
    for f in found:
        if f[0] not in seen:
            seen.add(f[0])
            out.append(f)
    return sorted(out)


def simple_starts(text: str) -> list[int]:
    """Sentence starts by fixed abbreviations alone, for operators that only need pieces of running text."""
    out = []
    for start, kind, before, after in scan(text):
        if kind == "period" and not before.startswith("#unit"):
            if before in ABBREVIATIONS or (len(before) == 1 and before.isalpha()):
                continue
        out.append(start)
    return out


def _candidates(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, langs = batch.column(0), batch.column(1).to_pylist()
            rows, out = [], defaultdict(list)
            for r, t in enumerate(batch.column(2).to_pylist()):
                for start, how, before, after in scan(t) if t else ():
                    rows.append(r)
                    out["lang"].append(langs[r])
                    out["start"].append(start)
                    out["sure"].append(how == "sure")
                    out["before"].append(before)
                    out["after"].append(after)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(out["lang"], pa.string()), pa.array(out["start"], pa.int32()),
                 pa.array(out["sure"], pa.bool_()), pa.array(out["before"], pa.string()), pa.array(out["after"], pa.string())],
                names=["k", "lang", "start", "sure", "before", "after"],
            )

    return df.select(F.col(key).alias("k"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), text).mapInArrow(
        run, f"k {kind}, lang string, start int, sure boolean, before string, after string"
    )


def _llr(a: str, b: str, ab: str, n: str) -> str:
    """SQL of Dunning's log-likelihood ratio that b follows a more often than elsewhere (ab of a's uses, of n in all)."""
    p, p1, p2 = f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / greatest({n} - {a}, 1))"

    def part(k: str, m: str, q: str) -> str:
        q = f"least(greatest({q}, 1e-12D), 1 - 1e-12D)"
        return f"({k} * ln({q}) + ({m} - {k}) * ln(1 - {q}))"

    return (
        f"(-2 * ({part(ab, a, p)} + {part(f'({b} - {ab})', f'({n} - {a})', p)}"
        f" - {part(ab, a, p1)} - {part(f'({b} - {ab})', f'({n} - {a})', p2)}))"
    )


def learn(df: DataFrame, found: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, DataFrame]:
    """Abbreviations, sentence starters and collocations of each language, as three tables of (lang, type...).

    Counted over all rows: word types by language with and without a final period, words after a certain
    end, and pairs of words over a period. All counts are combined before they are shuffled.
    """
    strip = "[" + re.escape(_STRIP) + "]"
    token = F.explode(F.split(F.lower(F.col(text)), r"[\s ]+")).alias("w")
    tokens = df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), token)
    tokens = tokens.select("lang", F.regexp_replace("w", f"^{strip}+|{strip}+$", "").alias("w")).where("w <> '' AND w <> '.'")
    typed = tokens.select(
        "lang", F.col("w").endswith(".").alias("dot"),
        F.expr("CASE WHEN w rlike '^[0-9]' THEN '#' ELSE rtrim('.', w) END").alias("type"),
    )
    types = typed.groupBy("lang", "type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if("dot").cast("double").alias("dots")
    )
    types = share(types)
    totals = types.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("dots").alias("all_dots"))
    types = types.join(F.broadcast(totals), "lang")  # one row for each language
    # Abbreviations: nearly always with a period, short, with inner periods, weighed down by uses without one.
    score = _llr("n", "all_dots", "dots", "`all`")
    marked = types.where("dots > 0 AND type rlike '[\\\\p{L}]' AND dots / n >= all_dots / `all`").withColumn(
        "inner", F.expr("length(type) - length(replace(type, '.', ''))")
    )
    short = "(length(type) - inner)"
    abbreviations = marked.where(
        f"{score} * exp(-{short}) * (inner + 1) * pow({short}, -(n - dots)) >= {ABBREVIATION_SCORE}"
    ).select("lang", F.col("type").alias("before"))
    # Starters: words that follow a certain end of a sentence, or a period after a word that is no abbreviation.
    after = found.where("before <> '' OR sure").where("after <> ''")
    sure_end = after.join(abbreviations.withColumn("abbr", F.lit(True)), ["lang", "before"], "left").where(
        "abbr IS NULL AND length(replace(before, '#unit ', '')) > 1"
    )
    starts = sure_end.groupBy("lang", F.col("after").alias("type")).agg(F.count(F.lit(1)).cast("double").alias("ab"))
    ends = starts.groupBy("lang").agg(F.sum("ab").alias("ends"))
    starters = (
        starts.withColumnRenamed("type", "after").withColumn("type", F.expr("rtrim('.', after)"))
        .join(types, ["lang", "type"]).join(F.broadcast(ends), "lang")
        .where("type <> '#' AND ab / ends > n / `all`")
        .where(f"{_llr('ends', 'greatest(n, ab)', 'ab', '`all`')} >= {STARTER_SCORE} AND ab >= 2")
        .select("lang", "after")
    )
    # Collocations: pairs over a period, tied closely, where the first is an abbreviation, an initial or a number.
    pairs = found.where("NOT sure AND before <> '' AND after <> ''").groupBy("lang", "before", "after").agg(
        F.count(F.lit(1)).cast("double").alias("ab")
    )
    collocations = (
        pairs.join(types.select("lang", F.col("type").alias("before"), F.col("n").alias("a"), "dots"), ["lang", "before"])
        .join(types.select("lang", F.col("type").alias("after"), F.col("n").alias("b"), "all"), ["lang", "after"])
        .join(abbreviations.withColumn("abbr", F.lit(True)), ["lang", "before"], "left")
        .where("(abbr OR before = '#' OR length(before) = 1 OR (after = '#' AND ab / dots > 0.5)) AND ab >= 2")
        .where(f"{_llr('greatest(a, ab)', 'greatest(b, ab)', 'ab', '`all`')} >= {COLLOCATION_SCORE} AND ab / a > b / `all`")
        .select("lang", "before", "after")
    )
    return {"abbreviations": abbreviations, "starters": starters, "collocations": collocations}


def sentence_starts(df: DataFrame, key: str = "block_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, sent_start``: the offset from 0, in characters, of the first character of every sentence.

    Opening quotation and inverted marks belong to the sentence; a quotation inside a sentence isn't split; a
    last stretch without an end mark is a sentence. NULL, empty and blank texts have no sentence. A NULL
    language is a language of its own; repeated rows give their sentences as often. Empty tables give none.

    A period after an abbreviation or an initial ends a sentence only before a sentence starter (or an
    opening mark); a period inside a collocation doesn't, unless its second word is a starter.
    """
    found = share(_candidates(df, key, text, lang))
    model = {name: share(table) for name, table in learn(df, found, text, lang).items()}
    flag = lambda name, col: model[name].withColumn(col, F.lit(True))
    judged = (
        found.where("NOT sure").join(flag("abbreviations", "abbr"), ["lang", "before"], "left")
        .join(flag("starters", "starter"), ["lang", "after"], "left")
        .join(flag("collocations", "tied"), ["lang", "before", "after"], "left")
    )
    ends = judged.where(
        """CASE WHEN starter THEN true
                WHEN startswith(before, '#unit ') THEN true
                WHEN after = '' THEN true
                WHEN abbr OR (length(before) = 1 AND before <> '#') THEN false
                WHEN tied THEN false
                ELSE true END"""
    )
    return (
        found.where("sure").select("k", "start").unionByName(ends.select("k", "start"))
        .select(F.col("k").alias(key), F.col("start").alias("sent_start"))
    )
