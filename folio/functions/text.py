"""Text scalar functions as Column expressions; all of them stay inside the JVM and keep NULL as NULL unless stated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java and for RE2.
WS = r"[\s\x0B\x{85}\p{Z}]"
#: Hyphen code points, reading of words, list markers, protected abbreviations.
HYPHENS = "-‐‑‒–—―−⁃﹘﹣"
WORD = r"[A-Za-zÀ-ÿА-Яа-яЁё]+(?:['’][A-Za-zА-Яа-яЁё]+)?"
LIST_LINE = r"(?m)^[\s]*([•\-*►▸‣⁃◦○●▪]|\d+[.)]\s|[a-z]\.\s)"
ABBREVIATIONS = r"(?i)\b(?:e\.g|i\.e|et al|fig|figs|eq|eqs|dr|mr|mrs|ms|prof|no|nos|vs|approx|ca|p|pp)\.$"
#: Prefixes of compounds, function words, markings that keep a hyphen.
PREFIXES = (
    "non pre post anti auto co de dis ex extra hyper inter intra macro meta micro mid mini multi over pseudo re semi sub super trans "
    "ultra under uni well high low long short self cross deep fast real un mis counter "
    "де ре пост пре анти авто со экс гипер интер макро микро мульти сверх суб транс ультра высоко низко долго само взаимо полу недо пере"
).split()
TAILS = "of the a an in on and or to в на с к о у об от до по из за над под".split()
MARKINGS = r"(?i)\b(?:DE|IE|NE|SD|SE|EEG|EOG|EMG|ECG|P\d+|N\d+)$"
PUNCTUATION = ")]}»\"'.,;:!?-–—•·"
INLINE_TAGS = r"(?i)</?(?:b|i|u|em|strong|small|sub|sup|span|font)[^>]*>"
REFERENCE_MARK = r"\[(?:[0-9][0-9,\s;\-–—]*|[A-Za-z][A-Za-z0-9-]*)\]"
NUMBER = r"(?<![\p{L}\p{N}_])[+-]?(?:\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?|\.\d+)(?:\s*[%‰])?(?![\p{L}\p{N}_])"
PREAMBLES = ("translation:", "translated text:", "here is the translation:", "here's the translation:", "перевод:", "вот перевод:")
MARKER = r"(?:<<<\s*(?:END_)?[A-Z_][A-Z0-9_]*\s*>>>|\[/?(?:END_)?(?:CTX|SRC|OUT)\])"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def tokens(c: Column) -> Column:
    """Parts between white space; no empty ones."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def normalize_whitespace(c: Column) -> Column:
    """Line ends become blanks, soft hyphens vanish, runs of blanks collapse, ends are stripped."""
    return strip(F.regexp_replace(clean_span_text(c), r"[ \t\f\x0B]+", " "))


def clean_span_text(c: Column) -> Column:
    """Line ends become blanks, soft hyphens vanish."""
    return F.translate(c, "\r\n­", "  ")


def normalize_text(c: Column) -> Column:
    """Words broken over lines joined, blanks collapsed, single line ends to blanks, blank lines kept."""
    # Only the last letter of the left half is matched: a whole word would be tried again from each of its letters.
    c = F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w+)", "$1$2")
    c = F.regexp_replace(c, r"(?U)(?<=\w)-\s+(?=[a-zа-яё])", "-")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def dedup_key(c: Column) -> Column:
    """Stripped, in small letters, white space collapsed."""
    return F.regexp_replace(F.lower(strip(c)), f"{WS}+", " ")


def running_head_key(c: Column) -> Column:
    """P04 without a page number at either end."""
    cut = F.regexp_replace(F.regexp_replace(dedup_key(c), r"^\d{1,4} +", ""), r" +\d{1,4}$", "")
    return strip(F.regexp_replace(cut, " +", " "))


def compare_key(c: Column) -> Column:
    """White space collapsed, case folded."""
    return F.replace(F.lower(F.regexp_replace(strip(c), f"{WS}+", " ")), F.lit("ß"), F.lit("ss"))


def split_trailing_hyphen(c: Column) -> Column:
    """struct(left, hyphen): the text without the hyphen it ends with, and that hyphen or NULL."""
    s = rstrip(c)
    last = F.right(s, F.lit(1))
    ends = (s != "") & (F.instr(F.lit(HYPHENS), last) > 0)
    left = F.when(ends, rstrip(F.substring(s, F.lit(1), F.length(s) - 1))).otherwise(s)
    return F.struct(left.alias("left"), F.when(ends, last).alias("hyphen"))


def first_word(c: Column) -> Column:
    """First word or '' (P08)."""
    return F.regexp_extract(c, WORD, 0)


def last_word(c: Column) -> Column:
    """Last word or '' (P08)."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lit(-1)), F.lit(""))


def script(left: Column, right: Column) -> Column:
    """Which word list is asked: 'ru' or 'en' by most letters, else 'both' (P10)."""
    both = F.lower(F.concat(left, right))
    cyr, lat = F.regexp_count(both, F.lit("[а-яё]")), F.regexp_count(both, F.lit("[a-z]"))
    return F.when(cyr > lat, "ru").when(lat > cyr, "en").otherwise("both")


def pick_words(left: Column, right: Column, lists: dict[str, Column]) -> Column:
    """The word list of the script that most letters are of, if it has words; else all lists together (P10)."""
    every = F.array().cast("array<string>")
    for words in lists.values():
        every = F.array_union(every, words)
    chosen = F.lit(None).cast("array<string>")
    for lang, words in lists.items():
        chosen = F.when((script(left, right) == lang) & (F.size(words) > 0), words).otherwise(chosen)
    return F.coalesce(chosen, every)


#: Set by a plug-in: language -> function of a word in small letters that gives the positions of its syllable breaks.
SYLLABLES: dict[str, Callable[[str], list[int]]] = {}


def valid_break(left: Column, right: Column) -> Column:
    """Whether a syllable of the joined word ends with ``left`` (P11): true if a dictionary of its script says so, false if
    one says otherwise, NULL without a dictionary or where the word has other characters than letters."""
    if not SYLLABLES:
        return F.lit(None).cast("boolean")
    known = dict(SYLLABLES)

    @F.pandas_udf("boolean")
    def judge(a: pd.Series, b: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for x, y, kind in zip(a, b, langs):
            word = ((x or "") + (y or "")).lower()
            asked = [known[k] for k in (("ru", "en") if kind == "both" else (kind,)) if k in known] if word.isalpha() else []
            out.append(any(len(x) in breaks(word) for breaks in asked) if asked else None)
        return pd.Series(out, dtype="object")

    return judge(left, right, script(left, right))


def keeps_hyphen(prefix: Column, following: Column, words: Column | None = None, syllables: bool = False) -> Column:
    """Whether the hyphen at the end of ``prefix`` belongs to the word that goes on in ``following``.

    Ten tests, the first that applies decides. ``words`` is an array of known words in small letters; ``syllables`` asks
    the plug-in's dictionaries as well, which a fold over lines can't.
    """
    parts = split_trailing_hyphen(prefix)
    left, hyphen, right, raw = parts["left"], parts["hyphen"], lstrip(following), rstrip(prefix)
    one = F.lit(1)
    lw = F.when(last_word(left) != "", last_word(left)).otherwise(left)
    rw = F.when(first_word(right) != "", first_word(right)).otherwise(right)
    head = F.substring(right, F.lit(1), one)
    return (
        F.when((F.coalesce(prefix, F.lit("")) == "") | (F.coalesce(following, F.lit("")) == ""), True)
        .when(hyphen.isNull(), False)
        .when(right == "", True)
        .when(raw.rlike(rf"{WS}.$"), True)
        .when(left.rlike(r"\d$") | right.rlike(r"^\d"), True)
        .when(F.instr(F.lit(PUNCTUATION), head) > 0, True)
        .when(~(left.rlike(r"\p{L}$") & right.rlike(r"^\p{L}")), True)
        .otherwise(is_compound(left, lw, rw, words, valid_break(lw, rw) if syllables else None))
    )


def is_compound(left: Column, lw: Column, rw: Column, words: Column | None = None, breaks: Column | None = None) -> Column:
    """The tests of P09 on words alone: markings, single letters, known words, prefixes, function words, syllables, capitals."""
    known = F.lit(None).cast("boolean")
    if words is not None:
        has = lambda x: F.array_contains(words, F.lower(x))
        known = F.when(has(F.concat(lw, rw)), False).when(has(lw) & has(rw), True)
    return (
        F.when(left.rlike(MARKINGS), True)
        .when((F.length(lw) <= 1) | (F.length(rw) <= 1), True)
        .when(known.isNotNull(), known)
        .when(F.lower(lw).isin(PREFIXES), True)
        .when(F.lower(rw).isin(TAILS), True)
        .when(F.lit(False) if breaks is None else breaks.isNotNull(), F.lit(False) if breaks is None else ~breaks)
        .otherwise(rw.rlike(r"^\p{Lu}"))
    )


def join_lines(lines: Column, words: Column | None = None) -> Column:
    """Lines joined into running text: broken words glued, compounds kept (P12). A fold over the array."""
    prepared = F.filter(F.transform(lines, lambda x: strip(clean_span_text(F.coalesce(x, F.lit(""))))), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        # The accumulator is the text so far; a NUL marks where its last line began.
        prev, cur = rstrip(F.substring_index(acc, "\x00", -1)), lstrip(line)
        before = F.substring(acc, F.lit(1), F.length(acc) - F.length(F.substring_index(acc, "\x00", -1)))
        parts = split_trailing_hyphen(prev)
        left, hyphen = parts["left"], parts["hyphen"]
        broken = hyphen.isNotNull() & left.rlike(r"\p{L}$") & cur.rlike(r"^\p{L}")
        return (
            F.when(acc == "", line)
            .when(broken & ~keeps_hyphen(prev, cur, words), F.concat(before, left, cur))
            .when(broken & cur.rlike(r"^\p{Ll}"), F.concat(before, left, hyphen, cur))
            .otherwise(F.concat(acc, F.lit("\x00"), cur))
        )

    return normalize_whitespace(F.replace(F.aggregate(prepared, F.lit(""), step), F.lit("\x00"), F.lit(" ")))


def line_text(spans: Column) -> Column:
    """Spans of a line from left to right, concatenated."""
    order = F.transform(spans, lambda s, i: F.struct(F.round(s["bbox"]["x0"], 3).alias("x"), i.alias("i"), clean_span_text(s["text"]).alias("t")))
    return normalize_whitespace(F.array_join(F.transform(F.array_sort(order), lambda s: s["t"]), ""))


def text_quality(c: Column) -> Column:
    """Score from 0 to 1 by the share of letters and digits, words, single letters and gaps (P14); '' has 0."""
    n = F.length(F.regexp_replace(c, WS, ""))
    good = F.regexp_count(c, F.lit(r"[\p{L}\p{Nd}]"))
    words = tokens(c)
    k = F.size(words)
    single = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
    gaps = F.regexp_count(c, F.lit(f"{WS}+"))
    score = (
        F.least(F.lit(0.45), good / n * 0.45)
        + F.when(k >= 2, 0.25).otherwise(0.0) + F.when(k >= 5, 0.15).otherwise(0.0)
        - F.when(k > 0, F.least(F.lit(0.45), single / k * 0.65)).otherwise(0.0)
        - F.when(gaps > F.greatest(F.lit(2.0), n * 0.35), 0.15).otherwise(0.0)
    )
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).when(c.isNotNull(), 0.0)


def count_list_lines(c: Column) -> Column:
    """Lines that begin with a bullet, a number or a letter."""
    return F.regexp_count(c, F.lit(LIST_LINE))


def strip_tags(c: Column, strict: bool = False) -> Column:
    """Without inline tags, white space collapsed (P18). As it stands a tag only has to begin with one of the names;
    ``strict`` wants the whole name."""
    tags = INLINE_TAGS.replace("[^>]*", r"(?:\s[^>]*)?/?") if strict else INLINE_TAGS
    return strip(F.regexp_replace(F.regexp_replace(c, tags, ""), f"{WS}{{2,}}", " "))


def numbers(c: Column) -> Column:
    """All numbers that touch no word character, with sign, exponent, per cent."""
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def normalize_number(c: Column) -> Column:
    """Value of such a number; NULL if it has none (P20, as intended: a minus sign counts as one)."""
    plain = F.regexp_replace(F.replace(c, F.lit("−"), F.lit("-")), rf"{WS}+|[%‰]$", "")
    return F.coalesce(F.replace(plain, F.lit(","), F.lit(".")).try_cast("double"), F.replace(plain, F.lit(","), F.lit("")).try_cast("double"))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def repetition_ratio(c: Column, n: int = 6) -> Column:
    """Share of word n-grams that are repetitions; 0 below 2n words."""

    def ratio(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        shares = F.transform(F.array(grams), lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g))
        return F.when(F.size(words) >= 2 * n, F.element_at(shares, 1)).otherwise(0.0)

    # Bound as elements of arrays, so that words and grams are made once and not for every use of them.
    return F.element_at(F.transform(F.array(words_of(c)), ratio), 1)


def strip_wrappers(c: Column) -> Column:
    """An answer without code fences, marker lines, inline markers and a known preamble line (P22); NULL is ''."""
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*```(?:text|markdown)?\s*", ""), r"\s*```\s*$", "")
    c = F.regexp_replace(c, rf"(?i)^(?:[ \t]*{MARKER}[ \t]*(?:\n|$))+", "")
    c = strip(F.regexp_replace(c, rf"(?i)(?:(?:^|\n)[ \t]*{MARKER}[ \t]*)+$", ""))
    c = strip(F.regexp_replace(F.regexp_replace(c, f"(?i){MARKER}", ""), r"\n{3,}", "\n\n"))
    first = F.lower(strip(F.substring_index(c, "\n", 1)))
    return strip(F.when(first.isin(*PREAMBLES), F.regexp_replace(c, r"^[^\n]*(?:\n|$)", "")).otherwise(c))


def postprocess_target(c: Column, lang: Column) -> Column:
    """Blanks around punctuation as the target language has them."""
    c = strip(F.regexp_replace(c, r"[ \t]+", " "))
    c = F.regexp_replace(c, rf"{WS}+([,.;:!?])", "$1")
    c = F.regexp_replace(c, rf"([(\[«„]){WS}+", "$1")
    c = F.regexp_replace(c, r"([,.;:!?])(?=[A-Za-zА-Яа-яЁё])", "$1 ")
    ru = F.replace(F.regexp_replace(c, rf"{WS}*—{WS}*", " — "), F.lit("..."), F.lit("…"))
    return F.when(lang == "ru", ru).otherwise(c)


def safe_name(c: Column) -> Column:
    """Runs of characters that a file name shouldn't have become '_' (P24)."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def format_time(seconds: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes (P25)."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.concat(F.bround(seconds, 0).cast("int").cast("string"), F.lit("с")))
        .when(seconds < 3600, F.format_string("%dм %02dс", F.floor(whole / 60), F.pmod(whole, F.lit(60))))
        .otherwise(F.format_string("%dч %02dм", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)))
    )


def block_font_size(font_size: Column, lines: Column) -> Column:
    """Font size of a block if positive, else the median of its spans' positive sizes, else 0."""
    sizes = F.array_sort(F.filter(F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["size"]))), lambda v: v > 0))
    n = F.size(sizes)
    mid = lambda i: F.get(sizes, i.cast("int"))
    median = (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2
    return F.when(font_size > 0, font_size).when(n > 0, median).otherwise(0.0)


def escape(c: Column) -> Column:
    """HTML entities for & < > " '."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight_refs(escaped: Column) -> Column:
    """Reference marks in a span element."""
    return F.regexp_replace(escaped, f"({REFERENCE_MARK})", '<span class="ref-link">$1</span>')


def reference_entries(line_texts: Column) -> Column:
    """Entries of a list of references: a line that begins with a number and a period begins one."""
    kept = F.filter(F.transform(line_texts, strip), lambda x: x != "")
    marked = F.regexp_replace(F.array_join(kept, "\n"), r"\n(\d+\.)", "\x01$1")
    return F.when(F.size(kept) > 0, F.transform(F.split(marked, "\x01"), lambda e: F.replace(e, F.lit("\n"), F.lit(" ")))).otherwise(F.array().cast("array<string>"))


def model_matches(expected: Column, actual: Column) -> Column:
    """Equal, or one within the other, whole or by the part after the last slash, whatever the case."""
    e, a = F.lower(expected), F.lower(actual)
    eb, ab = F.substring_index(e, "/", -1), F.substring_index(a, "/", -1)
    hit = (e == a) | F.contains(a, e) | F.contains(e, a) | F.contains(ab, eb) | F.contains(eb, ab)
    return F.coalesce((e != "") & (a != "") & hit, F.lit(False))


def split_sentences(c: Column, max_chars: int = 1800, min_chars: int = 650) -> Column:
    """Pieces of whole sentences of at most ``max_chars``, short ones merged into the piece before.

    A text that fits is one piece; a text without a boundary is packed by words. Two folds over arrays.
    """
    mark = "\x02"
    bounded = F.regexp_replace(c, r"([.!?][\]\"'”’)]*)\s+(?=[A-ZА-ЯЁ0-9])", "$1" + mark)
    raw = F.transform(F.split(bounded, mark), strip)
    # A boundary after an abbreviation is none: the part is joined to the next one.
    held = F.aggregate(
        raw, F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & F.right(F.element_at(acc, -1), F.lit(12)).rlike(ABBREVIATIONS),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), p))),
        ).when(p == "", acc).otherwise(F.concat(acc, F.array(p))),
    )
    parts = F.when(F.size(held) <= 1, tokens(c)).otherwise(held)
    packed = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) + 1 <= max_chars),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    merged = F.aggregate(
        packed, F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.length(p) < min_chars) & (F.length(F.element_at(acc, -1)) + F.length(p) + 1 <= max_chars),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(F.length(c) <= max_chars, F.array(c)).when(F.size(held) <= 1, packed).otherwise(merged if min_chars else packed)


def split_paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n\s*\n"), strip), lambda p: p != "")


def split_by_paragraphs(c: Column, max_chars: int = 1800) -> Column:
    """Paragraphs, long ones split into sentences; [] where there is nothing to split."""
    paras = split_paragraphs(c)
    pieces = F.flatten(F.transform(paras, lambda p: split_sentences(p, max_chars, max(80, max_chars // 3))))
    none = F.array().cast("array<string>")
    return F.when(F.length(c) <= max_chars, F.array(c)).when((F.size(paras) > 1) & (F.size(pieces) > 1), pieces).otherwise(none)
