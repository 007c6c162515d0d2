"""Predicates on the text of blocks, lines and cells, as boolean Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import WS, normalize_text, strip, tokens

# Patterns of captions, back matter, footers, citations, cells.
TABLE_CAPTION = r"(?i)^\s*(?:Table|Таблица|Табл\.?)\s+\d+"
TABLE_CAPTION_STRICT = TABLE_CAPTION + r"\s*[|:.–—-]"
FIGURE_CAPTION = r"(?i)^\s*(?:Fig(?:ure)?\.?\s*\d+|Рис\.?\s*\d+|Схема\s*\d+)"
FIGURE_CAPTION_STRICT = FIGURE_CAPTION + r"\s*[|:.,–—-]"
FIGURE_VERBS = r"(?i)(?U)\b(?:illustrates?|shows?|depicts?|displays?|demonstrates?|presents?|изобража\w*|показыва\w*|иллюстрир\w*)\b"
CAPTION = r"(?i)(?U)^\s*(?:рисунок|рис\.?|figure|fig\.?|табл\w*|table|схема|scheme|график|chart|diagram|диаграмма)\s*\d+"
CAPTION_LIKE = r"(?i)(?U)^\s*(?:fig\.?|figure|рис\.?|рисунок|схема|scheme|табл\w*|table|график|chart|diagram|диаграмма)\b"
BACK_MATTER = (
    r"(?i)^\s*(Acknowledg(?:ement|ment)s?\b|Author\s+contributions?\b|Funding\b|Competing\s+interests?\b|Additional\s+information\b|"
    r"Supplementary\s+information\b|Supplementary\s+notes?\b|Correspondence\b|Reprints?\s+and\s+permissions?\b|Publisher\s*'?s?\s+note\b|"
    r"Open\s+Access\b|Conflict(?:s)?\s+of\s+interest\b|Ethics\s+declarations?\b|Ethical\s+approval\b|Consent\s+to\s+participate\b|"
    r"Consent\s+for\s+publication\b|Data\s+availability\b|Code\s+availability\b|Availability\s+of\s+data\s+and\s+materials\b|"
    r"Declarations?\b|Received[:.]?\s+\d|Presented\s+at\b)"
)
FOOTER = r"(?i)^\s*(?:Page|Страница|P\.?\s*p?\.?|S\.?\s*p?\.?)\s*\d+\s*$"
AUTHOR = r"^\s*[A-Z][a-z]+\s+(?:et\s+al\.|and\s+[A-Z][a-z]+)\s*$"
JOURNAL_LINE = r"(?i)^(?:Author\s+manuscript|PMC\s+\d{4}|NIH-PA|Clin\s+Neurophysiol|Available\s+in\s+PMC)"
REF_CELL = r"(?i)(?:DOI:|Vol\.|Pp?\.\s|Art\.\s|http|//\s*\w+\.\w+|р\.\s|Том\s|№\s|С\.\s|\d{4}\.\s|\w+\.\s+\w+\.\s*\d{4}|Ser\.\s|pp\.\s|pp\.,|pp\.)"
REF_STYLE = r"(?:[A-Z][a-z]+\s+[A-Z]\.[A-Z]?\.|[A-Z][a-z]+\s+[A-Z]\.?\s+[A-Z][a-z]+)"
REF_NUMBER = r"^\d+\.\s+[A-Z]"
REF_HEADINGS = (
    r"Список\s+использованной\s+литературы|Список\s+использованных\s+источников|Библиографический\s+список|References?\s+and\s+notes?|"
    r"Reference\s+list|Использованная\s+литература|Список\s+литературы|Список\s+источников|References?|Bibliography|Библиография|"
    r"Литература|Источники"
)
REF_HEADING = rf"(?i)^\s*(?:{REF_HEADINGS})\s*[:.]?\s*$"
REF_HEADING_TRIM = r"[ \t:.,;—–-]"
NAME = r"[A-ZА-Я][A-Za-zА-Яа-я'’\-]+"
CITATION = (
    rf"^\s*(?:\(?{NAME}(?:\s+(?:et\s+al\.?|and\s+{NAME}|&\s*{NAME}))?\s*,?\s*(?:19|20)\d{{2}}[a-z]?\)?"
    rf"|\(?(?:{NAME}(?:\s*,\s*|\s*&\s*)?)+\s*,\s*(?:19|20)\d{{2}}[a-z]?\)?)[.,;]?\s*$"
)
CITATION_NUMBERS = r"^\s*(?:\d{1,3}(?:\s*[-–—,;]\s*\d{1,3})*|\[[0-9,\-–— ]+\])\s*[.]?\s*$"
CITATION_NAME = r"^(?:[A-Z][A-Za-z'’\-]+(?:\s+et\s+al\.?)?)(?:\s*\(?(?:19|20)\d{2}\)?)?\.?$"
META_PREFIXES = (
    "analysis:", "reasoning:", "chain of thought:", "thoughts:", "translation note:", "translator note:", "here is the translation:",
    "вот перевод:", "анализ:", "рассуждение:", "объяснение:", "я не могу перевести", "не могу перевести",
)
META_ANYWHERE = r"(?i)\b(i cannot|i can't|i am unable|as an ai|as a language model)\b"
COMMON_WORDS = (
    "the and for with from that this are was not but have has had one two all can her our out day his how its let may new now old see "
    "way who did get got him hit man put say she too use mean table value index group total score range level count percent rate sign "
    "test data type name case high low"
).split()
TRANSLATED_NOT = ("figure", "table", "empty", "metadata", "reference", "reference_heading")
COLUMN_GAP = r"\s{3,}|\t+"


def is_table_caption(c: Column) -> Column:
    """with a separator always, without one only if short."""
    return F.coalesce((c.rlike(TABLE_CAPTION)) & (c.rlike(TABLE_CAPTION_STRICT) | ((F.length(c) <= 120) & (F.size(tokens(c)) <= 15))), F.lit(False))


def is_figure_caption(c: Column) -> Column:
    """with a separator always; not a bare label, a long text or a sentence about the figure."""
    rest = F.regexp_replace(F.regexp_replace(c, FIGURE_CAPTION, ""), r"^\s+", "")
    return F.coalesce(
        c.rlike(FIGURE_CAPTION) & (c.rlike(FIGURE_CAPTION_STRICT) | ((rest != "") & (F.length(c) <= 160) & ~c.rlike(FIGURE_VERBS))), F.lit(False)
    )


def is_caption(c: Column) -> Column:
    """any caption word with a number."""
    return F.coalesce(c.rlike(CAPTION), F.lit(False))


def looks_like_axis_label(c: Column) -> Column:
    """short, no caption, with a digit."""
    t = strip(c)
    named = t.rlike(r"(?i)(?U)^\s*(?:table|fig\.?|figure|рис|схема|scheme)\b")
    return F.coalesce((t != "") & (F.length(t) <= 60) & ~is_caption(t) & ~named & t.rlike(r"\d"), F.lit(False))


def looks_like_figure_label(c: Column, nlines: Column, font_size: Column, body: Column) -> Column:
    """a short text with a digit, one short word, or one line no larger than the body's font."""
    t = strip(c)
    fits = (t != "") & (F.length(t) <= 80) & ~is_figure_caption(t) & ~t.rlike(CAPTION_LIKE)
    one = (F.length(t) <= 12) & t.rlike(r"^\(?[A-Za-zА-Яа-яЁё]{1,12}\)?$")
    line = (nlines <= 1) & (F.length(t) <= 60) & (body > 0) & (font_size <= body + 0.5)
    return F.coalesce(fits & (t.rlike(r"\d") | one | line), F.lit(False))


def is_short_dataless_table(kind: Column, table_data: Column, text: Column) -> Column:
    """F06."""
    return (kind == "table") & (F.coalesce(F.size(table_data), F.lit(0)) <= 0) & (F.length(F.coalesce(text, F.lit(""))) <= 250)


def is_eligible_for_running_head(kind: Column, table_data: Column, text: Column) -> Column:
    """F07."""
    return kind.isin("paragraph", "text", "heading") | is_short_dataless_table(kind, table_data, text)


def is_back_matter(c: Column) -> Column:
    return F.coalesce(c.rlike(BACK_MATTER), F.lit(False))


def is_footer(c: Column) -> Column:
    """a page line or a line of authors."""
    t = strip(c)
    return F.coalesce(t.rlike(FOOTER) | t.rlike(AUTHOR), F.lit(False))


def is_journal_line(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(JOURNAL_LINE), F.lit(False))


def is_reference_table(rows: Column) -> Column:
    """more than 0.3 signs of references for each cell that isn't empty."""
    cells = F.filter(F.transform(F.flatten(rows), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    signs = F.aggregate(
        cells, F.lit(0), lambda a, x: a + x.rlike(REF_CELL).cast("int") + x.rlike(REF_STYLE).cast("int") + x.rlike(REF_NUMBER).cast("int")
    )
    return F.coalesce((F.size(cells) > 0) & (signs / F.size(cells) > 0.3), F.lit(False))


def filled_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def _last_off(lines: Column) -> Column:
    return F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))


def looks_like_table_data(c: Column) -> Column:
    """two lines or more, none but the last ends a sentence, all of one number of columns, or all short."""
    lines = filled_lines(c)
    counts = F.array_distinct(F.transform(lines, lambda x: F.size(F.split(x, COLUMN_GAP))))
    same = (F.size(counts) == 1) & (F.element_at(counts, 1) >= 2)
    fits = (
        (F.size(lines) >= 2) & ~F.exists(_last_off(lines), lambda x: x.rlike(r"[.!?]\s*$"))
        & (F.when(F.size(lines) >= 1, same).otherwise(False) | F.forall(lines, lambda x: F.length(x) < 60))
    )
    return F.coalesce(F.when(F.contains(c, F.lit("\n")), fits), F.lit(False))


def is_likely_table(c: Column) -> Column:
    """lines of several columns agree on their number and none but the last ends a sentence."""
    lines = filled_lines(c)
    counts = F.array_distinct(F.filter(F.transform(lines, lambda x: F.size(F.split(strip(x), COLUMN_GAP))), lambda n: n >= 2))
    fits = (F.size(lines) >= 2) & (F.size(counts) == 1) & ~F.exists(_last_off(lines), lambda x: x.rlike(r"[.!?;]\s*$"))
    return F.coalesce(F.when(F.contains(c, F.lit("\n")), fits), F.lit(False))


def is_short_citation(c: Column) -> Column:
    """an author and a year, numbers, or a name with either."""
    t = normalize_text(c)
    named = (F.length(t) <= 50) & t.rlike(CITATION_NAME) & t.rlike(r"(?i)(?:19|20)\d{2}|et\s+al")
    return F.coalesce((t != "") & (F.length(t) <= 140) & (t.rlike(CITATION) | t.rlike(CITATION_NUMBERS) | named), F.lit(False))


def looks_like_meta_response(c: Column) -> Column:
    """an answer about the task instead of a translation."""
    lines = F.slice(F.filter(F.transform(F.split(strip(c), "\n"), lambda x: F.lower(strip(x))), lambda x: x != ""), 1, 2)
    begins = F.exists(lines, lambda x: F.exists(F.array(*map(F.lit, META_PREFIXES)), lambda p: F.startswith(x, p)))
    return F.coalesce((strip(c) != "") & (begins | c.rlike(META_ANYWHERE)), F.lit(False))


def cluster_passes_size(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """F14."""
    return (w >= 30) & (h >= 20) & (w * h >= 1500) & ~((w > page_w * 0.6) & (h < page_h * 0.15))


def is_translatable(kind: Column, text: Column) -> Column:
    """F15."""
    return ~kind.isin(*TRANSLATED_NOT) & (F.length(strip(F.coalesce(text, F.lit("")))) >= 2)


def is_reversed(c: Column) -> Column:
    """F16: its reversal has more common words, or it is a number with the comparison behind it."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-zA-Z]{3,})"), F.lit(1)))
    common = F.array(*map(F.lit, COMMON_WORDS))
    ahead, back = F.size(F.array_intersect(words(c), common)), F.size(F.array_intersect(words(F.reverse(c)), common))
    return F.coalesce((F.length(c) >= 3) & (((back > ahead) & (back >= 1)) | c.rlike(r"^[\d.,]+[<>≤≥]$")), F.lit(False))


def is_ref_heading_line(c: Column) -> Column:
    """A line of nothing but keywords of reference lists and punctuation."""
    rest = F.regexp_replace(c, f"(?i){REF_HEADINGS}", "")
    return F.coalesce(c.rlike(f"(?i){REF_HEADINGS}") & (F.regexp_replace(rest, REF_HEADING_TRIM, "") == ""), F.lit(False))
