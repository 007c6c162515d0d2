"""Queries of the core operators over the tables of a directory, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import predicates as P
from folio.functions import text as T
from folio.operators import classify as C
from folio.operators import figures, layout, masking, refs, render, running, summary, tables, translate, validate
from folio.sources import attach, load, reading_text, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Rows of a large table; where a small file has fewer splits than there are cores, they are spread over all."""
    return spread(load(spark, d, name))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").withColumn("text", reading_text())


def _lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("lines IS NOT NULL")
    return b.select("block_id", "doc_id", "page_num", F.posexplode("lines").alias("line_no", "line"))


# --- SQL shared by the queries below (DuckDB)
WS = r"[\s\x0B\x{85}\p{Z}]"
TEXT = (
    "coalesce(text_override, trim(array_to_string(flatten(list_transform(lines, lambda l: list_transform(l.spans, lambda s: s.text))), ' ')))"
)
B = f"b AS (SELECT *, {TEXT} AS text FROM blocks)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _lines_of(x: str) -> str:
    return f"list_filter(string_split({x}, chr(10)), lambda x: {_strip('x')} <> '')"


NORM = f"regexp_replace(lower({_strip('text')}), '{WS}+', ' ', 'g')"
CANON = f"trim(regexp_replace(regexp_replace(regexp_replace({NORM}, '^[0-9]{{1,4}} +', ''), ' +[0-9]{{1,4}}$', ''), ' +', ' ', 'g'))"
TOKENS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')"


W = r"\p{L}\p{M}\p{N}_"
_AGAIN = lambda x, pattern, to: f"regexp_replace(regexp_replace({x}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"


def _normalized(x: str) -> str:
    """Runs of line ends of two or more stand as one sign while single ones become blanks."""
    x = _AGAIN(x, rf"([{W}]+)-\s*\n\s*([{W}]+)", r"\1\2")
    x = _AGAIN(x, rf"([{W}])-{WS}+([a-zа-яё])", r"\1-\2")
    x = f"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g')"
    x = f"replace(replace(regexp_replace({x}, '\n\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10))"
    return _strip(x)


ABBREVIATED = r"(?i)\b(?:e\.g|i\.e|et al|fig|figs|eq|eqs|dr|mr|mrs|ms|prof|no|nos|vs|approx|ca|p|pp)\.$"
_APPEND = "list_concat({0}[1:len({0}) - 1], [{0}[-1] || ' ' || {1}[1]])"


def _fold(items: str, when: str) -> str:
    """A fold over texts: the next one joins the last where ``when`` holds of acc and x (a list of one)."""
    return f"list_reduce(list_transform({items}, lambda p: [p]), lambda acc, x: CASE WHEN {when} THEN {_APPEND.format('acc', 'x')} ELSE list_concat(acc, x) END)"


def _pieces(table: str, text: str, limit: int, least: int) -> str:
    """CTEs s1..s4 over ``table`` that end with ``pieces``, as P16 makes them."""
    marked = rf"string_split(regexp_replace({text}, '([.!?][\]\"''”’)]*)[\s\x0B]+([A-ZА-ЯЁ0-9])', '\1' || chr(2) || '\2', 'g'), chr(2))"
    fits = f"length(acc[-1]) + length(x[1]) + 1 <= {limit}"
    merged = f"CASE WHEN len(packed) < 2 THEN packed ELSE {_fold('packed', f'length(x[1]) < {least} AND ' + fits)} END" if least else "packed"
    return f"""s1 AS (SELECT *, list_filter(list_transform({marked}, lambda p: {_strip('p')}), lambda p: p <> '') AS raw FROM {table}),
s2 AS (SELECT *, CASE WHEN len(raw) < 2 THEN raw ELSE {_fold('raw', f"regexp_matches(right(acc[-1], 12), '{ABBREVIATED}')")} END AS held FROM s1),
s3 AS (SELECT *, CASE WHEN len(held) <= 1 THEN list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '') ELSE held END AS parts FROM s2),
s4 AS (SELECT *, CASE WHEN len(parts) < 2 THEN parts ELSE {_fold('parts', fits)} END AS packed FROM s3),
s5 AS (SELECT *, CASE WHEN length({text}) <= {limit} THEN [{text}] WHEN len(held) <= 1 THEN packed ELSE {merged} END AS pieces FROM s4)"""


@query(f"""WITH {B} SELECT block_id,
  {_strip("regexp_replace(translate(text, chr(13) || chr(10) || chr(173), '  '), '[ \\t\\f\\x0B]+', ' ', 'g')")} AS ws,
  translate(text, chr(13) || chr(10) || chr(173), '  ') AS span FROM b""")
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    """P01, P02."""
    return blocks(spark, d).select("block_id", T.normalize_whitespace(F.col("text")).alias("ws"), T.clean_span_text(F.col("text")).alias("span"))


@query(f"WITH {B} SELECT block_id, {NORM} AS norm, {CANON} AS canon FROM b")
def canonical_head(spark: SparkSession, d: str) -> DataFrame:
    """P04, P05."""
    return blocks(spark, d).select("block_id", T.dedup_key(F.col("text")).alias("norm"), T.running_head_key(F.col("text")).alias("canon"))


@query(f"WITH {B} SELECT block_id, {_normalized('text')} AS normalized FROM b")
def normalize_texts(spark: SparkSession, d: str) -> DataFrame:
    """P03."""
    return blocks(spark, d).select("block_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(rf"""WITH {B}, h AS (SELECT block_id, regexp_replace(text, '{WS}+$', '') AS s FROM b WHERE text IS NOT NULL)
SELECT block_id, CASE WHEN ends THEN regexp_replace(substr(s, 1, length(s) - 1), '{WS}+$', '') ELSE s END AS "left",
  CASE WHEN ends THEN right(s, 1) END AS hyphen,
  coalesce(list_last(regexp_extract_all(s, '{T.WORD.replace("'", "''")}')), '') AS last_word,
  regexp_extract(s, '{T.WORD.replace("'", "''")}') AS first_word
FROM (SELECT *, s <> '' AND instr('{T.HYPHENS}', right(s, 1)) > 0 AS ends FROM h)""")
def hyphen_edges(spark: SparkSession, d: str) -> DataFrame:
    """P07, P08."""
    s = T.rstrip(F.col("text"))
    return blocks(spark, d).where("text IS NOT NULL").select(
        "block_id", T.split_trailing_hyphen(F.col("text")).alias("p"), T.last_word(s).alias("last_word"), T.first_word(s).alias("first_word")
    ).select("block_id", "p.left", "p.hyphen", "last_word", "first_word")


@query(f"""WITH {B}, q AS (SELECT block_id, length(regexp_replace(text, '{WS}', '', 'g')) AS n,
  length(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS good, len({TOKENS}) AS k,
  len(list_filter({TOKENS}, lambda w: regexp_full_match(w, '\\p{{L}}'))) AS single, len(regexp_extract_all(text, '{WS}+')) AS gaps
  FROM b WHERE text IS NOT NULL)
SELECT block_id, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, least(0.45, good / n * 0.45) + CASE WHEN k >= 2 THEN 0.25 ELSE 0 END
  + CASE WHEN k >= 5 THEN 0.15 ELSE 0 END - CASE WHEN k > 0 THEN least(0.45, single / k * 0.65) ELSE 0 END
  - CASE WHEN gaps > greatest(2.0, n * 0.35) THEN 0.15 ELSE 0 END)) END::DOUBLE, 6) AS quality FROM q""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """P14."""
    return blocks(spark, d).where("text IS NOT NULL").select("block_id", F.round(T.text_quality(F.col("text")), 6).alias("quality"))


@query(f"""WITH {B} SELECT block_id, len(regexp_extract_all(text, '{T.LIST_LINE}'))::INT AS items FROM b WHERE text IS NOT NULL""")
def list_lines(spark: SparkSession, d: str) -> DataFrame:
    """P15."""
    return blocks(spark, d).where("text IS NOT NULL").select("block_id", T.count_list_lines(F.col("text")).alias("items"))


@query(f"""SELECT doc_id, {_strip(f"regexp_replace(regexp_replace(text, '(?i)</?(?:b|i|u|em|strong|small|sub|sup|span|font)[^>]*>', '', 'g'), '{WS}{{2,}}', ' ', 'g')")} AS plain
FROM documents WHERE text IS NOT NULL""")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """P18."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.strip_tags(F.col("text")).alias("plain"))


@query()
def numbers(spark: SparkSession, d: str) -> DataFrame:
    """P19, P20, A10 (look-around: tested against brute force): numbers of a block's two sides and whether they agree."""
    b = blocks(spark, d).where("translation IS NOT NULL AND text IS NOT NULL")
    values = lambda c: F.array_sort(F.transform(T.numbers(F.col(c)), T.normalize_number))
    return b.select("block_id", F.size(T.numbers(F.col("text"))).alias("n"), (values("text") == values("translation")).alias("same"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) >= 12 THEN list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' ')) END AS g FROM w)
SELECT doc_id, round(CASE WHEN n >= 12 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0 END::DOUBLE, 6) AS ratio FROM g""")
def repetition(spark: SparkSession, d: str) -> DataFrame:
    """P21, A06."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(T.repetition_ratio(F.col("text")), 6).alias("ratio"))


_MARKER = r"(?:<<<\s*(?:END_)?[A-Z_][A-Z0-9_]*\s*>>>|\[/?(?:END_)?(?:CTX|SRC|OUT)\])"


def _unwrapped(x: str) -> str:
    """CTEs w1..w4 over table w0 that end with ``plain``, as P22 makes it of column ``x``."""
    return rf"""w1 AS (SELECT *, regexp_replace(regexp_replace({_strip(x)}, '(?i)^\s*```(?:text|markdown)?\s*', ''), '\s*```\s*$', '') AS c FROM w0),
w2 AS (SELECT * REPLACE ({_strip(f"regexp_replace(regexp_replace(c, '(?i)^(?:[ \t]*{_MARKER}[ \t]*(?:\n|$))+', ''), '(?i)(?:(?:^|\n)[ \t]*{_MARKER}[ \t]*)+$', '', 'g')")} AS c) FROM w1),
w3 AS (SELECT * REPLACE ({_strip(f"regexp_replace(regexp_replace(c, '(?i){_MARKER}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS c) FROM w2),
w4 AS (SELECT *, {_strip(f"CASE WHEN lower({_strip('string_split(c, chr(10))[1]')}) IN ('translation:', 'translated text:', 'here is the translation:', 'here''s the translation:', 'перевод:', 'вот перевод:') THEN regexp_replace(c, '^[^\n]*(?:\n|$)', '') ELSE c END")} AS plain FROM w3)"""


@query(rf"""WITH w0 AS (SELECT block_id, translation, target_lang FROM blocks LEFT JOIN papers USING (doc_id) WHERE translation IS NOT NULL), {_unwrapped("translation")},
p1 AS (SELECT *, {_strip("regexp_replace(plain, '[ \t]+', ' ', 'g')")} AS t FROM w4),
p2 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(t, '{WS}+([,.;:!?])', '\1', 'g'), '([(\[«„]){WS}+', '\1', 'g'), '([,.;:!?])([A-Za-zА-Яа-яЁё])', '\1 \2', 'g') AS t) FROM p1)
SELECT block_id, plain, CASE WHEN target_lang = 'ru' THEN replace(regexp_replace(t, '{WS}*—{WS}*', ' — ', 'g'), '...', '…') ELSE t END AS target FROM p2""")
def stripped_answers(spark: SparkSession, d: str) -> DataFrame:
    """P22, P23."""
    p = load(spark, d, "papers").select("doc_id", "target_lang")
    b = table(spark, d, "blocks").where("translation IS NOT NULL").join(p, "doc_id", "left")
    plain = T.strip_wrappers(F.col("translation"))
    return b.select("block_id", plain.alias("plain"), T.postprocess_target(plain, F.coalesce("target_lang", F.lit(""))).alias("target"))


@query(f"""SELECT doc_id, regexp_replace(coalesce(title, ''), '[^A-Za-z0-9_.-]+', '_', 'g') AS safe,
  coalesce(contains(lower(journal), lower(mode)), FALSE) OR coalesce(contains(lower(mode), lower(journal)), FALSE) AS matches FROM papers""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """P24, P29."""
    return load(spark, d, "papers").select("doc_id", T.safe_name(F.coalesce("title", F.lit(""))).alias("safe"), T.model_matches(F.col("journal"), F.col("mode")).alias("matches"))


@query("""SELECT doc_id, CASE WHEN s < 60 THEN round_even(s, 0)::INT || 'с' WHEN s < 3600 THEN (s::BIGINT // 60) || 'м ' || lpad((s::BIGINT % 60)::VARCHAR, 2, '0') || 'с'
  ELSE (s::BIGINT // 3600) || 'ч ' || lpad(((s::BIGINT % 3600) // 60)::VARCHAR, 2, '0') || 'м' END AS took
FROM (SELECT doc_id, n_chars % 9000 AS s FROM documents WHERE n_chars IS NOT NULL)""")
def format_times(spark: SparkSession, d: str) -> DataFrame:
    """P25, over numbers of characters taken as seconds."""
    return table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", T.format_time(F.col("n_chars") % 9000).alias("took"))


@query("""WITH s AS (SELECT block_id, font_size, list_filter(flatten(list_transform(lines, lambda l: list_transform(l.spans, lambda s: s.size))), lambda v: v > 0) AS v FROM blocks)
SELECT block_id, CASE WHEN font_size > 0 THEN font_size WHEN len(v) > 0 THEN list_aggregate(v, 'median') ELSE 0.0 END::DOUBLE AS size FROM s""")
def block_fonts(spark: SparkSession, d: str) -> DataFrame:
    """P26."""
    return table(spark, d, "blocks").select("block_id", T.block_font_size(F.col("font_size"), F.col("lines")).alias("size"))


@query(rf"""WITH {B} SELECT block_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
  '({T.REFERENCE_MARK})', '<span class="ref-link">\1</span>', 'g') AS html FROM b""")
def highlighted_refs(spark: SparkSession, d: str) -> DataFrame:
    """P27."""
    return blocks(spark, d).select("block_id", T.highlight_refs(T.escape(F.col("text"))).alias("html"))


@query(rf"""WITH k AS (SELECT block_id, list_filter(list_transform(lines, lambda l: {_strip("array_to_string(list_transform(l.spans, lambda s: s.text), ' ')")}), lambda x: x <> '') AS k
  FROM blocks WHERE lines IS NOT NULL)
SELECT block_id, unnest(list_transform(string_split(regexp_replace(array_to_string(k, chr(10)), '\n([0-9]+\.)', chr(1) || '\1', 'g'), chr(1)),
  lambda e: replace(e, chr(10), ' '))) AS entry FROM k WHERE len(k) > 0""")
def reference_entries(spark: SparkSession, d: str) -> DataFrame:
    """P28."""
    b = table(spark, d, "blocks").where("lines IS NOT NULL")
    texts = F.transform("lines", lambda x: F.array_join(F.transform(x["spans"], lambda s: s["text"]), " "))
    return b.select("block_id", F.explode(T.reference_entries(texts)).alias("entry"))


@query(f"""WITH {B}, t AS (SELECT block_id, text FROM b WHERE text IS NOT NULL), {_pieces("t", "text", 1800, 650)}
SELECT block_id, unnest(range(len(pieces)))::INT AS piece_no, unnest(pieces) AS piece FROM s5""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 1,800 characters of every block."""
    return blocks(spark, d).where("text IS NOT NULL").select("block_id", F.posexplode(T.split_sentences(F.col("text"))).alias("piece_no", "piece"))


@query(rf"""WITH {B}, a AS (SELECT block_id, text AS whole, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[\s\x0B]*\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps
  FROM b WHERE text IS NOT NULL),
t AS (SELECT block_id, whole, len(ps) AS n, unnest(range(len(ps))) AS i, unnest(ps) AS para FROM a WHERE length(whole) > 1800 AND len(ps) > 1), {_pieces("t", "para", 1800, 600)},
m AS (SELECT block_id, flatten(list(pieces ORDER BY i)) AS pieces FROM s5 GROUP BY block_id),
r AS (SELECT block_id, [text] AS pieces FROM b WHERE length(text) <= 1800 UNION ALL SELECT block_id, pieces FROM m WHERE len(pieces) > 1)
SELECT block_id, unnest(range(len(pieces)))::INT AS piece_no, unnest(pieces) AS piece FROM r""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    """P17."""
    return blocks(spark, d).where("text IS NOT NULL").select("block_id", F.posexplode(T.split_by_paragraphs(F.col("text"))).alias("piece_no", "piece"))


@query()
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """P09-P13 (a fold: tested on literal rows): lines of every block as running text."""
    b = table(spark, d, "blocks").where("lines IS NOT NULL")
    return b.select("block_id", T.join_lines(F.transform("lines", lambda x: T.line_text(x["spans"]))).alias("text"))


@query(rf"""WITH {B}, f AS (SELECT *, replace(replace(text, '​', ''), '', '') AS t FROM b WHERE text IS NOT NULL)
SELECT block_id,
  regexp_matches(text, '{P.TABLE_CAPTION}') AND (regexp_matches(text, '{P.TABLE_CAPTION_STRICT}') OR (length(text) <= 120 AND len({TOKENS}) <= 15)) AS table_caption,
  regexp_matches(text, '(?i)^[\s]*(?:рисунок|рис\.?|figure|fig\.?|табл[\p{{L}}\p{{N}}_]*|table|схема|scheme|график|chart|diagram|диаграмма)[\s\p{{Z}}]*\p{{Nd}}+') AS caption,
  regexp_matches({_strip('text')}, '{P.FOOTER}') OR regexp_matches({_strip('text')}, '{P.AUTHOR}') AS footer,
  regexp_matches(text, '{P.BACK_MATTER.replace("'", "''")}') AS back_matter,
  regexp_matches({_strip('text')}, '{P.JOURNAL_LINE}') AS journal_line,
  regexp_matches(text, '{P.REF_HEADING}') AS ref_heading
FROM f""")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    """F01, F03, F08 and the anchored reference heading."""
    t = F.col("text")
    return blocks(spark, d).where("text IS NOT NULL").select(
        "block_id", P.is_table_caption(t).alias("table_caption"), P.is_caption(t).alias("caption"), P.is_footer(t).alias("footer"),
        P.is_back_matter(t).alias("back_matter"), P.is_journal_line(t).alias("journal_line"), t.rlike(P.REF_HEADING).alias("ref_heading"),
    )


@query(rf"""WITH {B}, l AS (SELECT block_id, {_lines_of('text')} AS ls FROM b WHERE text IS NOT NULL),
c AS (SELECT *, list_distinct(list_transform(ls, lambda x: len(regexp_split_to_array(x, '\s{{3,}}|\t+')))) AS a,
  list_distinct(list_filter(list_transform(ls, lambda x: len(regexp_split_to_array({_strip('x')}, '\s{{3,}}|\t+'))), lambda n: n >= 2)) AS k FROM l)
SELECT block_id,
  coalesce(len(ls) >= 2 AND len(list_filter(ls[1:len(ls) - 1], lambda x: regexp_matches(x, '[.!?]\s*$'))) = 0
    AND ((len(a) = 1 AND a[1] >= 2) OR len(list_filter(ls, lambda x: length(x) >= 60)) = 0), FALSE) AS table_data,
  coalesce(len(ls) >= 2 AND len(k) = 1 AND len(list_filter(ls[1:len(ls) - 1], lambda x: regexp_matches(x, '[.!?;]\s*$'))) = 0, FALSE) AS likely
FROM c""")
def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """F10, F11."""
    t = F.col("text")
    return blocks(spark, d).where("text IS NOT NULL").select("block_id", P.looks_like_table_data(t).alias("table_data"), P.is_likely_table(t).alias("likely"))


_FIG = r"(?i)^\s*(?:Fig(?:ure)?\.?\s*[0-9]+|Рис\.?\s*[0-9]+|Схема\s*[0-9]+)"
_NAMED = "[A-ZА-Я][A-Za-zА-Яа-я''’\\-]+"
_COMMON = (
    "the and for with from that this are was not but have has had one two all can her our out day his how its let may new now old see way who did get got him hit man put say she too use mean "
    "table value index group total score range level count percent rate sign test data type name case high low"
)


def _reversed(x: str) -> str:
    hits = lambda c: f"len(list_intersect(list_distinct(regexp_extract_all(lower({c}), '[a-zA-Z]{{3,}}')), string_split('{_COMMON}', ' ')))"
    back = f"list_aggregate(list_reverse(string_split({x}, '')), 'string_agg', '')"
    return f"(length({x}) >= 3 AND (({hits(back)} > {hits(x)} AND {hits(back)} >= 1) OR regexp_full_match({x}, '[0-9.,]+[<>≤≥]')))"


@query(rf"""WITH {B}, s AS (SELECT doc_id, page_num, list(font_size ORDER BY font_size) AS v FROM blocks WHERE font_size > 0 GROUP BY doc_id, page_num),
t AS (SELECT block_id, text, {_strip('text')} AS st, {_normalized('text')} AS nt, coalesce(len(lines), 1) AS n, font_size, coalesce(v[len(v) // 2 + 1], 0) AS body,
  regexp_replace(regexp_replace(text, '{_FIG}', ''), '^\s+', '') AS rest FROM b LEFT JOIN s USING (doc_id, page_num) WHERE text IS NOT NULL),
f AS (SELECT *, regexp_matches(text, '{_FIG}') AND (regexp_matches(text, '{_FIG}\s*[|:.,–—-]') OR (rest <> '' AND length(text) <= 160
    AND NOT regexp_matches(text, '(?i)(?:^|[^{W}])(?:illustrates?|shows?|depicts?|displays?|demonstrates?|presents?|изобража[{W}]*|показыва[{W}]*|иллюстрир[{W}]*)(?:[^{W}]|$)'))) AS figure_caption FROM t)
SELECT block_id, figure_caption,
  st <> '' AND length(st) <= 60 AND regexp_matches(st, '[0-9]') AND NOT regexp_matches(text, '(?i)^\s*(?:рисунок|рис\.?|figure|fig\.?|табл[{W}]*|table|схема|scheme|график|chart|diagram|диаграмма)\s*[0-9]')
    AND NOT regexp_matches(st, '(?i)^\s*(?:table|fig\.?|figure|рис|схема|scheme)(?:[^{W}]|$)') AS axis_label,
  st <> '' AND length(st) <= 80 AND NOT figure_caption AND NOT regexp_matches(st, '(?i)^\s*(?:fig\.?|figure|рис\.?|рисунок|схема|scheme|табл[{W}]*|table|график|chart|diagram|диаграмма)(?:[^{W}]|$)')
    AND (regexp_matches(st, '[0-9]') OR (length(st) <= 12 AND regexp_full_match(st, '\(?[A-Za-zА-Яа-яЁё]{{1,12}}\)?')) OR (n <= 1 AND length(st) <= 60 AND body > 0 AND font_size <= body + 0.5)) AS figure_label,
  nt <> '' AND length(nt) <= 140 AND (regexp_matches(nt, '^\s*(?:\(?{_NAMED}(?:\s+(?:et\s+al\.?|and\s+{_NAMED}|&\s*{_NAMED}))?\s*,?\s*(?:19|20)[0-9]{{2}}[a-z]?\)?|\(?(?:{_NAMED}(?:\s*,\s*|\s*&\s*)?)+\s*,\s*(?:19|20)[0-9]{{2}}[a-z]?\)?)[.,;]?\s*$')
    OR regexp_matches(nt, '^\s*(?:[0-9]{{1,3}}(?:\s*[-–—,;]\s*[0-9]{{1,3}})*|\[[0-9,\-–— ]+\])\s*[.]?\s*$')
    OR (length(nt) <= 50 AND regexp_matches(nt, '^(?:[A-Z][A-Za-z''’\-]+(?:\s+et\s+al\.?)?)(?:\s*\(?(?:19|20)[0-9]{{2}}\)?)?\.?$') AND regexp_matches(nt, '(?i)(?:19|20)[0-9]{{2}}|et\s+al'))) AS citation,
  {_reversed('text')} AS reversed FROM f""")
def label_predicates(spark: SparkSession, d: str) -> DataFrame:
    """F02, F04, F05, F12, F16."""
    t = F.col("text")
    b = blocks(spark, d).where("text IS NOT NULL").join(C.body_medians(table(spark, d, "blocks")), ["doc_id", "page_num"], "left")
    return b.select(
        "block_id", P.is_figure_caption(t).alias("figure_caption"), P.looks_like_axis_label(t).alias("axis_label"),
        P.looks_like_figure_label(t, F.coalesce(F.size("lines"), F.lit(1)), F.col("font_size"), F.coalesce("body", F.lit(0.0))).alias("figure_label"),
        P.is_short_citation(t).alias("citation"), P.is_reversed(t).alias("reversed"),
    )


@query(rf"""WITH t AS (SELECT block_id, translation, {_strip('translation')} AS s FROM blocks WHERE translation IS NOT NULL),
l AS (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda x: lower({_strip('x')})), lambda x: x <> '')[1:2] AS ls FROM t)
SELECT block_id, s <> '' AND (len(list_filter(ls, lambda x: {" OR ".join(f"starts_with(x, '{p}')" for p in P.META_PREFIXES)})) > 0
  OR regexp_matches(translation, '{P.META_ANYWHERE.replace("'", "''")}')) AS meta FROM l""")
def meta_response(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    return table(spark, d, "blocks").where("translation IS NOT NULL").select("block_id", P.looks_like_meta_response(F.col("translation")).alias("meta"))


@query(f"""WITH {B}, e AS (SELECT doc_id, page_num, {NORM} AS n, {CANON} AS c FROM b WHERE text IS NOT NULL
  AND (type IN ('paragraph', 'text', 'heading') OR (type = 'table' AND coalesce(len(table_data), 0) = 0 AND length(text) <= 250))),
k AS (SELECT doc_id, page_num, CASE WHEN regexp_full_match(n, '[0-9]{{1,4}}') THEN '__pagenum__' WHEN length(n) BETWEEN 5 AND 250 THEN n END AS key FROM e
  UNION ALL SELECT doc_id, page_num, c FROM e WHERE length(n) BETWEEN 5 AND 250 AND length(c) BETWEEN 10 AND 250 AND c <> n AND NOT regexp_full_match(n, '[0-9]{{1,4}}')),
p AS (SELECT doc_id, count(DISTINCT page_num) AS total FROM b GROUP BY doc_id)
SELECT doc_id, key, count(DISTINCT page_num)::BIGINT AS pages FROM k JOIN p USING (doc_id) WHERE key IS NOT NULL AND total >= 3
GROUP BY doc_id, key, total HAVING count(DISTINCT page_num) >= greatest(3, total // 2)""")
def repeating_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts that repeat on the pages of a paper."""
    return running.repeating_keys(blocks(spark, d))


@query(f"""WITH {B}, s AS (SELECT doc_id, page_num, CASE WHEN font_size > 0 THEN font_size
  ELSE list_aggregate(list_filter(flatten(list_transform(lines, lambda l: list_transform(l.spans, lambda s: s.size))), lambda v: v > 0), 'median') END AS v FROM b)
SELECT doc_id, page_num, coalesce(median(CASE WHEN v > 0 THEN v END), 12.0)::DOUBLE AS avg_font FROM s GROUP BY doc_id, page_num""")
def page_median(spark: SparkSession, d: str) -> DataFrame:
    """A02."""
    return C.page_medians(table(spark, d, "blocks"))


@query("""WITH s AS (SELECT doc_id, page_num, list(font_size ORDER BY font_size) AS v FROM blocks WHERE font_size > 0 GROUP BY doc_id, page_num)
SELECT doc_id, page_num, v[len(v) // 2 + 1] AS body FROM s""")
def body_median(spark: SparkSession, d: str) -> DataFrame:
    """A03."""
    return C.body_medians(table(spark, d, "blocks"))


@query("""SELECT doc_id, page_num, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1, count(*)::BIGINT AS n
FROM blocks GROUP BY doc_id, page_num""")
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A04."""
    b = table(spark, d, "blocks").groupBy("doc_id", "page_num").agg(G.union_agg("bbox").alias("box"), F.count(F.lit(1)).alias("n"))
    return b.select("doc_id", "page_num", "box.*", "n")


METRICS = rf"""m0 AS (SELECT b.*, flatten(list_transform(lines, lambda l: l.spans)) AS sp, p.page_width AS page_width FROM b LEFT JOIN
  (SELECT doc_id, page_num, max(width) AS page_width FROM paper_pages GROUP BY doc_id, page_num) p USING (doc_id, page_num)),
m AS (SELECT *, CASE WHEN list_aggregate(list_transform(sp, lambda s: s.size), 'max') > 0 THEN list_aggregate(list_transform(sp, lambda s: s.size), 'max')
    ELSE coalesce(font_size, 0.0) END AS max_font,
  coalesce(len(list_filter(sp, lambda s: coalesce(s.text, '') <> '' AND NOT (regexp_matches(s.text, '\p{{Lu}}') AND NOT regexp_matches(s.text, '\p{{Ll}}')))) = 0, TRUE) AS all_upper,
  coalesce(len(list_filter(sp, lambda s: (s.flags & 17) <> 0 OR contains(lower(coalesce(s.font, '')), 'bold'))) > 0, FALSE)
    OR coalesce((font_flags & 16) <> 0, FALSE) OR coalesce(starts_with_bold, FALSE) AS has_bold,
  coalesce(page_width > 0 AND abs((bbox.x0 + bbox.x1) / 2 - page_width / 2) < page_width * 0.1, FALSE) AS is_centered, coalesce(len(sp), 0)::INT AS total_spans FROM m0)"""
SCORE = r"""(CASE WHEN max_font > avg_font * 1.25 THEN 3 ELSE 0 END + CASE WHEN all_upper THEN 2 ELSE 0 END + CASE WHEN has_bold THEN 2 ELSE 0 END
  + CASE WHEN is_centered THEN 1 ELSE 0 END + CASE WHEN length(text) < 100 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '^[0-9]+(\.[0-9]+)*\s+') THEN 2 ELSE 0 END
  + CASE WHEN words <= 4 AND max_font >= avg_font * 1.1 THEN 2 ELSE 0 END)"""


@query(f"WITH {B}, {METRICS} SELECT block_id, max_font::DOUBLE AS max_font, all_upper, has_bold, is_centered, total_spans FROM m")
def block_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A05."""
    b = C.classify(blocks(spark, d), load(spark, d, "paper_pages"))
    return b.select("block_id", F.col("max_font").cast("double").alias("max_font"), "all_upper", "has_bold", "is_centered", "total_spans")


@query(rf"""WITH {B}, {METRICS}, a AS ({SQL["page_median"].replace("WITH ", "WITH ", 1)}),
x AS (SELECT m.*, avg_font, len({TOKENS}) AS words, {_strip('text')} AS st, regexp_replace({_strip('text')}, '[:.]+$', '') AS core,
  len(regexp_extract_all(text, '{T.LIST_LINE}')) AS items, {_lines_of('text')} AS ls FROM m JOIN a USING (doc_id, page_num)),
k AS (SELECT *, {SCORE} AS score, list_distinct(list_filter(list_transform(ls, lambda x: len(regexp_split_to_array({_strip('x')}, '\s{{3,}}|\t+'))), lambda n: n >= 2)) AS cols FROM x)
SELECT block_id, score::INT AS score, CASE WHEN type <> 'text' THEN type
  WHEN coalesce(len(lines), 0) = 0 OR coalesce(text, '') = '' OR total_spans = 0 OR NOT regexp_matches(text, '[A-Za-zА-Яа-я]') THEN 'empty'
  WHEN regexp_full_match(text, '\s*(?:[a-zA-Z_]+\(\)|(?:[^\p{{L}}\p{{M}}\p{{N}}_]|[0-9])+)\s*') THEN 'empty'
  WHEN words = 1 AND all_upper AND length(st) >= 3 AND NOT regexp_matches(text, '{P.REF_HEADING}') AND length(core) >= 3
    AND regexp_full_match(core, '[A-ZА-ЯЁ0-9\-]+') AND regexp_matches(core, '[A-ZА-ЯЁ]') THEN 'heading'
  WHEN len(ls) >= 2 AND len(cols) = 1 AND len(list_filter(ls[1:len(ls) - 1], lambda x: regexp_matches(x, '[.!?;]\s*$'))) = 0 THEN 'table'
  WHEN regexp_matches(text, '{P.REF_HEADING}') THEN 'reference_heading'
  WHEN regexp_matches(text, '{P.TABLE_CAPTION}') AND (regexp_matches(text, '{P.TABLE_CAPTION_STRICT}') OR (length(text) <= 120 AND words <= 15)) THEN 'table'
  WHEN words <= 10 AND regexp_matches(text, '^\[[0-9]+\]') THEN 'reference'
  WHEN words <= 10 AND regexp_matches(text, '[A-Z][a-z]+\s+[A-Z]\.[A-Z]\.') THEN 'metadata'
  WHEN words <= 10 AND regexp_matches(text, '{C.METADATA_WORDS}') THEN 'metadata'
  WHEN words <= 10 AND regexp_full_match(text, '[\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}\-]+,[\s\p{{Z}}]*\p{{Nd}}{{4}}') THEN 'metadata'
  WHEN items >= 2 OR (items >= 1 AND len(string_split(text, chr(10))) >= 2) THEN 'list'
  WHEN score >= 5 THEN 'heading' ELSE 'paragraph' END AS label FROM k""")
def classify_blocks(spark: SparkSession, d: str) -> DataFrame:
    """C01, C02."""
    return C.classify(blocks(spark, d), load(spark, d, "paper_pages")).select("block_id", "score", "label")


FOOT = f"coalesce(regexp_matches({_strip('text')}, '{P.FOOTER}') OR regexp_matches({_strip('text')}, '{P.AUTHOR}'), FALSE)"


@query(f"""WITH {B}, i AS (SELECT *, row_number() OVER w AS i, {FOOT} AS foot, coalesce(regexp_matches({_strip('text')}, '{P.JOURNAL_LINE}'), FALSE) AS j
  FROM b WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY block_pos)),
n AS (SELECT *, coalesce(lag(foot, 1) OVER w, FALSE) OR coalesce(lag(foot, 2) OVER w, FALSE) AS near FROM i WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY block_pos)),
c AS (SELECT *, min(CASE WHEN foot THEN i WHEN j AND near THEN i - 1 END) OVER p AS cut, max(i) OVER p AS n FROM n WINDOW p AS (PARTITION BY doc_id, page_num))
SELECT block_id FROM c WHERE (cut IS NULL OR i < cut) AND NOT (cut IS NULL AND j AND i = n)""")
def footer_cut(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that stay."""
    return running.cut_footers(blocks(spark, d)).select("block_id")


@query(f"""WITH {B}, e AS (SELECT *, CASE WHEN type = 'reference_heading' OR regexp_matches(text, '{P.REF_HEADING}') THEN 'reference_heading' ELSE type END AS t2 FROM b),
s AS (SELECT *, last_value(CASE WHEN t2 = 'reference_heading' THEN 1 WHEN regexp_matches(text, '{P.BACK_MATTER.replace("'", "''")}') THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY page_num, block_pos ROWS UNBOUNDED PRECEDING) AS st FROM e)
SELECT block_id, CASE WHEN coalesce(st, 0) = 1 AND t2 NOT IN ('reference_heading', 'figure', 'table') THEN 'reference' ELSE t2 END AS type FROM s""")
def refs_state(spark: SparkSession, d: str) -> DataFrame:
    """W02, with headings of reference lists by their text."""
    b = blocks(spark, d)
    b = b.withColumn("type", F.when(F.coalesce(F.col("text").rlike(P.REF_HEADING), F.lit(False)), "reference_heading").otherwise(F.col("type")))
    return refs.mark_references(b).select("block_id", "type")


@query(rf"""WITH f AS (SELECT block_id, type, len(lines) AS n, {_strip("array_to_string(list_transform(lines[1].spans, lambda s: s.text), ' ')")} AS first FROM blocks),
k AS (SELECT *, coalesce(n > 1 AND regexp_matches(first, '(?i){P.REF_HEADINGS}') AND regexp_replace(regexp_replace(first, '(?i){P.REF_HEADINGS}', '', 'g'), '[ \t:.,;—–-]', '', 'g') = '', FALSE) AS splits FROM f)
SELECT block_id, 0 AS part, CASE WHEN splits THEN 'reference_heading' ELSE type END AS type, CASE WHEN splits THEN 1 ELSE coalesce(n, 0) END::INT AS lines FROM k
UNION ALL SELECT block_id, 1, 'reference', (n - 1)::INT FROM k WHERE splits""")
def ref_heading_split(spark: SparkSession, d: str) -> DataFrame:
    """W03."""
    b = refs.split_reference_headings(table(spark, d, "blocks"))
    return b.select("block_id", "part", "type", F.coalesce(F.size("lines"), F.lit(0)).alias("lines"))


@query()
def citation_runs(spark: SparkSession, d: str) -> DataFrame:
    """W05."""
    return refs.citation_runs(_lines(spark, d).select("block_id", "line_no", "line.spans"))


@query("""WITH r AS (SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY round_even(l.bbox.y0, 3), round_even(l.bbox.x0, 3), i) AS reading_pos, (i - 1)::INT AS line_no
  FROM (SELECT block_id, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM blocks WHERE lines IS NOT NULL)) SELECT block_id, line_no, reading_pos::INT AS reading_pos FROM r""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    lines = _lines(spark, d).select("doc_id", "page_num", "block_id", "line_no", F.col("line.bbox").alias("bbox"))
    return layout.reading_order(lines).select("block_id", "line_no", "reading_pos")


@query()
def rebuilt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks made anew from their lines."""
    b = layout.rebuild_blocks(layout.split_groups(layout.line_rows(table(spark, d, "blocks"))))
    return b.select("block_id", "grp", "text", "font_size", "font_flags", "color", "n_lines", "bbox.*")


@query()
def broken_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that end in a broken word, merged with the next."""
    return layout.merge_broken_blocks(blocks(spark, d)).where("members > 1").select("block_id", "members", "text")


@query("""WITH f AS (SELECT doc_id, page_num, block_id AS figure_id, bbox AS fb FROM blocks WHERE type IN ('figure', 'table')),
o AS (SELECT b.block_id, figure_id, (least(b.bbox.x1, fb.x1) - greatest(b.bbox.x0, fb.x0)) * (least(b.bbox.y1, fb.y1) - greatest(b.bbox.y0, fb.y0))
    / ((b.bbox.x1 - b.bbox.x0) * (b.bbox.y1 - b.bbox.y0)) AS ratio
  FROM blocks b JOIN f USING (doc_id, page_num) WHERE b.block_id <> figure_id AND b.bbox.x0 < fb.x1 AND fb.x0 < b.bbox.x1 AND b.bbox.y0 < fb.y1 AND fb.y0 < b.bbox.y1
    AND (b.bbox.x1 - b.bbox.x0) * (b.bbox.y1 - b.bbox.y0) > 0)
SELECT block_id, figure_id, round(ratio, 6) AS ratio FROM o WHERE ratio > 0""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """J01."""
    b = table(spark, d, "blocks")
    return figures.overlaps(b, b.where("type IN ('figure', 'table')")).withColumn("ratio", F.round("ratio", 6))


@query("""WITH f AS (SELECT doc_id, page_num, block_id AS figure_id, bbox AS fb FROM blocks WHERE type = 'figure'),
c AS (SELECT doc_id, page_num, block_id AS caption_id, block_pos, bbox AS cb FROM blocks WHERE type IN ('paragraph', 'heading')),
g AS (SELECT figure_id, caption_id, block_pos, greatest(0, greatest(fb.x0, cb.x0) - least(fb.x1, cb.x1), greatest(fb.y0, cb.y0) - least(fb.y1, cb.y1))::DOUBLE AS gap
  FROM f JOIN c USING (doc_id, page_num))
SELECT figure_id, caption_id, round(gap, 6) AS gap FROM g WHERE gap < 120 QUALIFY row_number() OVER (PARTITION BY figure_id ORDER BY gap, block_pos, caption_id) = 1""")
def nearest_caption(spark: SparkSession, d: str) -> DataFrame:
    """J02, J03, with paragraphs and headings as candidates."""
    b = table(spark, d, "blocks")
    return figures.nearest_captions(b.where("type = 'figure'"), b.where("type IN ('paragraph', 'heading')")).withColumn("gap", F.round("gap", 6))


@query()
def assigned_captions(spark: SparkSession, d: str) -> DataFrame:
    """J03, greedy: each caption once."""
    b = table(spark, d, "blocks")
    return figures.assign_captions(b.where("type = 'figure'"), b.where("type IN ('paragraph', 'heading')"))


_CHEB = "greatest(0, greatest(lb.x0, fb.x0) - least(lb.x1, fb.x1), greatest(lb.y0, fb.y0) - least(lb.y1, fb.y1))"
_SHARED = "(CASE WHEN lb.x0 < fb.x1 AND fb.x0 < lb.x1 AND lb.y0 < fb.y1 AND fb.y0 < lb.y1 THEN (least(lb.x1, fb.x1) - greatest(lb.x0, fb.x0)) * (least(lb.y1, fb.y1) - greatest(lb.y0, fb.y0)) ELSE 0 END)"


@query(rf"""WITH l AS (SELECT doc_id, page_num, block_id, unnest(lines) AS l, generate_subscripts(lines, 1) - 1 AS line_no FROM blocks WHERE lines IS NOT NULL),
x AS (SELECT doc_id, page_num, block_id, line_no::INT AS line_no, l.bbox AS lb, {_strip("regexp_replace(array_to_string(list_transform(list_sort(list_transform(l.spans, lambda s, i: {'x': round(s.bbox.x0, 3), 'i': i, 't': s.text})), lambda s: s.t), ''), '[ \t\n\r]+', ' ', 'g')")} AS t FROM l),
f AS (SELECT doc_id, page_num, bbox AS fb FROM blocks WHERE type IN ('figure', 'table')),
j AS (SELECT *, {_CHEB} AS gap, {_SHARED} AS shared, (lb.x1 - lb.x0) * (lb.y1 - lb.y0) AS area FROM x JOIN f USING (doc_id, page_num))
SELECT DISTINCT block_id, line_no FROM j WHERE (area > 0 AND shared / area >= 0.6)
  OR ((lb.x0 + lb.x1) / 2 BETWEEN fb.x0 - 2 AND fb.x1 + 2 AND (lb.y0 + lb.y1) / 2 BETWEEN fb.y0 - 2 AND fb.y1 + 2)
  OR (t <> '' AND length(t) <= 60 AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '(?i)^\s*(?:рисунок|рис\.?|figure|fig\.?|табл[\p{{L}}]*|table|схема|scheme|график|chart|diagram|диаграмма)\s*[0-9]')
    AND NOT regexp_matches(t, '(?i)^\s*(?:table|fig\.?|figure|рис|схема|scheme)([^\p{{L}}\p{{N}}_]|$)') AND gap <= 14 AND least(lb.x1, fb.x1) - greatest(lb.x0, fb.x0) >= greatest(1.0, lb.x1 - lb.x0) * 0.5)""")
def line_drop(spark: SparkSession, d: str) -> DataFrame:
    """Lines that belong to a figure or table of their page."""
    b = table(spark, d, "blocks")
    lines = _lines(spark, d).select("doc_id", "page_num", "block_id", "line_no", F.col("line.bbox").alias("bbox"), T.line_text(F.col("line.spans")).alias("text"))
    return figures.lines_in_figures(lines, b.where("type IN ('figure', 'table')"))


@query("""WITH x AS (SELECT block_id, x, count(*) AS n FROM (SELECT block_id, unnest(list_transform(lines, lambda l: l.bbox.x0)) AS x FROM blocks WHERE len(lines) > 1) GROUP BY ALL),
g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY block_id ORDER BY x) <= 8 THEN 0 ELSE 1 END AS s FROM x),
c AS (SELECT *, sum(s) OVER (PARTITION BY block_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM g),
m AS (SELECT block_id, c, sum(x * n) / sum(n) AS mean FROM c GROUP BY block_id, c)
SELECT block_id, count(*)::INT AS columns, round(min(mean), 6) AS leftmost FROM m GROUP BY block_id""")
def columns_1d(spark: SparkSession, d: str) -> DataFrame:
    """Chains of left edges of the lines of a block."""
    b = table(spark, d, "blocks").where("size(lines) > 1")
    found = G.clusters_1d(F.transform("lines", lambda x: x["bbox"]["x0"]), 8.0)
    return b.select("block_id", found.alias("c")).select("block_id", F.size("c").alias("columns"), F.round(F.array_min("c"), 6).alias("leftmost"))


@query(rf"""WITH l AS (SELECT doc_id, page_num, unnest(lines) AS l FROM blocks WHERE type NOT IN ('table', 'figure', 'empty', 'reference', 'reference_heading', 'metadata')),
x AS (SELECT doc_id, page_num, s.bbox.x0 AS x FROM (SELECT doc_id, page_num, unnest(l.spans) AS s FROM l WHERE length({_strip("array_to_string(list_transform(l.spans, lambda s: s.text), '')")}) <= 60) WHERE {_strip('s.text')} <> ''),
g AS (SELECT *, CASE WHEN x - lag(x) OVER w <= 15 THEN 0 ELSE 1 END AS s FROM x WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY x)),
c AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page_num ORDER BY x RANGE UNBOUNDED PRECEDING) AS c FROM g),
m AS (SELECT doc_id, page_num, c, avg(x) AS mean FROM c GROUP BY doc_id, page_num, c HAVING count(*) >= 2), p AS (SELECT doc_id, page_num, list(mean ORDER BY mean) AS m FROM m GROUP BY doc_id, page_num)
SELECT doc_id, page_num, len(k)::INT AS columns, round(list_sum(k), 3) AS total FROM (SELECT *, list_reduce(list_transform(m, lambda v: [v]), lambda a, v: CASE WHEN v[1] - a[-1] > 60 THEN list_concat(a, v) ELSE a END) AS k FROM p)""")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """W08."""
    total = F.round(F.aggregate("columns", F.lit(0.0), lambda a, v: a + v), 3)
    return tables.columns_by_x(table(spark, d, "blocks")).select("doc_id", "page_num", total.alias("total"), F.size("columns").alias("columns"))


@query("""SELECT block_id, (row_number() OVER (PARTITION BY doc_id, page_num ORDER BY CASE type WHEN 'figure' THEN 2 WHEN 'table' THEN 1 ELSE 0 END, block_pos, block_id) - 1)::INT AS block_pos FROM blocks""")
def concatenated(spark: SparkSession, d: str) -> DataFrame:
    """U01."""
    b = table(spark, d, "blocks").select("doc_id", "page_num", "block_id", "block_pos", "type")
    return layout.concatenate(b.where("type NOT IN ('table', 'figure')"), b.where("type = 'table'"), b.where("type = 'figure'")).select("block_id", "block_pos")


@query()
def caption_tables(spark: SparkSession, d: str) -> DataFrame:
    """Captions with aligned rows."""
    return tables.caption_tables(blocks(spark, d)).select("caption_id", "rows", F.to_json("table_data").alias("cells"))


@query(rf"""WITH {B}, f AS (SELECT doc_id, page_num, block_id, block_pos, type IN ('text', 'paragraph') AS plain,
    len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\p{{L}}\p{{M}}]', 'x', 'g'), '[0-9]+[.,:][0-9]+|[0-9]+%|[0-9]+\.[0-9]+[eE][+-]?[0-9]+|\b[0-9]{{1,3}}(?:[,\s][0-9]{{3}})*(?:\.[0-9]+)?\b')) AS nums,
    len(regexp_split_to_array({_strip("coalesce(text, '')")}, '\s{{3,}}|\t+')) AS cols, regexp_full_match(coalesce(text, ''), '[A-Za-zА-Яа-я][{W}\s\p{{Z}}\-()]{{0,30}}') AS label FROM b),
l AS (SELECT *, CASE WHEN NOT plain THEN 0 WHEN NOT coalesce(lag(plain) OVER w, FALSE) THEN 1
    WHEN coalesce((lag(nums) OVER w >= 2 AND nums >= 2) OR (lag(cols) OVER w >= 2 AND cols >= 2 AND abs(cols - lag(cols) OVER w) <= 1), FALSE) THEN 3
    WHEN coalesce(lag(label) OVER w OR label, FALSE) THEN 2 ELSE 1 END AS link FROM f WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY block_pos, block_id)),
p AS (SELECT doc_id, page_num, list(block_id ORDER BY block_pos, block_id) AS ids, list(link ORDER BY block_pos, block_id) AS links FROM l GROUP BY doc_id, page_num),
r AS (SELECT *, list_reduce(list_transform(links, lambda x: {{'out': [CASE WHEN x > 0 THEN 1 ELSE -1 END], 'run': 1, 'size': 1, 'link': x}}), lambda a, x: {{
    'out': list_concat(a.out, [CASE WHEN x.link = 0 THEN -1 WHEN x.link = 3 OR (x.link = 2 AND a.size >= 2) THEN a.run ELSE a.run + 1 END]),
    'run': CASE WHEN x.link = 3 OR (x.link = 2 AND a.size >= 2) THEN a.run ELSE a.run + 1 END,
    'size': CASE WHEN x.link = 3 OR (x.link = 2 AND a.size >= 2) THEN a.size + 1 ELSE 1 END, 'link': x.link}}).out AS runs FROM p),
u AS (SELECT doc_id, page_num, unnest(ids) AS block_id, unnest(runs) AS run FROM r)
SELECT doc_id, page_num, block_id, run::INT AS run FROM u WHERE run >= 0 QUALIFY count(*) OVER (PARTITION BY doc_id, page_num, run) >= 3""")
def content_tables(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return tables.content_runs(blocks(spark, d))


@query()
def consolidated(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    return tables.consolidate(blocks(spark, d)).select("block_id", "type", F.coalesce(F.size("table_data"), F.lit(0)).alias("rows"))


@query(f"""WITH t AS (SELECT block_id, list_filter(list_transform(flatten(table_data), lambda x: {_strip("coalesce(x, '')")}), lambda x: x <> '') AS c, table_data FROM blocks WHERE table_data IS NOT NULL)
SELECT block_id, len(table_data)::INT AS rows, len(c)::INT AS filled, len(list_distinct(list_transform(table_data, lambda r: len(r))))::INT AS widths,
  coalesce(len(c) > 0 AND list_aggregate(list_transform(c, lambda x: regexp_matches(x, '(?i)(?:DOI:|Vol\\.|Pp?\\.\\s|Art\\.\\s|http|//\\s*[0-9A-Za-z_]+\\.[0-9A-Za-z_]+|р\\.\\s|Том\\s|№\\s|С\\.\\s|[0-9]{{4}}\\.\\s|[0-9A-Za-z_]+\\.\\s+[0-9A-Za-z_]+\\.\\s*[0-9]{{4}}|Ser\\.\\s|pp\\.\\s|pp\\.,|pp\\.)')::INT
    + regexp_matches(x, '{P.REF_STYLE}')::INT + regexp_matches(x, '{P.REF_NUMBER}')::INT), 'sum') / len(c) > 0.3, FALSE) AS reference FROM t""")
def reference_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables, their filled cells and widths, and whether they list references."""
    b = table(spark, d, "blocks").where("table_data IS NOT NULL")
    filled = F.filter(F.transform(F.flatten("table_data"), lambda c: T.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return b.select(
        "block_id", F.size("table_data").alias("rows"), F.size(filled).alias("filled"),
        F.size(F.array_distinct(F.transform("table_data", F.size))).alias("widths"), P.is_reference_table(F.col("table_data")).alias("reference"),
    )


_TURN = "list_aggregate(list_reverse(string_split({0}, '')), 'string_agg', '')"
_TURNED = f"CASE WHEN c = '' THEN c ELSE array_to_string(list_filter(list_transform(list_reverse(string_split(c, chr(10))), lambda l: coalesce({_TURN.format('l')}, '')), lambda x: {_strip('x')} <> ''), ' ') END"


@query(rf"""WITH t AS (SELECT doc_id, page_num, block_pos, block_id, bbox AS lb, list_transform(table_data, lambda r: list_transform(r, lambda c: {_strip("coalesce(c, '')")})) AS rows FROM blocks WHERE table_data IS NOT NULL),
k AS (SELECT * FROM t WHERE len(rows) >= 2 AND len(rows[1]) >= 2 AND len(list_filter(flatten(rows), lambda c: c <> '')) > 0 AND block_id NOT IN (SELECT block_id FROM ({SQL["reference_tables"]}) WHERE reference)),
w AS (SELECT *, len(list_filter(flatten(list_transform(rows[1:4], lambda r: r[1:6])), lambda c: length(c) > 1 AND {_reversed('c')})) >= 2 AS wrong FROM k),
e AS (SELECT doc_id, page_num, block_pos AS p0, lb AS fb FROM k), bad AS (SELECT block_id FROM w JOIN e USING (doc_id, page_num) WHERE p0 < block_pos AND (
  sqrt(pow(greatest(0, greatest(lb.x0, fb.x0) - least(lb.x1, fb.x1)), 2) + pow(greatest(0, greatest(lb.y0, fb.y0) - least(lb.y1, fb.y1)), 2)) <= 3 OR {_SHARED} >= 0.85 * (lb.x1 - lb.x0) * (lb.y1 - lb.y0)))
SELECT block_id, to_json(CASE WHEN wrong THEN list_transform(rows, lambda r: list_transform(r, lambda c: {_TURNED})) ELSE rows END)::VARCHAR AS cells FROM w WHERE block_id NOT IN (SELECT block_id FROM bad)""")
def mended_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables stripped and, where cells are reversed, mended."""
    raw = table(spark, d, "blocks").where("table_data IS NOT NULL").select("doc_id", "page_num", F.col("block_pos").alias("table_pos"), "block_id", "bbox", F.col("table_data").alias("rows"))
    return tables.clean_tables(raw).select("block_id", F.to_json("rows").alias("cells"))


@query(f"""WITH t AS (SELECT doc_id, page_num, block_id, bbox AS lb, starts_with_bold FROM blocks WHERE type = 'table'), x AS (SELECT doc_id, page_num, block_id AS o, bbox AS fb FROM blocks WHERE type NOT IN ('table', 'figure')),
bad AS (SELECT block_id FROM t JOIN x USING (doc_id, page_num) WHERE {_SHARED} > 0 AND greatest({_SHARED} / ((lb.x1 - lb.x0) * (lb.y1 - lb.y0)), {_SHARED} / ((fb.x1 - fb.x0) * (fb.y1 - fb.y0))) > 0.7)
SELECT block_id FROM t WHERE NOT coalesce(starts_with_bold, FALSE) AND block_id NOT IN (SELECT block_id FROM bad)""")
def validated_tables(spark: SparkSession, d: str) -> DataFrame:
    """J07."""
    b = table(spark, d, "blocks")
    return tables.validate_tables(b.where("type = 'table'"), b.where("type NOT IN ('table', 'figure')")).select("block_id")


_CUT = lambda gap: f"list_filter(list_transform(regexp_split_to_array({_strip('l')}, '{gap}'), lambda c: {_strip('c')}), lambda c: c <> '')"


@query(rf"""WITH {B}, a AS (SELECT block_id, {_lines_of("text")} AS ls FROM b WHERE text IS NOT NULL),
c AS (SELECT *, list_transform(ls, lambda l: CASE WHEN len({_CUT(r'\s{3,}|\t+')}) >= 2 THEN {_CUT(r'\s{3,}|\t+')} ELSE {_CUT(r'\s{2,}')} END) AS rows FROM a WHERE len(ls) >= 2),
k AS (SELECT *, list_distinct(list_transform(rows, lambda r: len(r))) AS counts, len(list_filter(ls, lambda l: regexp_matches(l, '[.!?;]\s*$'))) AS ends,
  list_sum(list_transform(ls, lambda l: length(l))) / len(ls) AS average FROM c)
SELECT block_id, to_json(list_transform(rows, lambda r: list_resize(r, list_max(counts), '')))::VARCHAR AS cells FROM k
WHERE NOT (average > 90 AND ends = 0) AND ends <= len(ls) * 0.4 AND list_min(counts) >= 2 AND len(counts) <= 2""")
def heuristic_tables(spark: SparkSession, d: str) -> DataFrame:
    """T01."""
    return blocks(spark, d).select("block_id", tables.heuristic_table(F.col("text")).alias("t")).where("t IS NOT NULL").select("block_id", F.to_json("t").alias("cells"))


@query()
def figure_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Figures and tables of a page by nearness."""
    return figures.clusters(table(spark, d, "blocks").where("type IN ('figure', 'table')"), 35.0).select("block_id", "cluster")


@query()
def composite_figures(spark: SparkSession, d: str) -> DataFrame:
    """W18."""
    f = table(spark, d, "blocks").where("type IN ('figure', 'table')")
    return figures.composite_figures(f, load(spark, d, "paper_pages")).select("cluster", "members", "bbox.*")


@query("""WITH h AS (SELECT doc_id, page_num, block_id, coalesce(translation, text_override) AS title,
  'h' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_pos) - 1) AS anchor FROM blocks WHERE type = 'heading')
SELECT doc_id, page_num, block_id, anchor, title FROM h""")
def toc(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    return render.headings(table(spark, d, "blocks").withColumn("text", F.col("text_override")))


@query()
def mask_tokens(spark: SparkSession, d: str) -> DataFrame:
    """M01."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    m = docs.select("doc_id", masking.mask("text").alias("m"))
    return m.select("doc_id", "m.masked", F.size("m.tokens").alias("tokens"))


@query(SQL["strip_tags"].replace("AS plain", "AS text"))
def mask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Restoring what was masked gives the text without inline tags."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    m = docs.select("doc_id", masking.mask("text").alias("m"))
    return m.select("doc_id", masking.restore(F.col("m.masked"), F.col("m.tokens")).alias("text"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "papers").select("doc_id", "target_lang")
    b = blocks(spark, d).where("translation IS NOT NULL").join(p, "doc_id")
    return b.select("block_id", F.col("text").alias("source"), F.col("translation").alias("candidate"), "target_lang")


@query()
def validate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """V01-V05 (numbers need look-around: tested on literal rows)."""
    return validate.validate(_pairs(spark, d)).drop("source", "candidate", "target_lang")


_TURNED_DOWN = rf"""w0 AS (SELECT block_id, {TEXT} AS source, translation AS candidate, target_lang FROM blocks JOIN papers USING (doc_id) WHERE translation IS NOT NULL), {_unwrapped("candidate")},
v1 AS (SELECT *, {_strip("coalesce(source, '')")} AS src, length({_strip("coalesce(source, '')")}) AS n, length(plain) AS m FROM w4),
v2 AS (SELECT *, replace(lower(regexp_replace(src, '{WS}+', ' ', 'g')), 'ß', 'ss') AS a, replace(lower(regexp_replace(plain, '{WS}+', ' ', 'g')), 'ß', 'ss') AS k,
  list_filter(list_transform(string_split(plain, chr(10)), lambda x: lower({_strip('x')})), lambda x: x <> '')[1:2] AS ls, regexp_extract_all(lower(plain), '[{W}]+') AS ws FROM v1),
v3 AS (SELECT *, CASE WHEN len(ws) >= 12 THEN list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 5], ' ')) END AS grams FROM v2),
v AS (SELECT block_id, source, candidate, m = 0 AS empty, m > 0 AND n >= 20 AND (a = k OR (contains(k, a) AND length(a) > 100 AND length(a) > length(k) * 0.8)) AS echo,
  m > 0 AND n >= 150 AND m < greatest(30, floor(n * 0.15)) AS too_short, m > 0 AND n >= 100 AND m > floor(n * 3.2) AS too_long,
  m > 0 AND (len(list_filter(ls, lambda x: regexp_matches(x, '^(?:analysis:|reasoning:|chain of thought:|thoughts:|translation note:|translator note:|here is the translation:|вот перевод:|анализ:|рассуждение:|объяснение:|я не могу перевести|не могу перевести)'))) > 0
    OR regexp_matches(plain, '(?i)\b(i cannot|i can''t|i am unable|as an ai|as a language model)\b')) AS meta_response,
  m > 0 AND coalesce((len(grams) - len(list_distinct(grams))) / len(grams) > 0.30, FALSE) AS repetition,
  coalesce(m > 30 AND target_lang IN ('ru', 'uk', 'bg', 'sr', 'be', 'mk', 'kk', 'uz', 'ky', 'mn') AND len(regexp_extract_all(plain, '\p{{L}}')) > 0
    AND len(regexp_extract_all(plain, '[а-яёА-ЯЁ]')) / len(regexp_extract_all(plain, '\p{{L}}')) < 0.12, FALSE) AS language_mismatch FROM v3)"""


@query(f"WITH {_TURNED_DOWN} SELECT block_id, empty, echo, too_short, too_long, meta_response, repetition, language_mismatch, NOT (empty OR echo OR too_short OR too_long OR meta_response) AS accepted FROM v")
def validate_flags(spark: SparkSession, d: str) -> DataFrame:
    """V01-V05 but for numbers, which :func:`number_cases` has."""
    names = ("empty", "echo", "too_short", "too_long", "meta_response", "repetition", "language_mismatch", "accepted")
    return validate.validate(_pairs(spark, d)).select("block_id", *names)


@query(f"""WITH {_TURNED_DOWN}, r AS (SELECT *, list_filter([CASE WHEN empty THEN 'empty' END, CASE WHEN echo THEN 'echo' END, CASE WHEN too_short THEN 'too_short' END, CASE WHEN too_long THEN 'too_long' END,
  CASE WHEN meta_response THEN 'meta_response' END], lambda x: x IS NOT NULL) AS reasons FROM v)
SELECT to_json({{'result': 'rejected', 'reasons': reasons, 'source_len': length(source), 'candidate_len': length(candidate), 'source_preview': left(source, 120)}})::VARCHAR AS value FROM r WHERE len(reasons) > 0""")
def rejected_log(spark: SparkSession, d: str) -> DataFrame:
    """S16."""
    return validate.rejected_log(validate.validate(_pairs(spark, d)))


@query("""WITH m AS (SELECT text, lang, arg_max(translation, (stored_at, entry_id)) AS cached FROM tm WHERE translation IS NOT NULL AND text IS NOT NULL GROUP BY text, lang)
SELECT text, lang, cached AS translation FROM m""")
def memory(spark: SparkSession, d: str) -> DataFrame:
    """The translation memory as it is read."""
    return translate.latest_memory(load(spark, d, "tm"))


@query("""WITH m AS (SELECT text, lang, arg_max(translation, (stored_at, entry_id)) AS cached FROM tm WHERE translation IS NOT NULL AND text IS NOT NULL GROUP BY text, lang)
SELECT b.block_id, m.cached IS NOT NULL AS known FROM blocks b JOIN papers p USING (doc_id) LEFT JOIN m ON m.text = b.text_override AND m.lang = p.target_lang
WHERE b.type = 'paragraph' AND b.text_override IS NOT NULL AND p.target_lang IS NOT NULL""")
def tm_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that the memory knows."""
    p = load(spark, d, "papers").where("target_lang IS NOT NULL").select("doc_id", "target_lang")
    b = table(spark, d, "blocks").where("type = 'paragraph' AND text_override IS NOT NULL").join(p, "doc_id")
    m = translate.latest_memory(load(spark, d, "tm")).select(F.col("text").alias("text_override"), F.col("lang").alias("target_lang"), "translation")
    found = b.drop("translation").join(m, ["text_override", "target_lang"], "left")
    return found.select("block_id", F.col("translation").isNotNull().alias("known"))


@query("""WITH g AS (SELECT DISTINCT lower(trim(term)) AS w, lang FROM glossary WHERE term IS NOT NULL AND translation IS NOT NULL AND trim(term) <> ''),
t AS (SELECT DISTINCT block_id, unnest(regexp_extract_all(lower(text_override), '[a-z]+')) AS w FROM blocks WHERE text_override IS NOT NULL)
SELECT block_id, lang, count(*)::BIGINT AS terms FROM t JOIN g USING (w) GROUP BY block_id, lang""")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    """Glossary words of each block by language."""
    g = load(spark, d, "glossary").where("term IS NOT NULL AND translation IS NOT NULL AND trim(term) <> ''")
    g = g.select(F.lower(F.trim("term")).alias("w"), "lang").distinct()
    b = table(spark, d, "blocks").where("text_override IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text_override"), F.lit("([a-z]+)"), F.lit(1)))
    return b.select("block_id", F.explode(words).alias("w")).join(g, "w").groupBy("block_id", "lang").agg(F.count(F.lit(1)).alias("terms"))


@query("SELECT lang, count(DISTINCT lower(trim(word)))::BIGINT AS words FROM wordlist WHERE word IS NOT NULL GROUP BY lang")
def wordlists(spark: SparkSession, d: str) -> DataFrame:
    """S09."""
    w = load(spark, d, "wordlist").where("word IS NOT NULL")
    return w.groupBy("lang").agg(F.countDistinct(F.lower(F.trim("word"))).alias("words"))


_WORK = f"""{B}, k AS (SELECT *, {_normalized('text')} AS normalized FROM b WHERE type NOT IN ('figure', 'table', 'empty', 'metadata', 'reference', 'reference_heading')
  AND length({_strip("coalesce(text, '')")}) >= 2)"""


@query(f"""WITH {_WORK}, t AS (SELECT doc_id, block_id, normalized AS t FROM k WHERE length(trim(text)) > 20), u AS (SELECT DISTINCT doc_id, t FROM t)
SELECT block_id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.doc_id = t.doc_id AND length(u.t) > length(t.t) AND contains(u.t, t.t))""")
def containment_dedup(spark: SparkSession, d: str) -> DataFrame:
    """J09."""
    return translate.contained_blocks(translate.work_list(blocks(spark, d)))


_PACKED = f"""{_WORK}, g AS (SELECT doc_id, list(block_id ORDER BY page_num, block_pos, block_id) AS ids,
  list(length(normalized) ORDER BY page_num, block_pos, block_id) AS ns FROM k GROUP BY doc_id),
f AS (SELECT *, list_reduce(list_transform(ns, lambda n: {{'out': [0], 'section': 0, 'size': n, 'n': n}}), lambda a, x: {{
  'out': list_concat(a.out, [CASE WHEN a.size + x.n > 4000 THEN a.section + 1 ELSE a.section END]), 'section': CASE WHEN a.size + x.n > 4000 THEN a.section + 1 ELSE a.section END,
  'size': CASE WHEN a.size + x.n > 4000 THEN x.n ELSE a.size + x.n END, 'n': x.n}}).out AS out FROM g),
s AS (SELECT doc_id, unnest(ids) AS block_id, unnest(out)::INT AS section FROM f)"""


@query(f"WITH {_PACKED} SELECT doc_id, block_id, section FROM s")
def pack_sections(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    return translate.sections(translate.work_list(blocks(spark, d)))


@query(f"""WITH {_PACKED} SELECT block_id, section, right(coalesce(lag(normalized) OVER w, ''), 600) AS context_before, left(coalesce(lead(normalized) OVER w, ''), 600) AS context_after
FROM k JOIN s USING (doc_id, block_id) WINDOW w AS (PARTITION BY doc_id, section ORDER BY page_num, block_pos, block_id)""")
def section_context(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    work = translate.work_list(blocks(spark, d))
    return translate.with_context(work, translate.sections(work)).select("block_id", "section", "context_before", "context_after")


@query()
def translated(spark: SparkSession, d: str) -> DataFrame:
    """X01-X09 with the test back end: outcome and translation of every block of papers that are translated."""
    p = load(spark, d, "papers").where("target_lang IS NOT NULL").select("doc_id", "target_lang")
    return translate.translate_blocks(attach(blocks(spark, d), p, "doc_id", "block_id"), load(spark, d, "tm"))


@query()
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """A07."""
    return translate.run_stats(translated(spark, d))


@query(f"""WITH {B}, t AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY block_pos, block_id) AS text FROM b WHERE type IN ('paragraph', 'heading', 'metadata', 'text', 'list') AND length(text) > 10 GROUP BY doc_id, page_num),
{_pieces("t", "text", 6000, 0)}, c AS (SELECT doc_id, unnest(pieces) AS chunk FROM s5)
SELECT doc_id, count(*)::BIGINT AS chunks, sum(length(chunk) // 4)::BIGINT AS tokens FROM c GROUP BY doc_id""")
def summary_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each paper for a summary."""
    return summary.chunk_stats(summary.summary_chunks(blocks(spark, d)))


@query(rf"""WITH {B}, k AS (SELECT doc_id, page_num, block_id, text FROM b WHERE type = 'paragraph' AND text IS NOT NULL),
s0 AS (SELECT *, string_split(regexp_replace(text, '([.!?])[\s\x0B]+', '\1' || chr(2), 'g'), chr(2)) AS ss FROM k),
s AS (SELECT doc_id, block_id, unnest(range(len(ss))) AS i, {_strip('unnest(ss)')} AS sentence FROM s0),
w AS (SELECT doc_id, block_id, i, sentence, unnest(list_distinct(list_filter(regexp_extract_all(lower(sentence), '[{W}]+'), lambda x: length(x) >= 4))) AS w FROM s WHERE length(sentence) >= 20),
f AS (SELECT doc_id, w, count(DISTINCT block_id) AS df FROM w GROUP BY doc_id, w), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
c AS (SELECT doc_id, block_id, i, sentence, round(avg(df / n), 9) AS score FROM w JOIN f USING (doc_id, w) JOIN n USING (doc_id) GROUP BY doc_id, block_id, i, sentence),
m AS (SELECT doc_id, sentence, max(score) AS score FROM c GROUP BY doc_id, sentence)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, encode(sentence))::INT AS rank, sentence FROM m QUALIFY rank <= 3""")
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    """X10, the extractive default."""
    return summary.extractive_summary(blocks(spark, d))


@query()
def block_html(spark: SparkSession, d: str) -> DataFrame:
    """R01-R04, R06, L01."""
    b = blocks(spark, d).withColumn("anchor", F.lit(None).cast("string"))
    return b.select("block_id", render.block_html().alias("html"), render.block_html(False).alias("raw"))


@query()
def doc_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each paper as HTML."""
    return render.page_html(blocks(spark, d))


@query()
def summary_html(spark: SparkSession, d: str) -> DataFrame:
    """Originals below a summary."""
    return render.summary_originals(blocks(spark, d))


@query(f"""WITH {B} SELECT doc_id FROM b GROUP BY doc_id HAVING sum(coalesce(length(text), 0)) < 200""")
def short_documents(spark: SparkSession, d: str) -> DataFrame:
    """F17, with a floor of 200 characters."""
    return running.empty_documents(blocks(spark, d), 200).select("doc_id")


@query()
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Classification, running heads, footers, reference headings and sections, tables, in that order."""
    from folio.plans.pipeline import post_process

    return post_process(blocks(spark, d), load(spark, d, "paper_pages")).select("block_id", "part", "type")
