"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import alignment, bpe, defects, langid, leaks, lookalike, multiset, pieces, scans, sentences
from folio.sources import attach, load, reading_text, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").where("mode = 'parallel'").select("doc_id", F.concat_ws(">", "lang", "target_lang").alias("pair"))
    blocks = load(spark, d, "blocks").where("type = 'paragraph' AND translation IS NOT NULL AND text_override IS NOT NULL")
    both = blocks.select("doc_id", "block_id", F.col("text_override").alias("source"), F.col("translation").alias("target"))
    pairs = attach(spread(both), papers, "doc_id", "block_id").drop("doc_id")
    return alignment.align(pairs, alignment.learn_concepts(pairs))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    blocks = load(spark, d, "blocks").select("block_id", F.col("text_override").alias("text"))
    return pieces.split_oversized(blocks.where(F.length("text") > 2500))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d).select("block_id", "cut")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    cols = F.posexplode("pieces").alias("piece_no", "p")
    return _oversized(spark, d).select("block_id", "cut", cols).select("block_id", "cut", "piece_no", "p.start", "p.piece")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").select("doc_id", F.col("lang").alias("source_lang"), "target_lang")
    blocks = load(spark, d, "blocks").where("translation IS NOT NULL")
    pairs = blocks.select("doc_id", "block_id", reading_text().alias("source"), F.col("translation").alias("target"))
    return defects.find_defects(attach(spread(pairs), papers, "doc_id", "block_id", "left").drop("doc_id"), _model(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("block_id", F.element_at("defects", 1).alias("defect"))


def p3_defects(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("block_id", F.explode("defects").alias("defect"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "blocks").select("block_id", reading_text().alias("text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(_readings(spark, d))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(_readings(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_members(_readings(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").where("mode = 'raw'").select("doc_id", "lang")
    blocks = load(spark, d, "blocks").where("type = 'paragraph' AND text_override IS NOT NULL")
    raw = blocks.select("doc_id", "block_id", F.col("text_override").alias("text"))
    raw = attach(spread(raw), papers, "doc_id", "block_id")
    return sentences.sentence_starts(raw.select("block_id", "lang", "text"))


def _recurring(spark: SparkSession, d: str) -> DataFrame:
    kept = load(spark, d, "blocks").where(F.col("type").isin("paragraph", "list", "metadata"))
    return spread(kept.select("block_id", "type", "text_override", "translation"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return multiset.copy_groups(_recurring(spark, d))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return multiset.copy_counts(_recurring(spark, d))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "papers").where("mode = 'scan'").select("doc_id", "lang")
    blocks = load(spark, d, "blocks").where("lines IS NOT NULL").select("doc_id", "page_num", "block_pos", "block_id", "lines")
    return attach(spread(blocks), papers, "doc_id", "block_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(_scanned(spark, d))


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(_scanned(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(load(spark, d, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(load(spark, d, "documents").select("doc_id", "text")), load(spark, d, "benchmark"))


def _model(spark: SparkSession, d: str) -> langid.Model:
    return langid.train(load(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    return langid.unnamed_languages(spread(docs), _model(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return langid.identify(docs, _model(spark, d)).select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    found = langid.identify(docs, _model(spark, d)).select("doc_id", F.explode("passages").alias("p"))
    return found.select("doc_id", "p.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        p1_found, p2_found, p2_pieces, p3_found, p3_defects, p4_found, p4_canonical, p4_classes, p5_found, p6_found, p6_counts, p7_found, p7_paragraphs, p8_ids, p9_found, p10_found, p10_languages,
        p10_passages,
    ]
    return {f.__name__: f for f in made}


_READINGS = (
    "coalesce(text_override, trim(array_to_string(flatten(list_transform(lines, lambda l: list_transform(l.spans, lambda s: s.text))), ' ')))"
)
# What looks the same, written out for the SQL (not read from the operator's tables).
_SAME = [
    ("АВЕКМНОРСТУХІЅЈԚԜ", "ABEKMHOPCTYXISJQW"), ("аеорсухіѕјһԛԝ", "aeopcyxisjhqw"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ονρϲϳ", "ovpcj"),
    ("ёЁїЇ", "ëËïÏ"), ("µ", "μ"), ("ıɡԁѵӀӏօսհ", "igdvIlouh"),
]
_BLANKS, _HYPHENS = "".join(map(chr, (0xA0, 0x2007, 0x202F, 0x3000))), "".join(map(chr, (0x2D7, 0x2010, 0x2011, 0x2043, 0xFE63)))
_GONE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF)))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FROM = "".join(a for a, _ in _SAME) + _BLANKS + _HYPHENS + _WIDE + _GONE
_TO = "".join(b for _, b in _SAME) + " " * len(_BLANKS) + "-" * len(_HYPHENS) + "".join(map(chr, range(0x21, 0x7F)))


def _look_sql(text: str) -> str:
    quote = lambda x: x.replace("'", "''")
    out = f"translate({text}, '{quote(_FROM)}', '{quote(_TO)}')"
    for ligature, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        out = f"replace({out}, '{ligature}', '{plain}')"
    return f"nfc_normalize({out})"


def _words_sql(text: str) -> str:
    """Runs of letters and digits of a text as a reader sees it, in small letters."""
    return f"regexp_extract_all(translate(lower({_look_sql(text)}), 'вкмнт', 'bkmht'), '[\\p{{L}}\\p{{N}}]+')"


_LOOKED = f"r AS (SELECT block_id, {_READINGS} AS t FROM blocks), l AS (SELECT block_id, t, {_look_sql('t')} AS k FROM r WHERE t IS NOT NULL)"
_PLAIN = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\\s\\p{{Z}}\\p{{P}}\\p{{Cc}}|=<>`~^¦]+', '', 'g')"
_COPIES = f"""WITH t AS (SELECT block_id, {_PLAIN.format("translation")} AS tr, list_sort(list_filter(list_transform(
    CASE WHEN type = 'metadata' THEN regexp_split_to_array(text_override, '[;|\n\r\t]+') ELSE [text_override] END,
    lambda x: {_PLAIN.format("x")}), lambda x: x <> '')) AS f
  FROM blocks WHERE type IN ('paragraph', 'list', 'metadata') AND text_override IS NOT NULL),
g AS (SELECT block_id, min(block_id) OVER (PARTITION BY f, tr) AS first_id FROM t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""WITH {_LOOKED} SELECT least(a.block_id, b.block_id) AS block_a, greatest(a.block_id, b.block_id) AS block_b FROM l a JOIN l b ON a.k = b.k AND a.t < b.t""",
        "p4_canonical": f"""WITH {_LOOKED}, n AS (SELECT k, t, count(*) AS n FROM l GROUP BY k, t), c AS (SELECT k, arg_min(t, (-n, encode(t))) AS c FROM n GROUP BY k)
            SELECT r.block_id, c.c AS canonical FROM r LEFT JOIN l USING (block_id) LEFT JOIN c ON c.k = l.k""",
        "p4_classes": f"""WITH {_LOOKED}, n AS (SELECT *, count(*) OVER (PARTITION BY k, t) AS copies, min(block_id) OVER (PARTITION BY k) AS class_id FROM l),
            m AS (SELECT k, count(DISTINCT t) AS forms FROM l GROUP BY k HAVING count(DISTINCT t) > 1)
            SELECT class_id, block_id, forms::BIGINT AS forms, copies::BIGINT AS copies FROM n JOIN m USING (k)""",
        "p9_found": f"""WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark WHERE text IS NOT NULL),
            g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
            h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
            SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)""",
        "p6_found": f"{_COPIES} SELECT first_id, block_id FROM g WHERE block_id <> first_id",
        "p6_counts": f"{_COPIES} SELECT first_id, count(*)::BIGINT AS copies FROM g GROUP BY first_id HAVING count(*) > 1",
    }
