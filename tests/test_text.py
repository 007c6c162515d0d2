"""Scalar functions on literal rows and against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import predicates as P
from folio.functions import text as T


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_joined_lines(spark):
    rows = [["представ-", "лений"], ["How-", "ever"], ["well-", "known"], ["EEG-", "based"], ["P12-", "related"], ["pre-", "Columbian"], ["", " "], ["one", "two"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, l array<string>")
    got = [r[0] for r in df.orderBy("i").select(T.join_lines(F.col("l"))).collect()]
    assert got == ["представлений", "However", "well-known", "EEG-based", "P12- related", "pre- Columbian", "", "one two"]


def test_known_words_decide(spark):
    words = F.array(F.lit("however"), F.lit("ice"), F.lit("cream"))
    df = spark.createDataFrame([("How-", "ever"), ("ice-", "cream")], "a string, b string")
    assert [r[0] for r in df.select(T.keeps_hyphen(F.col("a"), F.col("b"), words)).collect()] == [False, True]


def test_running_head_key(spark):
    got = values(spark, ["Current Biology 26, 2016 1723", "Current  Biology 26, 2016 1724", "1724 Current Biology 26, 2016", None], T.running_head_key(F.col("t")))
    assert got[0] == got[1] == ("current biology 26, 2016",) and got[3] == (None,)


def test_numbers(spark):
    pattern = re.compile(r"(?<!\w)[+-]?(?:\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?|\.\d+)(?:\s*[%‰])?(?!\w)")
    texts = ["a 1.5e3, -2 and x3 4% 5 ‰", "", "12,5 km2 .7", "1723-1724", "№7"]
    assert [r[0] for r in values(spark, texts, T.numbers(F.col("t")))] == [pattern.findall(t) for t in texts]
    assert values(spark, ["1,5", "−2", "7 %", "x"], T.normalize_number(F.col("t"))) == [(1.5,), (-2.0,), (7.0,), (None,)]


def test_repetition(spark):
    got = values(spark, ["a b c d e f " * 4, "one two", None, ""], T.repetition_ratio(F.col("t")))
    assert got[0][0] == pytest.approx((19 - 6) / 19) and got[1] == (0.0,) and got[3] == (0.0,)


def test_pieces_keep_all_words(spark):
    text = " ".join(f"Sentence number {i} of Dr. Smith et al. is here." for i in range(200))
    for pieces in (values(spark, [text], T.split_sentences(F.col("t"), 300, 80))[0][0], values(spark, ["word " * 500], T.split_sentences(F.col("t"), 100, 0))[0][0]):
        assert all(len(p) <= 300 for p in pieces)
    pieces = values(spark, [text], T.split_sentences(F.col("t"), 300, 80))[0][0]
    assert " ".join(pieces) == text and all(not p.endswith("Dr.") and not p.endswith("al.") for p in pieces)


def test_wrappers(spark):
    texts = ["```text\nabc\n```", "[OUT]\nTranslation:\nabc\n[/OUT]", "<<<END_X>>> a", None, "plain"]
    assert [r[0] for r in values(spark, texts, T.strip_wrappers(F.col("t")))] == ["abc", "abc", "a", "", "plain"]


def test_targets_and_times(spark):
    assert values(spark, ["a ,b ( c) ..."], T.postprocess_target(F.col("t"), F.lit("ru"))) == [("a, b (c)…",)]
    got = [r[0] for r in spark.createDataFrame([(42.5,), (130.0,), (7300.0,)], "s double").select(T.format_time(F.col("s"))).collect()]
    assert got == ["42с", "2м 10с", "2ч 01м"]


def test_predicates(spark):
    texts = ["Table 1. X", "Таблица 2", "Fig. 3: Y", "Рис. 4", "Figure 5 shows the rise", "", None]
    got = values(spark, texts, P.is_table_caption(F.col("t")), P.is_figure_caption(F.col("t")))
    assert got == [(True, False), (True, False), (False, True), (False, False), (False, False), (False, False), (False, False)]
    got = values(spark, ["Список литературы приведён в конце", "Литература. Библиография", "Reference list"], P.is_ref_heading_line(F.col("t")))
    assert got == [(False,), (True,), (True,)]
    assert values(spark, ["eulav", "50.0<", "value", "eulav-p"], P.is_reversed(F.col("t"))) == [(True,), (True,), (False,), (True,)]
    assert values(spark, ["(Smith et al., 2015)", "12, 13-15", "We saw it.", "Smith et al."], P.is_short_citation(F.col("t"))) == [(True,), (True,), (False,), (True,)]
    assert values(spark, ["As an AI model", "перевод: x", "я не могу перевести это", "fine"], P.looks_like_meta_response(F.col("t"))) == [(True,), (False,), (True,), (False,)]


def test_geometry(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0)), ((0.0, 0.0, 1.0, 1.0), (4.0, 5.0, 6.0, 6.0)), ((0.0, 0.0, 0.0, 5.0), (0.0, 0.0, 9.0, 9.0))], f"a {box}, b {box}")
    got = df.select(G.overlap_ratio(F.col("a"), F.col("b")), G.chebyshev_gap(F.col("a"), F.col("b")), G.euclidean_gap(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.25, 0.0, 0.0), (0.0, 4.0, 5.0), (0.0, 0.0, 0.0)]
