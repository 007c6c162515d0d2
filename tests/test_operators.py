"""Block operators on small fixtures and against plain loops."""

import random
import re

from pyspark.sql import functions as F

from folio.operators import figures, masking, refs, running, tables, translate, validate


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, page_num int, block_pos int, block_id bigint, type string, text string").withColumn(
        "table_data", F.lit(None).cast("array<array<string>>")
    )


def test_running_heads(spark):
    rows = [(1, p, 0, p * 10, "text", f"Current Biology 26, 2016 172{p}") for p in (1, 2, 3)]
    rows += [(1, p, 1, p * 10 + 1, "text", str(1720 + p)) for p in (1, 2, 3)] + [(1, 1, 2, 99, "text", "Only once here"), (2, 1, 0, 100, "text", None)]
    b = pages(spark, rows)
    assert {r.key for r in running.repeating_keys(b).collect()} == {"current biology 26, 2016", "__pagenum__"}
    marked = {r.block_id: r.type for r in running.mark_running_heads(b).collect()}
    assert marked[10] == marked[11] == "metadata" and marked[99] == marked[100] == "text" and len(marked) == 8
    assert running.repeating_keys(b.limit(0)).count() == 0


def test_footers(spark):
    rows = [(1, 1, i, i, "text", t) for i, t in enumerate(["a", "b", "Page 3", "c"])] + [(1, 2, i, 10 + i, "text", t) for i, t in enumerate(["a", "Author manuscript"])]
    assert sorted(r.block_id for r in running.cut_footers(pages(spark, rows)).collect()) == [0, 1, 10]


def test_reference_state_is_a_loop(spark):
    rng = random.Random(4)
    kinds = ["paragraph", "paragraph", "figure", "table", "heading", "reference_heading"]
    rows = [(d, p, i, d * 1000 + p * 10 + i, rng.choice(kinds), rng.choice(["x", "Funding from A", "y", None])) for d in (1, 2) for p in range(1, 9) for i in range(5)]
    want, state = {}, {}
    for d, p, i, b, kind, text in sorted(rows):
        inside = state.get(d, False)
        if kind == "reference_heading":
            state[d] = True
        elif inside and text and text.startswith("Funding"):
            state[d] = inside = False
        want[b] = "reference" if inside and kind not in ("figure", "table", "reference_heading") else kind
    got = {r.block_id: r.type for r in refs.mark_references(pages(spark, rows)).collect()}
    assert got == want


def test_masking_is_lossless(spark):
    texts = ["see (Smith et al., 2015) and [1, 3–5]", "https://a.org/x 10.1000/xyz a@b.org", "p < 0.05 and x^2", "<b>bold</b> text", "", "plain words only", "[[P_0001]] was here, LINK_0000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", masking.mask("t").alias("m"))
    rows = df.select("t", "m", masking.restore(F.col("m.masked"), F.col("m.tokens")).alias("back")).collect()
    for r in rows[:-1]:
        assert r.back == re.sub(r"\s{2,}", " ", re.sub(r"(?i)</?(?:b|i|u|em|strong|small|sub|sup|span|font)[^>]*>", "", r.t)).strip()
    assert any(x.token.startswith("[[CITE") for x in rows[0].m.tokens) and rows[5].m.tokens == []
    shown = lambda t: spark.createDataFrame([(t,)], "t string").select(masking.mask("t").alias("m")).first().m
    assert [x.value for x in shown("a [[REF7]] at (x + y)/(z + 1), (3; 4.5) and 7/8").tokens] == ["[[REF7]]", "(x + y)/(z + 1)", "(3; 4.5)"]
    assert [x.value for x in shown("Smith (2015) is at https://a.org/x.").tokens] == ["Smith (2015)", "https://a.org/x."]
    assert shown("plain " * 30000 + "x_1").tokens[0].value == "x_1" and shown(None) is None


def test_validation(spark):
    long = "The third laboratory repeated the test with care and obtained the same values again and again. " * 2
    rows = [(1, long, long, "ru"), (2, long, "коротко", "ru"), (3, long, "слово " * 200, "ru"), (4, "abc", "As an AI model I refuse", "en"), (5, long, None, "ru"), (6, "x 5", "y 6", "en"), (7, None, "a", None)]
    v = {r.id: r for r in validate.validate(spark.createDataFrame(rows, "id int, source string, candidate string, target_lang string")).collect()}
    assert v[1].echo and v[2].too_short and v[3].too_long and v[4].meta_response and v[5].empty and v[6].numbers_changed
    assert [v[i].accepted for i in range(1, 8)] == [False, False, False, False, False, True, True]


def test_contained_blocks_is_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 12))) for _ in range(80)]
    rows = [(i % 2, 1, i, i, "paragraph", t) for i, t in enumerate(texts)]
    want = {i for i, t in enumerate(texts) if len(t) > 20 and any(t in u and len(u) > len(t) for j, u in enumerate(texts) if i % 2 == j % 2 and len(u) > 20)}
    assert {r.block_id for r in translate.contained_blocks(pages(spark, rows)).collect()} == want


def test_sections_are_greedy(spark):
    rng = random.Random(2)
    rows = [(d, 1, i, d * 100 + i, "paragraph", "x" * rng.randint(1, 30)) for d in (1, 2) for i in range(40)]
    got = {r.block_id: r.section for r in translate.sections(pages(spark, rows).withColumn("normalized", F.col("text")), 50).collect()}
    for d in (1, 2):
        section, size = 0, 0
        for _, _, i, b, _, t in [r for r in rows if r[0] == d]:
            if size and size + len(t) > 50:
                section, size = section + 1, 0
            size += len(t)
            assert got[b] == section


def test_heuristic_table(spark):
    texts = ["a   b\nc   d", "a   b   c\nd   e", "one line   only", "This is prose.\nIt ends in stops.", "a\tb\nc\td\ne\tf"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tables.heuristic_table(F.col("t"))).collect()]
    assert got == [[["a", "b"], ["c", "d"]], [["a", "b", "c"], ["d", "e", ""]], None, None, [["a", "b"], ["c", "d"], ["e", "f"]]]


def test_clusters():
    assert figures._cluster([(0, 0, 10, 10), (12, 0, 20, 10), (100, 0, 110, 10)], 5, True) == [0, 0, 1]
    assert len(set(figures._cluster([(0, 0, 1, 1), (50, 0, 51, 1), (0, 2, 60, 3)], 5, True))) == 1


def test_memory_and_pipeline(spark):
    tm = spark.sql("SELECT 1L AS entry_id, 'known text of some length' AS text, 'ru' AS lang, 'известный текст такой длины' AS translation, timestamp'2020-01-01' AS stored_at")
    rows = [(1, 1, 0, 1, "paragraph", "known text of some length"), (1, 1, 1, 2, "paragraph", "some quite new text here"), (1, 1, 2, 3, "table", "x"), (1, 1, 3, 4, "paragraph", "(Smith et al., 2015)")]
    out = {r.block_id: r for r in translate.translate_blocks(pages(spark, rows).withColumn("target_lang", F.lit("ru")), tm).collect()}
    assert {k: v.outcome for k, v in out.items()} == {1: "cached", 2: "success", 3: "skipped", 4: "citation"}
    assert out[1].translation == "известный текст такой длины"


def test_fallback_rescue_and_context(spark):
    class Short:
        """Fails on long texts, on some words, and on a link that isn't masked; gives the words back in reverse."""

        name = "short"

        def translate(self, texts, lang):
            return [None if len(t) > 650 or "never" in t or "second" in t or "10.1000" in t else " ".join(t.split()[::-1]) for t in texts]

        def generate(self, prompt):
            return None

    class Other(Short):
        def translate(self, texts, lang):
            return ["запасной " + " ".join(t.split()[::-1]) if "second" in t and "never" not in t and len(t) < 650 else None for t in texts]

    class Context(Short):
        def translate_in_context(self, texts, lang, before, after):
            return [f"{b[-5:]}|{a[:5]}" for b, a in zip(before, after)]

    translate.register("short", Short, Other)
    translate.register("context", Context)
    tm = spark.sql("SELECT 1L AS entry_id, 'x' AS text, 'en' AS lang, 'y' AS translation, timestamp'2020-01-01' AS stored_at")
    long = [f"Sentence {i} has a {w} word in it and some more text to be long enough." for i, w in enumerate(["first", "second"] * 8)]
    texts = ["one plain short text here", "the second text of the page", "never answered by any", " ".join(long), " ".join(long[:-1]) + " It is never answered so.", "see 10.1000/xyz for the whole data"]
    b = pages(spark, [(1, 1, i, i, "paragraph", t) for i, t in enumerate(texts)]).withColumn("target_lang", F.lit("en"))
    out = {r.block_id: r for r in translate.translate_blocks(b, tm, "short").collect()}
    assert [out[i].outcome for i in range(6)] == ["success", "success", "failed", "success", "failed", "success"]
    assert out[1].translation.startswith("запасной") and out[4].translation is None and "10.1000/xyz" in out[5].translation
    assert out[3].translation.count("a has") == 16 and "\n" not in out[3].translation
    near = {r.block_id: r.translation for r in translate.translate_blocks(b, tm, "context").collect()}
    assert near[0] == "|the s" and near[1] == " here|never" and near[5] == "d so.|"
