"""Queries of operators of which the tables hold few or no cases, on literal rows; their SQL states the result in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query
from folio.functions import text as T
from folio.operators import figures, layout, masking, refs, running, summary, tables, translate
from folio.schema import BBOX, BLOCK, LINE

_BLOCKS = "doc_id bigint, page_num int, block_pos int, block_id bigint, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def _line(spans: list[tuple[str, float, float]], y: float, height: float = 10.0, flags: int = 0) -> tuple:
    """A line of spans (text, x0, x1); digits of a citation are given as flags by a fourth number."""
    made = [(s[0], "Serif", 10.0, s[3] if len(s) > 3 else flags, 0, (s[1], y), (s[1], y, s[2], y + height)) for s in spans]
    return made, (min(s[1] for s in spans), y, max(s[2] for s in spans), y + height), y


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Blocks of (doc, page, pos, id, type, text, box, lines or None)."""
    kind = f"{_BLOCKS}, lines array<{LINE.simpleString()}>"
    made = spark.createDataFrame(rows, kind)
    others = {f.name: F.lit(None).cast(f.dataType) for f in BLOCK.fields if f.name not in made.columns}
    return made.withColumns(others | {"font_size": F.lit(10.0), "text_override": F.col("text")})


def _plain(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Blocks of (doc, page, pos, id, type, text), one below the other, each a line."""
    return _frame(spark, [(*r, (0.0, 20.0 * r[2], 100.0, 20.0 * r[2] + 10.0), [_line([(r[5] or "", 0.0, 100.0)], 20.0 * r[2])]) for r in rows])


@query("SELECT * FROM (VALUES (1, 'представлений'), (2, 'However'), (3, 'well-known'), (4, 'EEG-based'), (5, 'P12- related'), (6, 'one two'), (7, 'e-mail'), (8, '')) t(id, joined)")
def joined_cases(spark: SparkSession, d: str) -> DataFrame:
    """P09, P12 on words broken over lines."""
    rows = [(1, ["представ-", "лений"]), (2, ["How-", "ever"]), (3, ["well-", "known"]), (4, ["EEG-", "based"]), (5, ["P12-", "related"]), (6, ["one", "", "two"]), (7, ["e-", "mail"]), (8, [])]
    return spark.createDataFrame(rows, "id int, ls array<string>").select("id", T.join_lines(F.col("ls")).alias("joined"))


@query("SELECT * FROM (VALUES (1, 'snowball'), (2, 'snow-ball'), (3, 'ледокол'), (4, 'snow-ball')) t(id, joined)")
def word_list_cases(spark: SparkSession, d: str) -> DataFrame:
    """P09 with P10: the word list of the script decides; without words both halves of a list of all decide."""
    rows = [(1, ["snow-", "ball"], ["snowball"], ["снег"]), (2, ["snow-", "ball"], ["snow", "ball"], []), (3, ["ледо-", "кол"], ["x"], ["ледокол"]), (4, ["snow-", "ball"], [], ["snow", "ball"])]
    df = spark.createDataFrame(rows, "id int, ls array<string>, en array<string>, ru array<string>")
    words = T.pick_words(F.get("ls", F.lit(0)), F.get("ls", F.lit(1)), {"en": F.col("en"), "ru": F.col("ru")})
    return df.select("id", T.join_lines(F.col("ls"), words).alias("joined"))


@query("""SELECT * FROM (VALUES (1, '-3.5|2,5%|10', FALSE), (2, '1e-3|.5', TRUE), (3, '', TRUE), (4, '1,000', TRUE), (5, '3', TRUE)) t(id, found, same)""")
def number_cases(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that touch no word character, compared as values."""
    rows = [(1, "T -3.5 and 2,5% of 10, x7", "10 2.5% 3.5"), (2, "1e-3 .5", "0.5 0.001"), (3, "no7 a_8", "none"), (4, "1,000", "1"), (5, "3 m2", "3.0")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    values = lambda c: F.array_sort(F.transform(T.numbers(F.col(c)), T.normalize_number))
    return df.select("id", F.array_join(T.numbers(F.col("a")), "|").alias("found"), (values("a") == values("b")).alias("same"))


@query("SELECT * FROM (VALUES (1, 0, 1, '[1, 2–5]'), (2, 0, 1, '[12]')) t(block_id, line_no, first_span, citation)")
def citation_cases(spark: SparkSession, d: str) -> DataFrame:
    """Superscript runs that are citations; not after a label, not other text."""
    at = lambda ss: [_line([(t, 10.0 * i, 10.0 * i + 9, f) for i, (t, f) in enumerate(ss)], 0.0)]
    rows = [(1, [("as shown", 0), ("1,", 1), ("2-5", 1), (" here", 0)]), (2, [("it is", 0), ("12", 1)]), (3, [("see Fig. ", 0), ("3", 1)]), (4, [("m", 0), ("th", 1)]), (5, [("7 a", 0)])]
    df = spark.createDataFrame([(i, at(ss)) for i, ss in rows], f"block_id int, lines array<{LINE.simpleString()}>")
    return refs.citation_runs(df.select("block_id", F.posexplode("lines").alias("line_no", "l")).select("block_id", "line_no", "l.spans"))


@query("SELECT * FROM (VALUES (1, 'ab|c', 'def'), (2, '', 'abc|def'), (3, 'abc|def', ''), (4, 'abc', 'def')) t(id, head, rest)")
def split_line_cases(spark: SparkSession, d: str) -> DataFrame:
    """A line cut after a number of characters."""
    spans = {1: [("ab", 0.0, 1.0), ("cdef", 1.0, 2.0)], 2: [("abc", 0.0, 1.0), ("def", 1.0, 2.0)], 3: [("abc", 0.0, 1.0), ("def", 1.0, 2.0)], 4: [("abc", 0.0, 1.0), ("def", 1.0, 2.0)]}
    df = spark.createDataFrame([(i, n, _line(spans[i], 0.0)) for i, n in ((1, 3), (2, 0), (3, 9), (4, 3))], f"id int, n int, l {LINE.simpleString()}")
    both = df.select("id", refs.split_line(F.col("l.spans"), F.col("n")).alias("b"))
    text = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "|")
    return both.select("id", text(F.col("b.head")).alias("head"), text(F.col("b.rest")).alias("rest"))


@query("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 'The whole representation of it'), (5, 3, 'One two compartments and three parts')) t(block_id, members, text)")
def broken_block_cases(spark: SparkSession, d: str) -> DataFrame:
    """Words broken over blocks, below each other or at the top of the next column; not over captions or other fonts."""
    box = lambda x, y: (x, y, x + 90.0, y + 10.0)
    rows = [
        (1, 1, 0, 1, "text", "The whole repre-", box(0.0, 0.0)), (1, 1, 1, 2, "text", "sentation of it", box(0.0, 12.0)), (1, 1, 2, 3, "text", "Figure 2. A sys-", box(0.0, 40.0)),
        (1, 1, 3, 4, "text", "tem of parts", box(0.0, 52.0)), (2, 1, 0, 5, "text", "One two compart-", box(0.0, 700.0)), (2, 1, 1, 6, "text", "ments and th-", box(200.0, 0.0)),
        (2, 1, 2, 7, "text", "ree parts", box(200.0, 12.0)), (2, 1, 3, 8, "text", "far be-", box(200.0, 100.0)), (2, 1, 4, 9, "text", "low it", box(200.0, 400.0)),
    ]
    b = _frame(spark, [(*r, [_line([(r[5], r[6][0], r[6][2])], r[6][1])]) for r in rows])
    return layout.merge_broken_blocks(b).where("members > 1").select("block_id", "members", "text")


_TABLE = [("Table 1. Values", [("Table 1. Values", 0.0, 90.0)]), ("a 1", [("a", 0.0, 20.0), ("1", 100.0, 120.0)]), ("b 2", [("b", 2.0, 20.0), ("2", 101.0, 120.0)]), ("End of it.", [("End of it.", 0.0, 90.0)])]


def _table_page(spark: SparkSession, caption: str, rest: str) -> DataFrame:
    rows = [(1, 1, k, k + 1, caption if k == 0 else rest, t, (0.0, 20.0 * k, 120.0, 20.0 * k + 10), [_line(ss, 20.0 * k)]) for k, (t, ss) in enumerate(_TABLE)]
    return _frame(spark, rows)


@query("""SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, '[["a","1"],["b","2"]]')) t(caption_id, rows, cells)""")
def caption_table_cases(spark: SparkSession, d: str) -> DataFrame:
    """A caption and the aligned rows that follow it."""
    return tables.caption_tables(_table_page(spark, "text", "text")).select("caption_id", "rows", F.to_json("table_data").alias("cells"))


@query("""SELECT * FROM (VALUES (1::BIGINT, 'table', 'Table 1. Values', '[["a","1"],["b","2"]]', 50.0::DOUBLE), (2, 'paragraph', NULL, NULL, 30.0), (3, 'paragraph', NULL, NULL, 50.0),
  (4, 'paragraph', NULL, NULL, 70.0), (6, 'table', 'Table 2. Found', '[["x","y"],["1","2"]]', 30.0)) t(block_id, type, caption, cells, bottom)""")
def consolidated_cases(spark: SparkSession, d: str) -> DataFrame:
    """A caption takes in the aligned rows after it, or names the table that follows; an empty table goes."""
    first = _table_page(spark, "table", "paragraph")
    rows = [(1, 2, 0, 5, "heading", "Table 2. Found", (0.0, 0.0, 90.0, 10.0), None), (1, 2, 1, 6, "table", None, (0.0, 20.0, 90.0, 30.0), None), (1, 2, 2, 7, "table", "", (0.0, 40.0, 90.0, 50.0), None)]
    data = F.when(F.col("block_id") == 6, F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("1"), F.lit("2"))))
    b = first.unionByName(_frame(spark, rows).withColumn("table_data", data))
    return tables.consolidate(b).select("block_id", "type", "caption", F.to_json("table_data").alias("cells"), F.col("bbox.y1").alias("bottom"))


@query("""SELECT * FROM (VALUES (1::BIGINT, 0, 'paragraph'), (2, 0, 'reference_heading'), (2, 1, 'reference'), (3, 0, 'reference'), (4, 0, 'table'), (5, 0, 'metadata'), (15, 0, 'reference'), (25, 0, 'metadata'),
  (11, 0, 'reference'), (12, 0, 'paragraph'), (21, 0, 'heading')) t(block_id, part, type)""")
def pipeline_cases(spark: SparkSession, d: str) -> DataFrame:
    """A running head, a list of references whose heading is cut off once, a table over it, back matter, a footer, in that order."""
    from folio.plans.pipeline import post_process

    rows = [
        (1, 1, 0, 5, "text", "Journal of Rivers 12, 1"), (1, 1, 1, 1, "paragraph", "Some words of a paper that go on for a while."), (1, 1, 2, 2, "paragraph", "References\\nA. Author, 2001"),
        (1, 1, 3, 3, "paragraph", "B. Author and others, in a journal."), (1, 1, 4, 4, "table", "a   b\\nc   d"), (1, 2, 0, 15, "text", "Journal of Rivers 12, 2"), (1, 2, 1, 11, "paragraph", "C. Author, in a third journal of it."),
        (1, 2, 2, 12, "paragraph", "Funding of this work was given by a trust."), (1, 3, 0, 25, "text", "Journal of Rivers 12, 3"), (1, 3, 1, 21, "text", "CONCLUSIONS"), (1, 3, 2, 22, "text", "Page 3"),
    ]
    def lines(r):
        return [_line([(t, 0.0, 100.0)], 40.0 * r[2] + 10.0 * k) for k, t in enumerate(r[5].split("\\n"))]

    b = _frame(spark, [(*r[:5], r[5].replace("\\n", "\n"), (0.0, 40.0 * r[2], 100.0, 40.0 * r[2] + 30), lines(r)) for r in rows])
    return post_process(b).select("block_id", "part", "type")


@query("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 0.0::DOUBLE, 90.0::DOUBLE, 'Fig. 1'), (7, 2, 0.0, 100.0, NULL)) t(cluster, members, x0, x1, caption)")
def composite_cases(spark: SparkSession, d: str) -> DataFrame:
    """Near figures become one, unless it would be tiny or fill the page."""
    boxes = {1: (0.0, 0.0, 40.0, 40.0), 2: (60.0, 0.0, 90.0, 40.0), 3: (300.0, 300.0, 310.0, 305.0), 4: (315.0, 300.0, 320.0, 305.0), 5: (0.0, 500.0, 50.0, 550.0)}
    rows = [(1, 1, k, k, "figure", None, b, None) for k, b in boxes.items()]
    rows += [(2, 1, 0, 7, "figure", None, (0.0, 0.0, 60.0, 60.0), None), (2, 1, 1, 8, "figure", None, (80.0, 0.0, 100.0, 60.0), None)]
    rows += [(3, 1, 0, 9, "figure", None, (0.0, 0.0, 590.0, 400.0), None), (3, 1, 1, 10, "figure", None, (0.0, 410.0, 590.0, 790.0), None)]
    f = _frame(spark, rows).withColumn("caption", F.when(F.col("block_id") == 2, "Fig. 1"))
    pages = spark.createDataFrame([(k, 1, 600.0, 800.0) for k in (1, 2, 3)], "doc_id bigint, page_num int, width double, height double")
    return figures.composite_figures(f, pages).select("cluster", "members", "bbox.x0", "bbox.x1", "caption")


@query("SELECT * FROM (VALUES (1::BIGINT), (3)) t(doc_id)")
def empty_document_cases(spark: SparkSession, d: str) -> DataFrame:
    """F17, with the floor of 10 characters."""
    rows = [(1, 1, 0, 1, "text", "short"), (1, 2, 0, 2, "text", "one"), (2, 1, 0, 3, "text", "long enough"), (3, 1, 0, 4, "text", None)]
    return running.empty_documents(_plain(spark, rows)).select("doc_id")


@query("SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'Figure 1. Map'), (4, 2, 'Fig. 2: Plot'), (5, NULL, NULL)) t(block_id, caption_id, caption)")
def image_cases(spark: SparkSession, d: str) -> DataFrame:
    """Images in order without repetitions, each with the nearest free caption."""
    rows = [
        (1, (0.0, 0.0, 50.0, 50.0), "a"), (2, (2.0, 2.0, 50.0, 50.0), "b"), (3, (50.5, 0.0, 60.0, 50.0), "a"), (4, (100.0, 0.0, 150.0, 50.0), "a"), (5, (400.0, 400.0, 450.0, 450.0), "c"), (6, (0.0, 200.0, 10.0, 210.0), "d"),
    ]
    images = spark.createDataFrame([(1, 1, n, 10 + n, b, c.encode()) for n, b, c in rows], f"doc_id bigint, page_num int, image_pos int, xref int, bbox {BBOX.simpleString()}, bytes binary")
    texts = _frame(spark, [(1, 1, 0, 1, "text", "Figure 1. Map", (0.0, 60.0, 50.0, 70.0), None), (1, 1, 1, 2, "text", "Fig. 2: Plot", (90.0, 60.0, 150.0, 70.0), None), (1, 1, 2, 3, "text", "No caption", (0.0, 0.0, 1.0, 1.0), None)])
    return figures.extract_images(images, texts)[0].select("block_id", "caption_id", "caption")


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE, 100.0::DOUBLE, 1::BIGINT, ''), (1, 280.0, 400.0, NULL, '2,3')) t(figure_no, x0, x1, caption_id, labels)")
def vector_figure_cases(spark: SparkSession, d: str) -> DataFrame:
    """Drawings with a caption, and drawings with labels only; rules, tables and framed paragraphs are none."""
    drawn = [(0.0, 0.0, 60.0, 60.0), (64.0, 0.0, 100.0, 60.0), (300.0, 300.0, 400.0, 380.0), (0.0, 500.0, 500.0, 501.0), (300.0, 600.0, 400.0, 700.0), (0.0, 600.0, 120.0, 680.0), (0.0, 0.0, 600.0, 800.0)]
    drawings = _frame(spark, [(1, 1, k, k, "drawing", None, b, None) for k, b in enumerate(drawn)])
    taken = _frame(spark, [(1, 1, 0, 90, "table", None, (290.0, 590.0, 410.0, 710.0), None)])
    texts = [
        (1, "Figure 1. Rivers", (0.0, 70.0, 100.0, 80.0)), (2, "n=24", (280.0, 330.0, 310.0, 340.0)), (3, "0.5", (320.0, 385.0, 340.0, 393.0)), (4, "far 7", (320.0, 500.0, 340.0, 510.0)), (5, "x " * 60, (5.0, 605.0, 115.0, 675.0)),
    ]
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id bigint, page_num int, width double, height double")
    found = figures.vector_figures(drawings, pages, taken, _frame(spark, [(1, 1, i, i, "text", t, b, None) for i, t, b in texts]))
    return found.select("figure_no", "bbox.x0", "bbox.x1", "caption_id", F.array_join("labels", ",").alias("labels"))


@query("""SELECT * FROM (VALUES (1::BIGINT, 2, 'Figure 1. Both lines'), (2, 1, 'outside it'), (4, 0, 'far away')) t(block_id, kept, text)""")
def figure_text_cases(spark: SparkSession, d: str) -> DataFrame:
    """Lines inside a figure leave their block; captions stay; a block of nothing else goes."""
    two = lambda a, b, y: [_line([(a, 0.0, 90.0)], y), _line([(b, 0.0, 90.0)], y + 60)]
    rows = [
        (1, 1, 0, 1, "text", "Figure 1. Both lines", (0.0, 10.0, 90.0, 80.0), two("Figure 1. Both", "lines", 10.0)), (1, 1, 1, 2, "text", "inside it outside it", (0.0, 10.0, 90.0, 80.0), two("inside it", "outside it", 10.0)),
        (1, 1, 2, 3, "text", "all in", (0.0, 20.0, 90.0, 30.0), [_line([("all in", 0.0, 90.0)], 20.0)]), (1, 1, 3, 4, "text", "far away", (0.0, 300.0, 90.0, 310.0), None), (1, 1, 4, 5, "text", "in as well", (0.0, 20.0, 90.0, 30.0), None),
    ]
    figure = _frame(spark, [(1, 1, 9, 9, "figure", None, (0.0, 0.0, 100.0, 50.0), None)])
    return figures.remove_figure_text(_frame(spark, rows), figure).select("block_id", "kept", "text")


@query("SELECT * FROM (VALUES (1::BIGINT, 'found', 'table'), (11, 'rows', 'table'), (12, 'rows', 'text')) t(block_id, origin, kind)")
def settled_table_cases(spark: SparkSession, d: str) -> DataFrame:
    """Tables compared with texts and with each other; one that isn't real goes back to the text."""
    at = lambda i, x0, y0, x1, y1: (1, 1, i, i, "table", None, (float(x0), float(y0), float(x1), float(y1)), None)
    found = _frame(spark, [at(1, 0, 0, 100, 100), at(2, 200, 0, 300, 100), at(3, 0, 300, 100, 400)]).withColumn("starts_with_bold", F.lit(False))
    spans = _frame(spark, [at(11, 205, 5, 300, 100), at(12, 0, 500, 100, 600), at(13, 0, 700, 50, 750)]).withColumn("starts_with_bold", F.lit(False))
    texts = _frame(spark, [at(21, 0, 305, 100, 400), at(22, 0, 510, 100, 595), at(23, 0, 700, 50, 750)])
    return tables.settle_tables(found, spans, texts).select("block_id", "origin", "kind")


@query("SELECT * FROM (VALUES (1, 'see [[CITE_0000]] and [[P_0001]]', '(Smith et al., 2015)~[1, 3–5]'), (2, '[[P_0000]] [[P_0001]]', 'https://a.org/x~a@b.org'), (3, '[[MATH_0000]]', 'p < 0.05'), (4, 'plain words', ''), (5, 'a [[REF7]] b', '')) t(id, masked, kept)".replace("(5, 'a [[REF7]] b', '')", "(5, 'a [[P_0000]] b', '[[REF7]]')"))
def mask_cases(spark: SparkSession, d: str) -> DataFrame:
    """M01 on one text of each kind."""
    rows = [(1, "see (Smith et al., 2015) and [1, 3–5]"), (2, "https://a.org/x a@b.org"), (3, "p < 0.05"), (4, "<b>plain</b> words"), (5, "a [[REF7]] b")]
    m = spark.createDataFrame(rows, "id int, t string").select("id", masking.mask("t").alias("m"))
    return m.select("id", "m.masked", F.array_join(F.transform("m.tokens", lambda t: t["value"]), "~").alias("kept"))


class _Stub:
    """Back end of the case below: turns words around; silent on long texts and on those that say so."""

    name = "stub"

    def translate(self, texts: list[str], lang: str) -> list[str | None]:
        return [None if len(t) > 650 or "never" in t else " ".join(reversed(t.split())) for t in texts]

    def generate(self, prompt: str) -> str | None:
        return None


@query("SELECT * FROM (VALUES ('cached', 1::BIGINT), ('citation', 1), ('contained', 1), ('failed', 1), ('skipped', 1), ('success', 3)) t(outcome, blocks)")
def outcome_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every outcome, with a back end that fails on long and on marked texts."""
    translate.register("stub", _Stub)
    tm = spark.sql("SELECT 1L AS entry_id, 'known text of some length' AS text, 'en' AS lang, 'another text of the same length' AS translation, timestamp'2020-01-01' AS stored_at")
    long = " ".join(f"Sentence {i} has some words in it that make it long enough." for i in range(20))
    texts = ["known text of some length", "quite a new text of a page", "never answered by any", long, "(Smith et al., 2015)", "new text of a page in it", "some words in it that make it"]
    rows = [(1, 1, k, k, "paragraph", t) for k, t in enumerate(texts)] + [(1, 1, 9, 9, "table", "x y")]
    done = translate.translate_blocks(_plain(spark, rows).withColumn("target_lang", F.lit("en")), tm, "stub")
    return translate.run_stats(done)


@query("SELECT * FROM (VALUES (1::BIGINT, '((0+1+2+3+4)+(5+6))'), (2, '(0+1)')) t(doc_id, summary)")
def summary_tree_cases(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of chunks combined by fives where there are more than five."""
    rows = [(1, k, str(k)) for k in range(7)] + [(2, k, str(k)) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_no int, summary string")
    return summary.reduce_tree(df, lambda c: F.when(F.size(c) > 1, F.concat(F.lit("("), F.array_join(c, "+"), F.lit(")"))).otherwise(F.array_join(c, "")))
