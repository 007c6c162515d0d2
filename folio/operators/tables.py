"""Tables: cells, columns, captions, and blocks that are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import predicates as P
from folio.functions.text import strip

NUMBER_LIKE = r"\d+[.,:]\d+|\d+%|\d+\.\d+[eE][+-]?\d+|\b\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?\b"
LABEL_LIKE = r"(?U)^[A-Za-zА-Яа-я][\w\s\-()]{0,30}$"


def _cells(line: Column, gap: str) -> Column:
    return F.filter(F.transform(F.split(strip(line), gap), strip), lambda c: c != "")


def heuristic_table(c: Column) -> Column:
    """Rows and cells that wide gaps or tabs make of a text, or NULL if it is no table.

    Not prose by length or end marks; every line has two cells or more; one number of cells, or two, where the
    shorter rows are padded.
    """
    lines = P.filled_lines(c)
    n = F.size(lines)
    ends = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?;]\s*$")))
    average = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n
    rows = F.transform(lines, lambda x: F.when(F.size(_cells(x, P.COLUMN_GAP)) >= 2, _cells(x, P.COLUMN_GAP)).otherwise(_cells(x, r"\s{2,}")))
    counts = F.array_distinct(F.transform(rows, F.size))
    most = F.array_max(counts)
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))))
    fits = (n >= 2) & ~((average > 90) & (ends == 0)) & (ends <= n * 0.4) & (F.array_min(counts) >= 2) & (F.size(counts) <= 2)
    return F.when(F.contains(c, F.lit("\n")), F.when(fits, padded))  # one line is never taken apart


def fix_reversed_cell(c: Column) -> Column:
    """Each line reversed, the lines in reverse order, without blank ones, as one line."""
    lines = F.transform(F.reverse(F.split(c, "\n")), F.reverse)
    return F.when(c == "", c).otherwise(F.array_join(F.filter(lines, lambda x: strip(x) != ""), " "))


def fix_reversed_table(rows: Column) -> Column:
    """All cells reversed if two or more of those sampled (4 rows, 6 cells each) are."""
    sample = F.filter(F.flatten(F.transform(F.slice(rows, 1, 4), lambda r: F.slice(r, 1, 6))), lambda c: F.length(strip(c)) > 1)
    wrong = F.size(F.filter(sample, lambda c: P.is_reversed(strip(c))))
    return F.when(wrong >= 2, F.transform(rows, lambda r: F.transform(r, fix_reversed_cell))).otherwise(rows)


def clean_tables(raw: DataFrame) -> DataFrame:
    """Raw tables (doc_id, page_num, table_pos, bbox, rows) that are tables, stripped and mended.

    Dropped: all empty, fewer than two rows or columns, lists of references; then, in order of table_pos, those
    within 3 points of an earlier table of the page or covered by it to 0.85. The last test compares tables of
    one page by an equi-join on (doc_id, page_num); a table that an earlier dropped one would have hidden stays.
    """
    rows = F.transform("rows", lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    t = raw.withColumn("rows", rows)
    t = t.where((F.size("rows") >= 2) & (F.size(F.element_at("rows", 1)) >= 2) & F.exists(F.flatten("rows"), lambda c: c != ""))
    t = t.where(~P.is_reference_table(F.col("rows"))).withColumn("rows", fix_reversed_table(F.col("rows")))
    a, b = t.alias("a"), t.select("doc_id", "page_num", F.col("table_pos").alias("p0"), F.col("bbox").alias("b0")).alias("b")
    near = (G.euclidean_gap(F.col("a.bbox"), F.col("b.b0")) <= 3) | (G.overlap_ratio(F.col("a.bbox"), F.col("b.b0")) >= 0.85)
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_num") == F.col("b.page_num"))
    return a.join(b, same & (F.col("b.p0") < F.col("a.table_pos")) & near, "left_anti")


def row_columns(lines: Column, tol: float = 8.0) -> Column:
    """Left edges of a block's columns: of spans if it has one line (none closer than 5), else of lines; NULL below two."""
    one = F.transform(F.filter(F.element_at(lines, 1)["spans"], lambda s: strip(s["text"]) != ""), lambda s: s["bbox"]["x0"])
    many = F.transform(F.filter(lines, lambda x: F.size(x["spans"]) > 0), lambda x: x["bbox"]["x0"])
    xs = F.array_sort(F.when(F.size(lines) == 1, one).otherwise(many))
    steps = F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: b - a)
    tight = (F.size(lines) == 1) & F.exists(steps, lambda d: d < 5)
    found = G.clusters_1d(xs, tol)
    return F.when((F.size(lines) > 0) & (F.size(xs) >= 2) & ~tight & (F.size(found) >= 2), found)


def columns_align(ref: Column, cols: Column, tol: float = 10.0, share: float = 0.5) -> Column:
    """Whether enough columns are near a column of the other row."""
    hits = F.size(F.filter(cols, lambda x: F.exists(ref, lambda y: F.abs(x - y) <= tol)))
    return F.coalesce((F.size(ref) > 0) & (F.size(cols) > 0) & (hits / F.size(cols) >= share), F.lit(False))


def table_row(lines: Column, columns: Column) -> Column:
    """Texts of a block by nearest column, the first on ties; several in one cell are joined by a blank."""
    cell = lambda spans: strip(F.array_join(F.filter(F.transform(spans, lambda s: s["text"]), lambda t: strip(t) != ""), " "))
    one = F.transform(F.element_at(lines, 1)["spans"], lambda s: F.struct(strip(s["text"]).alias("t"), s["bbox"]["x0"].alias("x")))
    many = F.transform(lines, lambda x: F.struct(cell(x["spans"]).alias("t"), F.when(F.size(x["spans"]) > 0, x["bbox"]["x0"]).otherwise(0.0).alias("x")))
    units = F.filter(F.when(F.size(lines) == 1, one).otherwise(many), lambda u: u["t"] != "")
    nearest = lambda x: F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))["i"]
    return F.transform(columns, lambda c, i: F.array_join(F.transform(F.filter(units, lambda u: nearest(u["x"]) == i), lambda u: u["t"]), " "))


def gutter_lines(lines: Column, gap: float = 15.0) -> Column:
    """Number of lines with a gap of 15 points or more between neighbouring spans."""

    def wide(line: Column) -> Column:
        xs = F.array_sort(F.transform(F.filter(line["spans"], lambda s: strip(s["text"]) != ""), lambda s: F.struct(s["bbox"]["x0"].alias("a"), s["bbox"]["x1"].alias("b"))))
        n = F.greatest(F.size(xs) - 1, F.lit(0))
        return F.exists(F.zip_with(F.slice(xs, 1, n), F.slice(xs, 2, n), lambda p, q: q["a"] - p["b"]), lambda d: d >= gap)

    return F.coalesce(F.size(F.filter(lines, wide)), F.lit(0))


def order_of(blocks: DataFrame) -> list[str]:
    """Columns that order the blocks of a page; halves of a split block have a ``part``."""
    return ["block_pos", "block_id", *(["part"] if "part" in blocks.columns else [])]


def content_links(blocks: DataFrame, kind: Column | None = None) -> Column:
    """How a block is tied to the one before it on its page (W10): 0 no text, 1 begins a run, 2 continues one of two or more,
    3 continues. A window of one page."""
    w = Window.partitionBy("doc_id", "page_num").orderBy(*order_of(blocks))
    lag = lambda c: F.lag(c).over(w)
    t = F.coalesce(F.col("text"), F.lit(""))
    plain = (F.col("type") if kind is None else kind).isin("text", "paragraph")
    nums, cols, label = F.regexp_count(t, F.lit(NUMBER_LIKE)), F.size(F.split(strip(t), P.COLUMN_GAP)), t.rlike(LABEL_LIKE)
    facts = F.struct(plain.alias("plain"), nums.alias("nums"), cols.alias("cols"), label.alias("label"))
    one, two = lag(facts), facts
    strong = ((one["nums"] >= 2) & (two["nums"] >= 2)) | ((one["cols"] >= 2) & (two["cols"] >= 2) & (F.abs(two["cols"] - one["cols"]) <= 1))
    weak = one["label"] | two["label"]
    return (
        F.when(~two["plain"], 0).when(~F.coalesce(one["plain"], F.lit(False)), 1).when(F.coalesce(strong, F.lit(False)), 3)
        .when(F.coalesce(weak, F.lit(False)), 2).otherwise(1)
    )


def run_lengths(links: Column) -> Column:
    """Array of (run, length of it) for the links of a page in order: a label-like block continues only a run of two."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("run"), F.lit(0).alias("size"))

    def step(acc: Column, link: Column) -> Column:
        goes = (link == 3) | ((link == 2) & (acc["size"] >= 2))
        run = F.when(goes, acc["run"]).otherwise(acc["run"] + 1)
        return F.struct(
            F.concat(acc["out"], F.array(F.when(link > 0, run).otherwise(F.lit(-1)))).alias("out"), run.alias("run"),
            F.when(goes, acc["size"] + 1).otherwise(F.lit(1)).alias("size"),
        )

    runs = F.aggregate(links, state, step)["out"]
    size = lambda rs, r: F.size(F.filter(rs, lambda x: x == r))
    sized = F.transform(F.array(runs), lambda rs: F.transform(rs, lambda r: F.struct(r.alias("run"), size(rs, r).alias("n"))))
    return F.element_at(sized, 1)


def content_runs(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, block_id, run``: blocks of runs of three or more that look like rows of a table.

    Neighbouring text blocks of a page are tied if both have two numbers, or columns whose numbers differ by one
    at most; a label-like block continues a run of two. Links are found by a window, the label rule by a fold over
    the page's links, carried by the same window: blocks are shuffled once.
    """
    return _with_runs(blocks).where("_run >= 0 AND _length >= 3").select("doc_id", "page_num", "block_id", F.col("_run").alias("run"))


def _with_runs(blocks: DataFrame, kind: Column | None = None) -> DataFrame:
    """Adds ``_run, _length`` of each block's run."""
    whole = Window.partitionBy("doc_id", "page_num")
    order = order_of(blocks)
    b = blocks.withColumn("_link", content_links(blocks, kind)).withColumn("_i", F.row_number().over(whole.orderBy(*order)))
    links = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_link")).over(whole)), lambda x: x["_link"])
    b = b.withColumn("_at", F.get(run_lengths(links), F.col("_i") - 1))
    return b.withColumns({"_run": F.col("_at.run"), "_length": F.col("_at.n")}).drop("_link", "_i", "_at")


def caption_tables(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, caption_id, rows, bbox, table_data``: captions with the aligned rows that follow them.

    Rows are the text blocks after the caption, up to the first that has no columns or isn't aligned with the first
    row. A fold's state is the first row of a run, so runs are islands and the reference is their first value.
    """
    w = Window.partitionBy("doc_id", "page_num").orderBy("block_pos", "block_id")
    b = blocks.withColumn("cols", row_columns(F.col("lines"))).withColumn("is_caption", (F.col("type") == "text") & P.is_table_caption(F.col("text")))
    fits = (F.col("type") == "text") & F.col("cols").isNotNull() & ~F.col("is_caption")
    b = b.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("run", F.sum(F.when(F.col("is_caption"), 1).otherwise(0)).over(w)).where("run > 0")
    at = Window.partitionBy("doc_id", "page_num", "run").orderBy("block_pos", "block_id")
    b = b.withColumn("i", F.row_number().over(at))
    b = b.withColumn("ref", F.first(F.when(F.col("i") == 2, F.col("cols")), ignorenulls=True).over(at))
    ok = (F.col("i") == 1) | (F.col("fits") & ((F.col("i") == 2) | columns_align(F.col("ref"), F.col("cols"))))
    b = b.withColumn("bad", F.sum(F.when(ok, 0).otherwise(1)).over(at)).where("bad = 0")
    grouped = b.groupBy("doc_id", "page_num", "run").agg(
        F.min_by("block_id", "i").alias("caption_id"), (F.count(F.lit(1)) - 1).alias("rows"), G.union_agg("bbox").alias("bbox"),
        F.array_sort(F.collect_list(F.when(F.col("i") > 1, F.struct("i", "cols", "lines")))).alias("rs"),
    ).where("rows > 0")
    columns = row_column_union(F.col("rs"))
    data = F.transform("rs", lambda r: table_row(r["lines"], F.col("columns")))
    return grouped.withColumn("columns", columns).select("doc_id", "page_num", "caption_id", "rows", "bbox", data.alias("table_data"))


def validate_tables(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """Tables (doc_id, page_num, block_id, bbox, starts_with_bold) that no text block covers, or is covered by, to more
    than 0.7, and that don't begin in bold (J07). A table is never compared with itself."""
    t, x = tables.alias("t"), texts.select("doc_id", "page_num", F.col("block_id").alias("text_id"), F.col("bbox").alias("text_box")).alias("x")
    same = (F.col("t.doc_id") == F.col("x.doc_id")) & (F.col("t.page_num") == F.col("x.page_num")) & (F.col("t.block_id") != F.col("x.text_id"))
    over = F.greatest(G.overlap_ratio(F.col("t.bbox"), F.col("x.text_box")), G.overlap_ratio(F.col("x.text_box"), F.col("t.bbox"))) > 0.7
    return t.where(~F.coalesce("starts_with_bold", F.lit(False))).join(x, same & over, "left_anti")


def settle_tables(found: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, page_num, block_id, origin, kind`` of tables found by a reader (``found``) and made of captions and rows
    (``spans``), checked and compared with each other (J07).

    Real tables are those of :func:`validate_tables`; found ones must not share 0.7 with any of ``spans`` either. Of a real pair
    that shares 0.7 the one of ``spans`` stays. A table of ``spans`` that isn't real goes back to the text, unless a text
    covers it to 0.9. Tables are never compared with themselves. All joins are within a page.
    """
    real_spans, real_found = validate_tables(spans, texts), validate_tables(found, texts.select("doc_id", "page_num", "block_id", "bbox").unionByName(spans.select("doc_id", "page_num", "block_id", "bbox")))

    def without(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
        x, y = a.alias("x"), b.select("doc_id", "page_num", F.col("bbox").alias("_box"), F.col("block_id").alias("_id")).alias("y")
        same = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.page_num") == F.col("y.page_num")) & (F.col("x.block_id") != F.col("y._id"))
        return x.join(y, same & (G.overlap_ratio(F.col("x.bbox"), F.col("y._box")) > share), "left_anti")

    kept_found = without(real_found, real_spans, 0.7)
    kept_spans = without(real_spans, kept_found, 0.7)
    back = without(spans.join(real_spans.select("block_id"), "block_id", "left_anti"), texts, 0.9)
    row = lambda df, origin, kind: df.select("doc_id", "page_num", "block_id", F.lit(origin).alias("origin"), F.lit(kind).alias("kind"))
    return row(kept_found, "found", "table").unionByName(row(kept_spans, "rows", "table")).unionByName(row(back, "rows", "text"))


def columns_by_x(blocks: DataFrame, eps: float = 15.0, least: int = 2, apart: float = 60.0) -> DataFrame:
    """``doc_id, page_num, columns``: left edges of a page's columns (W08): chains of spans of lines of at most 60 characters,
    ``least`` of them or more, each further than ``apart`` from the one kept before it. Gaps and islands, then a fold."""
    kinds = ("table", "figure", "empty", "reference", "reference_heading", "metadata")
    lines = blocks.where(~F.col("type").isin(*kinds)).select("doc_id", "page_num", F.explode("lines").alias("l"))
    short = F.length(strip(F.array_join(F.transform("l.spans", lambda s: s["text"]), ""))) <= 60
    x = lines.where(short).select("doc_id", "page_num", F.explode("l.spans").alias("s")).where(strip(F.col("s.text")) != "").select("doc_id", "page_num", F.col("s.bbox.x0").alias("x"))
    x = x.groupBy("doc_id", "page_num", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id", "page_num").orderBy("x")
    x = x.withColumn("c", F.sum(F.when(F.col("x") - F.lag("x").over(w) <= eps, 0).otherwise(1)).over(w))
    c = x.groupBy("doc_id", "page_num", "c").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")).where(F.col("n") >= least)
    page = c.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list("mean")).alias("m"))
    kept = F.aggregate("m", F.array().cast("array<double>"), lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > apart), F.concat(a, F.array(v))).otherwise(a))
    return page.select("doc_id", "page_num", kept.alias("columns"))


def row_column_union(rows: Column) -> Column:
    """Columns of the rows of a table: the first seen, none nearer than 10 to one before, in order."""
    return F.array_sort(F.aggregate(
        F.flatten(F.transform(rows, lambda r: F.coalesce(r["cols"], F.array().cast("array<double>")))), F.array().cast("array<double>"),
        lambda acc, c: F.when(F.exists(acc, lambda x: F.abs(c - x) <= 10), acc).otherwise(F.concat(acc, F.array(c))),
    ))


def consolidate(blocks: DataFrame) -> DataFrame:
    """Types and data of tables settled (W11). ``blocks`` has the block schema plus ``text``, and ``part`` where blocks are split.

    A block that a found table covers, whose text makes rows, that has gutters or is in a run of table-like blocks is a
    table. A caption before a table with data becomes its caption. Any other caption is a table itself: of the aligned or
    table-like blocks that follow it, which stay in the text as well. Blocks without content are left out. Every step is a
    window of one page or a join of its rectangles, so blocks are shuffled once, by page.
    """
    columns, order = blocks.columns, order_of(blocks)
    text = F.coalesce("text", F.lit(""))
    page = Window.partitionBy("doc_id", "page_num")
    w = page.orderBy(*order)
    rows = heuristic_table(text)
    boxes = F.collect_list(F.when(F.col("type") == "table", F.struct("block_id", "bbox"))).over(page)
    j = blocks.withColumn("_rows", rows).withColumn("_found", boxes)
    covered = F.exists("_found", lambda f: (f["block_id"] != F.col("block_id")) & (G.overlap_ratio(F.col("bbox"), f["bbox"]) > 0.5))
    alike = F.col("_rows").isNotNull() | P.looks_like_table_data(text)
    kind = F.when((F.col("type") != "table") & F.coalesce(covered, F.lit(False)) & alike, "table").otherwise(F.col("type"))
    fixed = ("table", "figure", "reference", "reference_heading", "metadata")
    j = j.withColumn("type", kind).drop("_found")
    own = ~F.col("type").isin(*fixed) & F.col("_rows").isNotNull()
    j = j.withColumn("table_data", F.when(own, F.col("_rows")).otherwise(F.col("table_data")))
    gutters = F.col("type").isin("text", "paragraph") & (F.size("lines") >= 2) & (gutter_lines(F.col("lines")) >= 2)
    j = j.withColumn("type", F.when(F.coalesce(own | gutters, F.lit(False)), "table").otherwise(F.col("type")))
    j = _with_runs(j)
    j = j.withColumn("type", F.when((F.col("type") == "text") & (F.col("_run") >= 0) & (F.col("_length") >= 3), "table").otherwise(F.col("type")))
    # Captions: islands of a caption and what follows it, up to the first block that is no row.
    filled = F.coalesce(F.size("table_data"), F.lit(0)) > 0
    caption = F.coalesce(F.col("type").isin("text", "heading", "table") & ~filled & P.is_table_caption(text), F.lit(False))
    j = j.withColumns({"_caption": caption, "_data": F.coalesce((F.col("type") == "table") & filled, F.lit(False)), "_cols": row_columns(F.col("lines"))})
    j = j.withColumn("_island", F.sum(F.col("_caption").cast("int")).over(w))
    island = Window.partitionBy("doc_id", "page_num", "_island")
    inside = island.orderBy(*order)
    j = j.withColumns({"_n": F.row_number().over(inside), "_before": F.lag(F.when(F.col("_caption"), F.col("text"))).over(w), "_after": F.lead("_data").over(w)})
    j = j.withColumn("_ref", F.first(F.when(F.col("_n") > 1, F.col("_cols")), ignorenulls=True).over(inside))
    fits = F.col("type").isin("text", "paragraph", "list") & (
        (F.col("_cols").isNotNull() & columns_align(F.col("_ref"), F.col("_cols"))) | F.col("_rows").isNotNull() | P.looks_like_table_data(text)
    )
    j = j.withColumn("_bad", F.sum(F.when((F.col("_n") == 1) | F.coalesce(fits, F.lit(False)), 0).otherwise(1)).over(inside))
    row = F.when((F.col("_island") > 0) & (F.col("_n") > 1) & (F.col("_bad") == 0), F.struct("_n", F.col("_cols").alias("cols"), "lines", "bbox", "text"))
    j = j.withColumn("_follow", F.when(F.col("_caption"), F.array_sort(F.collect_list(row).over(island))))
    j = j.withColumn("_columns", row_column_union(F.col("_follow")))
    cells = lambda r: F.when((F.size("_columns") > 0) & r["lines"].isNotNull(), table_row(r["lines"], F.col("_columns"))).otherwise(F.array(r["text"]))
    absorbs = F.col("_caption") & ~F.coalesce("_after", F.lit(False)) & (F.size("_follow") > 0)
    every = F.concat(F.array("bbox"), F.transform("_follow", lambda r: r["bbox"]))
    box = F.aggregate(every, F.col("bbox"), lambda a, b: G.union(a, b))
    j = j.withColumns({
        "caption": F.when(F.col("_data") & F.col("_before").isNotNull(), F.col("_before")).when(absorbs, F.col("text")).otherwise(F.col("caption")),
        "table_data": F.when(absorbs, F.transform("_follow", cells)).otherwise(F.col("table_data")),
        "bbox": F.when(absorbs, box).otherwise(F.col("bbox")),
        "lines": F.when(absorbs, F.concat(F.coalesce("lines", F.array().cast(blocks.schema["lines"].dataType)), F.flatten(F.transform("_follow", lambda r: F.coalesce(r["lines"], F.array().cast(blocks.schema["lines"].dataType)))))).otherwise(F.col("lines")),
        "type": F.when(F.col("_caption"), "table").otherwise(F.col("type")),
    })
    attached = F.col("_caption") & F.coalesce("_after", F.lit(False))
    empty = (F.col("type") == "empty") | ((F.col("type") == "table") & F.col("table_data").isNull() & (strip(text) == ""))
    return j.where(~attached & ~F.coalesce(empty, F.lit(False))).select(*columns)
