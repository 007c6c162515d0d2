"""Reference sections, their headings, and citations set as superscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import predicates as P
from folio.functions.text import strip

# A run of superscript citation numbers, and labels that are no citation.
CITATION_RUN = r"^\d{1,2}(?:\s*[,–—-]\s*\d{1,2})*\s*[,.]?$"
LABEL_BEFORE = (
    r"\b(?:Fig(?:ure)?\.?|Table|Tab\.?|Vol(?:ume)?\.?|No\.?|Section|Chapter|Ch\.?|Equation|Eq\.?|Ref\.?|Page|pp\.?|Appendix|"
    r"Supplementary|Suppl\.?)\s*$"
)


def carry_over_pages(rows: DataFrame, event: Column, order: tuple[str, ...] = ("block_pos",)) -> DataFrame:
    """Adds ``_state``: the last event that isn't NULL up to and with each row of a document.

    Within a page by a window over the page; over pages by a window over one row a page, so that no task
    holds all blocks of a large document.
    """
    page = Window.partitionBy("doc_id", "page_num").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = rows.withColumn("_event", event).withColumn("_here", F.last("_event", ignorenulls=True).over(page))
    pages = b.groupBy("doc_id", "page_num").agg(F.max_by("_event", F.when(F.col("_event").isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    return b.join(pages, ["doc_id", "page_num"]).withColumn("_state", F.coalesce("_here", "_before")).drop("_event", "_here", "_before")


def mark_references(blocks: DataFrame) -> DataFrame:
    """Blocks between a reference heading and back matter get type reference, figures and tables excepted."""
    event = F.when(F.col("type") == "reference_heading", F.lit(1)).when(P.is_back_matter(F.col("text")), F.lit(0))
    b = carry_over_pages(blocks, event, ("block_pos", "part") if "part" in blocks.columns else ("block_pos",))
    inside = (F.coalesce("_state", F.lit(0)) == 1) & ~F.col("type").isin("reference_heading", "figure", "table")
    return b.withColumn("type", F.when(inside, "reference").otherwise(F.col("type"))).select(*blocks.columns)


def split_reference_headings(blocks: DataFrame) -> DataFrame:
    """A block whose first line is nothing but reference keywords becomes a heading and, if it goes on, a reference.

    Both halves keep the block's id and place: ``part``, which is added, is 0 for the first and 1 for the second, and orders
    and identifies them together with the block's.
    """
    first = strip(F.array_join(F.transform(F.try_element_at("lines", F.lit(1))["spans"], lambda s: s["text"]), " "))
    splits = (F.size("lines") > 1) & P.is_ref_heading_line(first)
    part = lambda kind, lines, n: F.struct(F.lit(kind).alias("type"), lines.alias("lines"), F.lit(n).alias("part"))
    both = F.array(part("reference_heading", F.slice("lines", 1, 1), 0), part("reference", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), 1))
    same = F.array(F.struct(F.col("type"), F.col("lines"), F.lit(0).alias("part")))
    out = blocks.withColumn("_split", F.coalesce(splits, F.lit(False)))
    out = out.withColumn("_part", F.explode(F.when(F.col("_split"), both).otherwise(same)))
    out = out.withColumn("text_override", F.when(~F.col("_split"), F.col("text_override"))) if "text_override" in blocks.columns else out
    out = out.withColumns({"type": F.col("_part.type"), "lines": F.col("_part.lines"), "part": F.col("_part.part")})
    return out.select(*blocks.columns, *(["part"] if "part" not in blocks.columns else []))


def citation_runs(lines: DataFrame) -> DataFrame:
    """``block_id, line_no, first_span, citation``: runs of superscript spans that are citations, as [1, 2–5].

    ``lines`` has block_id, line_no and spans. Runs are islands of consecutive superscript spans of a line.
    """
    at = Window.partitionBy("block_id", "line_no").orderBy("span_no")
    s = lines.select("block_id", "line_no", F.posexplode("spans").alias("span_no", "s"))
    s = s.withColumn("up", F.col("s.flags").bitwiseAND(1) == 1)
    s = s.withColumn("opens", F.col("up") & (F.trim("s.text") != "") & ~F.coalesce(F.lag("up").over(at), F.lit(False)))
    s = s.withColumn("island", F.sum(F.when(F.col("up") == F.coalesce(F.lag("up").over(at), ~F.col("up")), 0).otherwise(1)).over(at))
    ahead = Window.partitionBy("block_id", "line_no").orderBy("span_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("ahead", F.array_join(F.collect_list("s.text").over(ahead), ""))
    runs = s.where("up").groupBy("block_id", "line_no", "island").agg(
        F.min("span_no").alias("first_span"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "s.text"))), lambda x: x["text"]), "").alias("run"),
        F.min_by("ahead", "span_no").alias("ahead"),
    )
    runs = runs.where(F.col("run").rlike(CITATION_RUN) & ~F.col("ahead").rlike(LABEL_BEFORE))
    inner = F.regexp_replace(F.regexp_replace("run", r"^[., ]+|[., ]+$", ""), r"\s*[–—-]\s*", "–")
    return runs.select("block_id", "line_no", "first_span", F.concat(F.lit("["), F.regexp_replace(inner, r"\s*,\s*", ", "), F.lit("]")).alias("citation"))


def split_line(spans: Column, at: Column) -> Column:
    """struct(head, rest): the spans of a line before and after a number of characters; a span across it is cut."""
    sizes = F.transform(spans, lambda s: F.length(F.coalesce(s["text"], F.lit(""))))
    begin = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n)
    cut = lambda s, text: s.withField("text", text)
    head = F.filter(F.transform(spans, lambda s, i: F.when(begin(i) < at, cut(s, F.substring(s["text"], F.lit(1), at - begin(i))))), lambda s: s.isNotNull())
    rest = F.filter(
        F.transform(spans, lambda s, i: F.when(begin(i) >= at, s).when(begin(i) + F.get(sizes, i) > at, cut(s, F.substring(s["text"], at - begin(i) + 1, F.get(sizes, i))))),
        lambda s: s.isNotNull(),
    )
    return F.struct(head.alias("head"), rest.alias("rest"))
