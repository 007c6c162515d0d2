"""Block metrics and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import predicates as P
from folio.functions.text import block_font_size, count_list_lines, strip, tokens

METADATA_WORDS = r"(?i)(Journal|Volume|Issue|Pages|DOI|ISSN|ISBN|©|Copyright|Email|Corresponding|Received|Accepted|Published)"


def page_medians(blocks: DataFrame, default: float = 12.0) -> DataFrame:
    """``doc_id, page_num, avg_font``: the exact median of the positive font sizes of a page's blocks."""
    size = block_font_size(F.col("font_size"), F.col("lines"))
    b = blocks.select("doc_id", "page_num", F.when(size > 0, size).alias("size"))
    return b.groupBy("doc_id", "page_num").agg(F.coalesce(F.median("size"), F.lit(default)).alias("avg_font"))


def body_medians(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, body``: the upper median of a page's block font sizes (A03). A page is a small group."""
    b = blocks.where("font_size > 0").groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list("font_size")).alias("sizes"))
    return b.select("doc_id", "page_num", F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")).alias("body"))


def metrics(page_width: Column) -> dict[str, Column]:
    """Block metrics as expressions over text, lines, bbox and font columns."""
    spans = F.flatten(F.transform("lines", lambda x: x["spans"]))
    filled = F.filter(spans, lambda s: F.coalesce(s["text"], F.lit("")) != "")
    # A text is upper case if it has a cased letter and none that is small.
    upper = F.forall(filled, lambda s: s["text"].rlike(r"\p{Lu}") & ~s["text"].rlike(r"\p{Ll}"))
    bold = F.exists(spans, lambda s: (s["flags"].bitwiseAND(17) != 0) | F.contains(F.lower(F.coalesce(s["font"], F.lit(""))), F.lit("bold")))
    largest = F.array_max(F.transform(spans, lambda s: s["size"]))
    centre = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    return {
        "max_font": F.when(largest > 0, largest).otherwise(F.coalesce("font_size", F.lit(0.0))),
        "all_upper": F.coalesce(upper, F.lit(True)),
        "has_bold": F.coalesce(bold, F.lit(False)) | F.coalesce(F.col("font_flags").bitwiseAND(16) != 0, F.lit(False)) | F.coalesce("starts_with_bold", F.lit(False)),
        "is_centered": F.coalesce((page_width > 0) & (F.abs(centre - page_width / 2) < page_width * 0.1), F.lit(False)),
        "total_spans": F.greatest(F.coalesce(F.size(spans), F.lit(0)), F.lit(0)),
    }


def heading_score(text: Column, avg_font: Column) -> Column:
    """Points for a heading over the metric columns (C02); 5 make one."""
    words = F.size(tokens(text))
    return (
        F.when(F.col("max_font") > avg_font * 1.25, 3).otherwise(0) + F.when(F.col("all_upper"), 2).otherwise(0)
        + F.when(F.col("has_bold"), 2).otherwise(0) + F.when(F.col("is_centered"), 1).otherwise(0)
        + F.when(F.length(text) < 100, 1).otherwise(0) + F.when(text.rlike(r"^\d+(\.\d+)*\s+"), 2).otherwise(0)
        + F.when((words <= 4) & (F.col("max_font") >= avg_font * 1.1), 2).otherwise(0)
    )


def classify(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Adds metric columns, ``score`` and ``label``; the label of a block that isn't raw text is its type.

    ``blocks`` has the block schema plus ``text``; ``pages`` (doc_id, page_num, width) may give page widths. One
    CASE, first rule first. Medians and widths join on (doc_id, page_num).
    """
    b = blocks.join(page_medians(blocks), ["doc_id", "page_num"])
    if pages is not None:
        sizes = pages.groupBy("doc_id", "page_num").agg(F.max("width").alias("page_width"))
        b = b.join(sizes, ["doc_id", "page_num"], "left")
    else:
        b = b.withColumn("page_width", F.lit(0.0))
    b = b.withColumns(metrics(F.coalesce("page_width", F.lit(0.0))))
    return b.withColumn("score", heading_score(F.col("text"), F.col("avg_font"))).withColumn(
        "label", F.when(F.col("type") == "text", label(F.col("text"))).otherwise(F.col("type"))
    )


def label(t: Column) -> Column:
    """Label of a text by rules over the metric columns and score."""
    words, core = F.size(tokens(t)), F.regexp_replace(strip(t), r"[:.]+$", "")
    shout = (words == 1) & F.col("all_upper") & (F.length(strip(t)) >= 3) & ~t.rlike(P.REF_HEADING)
    shout = shout & (F.length(core) >= 3) & core.rlike(r"^[A-ZА-ЯЁ0-9\-]+$") & core.rlike(r"[A-ZА-ЯЁ]")
    few = words <= 10
    lists = count_list_lines(t)
    return (
        F.when((F.coalesce(F.size("lines"), F.lit(0)) <= 0) | (F.coalesce(t, F.lit("")) == "") | (F.col("total_spans") == 0), "empty")
        .when(~t.rlike(r"[A-Za-zА-Яа-я]"), "empty")
        .when(t.rlike(r"^\s*(?:[a-zA-Z_]+\(\)|(?:[^\p{L}\p{M}\p{N}_]|\d)+)\s*$"), "empty")
        .when(shout, "heading")
        .when(P.is_likely_table(t), "table")
        .when(t.rlike(P.REF_HEADING), "reference_heading")
        .when(P.is_table_caption(t), "table")
        .when(few & t.rlike(r"^\[\d+\]"), "reference")
        .when(few & t.rlike(r"[A-Z][a-z]+\s+[A-Z]\.[A-Z]\."), "metadata")
        .when(few & t.rlike(METADATA_WORDS), "metadata")
        .when(few & t.rlike(r"(?U)^[\w\s\-]+,\s*\d{4}$"), "metadata")
        .when((lists >= 2) | ((lists >= 1) & (F.size(F.split(t, "\n")) >= 2)), "list")
        .when(F.col("score") >= 5, "heading")
        .otherwise("paragraph")
    )
