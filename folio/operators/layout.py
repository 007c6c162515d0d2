"""Blocks from lines: reading order, splitting, rebuilding, and words broken over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import predicates as P
from folio.functions.text import HYPHENS, first_word, is_compound, join_lines, last_word, line_text, lstrip, rstrip, text_quality


def line_rows(blocks: DataFrame) -> DataFrame:
    """One row for each line of a block, with its text, dominant span and quality."""
    x = blocks.where("lines IS NOT NULL").select("doc_id", "page_num", "block_id", "block_pos", F.posexplode("lines").alias("line_no", "line"))
    spans = F.filter("line.spans", lambda s: F.coalesce(s["text"], F.lit("")) != "")
    x = x.withColumn("spans", spans).where(F.size("spans") > 0)
    sizes = F.array_sort(F.filter(F.transform("spans", lambda s: s["size"]), lambda v: v > 0))
    n = F.size(sizes)
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
    x = x.withColumn("size", F.when(n > 0, middle).otherwise(12.0))
    nearest = F.array_min(F.transform("spans", lambda s, i: F.struct(F.abs(s["size"] - F.col("size")).alias("d"), i.alias("i"), s["color"].alias("color"), s["flags"].alias("flags"))))
    bold = F.exists("spans", lambda s: (s["flags"].bitwiseAND(16) != 0) | F.contains(F.lower(F.coalesce(s["font"], F.lit(""))), F.lit("bold")))
    x = x.withColumn("dominant", nearest).withColumn("bold", F.coalesce(bold, F.lit(False)))
    text = line_text(F.col("spans"))
    return x.select(
        "doc_id", "page_num", "block_id", "block_pos", "line_no", F.col("line.bbox").alias("bbox"), "spans", "size",
        F.col("dominant.color").alias("color"), F.col("dominant.flags").alias("flags"), "bold", text.alias("text"), text_quality(text).alias("quality"),
    ).where("text <> ''")


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds ``reading_pos``, from 1 within a block: top to bottom, then left to right, to 3 decimals."""
    w = Window.partitionBy("doc_id", "page_num", "block_id").orderBy(F.bround("bbox.y0", 3), F.bround("bbox.x0", 3), "line_no")
    return lines.withColumn("reading_pos", F.row_number().over(w))


def split_groups(lines: DataFrame) -> DataFrame:
    """Adds ``grp``: a new group where size, colour or boldness changes or the gap is wide (S02, gaps and islands)."""
    w = Window.partitionBy("doc_id", "page_num", "block_id").orderBy("reading_pos")
    before = lambda c: F.lag(c).over(w)
    height = F.greatest(F.lit(1.0), before("bbox.y1") - before("bbox.y0"))
    splits = (
        (F.abs(F.col("size") - before("size")) > 1.2) | (F.col("color") != before("color")) | (F.col("bold") != before("bold"))
        | (F.col("bbox.y0") - before("bbox.y1") > height * 1.65)
    )
    marked = reading_order(lines).withColumn("_split", F.coalesce(splits, F.lit(False)).cast("int"))
    return marked.withColumn("grp", F.sum("_split").over(w)).drop("_split")


def rebuild_blocks(lines: DataFrame, words: Column | None = None) -> DataFrame:
    """One row for each (block, grp): box, joined text, largest font, flags, first colour, bold start."""
    keyed = F.struct("reading_pos", "text", "color", "bold")
    out = lines.groupBy("doc_id", "page_num", "block_id", "block_pos", "grp").agg(
        G.union_agg("bbox").alias("bbox"), F.array_sort(F.collect_list(keyed)).alias("ls"),
        F.max(F.array_max(F.transform("spans", lambda s: s["size"]))).alias("font_size"),
        F.bit_or(F.aggregate("spans", F.lit(0), lambda a, s: a.bitwiseOR(F.coalesce(s["flags"], F.lit(0))))).alias("font_flags"),
        F.bool_or("bold").alias("any_bold"),
        F.min_by(F.element_at("spans", 1), "reading_pos").alias("first"),
    )
    starts = F.contains(F.lower(F.coalesce("first.font", F.lit(""))), F.lit("bold")) | (F.coalesce("first.flags", F.lit(0)).bitwiseAND(16) != 0)
    out = out.withColumn("text", join_lines(F.transform("ls", lambda x: x["text"]), words)).where("text <> ''")
    return out.select(
        "doc_id", "page_num", "block_id", "block_pos", "grp", "bbox", "text", "font_size",
        F.when(F.col("any_bold"), F.col("font_flags").bitwiseOR(16)).otherwise(F.col("font_flags")).alias("font_flags"),
        F.element_at("ls", 1)["color"].alias("color"), starts.alias("starts_with_bold"), F.size("ls").alias("n_lines"),
    )


def hyphen_joins(blocks: DataFrame, words: Column | None = None) -> DataFrame:
    """``doc_id, page_num, block_id, next_id, joined``: neighbours on a page that share a broken word.

    ``blocks`` has block_pos, bbox, lines, font_size, text. The next block continues below in the same column or at
    the top of the next one. A chain of joins is one merged block: :func:`merge_broken_blocks`.
    """
    w = Window.partitionBy("doc_id", "page_num").orderBy("block_pos", "block_id")
    b = blocks.select("doc_id", "page_num", "block_id", "block_pos", "bbox", F.size("lines").alias("n"), "font_size", "text")
    for c in ("block_id", "bbox", "n", "font_size", "text"):
        b = b.withColumn(f"next_{c}", F.lead(c).over(w))
    b = b.withColumns({"_at": rstrip(F.col("text")), "_bt": lstrip(F.col("next_text"))})
    at, bt = F.col("_at"), F.col("_bt")
    hyphen = F.instr(F.lit(HYPHENS), F.right(at, F.lit(1))) > 0
    b = b.where((at != "") & hyphen & bt.rlike(r"^\p{Ll}")).withColumn("_base", rstrip(F.substring(at, F.lit(1), F.length(at) - 1)))
    base = F.col("_base")
    b = b.withColumns({"_lw": last_word(base), "_rw": first_word(bt)})
    lw, rw = F.when(F.col("_lw") != "", F.col("_lw")).otherwise(base), F.when(F.col("_rw") != "", F.col("_rw")).otherwise(bt)
    line = F.greatest(F.lit(1.0), (F.col("bbox.y1") - F.col("bbox.y0")) / F.greatest(F.lit(1), F.col("n")))
    gap = F.col("next_bbox.y0") - F.col("bbox.y1")
    wide = F.greatest(F.lit(1.0), F.least(F.col("bbox.x1") - F.col("bbox.x0"), F.col("next_bbox.x1") - F.col("next_bbox.x0")))
    aside = G.x_overlap(F.col("bbox"), F.col("next_bbox")) < wide * 0.3
    near = F.when(aside, F.col("next_bbox.y0") < F.col("bbox.y0") - line * 2).otherwise(gap.between(F.lit(-2.0), line * 2.5))
    joins = (
        base.rlike(r"\p{L}$") & ~P.is_caption(at) & ~P.is_caption(bt) & ~is_compound(lw, lw, rw, words) & near & (F.abs(F.col("font_size") - F.col("next_font_size")) <= 1.5)
        & (F.col("n") > 0) & (F.col("next_n") > 0)
    )
    return b.where(joins).select("doc_id", "page_num", "block_id", F.col("next_block_id").alias("next_id"), F.concat(base, bt).alias("joined"))


def merge_broken_blocks(blocks: DataFrame, words: Column | None = None) -> DataFrame:
    """``doc_id, page_num, block_id, members, text``: chains of blocks that share broken words, as one block each."""
    joins = hyphen_joins(blocks, words).select("doc_id", "page_num", F.col("next_id").alias("block_id"), F.lit(1).alias("_joined"))
    w = Window.partitionBy("doc_id", "page_num").orderBy("block_pos", "block_id")
    b = blocks.join(joins, ["doc_id", "page_num", "block_id"], "left")
    b = b.withColumn("_chain", F.sum(F.when(F.col("_joined").isNull(), 1).otherwise(0)).over(w))
    merged = b.groupBy("doc_id", "page_num", "_chain").agg(
        F.min_by("block_id", F.struct("block_pos", "block_id")).alias("block_id"), F.count(F.lit(1)).alias("members"),
        F.array_sort(F.collect_list(F.struct("block_pos", "block_id", "text"))).alias("ts"),
    )
    return merged.select("doc_id", "page_num", "block_id", "members", join_lines(F.transform("ts", lambda x: x["text"]), words).alias("text"))


def concatenate(texts: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks of all pages with ``block_pos`` from 0: a page's texts, then its tables, then its figures, each in order."""
    kinds = [part.withColumn("_kind", F.lit(k)) for k, part in enumerate((texts, tables, figures))]
    every = kinds[0].unionByName(kinds[1], True).unionByName(kinds[2], True)
    order = Window.partitionBy("doc_id", "page_num").orderBy("_kind", "block_pos", "block_id")
    return every.withColumn("block_pos", F.row_number().over(order) - 1).drop("_kind")
