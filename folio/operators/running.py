"""Running heads, footers and empty documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import predicates as P
from folio.functions.text import dedup_key, running_head_key


def _keys_of(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, key``: the keys of each block that may be a running head."""
    eligible = blocks.where(P.is_eligible_for_running_head(F.col("type"), F.col("table_data"), F.col("text")))
    norm, canon = dedup_key(F.col("text")), running_head_key(F.col("text"))
    keys = F.when(norm.rlike(r"^\d{1,4}$"), F.array(F.lit("__pagenum__"))).otherwise(
        F.array_compact(F.array(
            F.when(F.length(norm).between(5, 250), norm),
            F.when(F.length(norm).between(5, 250) & F.length(canon).between(10, 250) & (canon != norm), canon),
        ))
    )
    return eligible.where("text IS NOT NULL").select("doc_id", "page_num", F.explode(keys).alias("key"))


def repeating_keys(blocks: DataFrame, min_pages: int | None = None) -> DataFrame:
    """``doc_id, key, pages``: normalized or canonical texts, or ``__pagenum__``, on enough pages of a document.

    ``blocks`` has doc_id, page_num, type, table_data, text. Enough is max(3, half the pages) unless given;
    documents of fewer than 3 pages have none. Keys of a block are exploded and counted in one aggregation;
    no group is collected.
    """
    counted = _keys_of(blocks).groupBy("doc_id", "key").agg(F.countDistinct("page_num").alias("pages"))
    totals = blocks.groupBy("doc_id").agg(F.countDistinct("page_num").alias("total"))
    enough = F.greatest(F.lit(3), F.floor(F.col("total") / 2)) if min_pages is None else F.lit(min_pages)
    return counted.join(totals, "doc_id").where((F.col("total") >= 3) & (F.col("pages") >= enough)).select("doc_id", "key", "pages")


def mark_running_heads(blocks: DataFrame, min_pages: int | None = None) -> DataFrame:
    """Blocks whose normalized or canonical text repeats get type metadata (A01). Keeps all columns.

    What goes back to the blocks is one row a page, the keys of that page that repeat, so that blocks are only ever
    shuffled by page.
    """
    keys = repeating_keys(blocks, min_pages).select("doc_id", "key")
    found = _keys_of(blocks).join(keys, ["doc_id", "key"], "left_semi").groupBy("doc_id", "page_num").agg(F.collect_set("key").alias("_keys"))
    norm = dedup_key(F.col("text"))
    eligible = P.is_eligible_for_running_head(F.col("type"), F.col("table_data"), F.col("text"))
    number = norm.rlike(r"^\d{1,4}$")
    repeats = F.array_contains("_keys", F.when(number, "__pagenum__").otherwise(norm)) | (~number & F.array_contains("_keys", running_head_key(F.col("text"))))
    marked = blocks.join(found, ["doc_id", "page_num"], "left")
    return marked.withColumn("type", F.when(F.coalesce(eligible & repeats, F.lit(False)), "metadata").otherwise(F.col("type"))).select(*blocks.columns)


def cut_footers(blocks: DataFrame) -> DataFrame:
    """Blocks without each page's footer and what follows it.

    A footer begins at the first page or author line, or one block before a journal line that has such a line
    among the two blocks before it; failing that, a page's last block goes if it is a journal line. ``blocks``
    has doc_id, page_num, block_pos, text; a window holds one page.
    """
    page = Window.partitionBy("doc_id", "page_num").orderBy("block_pos")
    whole = Window.partitionBy("doc_id", "page_num")
    foot = F.coalesce(P.is_footer(F.col("text")), F.lit(False))
    journal = F.coalesce(P.is_journal_line(F.col("text")), F.lit(False))
    b = blocks.withColumn("_i", F.row_number().over(page)).withColumn("_foot", foot).withColumn("_journal", journal)
    near = F.coalesce(F.lag("_foot", 1).over(page), F.lit(False)) | F.coalesce(F.lag("_foot", 2).over(page), F.lit(False))
    b = b.withColumn("_at", F.when(F.col("_foot"), F.col("_i")).when(F.col("_journal") & near, F.col("_i") - 1))
    b = b.withColumn("_cut", F.min("_at").over(whole)).withColumn("_n", F.max("_i").over(whole))
    last = F.col("_cut").isNull() & F.col("_journal") & (F.col("_i") == F.col("_n"))
    return b.where((F.col("_cut").isNull() | (F.col("_i") < F.col("_cut"))) & ~last).select(*blocks.columns)


def empty_documents(blocks: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id`` of documents with fewer than ``least`` characters of text."""
    total = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    return blocks.groupBy("doc_id").agg(total.alias("n")).where(F.col("n") < least).select("doc_id")
