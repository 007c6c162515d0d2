"""The whole pipeline over blocks: classification and document-level post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import classify, refs, render, running, tables, translate
from folio.sources.lineage import cut, share
from folio.sources.tables import reading_text


def post_process(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Classified blocks, then A01, W01, W03, W02 and W11 in that order.

    ``blocks`` has the block schema plus ``text``; ``part`` is added, 1 for the second half of a block that W03 splits. Every step is keyed by (doc_id, page_num) but the counting of
    running heads, which is an aggregation.
    """
    columns = blocks.columns
    # Shared, as the keys of running heads and the sections of pages are counted over blocks that are then changed by them.
    b = share(classify.classify(blocks, pages).withColumn("type", F.col("label")).select(*columns))
    b = running.cut_footers(running.mark_running_heads(b))
    b = share(refs.split_reference_headings(b).withColumn("text", reading_text()))
    return tables.consolidate(refs.mark_references(b))


def raw_report(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Pages as raw HTML."""
    return render.page_html(cut(post_process(blocks, pages)), translated=False)


def translated_report(blocks: DataFrame, tm: DataFrame, pages: DataFrame | None = None, backend: str = "identity") -> DataFrame:
    """Pages as translated HTML; ``blocks`` has target_lang as well."""
    b = cut(post_process(blocks, pages))  # every step of the translation reads it: its lineage would be planned for each
    done = translate.translate_blocks(b.drop("translation"), tm, backend).select("block_id", "translation")
    return render.page_html(cut(b.drop("translation").join(done, "block_id", "left")))
