"""Summaries by a reduction tree over chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import split_sentences, strip, words_of

TYPES = ("paragraph", "heading", "metadata", "text", "list")
CHUNK_CHARS, FAN_IN = 6000, 5


def summary_chunks(blocks: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, chunk_no, chunk``: texts of the five types longer than 10 characters, in order, in chunks.

    Chunks are cut within runs of pages that together have at most ``limit`` characters more or less, so that no
    document is held as one string: a page's text is chunked with its own sentences.
    """
    kept = blocks.where(F.col("type").isin(*TYPES) & (F.length("text") > 10))
    pages = kept.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_pos", "block_id", "text"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: x["text"]), "\n")
    rows = pages.select("doc_id", "page_num", F.posexplode(split_sentences(text, limit, 0)).alias("i", "chunk"))
    order = Window.partitionBy("doc_id").orderBy("page_num", "i")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_no"), "chunk")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """``doc_id, chunks, tokens``: a token is four characters."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.floor(F.length("chunk") / 4)).alias("tokens"))


def sentence_scores(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_num, block_id, sent_no, sentence, score``: mean document frequency weight of a sentence's words.

    The extractive default (our own): deterministic, no model. A word's weight in a document is the share of the
    document's blocks that have it; scores are means over a sentence's distinct words of four letters or more.
    """
    kept = blocks.where((F.col("type") == "paragraph") & F.col("text").isNotNull()).select("doc_id", "page_num", "block_id", "text")
    marked = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x02"), "\x02")
    s = kept.select("doc_id", "page_num", "block_id", F.posexplode(marked).alias("sent_no", "sentence"))
    s = s.withColumn("sentence", strip(F.col("sentence"))).where("length(sentence) >= 20")
    w = s.withColumn("w", F.explode(F.filter(F.array_distinct(words_of(F.col("sentence"))), lambda x: F.length(x) >= 4)))
    share = w.groupBy("doc_id", "w").agg(F.countDistinct("block_id").alias("df"))
    total = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    weighed = w.join(share, ["doc_id", "w"]).join(total, "doc_id")
    return weighed.groupBy("doc_id", "page_num", "block_id", "sent_no", "sentence").agg(F.avg(F.col("df") / F.col("n")).alias("score"))


def extractive_summary(blocks: DataFrame, top: int = 3) -> DataFrame:
    """``doc_id, rank, sentence``: the ``top`` sentences of each document by score, each text once; a top-k report."""
    best = sentence_scores(blocks).groupBy("doc_id", "sentence").agg(F.max(F.round("score", 9)).alias("score"))
    # The best of each of 64 parts first, so that a large document isn't ranked by one task.
    part = Window.partitionBy("doc_id", "part").orderBy(F.desc("score"), "sentence")
    few = best.withColumn("part", F.pmod(F.xxhash64("sentence"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(f"r <= {top}")
    whole = Window.partitionBy("doc_id").orderBy(F.desc("score"), "sentence")
    return few.withColumn("rank", F.row_number().over(whole)).where(f"rank <= {top}").select("doc_id", "rank", "sentence")


def reduce_tree(chunk_summaries: DataFrame, combine, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, summary``: summaries (doc_id, chunk_no, summary) combined by groups of ``fan_in`` where there are more.

    ``combine`` is a Column function of an array of summaries; a language model's is its plug-in's Arrow UDF.
    """
    n = Window.partitionBy("doc_id")
    s = chunk_summaries.withColumn("total", F.count(F.lit(1)).over(n))
    s = s.withColumn("g", F.when(F.col("total") > fan_in, F.floor(F.col("chunk_no") / fan_in)).otherwise(F.col("chunk_no")))
    ordered = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v])
    groups = s.groupBy("doc_id", "g").agg(combine(ordered("chunk_no", "summary")).alias("part"))
    return groups.groupBy("doc_id").agg(combine(ordered("g", "part")).alias("summary"))
