"""Blocks as a stream: stateless operators row by row, document-level ones batch by batch (our own addition)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import predicates as P
from folio.functions import text as T
from folio.schema import BLOCK
from folio.sources.tables import reading_text


def block_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of blocks, each new file once, with the reading text."""
    return spark.readStream.schema(BLOCK).parquet(folder).withColumn("text", reading_text())


def annotate(stream: DataFrame) -> DataFrame:
    """Scalar functions and predicates of every block; needs no state, so it is the same for a batch."""
    t = F.col("text")
    return stream.select(
        "block_id", "doc_id", "page_num", "type", T.normalize_text(t).alias("normalized"), F.round(T.text_quality(t), 6).alias("quality"),
        P.is_caption(t).alias("caption"), P.is_footer(t).alias("footer"), P.is_likely_table(t).alias("table_like"),
    )


def type_counts(events: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by type and event-time window; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "type").agg(F.count(F.lit(1)).alias("n"))


def by_document(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs a document-level operator over every batch, which must hold whole documents, and appends its rows."""

    def write(batch: DataFrame, _: int) -> None:
        operator(batch).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
