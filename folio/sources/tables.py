"""Parquet tables of a data directory, and the derived columns every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet``, a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def span_text(lines: str = "lines") -> Column:
    """All span texts of a block in order, joined by one blank and trimmed; NULL where ``lines`` is NULL."""
    return F.expr(
        f"trim(array_join(flatten(transform({lines}, l -> transform(l.spans, s -> s.text))), ' '))"
    )


def reading_text(override: str = "text_override", lines: str = "lines") -> Column:
    """Reading text of a block: ``text_override``, or if NULL the texts of its spans."""
    return F.coalesce(F.col(override), span_text(lines))


#: Bytes that a side of a join may have, as the optimizer estimates or a cached table knows, to be sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Parts that the rows of one key are split into where a side is too large to be sent.
SALTS = 16


def known_size(df: DataFrame) -> int:
    """Bytes of a table: those of its cached rows if it was persisted and counted, else the optimizer's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach(rows: DataFrame, side: DataFrame, on: str, by: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows joined to ``side``, which has one row for each key ``on``, however many rows one key has.

    A side of at most ``limit`` bytes is broadcast, so no row moves. A larger one is repeated SALTS times and the rows
    of a key are split by a hash of ``by``, so that a key with a third of all rows is no single task.
    """
    if known_size(side) <= limit:
        return rows.join(F.broadcast(side), on, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(`{by}`), {SALTS}) AS int)")).join(salted, [on, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy work on a small input that arrives in too few splits.

    Large inputs already have more splits than cores and are returned as they are, so the
    round-robin exchange is only ever paid on a few megabytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
