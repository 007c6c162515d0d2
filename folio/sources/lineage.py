"""Results that many later steps share: kept for a while, or written so that their lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

_KEPT: list[DataFrame] = []


def share(df: DataFrame) -> DataFrame:
    """The same rows, persisted (they spill to disk, and lost ones are computed again) until :func:`release`."""
    _KEPT.append(df.persist())
    return df


def release() -> None:
    """Gives up all that operators have persisted; to be called once their results are written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder that spark.checkpoint.dir names.

    Without that setting a cluster raises an error, since a folder of one machine would be lost with it; a local
    master, as in tests, gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return df.checkpoint(eager=True)
