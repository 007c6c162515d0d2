"""Documents from folders: file scan in batch and as a stream, and the reader plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folio.schema import BLOCK

#: Set by a plug-in: bytes of a file -> rows of BLOCK (without block_id and doc_id). No such library is part of this package.
READER: Callable[[bytes], Iterator[dict]] | None = None

FILES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of one level of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """The same as a stream: each new file once."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)


def read_blocks(found: DataFrame) -> DataFrame:
    """Blocks of files by the plug-in's reader (S01); a file that can't be read gives a row of type ``failed`` with its path."""
    reader = READER
    if reader is None:
        raise RuntimeError("no reader is registered: set folio.sources.pdf.READER")
    schema = T.StructType([T.StructField("path", T.StringType()), *[f for f in BLOCK.fields if f.name not in ("block_id", "doc_id")]])
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [{"path": path} | row for row in reader(content)]
                except Exception:  # noqa: BLE001 - one broken file must not end the scan
                    rows.append({"path": path, "type": "failed"})
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return found.select("path", "content").mapInPandas(run, schema)
