"""Schema of blocks and the pages, lines and spans within them."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
SPAN = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()),
    T.StructField("flags", T.IntegerType()), T.StructField("color", T.IntegerType()), T.StructField("origin", POINT), T.StructField("bbox", BBOX),
])
LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("bbox", BBOX), T.StructField("y0", T.DoubleType())])
BLOCK = T.StructType([
    T.StructField("block_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("page_num", T.IntegerType()),
    T.StructField("block_pos", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("lines", T.ArrayType(LINE)),
    T.StructField("bbox", BBOX), T.StructField("caption", T.StringType()), T.StructField("table_data", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("translation", T.StringType()), T.StructField("text_override", T.StringType()), T.StructField("font_size", T.DoubleType()),
    T.StructField("font_flags", T.IntegerType()), T.StructField("color", T.IntegerType()), T.StructField("starts_with_bold", T.BooleanType()),
    T.StructField("image", T.BinaryType()), T.StructField("image_ext", T.StringType()),
])

#: Flag bits as the three readers of them have it.
BOLD_IN_EXTRACTION, BOLD_IN_METRICS, SUPERSCRIPT, RENDER_BOLD, RENDER_ITALIC = 16, 17, 1, 1, 2
