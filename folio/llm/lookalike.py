"""Visually identical text with different characters (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.glyphs import look, look_key
from folio.sources.lineage import share
from folio.sources.tables import BROADCAST_BYTES, known_size

#: Other sides of a pair are repeated so many times, so that a hot form is spread over as many tasks.
SALTS = 16


def look_classes(df: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """Rows whose text has a look-alike that is a different string: ``key, text, class_id, canonical``.

    Two texts are of one class if they are equal under accent-sensitive Unicode collation once look-alike
    characters are replaced. ``canonical`` is the most frequent form of the class, on a tie the smallest in
    byte order; ``class_id`` is the smallest key. NULL texts belong to no class; the empty text is a form as
    any other; exact repetitions share their form; a NULL key is kept. An empty table gives an empty one.

    A first pass groups 16 bytes a row, combined before they are shuffled, to find the few blocking keys with two
    or more forms. Those are sent to every executor if they are few enough, and a second pass keeps the texts they
    name without moving any other; beyond that size texts are shuffled by their blocking key. Collation sorts
    nothing but what is kept.
    """
    t = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    keyed = t.withColumn("lk", look_key(look(F.col("t"))))
    several = share(
        keyed.groupBy("lk").agg(F.min(F.xxhash64("t")).alias("f0"), F.max(F.xxhash64("t")).alias("f1"))
        .where("f0 <> f1").select("lk")
    )
    several.count()  # its size decides the join
    side = F.broadcast(several) if known_size(several) <= BROADCAST_BYTES else several
    few = share(keyed.join(side, "lk", "left_semi").select("k", "t", look(F.col("t")).alias("look"))).withColumn("c", F.expr("look COLLATE UNICODE"))
    forms = few.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k0"))
    classes = (
        forms.groupBy("c")
        .agg(F.count(F.lit(1)).alias("forms"), F.min("k0").alias("class_id"),
             F.min(F.struct((-F.col("n")).alias("n"), F.col("t").alias("t"))).alias("best"))
        .where("forms > 1")
        .select("c", "class_id", F.col("best.t").alias("canonical"))
    )
    return few.join(classes, "c").select(F.col("k").alias(key), F.col("t").alias(text), "class_id", "canonical")


def canonical(df: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """``key, canonical`` of every row: the canonical member of its class, or the text itself if it has no look-alike.

    NULL stays NULL. A text that is its own only form keeps its characters, since a look-alike replacement
    alone would turn text of another script into a mixture. Forms that change are sent to every executor if they
    are few enough; texts are shuffled only beyond that.
    """
    found = share(look_classes(df, key, text).where(F.col(text) != F.col("canonical")).select(F.col(text).alias("t"), "canonical").distinct())
    found.count()
    side = F.broadcast(found) if known_size(found) <= BROADCAST_BYTES else found
    return (
        df.select(F.col(key), F.col(text).alias("t")).join(side, "t", "left")
        .select(key, F.coalesce("canonical", "t").alias("canonical"))
    )


def look_members(df: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """``class_id, key, forms, copies``: every row of a class of two or more forms, the number of the class's forms and of
    the rows that share the row's form. One row for each member, however many pairs a class would have."""
    rows = look_classes(df, key, text).select("class_id", F.xxhash64(text).alias("form"), F.col(key).alias("k"))
    forms = rows.groupBy("class_id", "form").agg(F.count(F.lit(1)).alias("copies"))
    sizes = forms.groupBy("class_id").agg(F.count(F.lit(1)).alias("forms"))
    return rows.join(forms, ["class_id", "form"]).join(sizes, "class_id").select("class_id", F.col("k").alias(key), "forms", "copies")


def look_pairs(df: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """``block_a, block_b`` for each two keys, a < b, whose texts look the same and are different strings.

    Pairs of forms are made first; rows of one form never meet each other, and each join only makes rows of
    the result. The side of the forms is repeated SALTS times, so a form of very many rows is no single task.
    """
    rows = share(look_classes(df, key, text).select("class_id", F.xxhash64(text).alias("form"), F.col(key).alias("k")))
    forms = rows.select("class_id", "form").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pairs = (
        forms.withColumnRenamed("form", "f1").join(forms.withColumnRenamed("form", "f2"), "class_id")
        .where("f1 < f2").select("f1", "f2", salts.alias("salt"))
    )
    rows = rows.withColumn("salt", F.expr(f"pmod(xxhash64(k), {SALTS})"))
    left = pairs.join(rows.select(F.col("form").alias("f1"), "salt", F.col("k").alias("a")), ["f1", "salt"])
    left = left.select("f2", "a", salts.alias("salt"))
    both = left.join(rows.select(F.col("form").alias("f2"), "salt", F.col("k").alias("b")), ["f2", "salt"])
    return both.select(F.least("a", "b").alias("block_a"), F.greatest("a", "b").alias("block_b"))
