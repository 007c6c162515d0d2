"""Duplicates hidden by formatting differences (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.lineage import share
from folio.sources.tables import BROADCAST_BYTES, known_size

#: Fixed value: modulus of the multiset hash (a Mersenne prime, so that sums stay below 2**63).
PRIME = (1 << 61) - 1
SALTS = 8


def plain(text: Column) -> Column:
    """Text without blanks, letter case, punctuation and separator signs; other signs (°, +, µ) stay."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[\s\p{Z}\p{P}\p{Cc}|=<>`~^¦]+", "")


def fields(text: str, kind: str) -> Column:
    """Normalized name-value pairs of a metadata block; the whole text of any other is one field. Empty fields vanish."""
    parts = F.when(F.col(kind) == "metadata", F.split(F.col(text), r"[;|\n\r\t]+")).otherwise(F.array(F.col(text)))
    return F.filter(F.transform(parts, plain), lambda x: x != "")


def multiset_hash(items: str, seed: int) -> Column:
    """Sum of the hashes of all items modulo a prime: the same for any order, and it counts repetitions."""
    return F.expr(f"aggregate({items}, 0L, (a, x) -> pmod(a + pmod(xxhash64({seed}, x), {PRIME}L), {PRIME}L))")


def same_multiset(a: str, b: str) -> Column:
    """Whether two arrays hold the same items as often, without sorting: by hash sets if no item is repeated."""
    return F.expr(
        f"size({a}) = size({b}) AND CASE WHEN size({a}) = size(array_distinct({a})) THEN size(array_except({a}, {b})) = 0 "
        f"ELSE forall(array_distinct({a}), x -> size(filter({a}, y -> y = x)) = size(filter({b}, y -> y = x))) END"
    )


def copy_groups(
    df: DataFrame, key: str = "block_id", text: str = "text_override", translation: str = "translation", kind: str = "type"
) -> DataFrame:
    """``first_id, key`` for each row that isn't the smallest key of its group of copies; copies have equal
    normalized fields and translation. NULL text: no row. NULL translation only equals NULL. A text of
    nothing but signs is a copy of any other such text. Rows with a NULL key are dropped, equal keys count once.

    A row is its fingerprint (two multiset hashes of the fields, one of the translation) in a first pass, which
    combines 32 bytes a row before they are shuffled. The groups of two or more are sent to every executor if they
    are few enough, and a second pass keeps the fields of their members, the only ones that move; beyond that size
    rows meet their group by a shuffle. A hot group is split into SALTS parts, each of which gets the group's first row.
    """
    t = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(translation).alias("tr"), F.col(kind).alias("kind"))
    t = t.where("t IS NOT NULL AND k IS NOT NULL").select(
        "k", fields("t", "kind").alias("f"), plain(F.col("tr")).alias("tr")
    )
    t = t.select("k", "f", "tr", multiset_hash("f", 1).alias("h1"), multiset_hash("f", 2).alias("h2"),
                 F.when(F.col("tr").isNull(), F.lit(0)).otherwise(F.xxhash64("tr")).alias("h3"))
    groups = t.groupBy("h1", "h2", "h3").agg(F.min("k").alias("first_id"), F.max("k").alias("last")).where("first_id < last")
    groups = share(groups.drop("last"))
    groups.count()  # its size decides the join
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = t.withColumn("salt", F.expr(f"cast(pmod(xxhash64(k), {SALTS}) AS int)"))
    if known_size(groups) <= BROADCAST_BYTES:
        members = salted.join(F.broadcast(groups), ["h1", "h2", "h3"])
    else:
        members = salted.join(groups.select("*", salts), ["h1", "h2", "h3", "salt"])
    members = share(members.select("first_id", "k", "f", "tr", "salt"))
    first = members.where("k = first_id").select("first_id", F.col("f").alias("f0"), F.col("tr").alias("tr0"))
    first = first.dropDuplicates(["first_id"]).select("*", salts)
    checked = (
        members.where("k <> first_id").join(first, ["first_id", "salt"])
        .withColumn("same", same_multiset("f", "f0") & F.expr("tr <=> tr0"))
    )
    # Rows whose fingerprint collides with another group's, in theory, are grouped by their fields themselves.
    odd = checked.where(~F.col("same")).select("k", F.array_sort("f").alias("f"), "tr")
    odd_first = odd.groupBy("f", "tr").agg(F.min("k").alias("first_id"))
    rest = odd.join(odd_first, (odd["f"] == odd_first["f"]) & odd["tr"].eqNullSafe(odd_first["tr"]))
    rest = rest.where(F.col("k") > F.col("first_id")).select("first_id", "k")
    return checked.where("same").select("first_id", "k").union(rest).distinct().select("first_id", F.col("k").alias(key))


def copy_counts(df: DataFrame, key: str = "block_id", **columns: str) -> DataFrame:
    """One row for each group of copies: ``first_id`` and ``copies``, the number of its rows (2 or more)."""
    found = copy_groups(df, key, **columns)
    return found.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("copies"))
