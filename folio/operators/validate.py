"""Checks of translations against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.predicates import looks_like_meta_response
from folio.functions.text import compare_key, normalize_number, numbers, repetition_ratio, strip, strip_wrappers

CYRILLIC_TARGETS = ("ru", "uk", "bg", "sr", "be", "mk", "kk", "uz", "ky", "mn")


def flags(source: Column, candidate: Column, lang: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Flags of a pair (V01-V04). echo, too_short, too_long, meta_response and empty reject; the others only warn."""
    src, cand = strip(F.coalesce(source, F.lit(""))), strip_wrappers(candidate)
    a, b, n, m = compare_key(src), compare_key(cand), F.length(src), F.length(cand)
    contained = F.contains(b, a) & (F.length(a) > 100) & (F.length(a) > F.length(b) * 0.8)
    values = lambda c: F.array_sort(F.transform(numbers(c), normalize_number))
    letters, cyrillic = F.regexp_count(cand, F.lit(r"\p{L}")), F.regexp_count(cand, F.lit("[а-яёА-ЯЁ]"))
    there = m > 0
    out = {
        "empty": ~there,
        "echo": there & (n >= 20) & ((a == b) | contained),
        "too_short": there & (n >= 150) & (m < F.greatest(F.lit(30), F.floor(n * 0.15))),
        "too_long": there & (n >= 100) & (m > F.floor(n * 3.2)),
        "meta_response": there & looks_like_meta_response(cand),
        "repetition": there & (repetition_ratio(cand) > 0.30),
        "numbers_changed": there & ~(values(src) == values(cand)),
        "language_mismatch": F.coalesce(there & lang.isin(*CYRILLIC_TARGETS) & (m > 30) & (letters > 0) & (cyrillic / letters < 0.12), F.lit(False)),
    }
    if tokens is not None:
        out["protected_missing"] = there & F.exists(tokens, lambda t: ~F.contains(cand, t["token"]))
    return out


def rejects(f: dict[str, Column]) -> Column:
    return f["empty"] | f["echo"] | f["too_short"] | f["too_long"] | f["meta_response"]


def validate(pairs: DataFrame, source: str = "source", candidate: str = "candidate", lang: str = "target_lang") -> DataFrame:
    """Adds the flags and ``accepted`` (V05). NULL source is '', NULL candidate is empty."""
    f = flags(F.col(source), F.col(candidate), F.col(lang))
    return pairs.withColumns(f | {"accepted": ~rejects(f)})


def rejected_log(validated: DataFrame) -> DataFrame:
    """One JSON line for each rejected pair: reasons, lengths, a preview (S16); write it with ``write.text``."""
    names = ("empty", "echo", "too_short", "too_long", "meta_response")
    reasons = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    row = F.struct(
        F.lit("rejected").alias("result"), reasons.alias("reasons"), F.length("source").alias("source_len"),
        F.length("candidate").alias("candidate_len"), F.left("source", F.lit(120)).alias("source_preview"),
    )
    return validated.where(~F.col("accepted")).select(F.to_json(row).alias("value"))
