"""Translation of blocks: what is translated, memory, sections, back ends, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import predicates as P
from folio.functions.text import normalize_text, split_by_paragraphs, split_sentences
from folio.operators import masking
from folio.operators.contain import within
from folio.operators.validate import flags, rejects
from folio.sources.lineage import share
from folio.sources.tables import BROADCAST_BYTES, known_size

LANGUAGE_NAMES = {
    "ru": "Russian", "en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "zh": "Chinese", "ja": "Japanese",
    "ko": "Korean", "pt": "Portuguese", "pl": "Polish", "tr": "Turkish", "ar": "Arabic", "hi": "Hindi", "uk": "Ukrainian", "bg": "Bulgarian",
}
SECTION_CHARS, CHUNK_CHARS, RESCUE_CHARS, CONTEXT_CHARS = 4000, 2500, 600, 600
#: Context of the outer chunks of a text of several, and of the outer pieces of a rescued text.
CHUNK_CONTEXT, PIECE_CONTEXT = 500, 300


class Translator(Protocol):
    """What a back end offers; one is made for each partition, on the executor.

    One that has ``translate_in_context(texts, lang, before, after)`` as well, as language models do, is given plain
    texts and what stands around them (X08); the others are given texts whose protected tokens are masked.
    """

    name: str

    def translate(self, texts: list[str], lang: str) -> list[str | None]: ...

    def generate(self, prompt: str) -> str | None: ...


class Identity:
    """Test back end: gives each text back in brackets."""

    name = "identity"

    def translate(self, texts: list[str], lang: str) -> list[str | None]:
        return [f"[{lang}] {t}" for t in texts]

    def generate(self, prompt: str) -> str | None:
        return prompt


class Dictionary:
    """Test back end: word for word by a glossary; None where it knows no word."""

    name = "dictionary"

    def __init__(self, terms: dict[str, str]):
        self.terms = {k.lower(): v for k, v in terms.items()}

    def translate(self, texts: list[str], lang: str) -> list[str | None]:
        out = [[self.terms.get(w.lower(), w) for w in t.split()] for t in texts]
        return [" ".join(a) if a != t.split() else None for a, t in zip(out, texts)]

    def generate(self, prompt: str) -> str | None:
        return None


#: Name -> (primary, fallback or None). Back ends that need a network or a model are registered by their plug-ins.
BACKENDS: dict[str, tuple[Callable[[], Translator], Callable[[], Translator] | None]] = {"identity": (Identity, None)}


def register(name: str, primary: Callable[[], Translator], fallback: Callable[[], Translator] | None = None) -> None:
    BACKENDS[name] = (primary, fallback)


def backend(name: str) -> tuple[Callable[[], Translator], Callable[[], Translator] | None]:
    if name not in BACKENDS:
        raise ValueError(f"unknown back end {name!r}")
    return BACKENDS[name]


def prompt(source_lang: Column, lang: Column, glossary: dict[str, str] | None = None) -> Column:
    """Instruction for a language model (X11), with the glossary's lines if there is one."""
    names = F.create_map(*[F.lit(x) for k, v in LANGUAGE_NAMES.items() for x in (k, v)])
    text = F.concat(
        F.lit("Translate from "), F.coalesce(source_lang, F.lit("the source language")), F.lit(" to "), F.coalesce(F.try_element_at(names, lang), lang), F.lit(".")
    )
    terms = "".join(f"\n- {k} => {v}" for k, v in (glossary or {}).items())
    return F.concat(text, F.lit(f"\nUse these terms:{terms}")) if terms else text


def work_list(blocks: DataFrame) -> DataFrame:
    """Blocks to translate with their normalized text."""
    return blocks.where(P.is_translatable(F.col("type"), F.col("text"))).withColumn("normalized", normalize_text(F.col("text")))


def contained_blocks(blocks: DataFrame) -> DataFrame:
    """``block_id`` of blocks whose normalized text lies within a longer one of the same document.

    Texts of more than 20 characters; equal texts don't contain each other.
    """
    t = F.col("normalized") if "normalized" in blocks.columns else normalize_text(F.col("text"))
    return within(blocks.where(F.length(F.trim("text")) > 20), "doc_id", "block_id", t)


def latest_memory(tm: DataFrame) -> DataFrame:
    """One row for each (text, lang) of a translation memory: the value stored last that isn't NULL."""
    stored = tm.where("translation IS NOT NULL AND text IS NOT NULL").groupBy("text", "lang")
    return stored.agg(F.max_by("translation", F.struct("stored_at", "entry_id")).alias("translation"))


def lookup(work: DataFrame, tm: DataFrame, text: str = "text", lang: str = "target_lang") -> DataFrame:
    """Left join with the memory (J11): adds ``cached``, a value that passes the checks again, or NULL.

    The memory is pre-aggregated on its key, so a text met very often joins one row.
    """
    m = latest_memory(tm).select(F.col("text").alias("_t"), F.col("lang").alias("_l"), F.col("translation").alias("_tr"))
    j = work.join(m, (F.col(text) == F.col("_t")) & (F.col(lang) == F.col("_l")), "left")
    ok = ~rejects(flags(F.col(text), F.col("_tr"), F.col(lang)))
    return j.withColumn("cached", F.when(F.col("_tr").isNotNull() & ok, F.col("_tr"))).drop("_t", "_l", "_tr")


def put_memory(tm: DataFrame, new: DataFrame) -> DataFrame:
    """Memory with new rows (text, lang, translation, stored_at, entry_id) appended; NULL values never are."""
    return tm.unionByName(new.where("translation IS NOT NULL").select(*tm.columns))


def sections(work: DataFrame, limit: int = SECTION_CHARS) -> DataFrame:
    """``doc_id, block_id, section``: blocks packed in order into sections of at most ``limit`` characters.

    Greedy packing depends on all that came before, so a document is one fold, but only over (order, length).
    """
    order = F.struct("page_num", "block_pos", "block_id", F.length("normalized").alias("n"))
    docs = work.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("bs"))
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("section"), F.lit(-1).alias("size"))

    def step(acc: Column, b: Column) -> Column:
        full = (acc["size"] >= 0) & (acc["size"] + b["n"] > limit)
        section = F.when(full, acc["section"] + 1).otherwise(acc["section"])
        return F.struct(
            F.concat(acc["out"], F.array(section)).alias("out"), section.alias("section"),
            F.when(full | (acc["size"] < 0), b["n"]).otherwise(acc["size"] + b["n"]).alias("size"),
        )

    packed = docs.select("doc_id", "bs", F.aggregate("bs", state, step)["out"].alias("out"))
    return packed.select("doc_id", F.explode(F.arrays_zip("bs", "out")).alias("z")).select("doc_id", F.col("z.bs.block_id").alias("block_id"), F.col("z.out").alias("section"))


def with_context(work: DataFrame, sectioned: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """Adds the end of the block before and the beginning of the block after within the section."""
    w = Window.partitionBy("doc_id", "section").orderBy("page_num", "block_pos", "block_id")
    j = work.join(sectioned, ["doc_id", "block_id"])
    before, after = F.lag("normalized").over(w), F.lead("normalized").over(w)
    return j.withColumn("context_before", F.right(F.coalesce(before, F.lit("")), F.lit(chars))).withColumn("context_after", F.left(F.coalesce(after, F.lit("")), F.lit(chars)))


def chunks(work: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """One row for each chunk of a normalized text: by paragraphs where there are any, else by sentences.

    ``last_no`` is the number of the text's last chunk.
    """
    paras = split_by_paragraphs(F.col("normalized"), limit)
    pieces = F.when(F.size(paras) > 0, paras).otherwise(split_sentences(F.col("normalized"), limit))
    cut = work.withColumn("_pieces", pieces).withColumn("last_no", F.size("_pieces") - 1)
    return cut.select("*", F.posexplode("_pieces").alias("chunk_no", "chunk")).drop("_pieces")


def translate_chunks(rows: DataFrame, name: str, fallback: bool = False, attempts: int = 2) -> DataFrame:
    """Adds ``answer`` to rows with ``chunk`` and ``target_lang`` (X02-X05): a back end for each partition.

    It reads ``masked`` instead of the chunk if that column is there, or ``context_before`` and ``context_after``.
    Texts of fewer than 3 characters pass through. A call that fails is tried again; after that the answer is NULL.
    Spark may run a task twice, so a back end with side effects should answer from a memory.
    """
    make = backend(name)[1 if fallback else 0]
    if make is None:
        return rows.withColumn("answer", F.lit(None).cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for pdf in batches:
            out: list[str | None] = [None] * len(pdf)
            for lang, index in pdf.reset_index(drop=True).groupby("target_lang", dropna=False).groups.items():
                around = [[pdf[c].iloc[i] for i in index] for c in ("context_before", "context_after") if c in pdf]
                if fallback:
                    around = [[""] * len(index) for _ in around]
                in_context = len(around) == 2 and hasattr(engine, "translate_in_context")
                texts = [pdf["masked" if "masked" in pdf and not in_context else "chunk"].iloc[i] for i in index]
                for _ in range(attempts):
                    try:
                        for i, a in zip(index, engine.translate_in_context(texts, lang, *around) if in_context else engine.translate(texts, lang)):
                            out[i] = a
                        break
                    except OSError:
                        continue
            short = pdf["chunk"].str.len() < 3
            yield pdf.assign(answer=[c if s else a for c, s, a in zip(pdf["chunk"], short, out)])

    return rows.mapInPandas(run, schema)


def _answers(rows: DataFrame, name: str, keep: int | None = None) -> DataFrame:
    """Adds ``answer`` and ``ok``: of the primary back end, and of the fallback, without context, where that is rejected.

    Protected tokens are masked on the way and put back before the checks. Results are persisted: no text is asked twice.
    What is persisted holds a good answer or what may still be asked, never both: the chunk and its context are kept where
    all answers were rejected and it has more than ``keep`` characters, if that is given.
    """

    def ask(rows: DataFrame, fallback: bool, keep: int | None) -> DataFrame:
        rows = rows.withColumn("_marked", masking.marked(F.col("chunk")))
        done = translate_chunks(rows.withColumn("masked", masking.numbered(F.col("_marked"))["masked"]), name, fallback).drop("masked")
        back = masking.restore(F.col("answer"), masking.numbered(F.col("_marked"))["tokens"])
        done = done.withColumn("answer", F.when(P.is_short_citation(F.col("chunk")), F.col("chunk")).when(F.col("answer").isNotNull(), back))
        ok = F.col("answer").isNotNull() & (P.is_short_citation(F.col("chunk")) | ~rejects(flags(F.col("chunk"), F.col("answer"), F.col("target_lang"))))
        done = done.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_marked")
        again = F.lit(False) if keep is None else ~F.col("ok") & (F.length("chunk") > keep)
        kept = {c: F.when(again, F.col(c)) for c in ("chunk", "context_before", "context_after")}
        return share(done.withColumns(kept | {"answer": F.when(F.col("ok"), F.col("answer"))}))

    if backend(name)[1] is None:
        return ask(rows, False, keep)
    first = ask(rows, False, -1)
    return first.where("ok").unionByName(ask(first.where("NOT ok").select(*rows.columns), True, keep))


def _rescued(failed: DataFrame, name: str, chars: int) -> DataFrame:
    """``block_id, chunk_no, rescued``: failed chunks that pass in pieces of ``chars``, all of them or none."""
    parts = split_sentences(F.col("chunk"), chars, max(80, min(650, chars // 3)))
    long = failed.where(F.length("chunk") > chars).withColumn("parts", parts).where("size(parts) > 1")
    # Contexts of a chunk of several are not handed on.
    whole = long.withColumns({c: F.when(F.col("last_no") == 0, F.col(c)).otherwise("") for c in ("context_before", "context_after")})
    pieces = whole.select(
        "block_id", "target_lang", "chunk_no", F.size("parts").alias("n"), F.posexplode("parts").alias("piece_no", "chunk"), "context_before", "context_after"
    )
    pieces = pieces.withColumns({
        "context_before": F.when(F.col("piece_no") == 0, F.right("context_before", F.lit(PIECE_CONTEXT))).otherwise(""),
        "context_after": F.when(F.col("piece_no") == F.col("n") - 1, F.left("context_after", F.lit(PIECE_CONTEXT))).otherwise(""),
    })
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.trim("answer").alias("a")))), lambda x: x["a"]), " ")
    return _answers(pieces, name).groupBy("block_id", "chunk_no").agg(F.bool_and("ok").alias("ok"), joined.alias("rescued")).where("ok").drop("ok")


def translate_blocks(blocks: DataFrame, tm: DataFrame, name: str = "identity", rescue_chars: int = RESCUE_CHARS) -> DataFrame:
    """``block_id, translation, outcome`` of every block (X09): skipped, contained, citation, cached, success or failed.

    ``blocks`` has doc_id, block_id, page_num, block_pos, type, text, target_lang. Cheap outcomes are taken out
    before the back end sees a row; a chunk that neither back end answers well is tried in pieces (X06, X07); a block
    succeeds if all its chunks are answered and pass the checks.
    """
    work = work_list(blocks)
    inside = share(contained_blocks(work).withColumn("_inside", F.lit(True)))
    inside.count()
    w = work.join(F.broadcast(inside) if known_size(inside) <= BROADCAST_BYTES else inside, "block_id", "left")
    # One text a row: the block's own where that is the outcome, else the normalized one.
    w = w.withColumn("outcome", F.when(F.col("_inside"), "contained").when(P.is_short_citation(F.col("text")), "citation"))
    one = F.when(F.col("outcome").isNotNull(), F.col("text")).otherwise(F.col("normalized"))
    w = lookup(w.select("doc_id", "block_id", "page_num", "block_pos", "target_lang", "outcome", one.alias("normalized")), tm, "normalized")
    w = w.withColumn("outcome", F.coalesce("outcome", F.when(F.col("cached").isNotNull(), "cached")))
    w = share(w.withColumn("cached", F.when(F.col("outcome") == "cached", F.col("cached"))))
    packed = w.where("outcome IS NULL OR outcome = 'cached'").drop("cached")
    asked = with_context(packed, sections(packed)).where("outcome IS NULL")
    todo = chunks(asked.select("block_id", "target_lang", "normalized", "context_before", "context_after"))
    todo = todo.withColumns({
        "context_before": F.when(F.col("last_no") == 0, F.col("context_before")).when(F.col("chunk_no") == 0, F.right("context_before", F.lit(CHUNK_CONTEXT))).otherwise(""),
        "context_after": F.when(F.col("last_no") == 0, F.col("context_after")).when(F.col("chunk_no") == F.col("last_no"), F.left("context_after", F.lit(CHUNK_CONTEXT))).otherwise(""),
    })
    done = _answers(todo.select("block_id", "target_lang", "chunk_no", "last_no", "chunk", "context_before", "context_after"), name, rescue_chars)
    pieces = _rescued(done.where("NOT ok"), name, rescue_chars)
    # A text of one chunk that is answered is complete; only the others are put together.
    single = (F.col("last_no") == 0) & F.col("ok")
    parts = done.where(~single).select("block_id", "chunk_no", "ok", "answer").join(pieces, ["block_id", "chunk_no"], "left")
    parts = parts.withColumn("ok", F.col("ok") | F.col("rescued").isNotNull()).withColumn("answer", F.coalesce("rescued", "answer"))
    whole = parts.groupBy("block_id").agg(
        F.bool_and("ok").alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "answer"))), lambda x: x["answer"]), "\n\n").alias("answer")
    )
    first = w.where("outcome IS NOT NULL").select("block_id", F.when(F.col("outcome") == "cached", F.col("cached")).otherwise(F.col("normalized")).alias("translation"), "outcome")
    whole = done.where(single).select("block_id", "ok", "answer").unionByName(whole)
    second = whole.select("block_id", F.when(F.col("ok"), F.col("answer")).alias("translation"), F.when(F.col("ok"), "success").otherwise("failed").alias("outcome"))
    rest = blocks.where(~P.is_translatable(F.col("type"), F.col("text"))).select("block_id", F.lit(None).cast("string").alias("translation"), F.lit("skipped").alias("outcome"))
    return first.unionByName(second).unionByName(rest)


def run_stats(outcomes: DataFrame) -> DataFrame:
    """``outcome, blocks``."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("blocks"))
