"""Containment of texts against plain loops, and what it moves."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import contain, masking, translate
from test_operators import pages


def _rows(seed):
    rng = random.Random(seed)
    long = ["".join(rng.choice("ab бв 中") for _ in range(rng.randint(21, 300))) for _ in range(40)]
    cuts = [(u := rng.choice(long))[(i := rng.randrange(len(u))) : i + rng.randint(21, 140)] for _ in range(160)]
    same = ["The same start of all of these texts, at great length, and number " + str(i) for i in range(120)]
    return [(i % 3, 1, i, i, "paragraph", t) for i, t in enumerate(long + cuts + [c[:-1] + "x" for c in cuts] + same + same)]


@pytest.mark.parametrize("cells", [False, True])
def test_contained_in_any_place(spark, monkeypatch, cells):
    if cells:  # documents are dealt to cells
        monkeypatch.setattr(contain, "CELL_BYTES", 2000)
        monkeypatch.setattr(contain, "CELL_KEYS", 50)
    rows = _rows(5)
    df = pages(spark, rows + [(None, 1, 0, 9001, "paragraph", rows[0][5][:25] + "?"), (0, 1, 0, 9002, "paragraph", None)])
    t = {r.block_id: (r.doc_id, r.normalized, r.text) for r in translate.work_list(df).collect() if r.doc_id is not None and len(r.text.strip(" ")) > 20}
    want = {i for i, (d, a, _) in t.items() if any(d == e and a != u and a in u for e, u, _ in t.values())}
    got = [r.block_id for r in translate.contained_blocks(df).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_texts_are_not_taken_apart(spark):
    plan = translate.contained_blocks(translate.work_list(pages(spark, _rows(6))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan, "a row for each word of each text is several times the input"


def test_persisted_texts_of_a_translation(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(translate, "share", lambda df: kept.append(df.persist()) or df)
    tm = spark.sql("SELECT 1L AS entry_id, 'x' AS text, 'en' AS lang, 'y' AS translation, timestamp'2020-01-01' AS stored_at")
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(6, 60))) for _ in range(200)]
    b = pages(spark, [(1, 1, i, i, "paragraph", t) for i, t in enumerate(texts)]).withColumn("target_lang", F.lit("en"))
    out = translate.translate_blocks(b, tm).collect()
    assert len(out) == 200 and {"success", "failed"} <= {r.outcome for r in out}
    held = [r for df in kept for r in df.collect()]
    size = sum(len(v) for r in held for v in r.asDict().values() if isinstance(v, str))
    assert size < 2.5 * sum(map(len, texts)), "texts are persisted several times"
    assert all(r.chunk is None and r.context_before is None for r in held if "ok" in r and r.ok)


def test_run_stats_marks_a_chunk_once(spark, monkeypatch):
    passes, kept = [], []
    strip_tags = masking.strip_tags
    monkeypatch.setattr(masking, "strip_tags", lambda c: passes.append(c) or strip_tags(c))
    monkeypatch.setattr(translate, "share", lambda df: kept.append(df) or df)
    tm = spark.sql("SELECT 1L AS entry_id, 'x' AS text, 'en' AS lang, 'y' AS translation, timestamp'2020-01-01' AS stored_at")
    translate.run_stats(translate.translate_blocks(pages(spark, _rows(7)[:40]).withColumn("target_lang", F.lit("en")), tm))
    assert len(passes) == 2, "the passes over chunks, and over pieces of those that failed, are made once each"
    assert not any("Generate explode(words" in df._jdf.queryExecution().optimizedPlan().toString() for df in kept)
