"""Sources, sinks, plug-ins and streams on small files; joins to one-row-a-key sides."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio import golden
from folio.functions import text as T
from folio.operators import figures, render, translate
from folio.plans import pipeline
from folio.sources import attach, config, known_size, lineage, pdf
from folio.streaming import blocks as stream


def test_files_are_read_by_the_plug_in(spark, tmp_path, monkeypatch):
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = pdf.files(spark, str(tmp_path))
    assert found.count() == 2
    with pytest.raises(RuntimeError):
        pdf.read_blocks(found)

    def reader(content):
        if content == b"b.pdf":
            raise ValueError
        yield {"page_num": 1, "block_pos": 0, "type": "text", "text_override": content.decode()}

    monkeypatch.setattr(pdf, "READER", reader)
    got = {Path(r.path).name: (r.type, r.text_override) for r in pdf.read_blocks(found).collect()}
    assert got == {"a.pdf": ("text", "a.pdf"), "b.pdf": ("failed", None)}
    q = pdf.file_stream(spark, str(tmp_path)).select("path").writeStream.format("memory").queryName("files").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("files").count() == 2


def test_environment_file(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("FOLIO_A=1\nFOLIO_B='two'\n# FOLIO_C=3\n")
    monkeypatch.setenv("FOLIO_A", "0")
    monkeypatch.delenv("FOLIO_B", raising=False)
    config.load_env(str(tmp_path / "env"))
    assert os.environ["FOLIO_A"] == "0" and os.environ.pop("FOLIO_B") == "two" and "FOLIO_C" not in os.environ
    config.load_env(str(tmp_path / "none"))


def test_reports_are_written(spark, tmp_path):
    rows = [(1, 1, 0, 1, "heading", "Rivers & lakes"), (1, 1, 1, 2, "paragraph", "The river rises."), (2, 1, 0, 3, "paragraph", "Another paper of it.")]
    b = golden._plain(spark, rows)
    raw = {(r.doc_id, r.page_num): r.html for r in pipeline.raw_report(b).collect()}
    assert "<h3>Rivers &amp; lakes</h3>" in raw[1, 1] and "The river rises." in raw[1, 1] and "</details>" in raw[2, 1]
    tm = spark.sql("SELECT 1L AS entry_id, 'x' AS text, 'ru' AS lang, 'y' AS translation, timestamp'2020-01-01' AS stored_at")
    new = spark.sql("SELECT 'The river rises.' AS text, 'ru' AS lang, 'Река поднимается.' AS translation, timestamp'2021-01-01' AS stored_at, 2L AS entry_id UNION ALL SELECT 'z', 'ru', NULL, timestamp'2021-01-01', 3L")
    memory = translate.put_memory(tm, new)
    assert memory.count() == 2
    done = pipeline.translated_report(b.withColumn("target_lang", F.lit("ru")), memory)
    page = {(r.doc_id, r.page_num): r.html for r in done.collect()}
    assert "Река поднимается." in page[1, 1] and "</span> Another paper of it." in page[2, 1]
    render.write_html(done, str(tmp_path / "out"))
    assert "Река" in "".join(p.read_text() for p in (tmp_path / "out" / "doc_id=1").glob("*.txt")) and render.css(True) != render.css()


def test_prompt_and_dictionary(spark):
    row = spark.range(1).select(translate.prompt(F.lit("English"), F.lit("de"), {"river": "Fluss"}).alias("a"), translate.prompt(F.lit(None).cast("string"), F.lit("xx")).alias("b")).first()
    assert row.a == "Translate from English to German.\nUse these terms:\n- river => Fluss" and row.b == "Translate from the source language to xx."
    words = translate.Dictionary({"river": "Fluss"})
    assert words.translate(["the River rises", "no word"], "de") == ["the Fluss rises", None] and words.generate("x") is None and translate.Identity().generate("x") == "x"
    with pytest.raises(ValueError):
        translate.backend("nowhere")


def test_syllable_and_render_plug_ins(spark, monkeypatch):
    df = spark.createDataFrame([("sys-", "tem"), ("snow-", "Ball"), ("x1-", "y")], "a string, b string")
    keep = lambda: [r[0] for r in df.select(T.keeps_hyphen(F.col("a"), F.col("b"), syllables=True)).collect()]
    assert keep() == [False, True, True]
    monkeypatch.setattr(T, "SYLLABLES", {"en": lambda w: [4] if w == "snowball" else [2]})
    assert keep() == [True, False, True]
    rects = spark.createDataFrame([(1, 1, (0.0, 0.0, 9.0, 9.0)), (1, 2, (0.0, 0.0, 1.0, 1.0))], "doc_id bigint, page_num int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.image for r in figures.render(rects).collect()] == [None, None]

    def draw(doc, page, box, dpi):
        if page == 2:
            raise ValueError
        return f"{doc}:{page}:{box[2]}:{dpi}".encode()

    monkeypatch.setattr(figures, "RENDERER", draw)
    assert {r.page_num: r.image and bytes(r.image) for r in figures.render(rects).collect()} == {1: b"1:1:9.0:150", 2: None}


def test_streams_count_and_run_operators(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2020-01-01 00:10:00' AS t, 'text' AS type UNION ALL SELECT timestamp'2020-01-01 00:50:00', 'text' UNION ALL SELECT timestamp'2020-01-01 01:10:00', 'table'")
    events.write.parquet(str(tmp_path / "events"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = stream.type_counts(s, "t").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.type, r.n) for r in spark.table("counts").collect()) == [("table", 1), ("text", 2)]
    golden._plain(spark, [(1, 1, 0, 1, "text", "short"), (2, 1, 0, 2, "text", "long enough")]).select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    from folio.operators.running import empty_documents

    q = stream.by_document(docs, empty_documents, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_attach_gives_the_same_rows_either_way(spark):
    rows = spark.range(300).select(F.col("id").alias("block_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"))
    side = spark.range(0, 300, 2).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("x"))
    for how in ("inner", "left"):
        small, large = (attach(rows, side, "doc_id", "block_id", how, limit) for limit in (1 << 30, 0))
        want = rows.join(side, "doc_id", how)
        key = lambda df: sorted((r.block_id, r.doc_id, r.x or -1) for r in df.collect())
        assert key(small) == key(large) == key(want)
    kept = lineage.share(side)
    assert kept.count() == 150 and known_size(kept) < 1 << 20 and kept.storageLevel.useMemory
    lineage.release()
    assert not kept.storageLevel.useMemory
    assert lineage.cut(side).count() == 150
