"""Queries against their SQL on the smallest tables, where those are there."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else (x.item() if hasattr(x, "item") else x)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def names(core: bool = True):
    import __spark_entry__ as entry
    from folio.catalog import SQL

    return sorted(n for n in entry.oracle_sql() if (n in SQL) == core)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    import __spark_entry__ as entry

    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    spark.catalog.clearCache()


def test_every_literal_case_has_rows():
    from folio.catalog import QUERIES, SQL

    assert all(n in SQL for n in QUERIES if n.endswith("_cases")) and len(SQL) >= 70


def test_entry_and_stream(spark, tmp_path):
    import __spark_entry__ as entry
    from folio.schema import BLOCK
    from folio.streaming import blocks

    assert entry.entry(spark).count() > 0
    spark.read.parquet(f"{DATA}/blocks.parquet").select(*BLOCK.names).write.parquet(str(tmp_path / "in"))
    q = blocks.annotate(blocks.block_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == spark.read.parquet(f"{DATA}/blocks.parquet").count()


def test_settings(tmp_path):
    from folio.sources.config import load_settings, parse_env

    (tmp_path / "s.json").write_text('{"chunk_chars": 100, "other": 1}')
    assert load_settings(str(tmp_path / "s.json")).chunk_chars == 100 and load_settings(str(tmp_path / "none")).chunk_chars == 2500
    assert parse_env("A=1\n# B=2\nC='x'\n") == {"A": "1", "C": "x"}
