"""Every registered query with SQL gives the SQL's rows on the smallest tables; streams; the entry works without llm."""

import math
import subprocess
import sys

import duckdb
import pytest

from meterlake.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    at = [sql.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=key)


def test_pushdown(spark):
    from meterlake.operators import listing

    bills = spark.read.parquet(f"{SF}/orders.parquet").withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "validation_status"})
    plan = listing.matching(bills, status="F").select("id")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_stream(spark, tmp_path):
    from meterlake.streaming import arrivals

    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c.pdf", b"%PDF-2"), ("d.pdf", b"x" * 50)):
        (tmp_path / "in" / name).write_bytes(body)
    stream = arrivals.once_each(arrivals.files(spark, str(tmp_path / "in"), 20)).select("file_hash")
    arrivals.into_store(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_without_llm(tmp_path):
    code = "import sys; sys.modules['meterlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
