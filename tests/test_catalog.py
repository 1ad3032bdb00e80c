"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(spark_rows, sql_rows, columns, names):
    a = sorted(tuple(cell(r[c]) for c in columns) for r in spark_rows)
    b = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in sql_rows)
    assert a == b


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rel = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    same(df.collect(), rel.fetchall(), sorted(df.columns), list(rel.columns))
    spark.catalog.clearCache()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_listwise(spark):
    rows = catalog.listwise_rerank(spark, DATA).collect()
    assert len({(r["qid"], r["docid"]) for r in rows}) == len(rows) > 0


def test_whole_runs(spark):
    """Runs of depth 1000 find what a run of 50 cannot reach; the SQL of the short queries stays as it is."""
    deep = {r["qid"]: r for r in catalog.QUERIES["metrics_per_query_1000"](spark, DATA).collect()}
    short = {r["qid"]: r for r in catalog.QUERIES["metrics_per_query"](spark, DATA).collect()}
    assert all(r["recall_1000"] >= r["recall_50"] == short[q]["recall_50"] for q, r in deep.items())
    assert any(r["recall_1000"] > r["recall_50"] for r in deep.values())
    for name in catalog.WHOLE.split():
        assert f"WHERE rank <= {catalog.DEPTH})" not in catalog.SQL[f"{name}_1000"] and f"WHERE rank <= {catalog.DEPTH})" in catalog.SQL[name]
    spark.catalog.clearCache()
