"""Every registered query runs, and agrees with its DuckDB statement, on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    return sorted(tuple(plain(x) for _, x in sorted(zip(columns, r, strict=True))) for r in rows)


def against_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    said = con.execute(SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, said.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_queries_agree_with_sql(spark, con, name):
    against_sql(spark, con, name)


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0 and set(SQL) <= set(QUERIES)


def test_language_model_counts_every_document(spark, tmp_path):
    """More documents than a bounded sample would hold; the last ones alone know a language."""
    docs = spark.range(22_000).selectExpr("id AS doc_id", "concat('w', id % 97, ' ', id % 13) AS text", "CASE WHEN id % 11 = 0 THEN 'en' WHEN id % 5 = 0 THEN 'fr' WHEN id >= 21999 THEN 'de' ELSE 'es' END AS lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["doc_language_model"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    said = c.execute(SQL["doc_language_model"])
    columns = [d[0] for d in said.description]
    assert rows_of(found.columns, found.collect()) == rows_of(columns, said.fetchall())
