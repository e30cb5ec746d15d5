"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
OWN = {n: q for n, q in entry.queries().items() if q.__module__.startswith("boardmill.plans")}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(values):
    return sorted([tuple("nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v for v in r) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sql, name):
    df = OWN[name](spark, FOLDER)
    got = df.collect()
    text = entry.oracle_sql().get(name)
    if text is None:
        assert got
        return
    want = sql.sql(text)
    assert df.columns == want.columns
    assert [KINDS[t] for _, t in df.dtypes] == [str(t) for t in want.types]
    assert rows(got) == rows(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
