"""Every registered query with a DuckDB twin gives the twin's rows; the others run."""

import os

import pytest

from turnloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = registry.load()


@pytest.fixture(scope="module")
def con(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    q = QUERIES[name]
    df = q.run(spark, sf)
    rows = df.collect()
    if q.sql is None:
        return
    want = con.sql(q.sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([cell(r[c]) for c in columns] for r in rows) == sorted([cell(r[i]) for i in at] for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_survey_ids_are_known():
    import re

    covered = {x for q in QUERIES.values() for x in q.ops.split()}
    assert all(re.fullmatch(r"(SRC|SNK|PRJ|JN|AG|PV|WN|ST|SMP|SC|UD|STR|OR)\d+", x) for x in covered)
