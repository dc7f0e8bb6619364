"""Driver contract and the DuckDB oracle on the smallest testdata."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from keelson.plans.catalog import load_all
from tools.check_oracle import TABLES, digest

from .conftest import SF

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 25
    assert "close_rate" in df.columns


def test_every_query_has_oracle():
    own = load_all()
    assert all(q.oracle for q in own.values())
    assert set(own) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


# Spark type name -> the oracle engine's type name.
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert got_types == want_types
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]
