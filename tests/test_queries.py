"""Every query against its SQL on the smallest tables; those without SQL must run and keep their schema."""

import duckdb
import numpy as np
import pytest

from traceforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def ordered(d):
    d = d[sorted(d.columns)].copy()
    return d.sort_values(list(d.columns), na_position="last", kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = ordered(got), ordered(want)
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if got[c].dtype.kind == "f":
            same |= np.isclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=1e-9)
        assert same.all(), f"{name}.{c}: {got[c][~same].iloc[0]} and {want[c][~same].iloc[0]}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_has_rows(name, spark):
    """Their values have tests of their own; here the tables are large enough that each gives rows."""
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark, sf):
    assert registry.entry(spark, sf).count() > 0


def test_every_query_names_its_operator():
    assert all(f.__doc__ for f in QUERIES.values())
