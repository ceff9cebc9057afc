"""Each query of the library against the same statement in DuckDB."""

import os

import duckdb
import pytest

from citeweave.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    theirs = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert columns == sorted(names)
    assert ours == theirs
