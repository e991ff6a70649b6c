"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("nation", "events", "customer", "orders", "lineitem", "documents", "pages", "labels", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([None if x != x else round(x, 5) if isinstance(x, float) else str(x) for x in (r[k] for k in order)]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    ours = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:  # SQL can't express it: its operator has a plain version in the tests
        assert len(set(ours.columns)) == len(ours.columns) and ours.count() > 0
        return
    theirs = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())
