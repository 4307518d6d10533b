"""Every graph query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from quillgraph.plans.catalogue import ORACLE, QUERIES
from quillgraph.plans.fixture import SOURCES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in SOURCES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.7g}" if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = db.sql(ORACLE[name])
    at = [found.columns.index(c) for c in columns]
    got = sorted(str([plain(x) for x in r]) for r in df.select(*columns).collect())
    assert got == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
