"""Every registered query of the core against its SQL in DuckDB, over the whole small tables."""

import math
import os

import pytest

from messagelake.plans import registry

DATA = os.environ.get("MESSAGELAKE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    relation = duck.sql(registry.ORACLES[name])
    assert columns == sorted(relation.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall()
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    rows = [tuple(plain(v) for v in r) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(rows, key=key) == sorted((tuple(plain(v) for v in r) for r in want), key=key)


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, DATA).count() > 0
