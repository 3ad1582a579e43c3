"""Every query with SQL gives, on the smallest tables, the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from quarry import catalog

DIR = os.environ.get("QUARRY_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, DIR)
    cols = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in found.collect()), key=repr)
    said = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in said.fetchall()), key=repr)


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, DIR).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
