"""Every corpus query with SQL gives, on the smallest tables, the rows that DuckDB gives."""

import os

import duckdb
import pytest

from quarry.llm import queries

DIR = os.environ.get("QUARRY_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = queries.queries()[name](spark, DIR)
    cols = sorted(found.columns)
    said = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in found.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in said.fetchall()), key=repr)
