"""Every registered query with SQL against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from driftframe.plans import features, preparation, small, spaces, tables, wide_features  # noqa: F401
from driftframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events conversations embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    got, want = run(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) > 0
    assert [t.kind for t in got.dtypes] == [t.kind for t in want.dtypes], (got.dtypes, want.dtypes)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)
