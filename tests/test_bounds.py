"""Values that lie on a bound are decided alike by query and SQL, whatever the order of the sums."""

import itertools

import duckdb
import pandas as pd
import pytest

from driftframe.plans import tables  # noqa: F401
from driftframe.plans.queries import QUERIES


def orders(values):
    return sorted(set(itertools.permutations(values)))


def compared(spark, folder, name, **frames):
    duck = duckdb.connect()
    for table, rows in frames.items():
        rows.to_parquet(f"{folder}/{table}.parquet")
        duck.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    run, sql = QUERIES[name]
    got, want = run(spark, str(folder)).toPandas(), duck.sql(sql).df()
    cols = sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)
    return got


def test_means_of_exactly_the_level(spark, tmp_path):
    rows = [(gene, c, d, 0.02) for gene, ds in enumerate(orders((0.03, 0.07, 0.04, 0.06))) for c in "AN" for d in ds]
    rows += [(99, "A", 0.01, None), (99, "N", 0.02, 0.02)]
    table = pd.DataFrame(rows, columns=["l_partkey", "l_returnflag", "l_discount", "l_tax"])
    got = compared(spark, tmp_path, "r6_distinctive", lineitem=table).set_index(["gene", "cluster"]).distinctive
    assert all(v == pytest.approx(0.026021, abs=1e-6) or gene == 99 for (gene, _), v in (-got).items())  # no mean of 0.05 is below 0.05
    assert got[99, "A"] == 0


def test_folds_of_exactly_the_bound(spark, tmp_path):
    """9 less ninths of 1, 2 and 6 is 8, not over it; summed in this order in doubles it ends above 8."""
    rows = [(g, k, float(q)) for g in range(24) for k, q in ((3, 9), (1, 1), (2, 2), (4, 6))]
    rows += [(g, 13, 40.0) for g in range(100, 140)]
    table = pd.DataFrame(rows, columns=["l_partkey", "l_suppkey", "l_quantity"])
    part = pd.DataFrame({"p_partkey": range(400)})
    got = compared(spark, tmp_path, "r8_enriched_sets", lineitem=table, part=part)
    assert got.set_name.tolist() == [13] and got.hits.tolist() == [40]
