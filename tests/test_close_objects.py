"""Close objects against brute force, without pairs of crowded places and without a copy in the driver."""

import math

import numpy as np

from driftframe.operators import joins


def test_close_objects(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(f), *map(float, p)) for i, (f, p) in enumerate(zip(rng.integers(0, 3, 400), rng.uniform(0, 6, (400, 3))))]
    rows += [(1000 + i, 0, 50.0, 50.0, 50.0 + i * 0.5) for i in range(6)] + [(1100 + i, 0, -80.0 + i * 0.499, 0.0, 0.0) for i in range(4)]
    rows += [(1200, 1, 70.0, 0.0, 0.0), (1200, 1, 70.0, 0.0, 0.0), (1300, None, 90.0, 0.0, 0.0), (1301, None, 90.0, 0.0, 0.0), (None, 0, 95.0, 0.0, 0.0), (1400, 0, 95.0, 0.0, 0.0)]
    rows += [(1500, 0, math.nan, 0.0, 0.0), (1501, 0, math.nan, 0.0, 0.0), (1502, 0, math.inf, 0.0, 0.0), (1503, 0, math.inf, 0.0, 0.0), (1504, 0, None, 0.0, 0.0), (1505, 0, 0.0, 0.0, 0.0), (1506, 0, 0.0, 0.0, 0.0)]
    known = [r for r in rows if None not in r]
    close = {a[0] for a in known for b in known if a[0] != b[0] and a[1] == b[1] and math.dist(a[2:], b[2:]) < 0.5}
    assert 50 < len(close) < 380 and {1100, 1505} <= close and not {1000, 1200, 1400, 1500} & close
    spark.createDataFrame(rows, "id long, f int, x double, y double, z double").write.parquet(f"{tmp_path}/o")
    df = spark.read.parquet(f"{tmp_path}/o")
    assert {r.id for r in joins.close_objects(df, 0.5, ["f"]).collect()} == close
    assert sorted(map(str, joins.drop_close(df, 0.5, ["f"]).select(*df.columns).collect())) == sorted(str(r) for r in df.collect() if r.id not in close)
    plan = joins.close_objects(df, 0.5, ["f"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_a_crowded_place_has_no_pairs(spark):
    """60,000 objects in one place: 3.6e9 pairs."""
    df = spark.range(60_000).selectExpr("id", "1 AS f", "0.0D AS x", "id % 7 * 1e-6D AS y", "0.0D AS z")
    assert joins.close_objects(df, 0.5, ["f"]).count() == 60_000 and joins.drop_close(df, 0.5, ["f"]).isEmpty()
