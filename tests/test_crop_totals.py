"""Totals of crops are those of their rows, which are added up before they meet the boxes."""

from pyspark.sql import functions as F

from driftframe.operators import voxels


def test_totals_are_those_of_the_rows(spark):
    rows = [(t, z, y, x, float(v)) for t in (0, 1) for z in range(8) for y in range(10) for x in range(10) for v in range((z * y + x) % 3)]
    rows += [(0, 4, 4, 4, None), (None, 4, 4, 4, 1.0)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, value double")
    centres = [("a", 0, 4, 5, 5), ("b", 0, 4, 5, 5), ("b", 0, 4, 5, 5), ("c", 0, 4, 5, 5), ("c", 0, 4, 6, 4), ("c", 1, 4, 4, 4), ("d", 1, 4, 1, 4), ("e", None, 4, 4, 4), (None, 1, 3, 4, 4)]
    centres = spark.createDataFrame(centres, "label string, t int, z int, y int, x int")
    size, shape = (2, 4, 4), (8, 10, 10)
    want = voxels.crops(df, centres, "value", size, shape, ["t"]).groupBy("t", "label", "dz", "dy", "dx").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    got = voxels.crop_totals(df, centres, "value", size, shape, ["t"]).select(*want.columns)
    assert want.count() > 80 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_of_a_voxel_are_added_up_before_the_join(spark):
    """20,000 labels around one voxel of 100,000 rows: 2e9 rows if they met."""
    df = spark.range(100_000).selectExpr("0 AS t", "4 AS z", "4 AS y", "4 AS x", "1.0D AS value")
    centres = spark.range(20_000).selectExpr("id AS label", "0 AS t", "4 AS z", "4 AS y", "4 AS x")
    got = voxels.crop_totals(df, centres, "value", (2, 4, 4), (8, 10, 10), ["t"])
    assert got.agg(F.count("*"), F.min("n"), F.min("total")).first() == (20_000, 100_000, 100_000.0)
