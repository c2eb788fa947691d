"""Top rows, extremes, gaps and set sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordering import value_parts


def top_by_size(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """n rows of each group by absolute score, ties by `tie`; tasks keep n per group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.abs(F.col(score))), tie))).where(F.col("rank") <= n)


def extremes(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n lowest and n highest rows with their end."""
    low = df.orderBy(F.asc(score), tie).limit(n).withColumn("end", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(score), tie).limit(n).withColumn("end", F.lit("high")))


def split_at_gap(df: DataFrame, x: str) -> DataFrame:
    """df with `outlier`: the smaller side of the widest gap between sorted values (first of ties).

    Values are dealt out by quantile; gaps inside a part and between the ends of neighbouring parts are
    all the gaps there are, so no task sees the whole column.
    """
    values = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"))
    parts = values.distinct().withColumn("part", value_parts(values, "v"))
    inner = parts.withColumn("before", F.lag("v").over(W.partitionBy("part").orderBy("v"))).select("v", "before")
    ends = parts.groupBy("part").agg(F.min("v").alias("v"), F.max("v").alias("top"))
    outer = ends.select("v", F.lag("top").over(W.orderBy("part")).alias("before"))  # a row per part
    gap = inner.unionByName(outer).where("before is not null").agg(F.max_by(F.struct("before", "v"), F.struct(F.col("v") - F.col("before"), -F.col("v"))).alias("gap"))
    sides = df.join(F.broadcast(gap)).withColumn("__high", F.col(x) >= F.col("gap.v"))  # one row
    n = sides.agg(F.count_if("__high").alias("__up"), F.count_if(~F.col("__high")).alias("__down"))
    out = sides.join(F.broadcast(n))  # one row
    return out.withColumn("outlier", F.coalesce(F.when(F.col("__up") <= F.col("__down"), F.col("__high")).otherwise(~F.col("__high")), F.lit(False))).drop("gap", "__high", "__up", "__down")


def set_sizes(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes of the intersection and union of two array columns."""
    return df.withColumn("shared", F.size(F.array_intersect(a, b))).withColumn("joint", F.size(F.array_union(a, b)))
