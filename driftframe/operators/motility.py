"""Motility features, one row per track segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tracks import SEGMENT, steps, turns


def moments(x: str, prefix: str) -> list[Column]:
    """Population variance, coefficient of variation, skewness, excess kurtosis, non-Gaussian parameter; null if constant."""
    varies = F.min(x) < F.max(x)  # no distinct count: that would copy every row for each x
    when = lambda c, n: F.when(varies, c).alias(f"{prefix}_{n}")
    return [
        when(F.var_pop(x), "variance"),
        when(F.stddev_pop(x) / F.avg(x), "cov"),
        when(F.skewness(x), "skewness"),
        when(F.kurtosis(x), "kurtosis"),
        when(F.avg(F.pow(x, F.lit(4))) / (3 * F.pow(F.avg(F.pow(x, F.lit(2))), F.lit(2))) - 1, "ngaussalpha"),
    ]


def basic_motility(df: DataFrame, coords: list[str], time_unit: float = 0.5, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Distances, speeds, progressivity, angles and the moments of both, in one aggregation."""
    t = turns(steps(df, coords, keys, time), coords, keys, time)
    ends = [F.max_by(c, time) - F.min_by(c, time) for c in coords]
    net = F.sqrt(sum((e * e for e in ends[1:]), ends[0] * ends[0]))
    return t.groupBy(*keys).agg(
        F.sum("step").alias("total_distance"), (F.avg("step") / time_unit).alias("avg_speed"), (F.max("step") / time_unit).alias("max_speed"), (F.min("step") / time_unit).alias("min_speed"),
        net.alias("net_distance"), (net / F.nullif(F.sum("step"), F.lit(0.0))).alias("progressivity"),
        F.sum("angle").alias("total_angle"), (F.avg("angle") / time_unit).alias("avg_angle"), (F.max("angle") / time_unit).alias("max_angle"), (F.min("angle") / time_unit).alias("min_angle"),
        *moments("step", "displ"), *moments("angle", "angle"),
    )


def gini(df: DataFrame, x: str, keys: list[str] = SEGMENT) -> DataFrame:
    """Sum of absolute pair differences over n^2 times the mean, from ranks."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(x))
    s = df.where(F.col(x).isNotNull()).withColumn("__r", r).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    return s.groupBy(*keys).agg((F.sum((2 * F.col("__r") - F.col("__n") - 1) * F.col(x)) / F.nullif(F.max("__n") * F.max("__n") * F.avg(x), F.lit(0.0))).alias("gini"))


def mean_squared_displacements(df: DataFrame, coords: list[str], keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """(keys, tau, msd) over all lags, by pairs of frames inside a track (quadratic in its cut length only)."""
    a = df.select(*keys, F.col(time).alias("t0"), *[F.col(c).alias(f"a_{c}") for c in coords])
    b = df.select(*keys, F.col(time).alias("t1"), *coords)
    d = [F.col(c) - F.col(f"a_{c}") for c in coords]
    sq = sum((x * x for x in d[1:]), d[0] * d[0])
    return a.join(b, keys).where("t1 > t0").groupBy(*keys, (F.col("t1") - F.col("t0")).alias("tau")).agg(F.avg(sq).alias("msd"))


def alpha(msd: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """Slope of ln msd on ln tau; lags without displacement are left out."""
    return msd.groupBy(*keys).agg(F.regr_slope(F.when(F.col("msd") > 0, F.ln("msd")), F.ln("tau")).alias("alpha"))


def autocorrelations(df: DataFrame, x: str, lags: int = 3, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """acf_1 .. acf_lags of the track's series; null if constant."""
    p = W.partitionBy(*keys)
    s = df.where(F.col(x).isNotNull()).withColumn("__c", F.col(x) - F.avg(x).over(p))
    for k in range(1, lags + 1):
        s = s.withColumn(f"__p{k}", F.col("__c") * F.lag("__c", k).over(p.orderBy(time)))
    total = F.sum(F.col("__c") * F.col("__c"))
    return s.groupBy(*keys).agg(*[F.when(F.count_distinct(x) > 1, F.sum(f"__p{k}") / F.nullif(total, F.lit(0.0))).alias(f"acf_{k}") for k in range(1, lags + 1)])


def partial_autocorrelations(df: DataFrame, x: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """pacf_1 .. pacf_3 by Yule-Walker on autocovariances divided by n - k; null for constant series."""
    p = W.partitionBy(*keys)
    s = df.where(F.col(x).isNotNull()).withColumn("__c", F.col(x) - F.avg(x).over(p))
    for k in (1, 2, 3):
        s = s.withColumn(f"__p{k}", F.col("__c") * F.lag("__c", k).over(p.orderBy(time)))
    a = s.groupBy(*keys).agg(F.nullif(F.avg(F.col("__c") * F.col("__c")), F.lit(0.0)).alias("v"), *[F.avg(f"__p{k}").alias(f"a{k}") for k in (1, 2, 3)])
    r1, r2, r3 = (F.col(f"a{k}") / F.col("v") for k in (1, 2, 3))
    a = a.select(*keys, r1.alias("r1"), r2.alias("r2"), r3.alias("r3")).withColumn("p2", F.expr("(r2 - r1 * r1) / nullif(1 - r1 * r1, 0)"))
    a = a.withColumn("q", F.expr("r1 - p2 * r1"))
    return a.select(*keys, F.col("r1").alias("pacf_1"), F.col("p2").alias("pacf_2"), F.expr("(r3 - q * r2 - p2 * r1) / nullif(1 - q * r1 - p2 * r2, 0)").alias("pacf_3"))


def hurst(df: DataFrame, x: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Slope of ln(mean R/S) on ln(size) over blocks of floor(n / 2^i) values, i + 1 < floor(log2 n); blocks without deviation do not count.

    Blocks live inside a track, so one shuffle by the track serves every window and both groupings.
    """
    p = W.partitionBy(*keys)
    s = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("__x"), (F.row_number().over(p.orderBy(time)) - 1).alias("__r"), F.count("*").over(p).alias("__n"))
    s = s.where("__n >= 4").withColumn("__i", F.explode(F.sequence(F.lit(0), F.floor(F.log2("__n")).cast("int") - 2)))
    s = s.withColumn("__w", F.floor(F.col("__n") / F.pow(F.lit(2.0), F.col("__i")))).withColumn("__b", F.floor(F.col("__r") / F.col("__w"))).where("__b < floor(__n / __w)")
    block = [*keys, "__i", "__w", "__b"]
    s = s.withColumn("__c", F.col("__x") - F.avg("__x").over(W.partitionBy(*block)))
    s = s.withColumn("__y", F.sum("__c").over(W.partitionBy(*block).orderBy("__r").rowsBetween(W.unboundedPreceding, 0)))
    b = s.groupBy(*block).agg((F.max("__y") - F.min("__y")).alias("__range"), F.stddev_pop("__x").alias("__dev")).where("__dev > 1e-12")
    m = b.groupBy(*keys, "__i", "__w").agg(F.avg(F.col("__range") / F.col("__dev")).alias("__rs"))
    return m.where("__rs > 0").groupBy(*keys).agg(F.regr_slope(F.ln("__rs"), F.ln("__w")).alias("hurst"))


def elongations(df: DataFrame, coords: list[str], keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Extent and path length of the three axes, their ratios (the later axis over the earlier one), and phi = (z^2 / (x y))^(1/3) of both."""
    x, y, z = coords
    s = steps(df, coords, keys, time)
    a = s.groupBy(*keys).agg(*[e for c in coords for e in ((F.max(c) - F.min(c)).alias(f"{c}_max"), F.sum(F.abs(F.col(f"d_{c}"))).alias(f"{c}_total"))])
    over = lambda p, q, k: F.col(f"{p}_{k}") / F.nullif(f"{q}_{k}", F.lit(0.0))
    phi = lambda k: F.cbrt(F.col(f"{z}_{k}") * F.col(f"{z}_{k}") / F.nullif(F.col(f"{x}_{k}") * F.col(f"{y}_{k}"), F.lit(0.0)))
    return a.select(*keys, *[f"{c}_max" for c in coords], *[e for k in ("max", "total") for e in (over(y, x, k).alias(f"exy_{k}"), over(z, y, k).alias(f"eyz_{k}"), over(z, x, k).alias(f"exz_{k}"), phi(k).alias(f"phi_{k}"))])
