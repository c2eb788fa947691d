"""Scaling, components, clusters and transport over feature tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardise(df: DataFrame, columns: list[str], population: bool = True, clip: float | None = None) -> DataFrame:
    """Columns minus mean over deviation, 0 where that is 0, clipped to +-clip: one aggregation, one row broadcast."""
    dev = F.stddev_pop if population else F.stddev_samp
    m = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"__m_{c}"), dev(c).alias(f"__s_{c}"))])
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).when(F.col(c).isNotNull(), 0.0)
    bound = lambda e: e if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), e))
    return df.join(F.broadcast(m)).withColumns({c: bound(z(c)) for c in columns}).drop(*m.columns)  # one row


def components(df: DataFrame, columns: list[str], share: float | None = 0.95, k: int | None = None) -> DataFrame:
    """df with `pcs`: the first k components, or the fewest that hold over `share` of the variance; signs by the largest loading."""
    ready = standardise(df, columns).na.drop(subset=columns)
    v = VectorAssembler(inputCols=columns, outputCol="__v").transform(ready)
    model = PCA(k=k or len(columns), inputCol="__v", outputCol="__p").fit(v)
    held = model.explainedVariance.toArray().cumsum()
    k = k or min(len(columns), int((held <= share).sum()) + 1)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    p = vector_to_array("__p")
    return model.transform(v).withColumn("pcs", F.array(*[p[j] * sign[j] for j in range(k)])).drop("__v", "__p")


def clusters(df: DataFrame, vector: str, k: int = 9, starts: int = 10, seed: int = 0) -> DataFrame:
    """df with `cluster`: k-means, the best of several starts by cost. vector: an array column."""
    v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))).persist()
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))).drop("__v")
    v.unpersist()
    return out


def transport(cost: DataFrame, epsilon: float, iterations: int) -> DataFrame:
    """(i, j, mass) between uniform weights by scaling exp(-cost / epsilon) in turn by row and column.

    Every iteration sums by i and by j; only the two scaling columns go from one to the next, and where a
    checkpoint folder is set they are cut from their lineage every fifth time.
    """
    k = cost.select("i", "j", F.exp(-F.col("cost") / epsilon).alias("k"))
    n = k.agg(F.count_distinct("i").alias("n"), F.count_distinct("j").alias("m"))
    k = k.join(F.broadcast(n))  # one row
    v = k.select("j").distinct().withColumn("v", F.lit(1.0))
    u = None
    for step in range(iterations):
        u = k.join(v, "j").groupBy("i").agg((1 / (F.first("n") * F.sum(F.col("k") * F.col("v")))).alias("u"))
        v = k.join(u, "i").groupBy("j").agg((1 / (F.first("m") * F.sum(F.col("k") * F.col("u")))).alias("v"))
        if step % 5 == 4 and cost.sparkSession.conf.get("spark.checkpoint.dir", None):
            u, v = u.checkpoint(), v.checkpoint()
    return k.join(u, "i").join(v, "j").select("i", "j", (F.col("k") * F.col("u") * F.col("v")).alias("mass"))


def barycentric(mass: DataFrame, sources: DataFrame) -> DataFrame:
    """Mean source position (i, dim, value) of each target j and dimension, weighted by mass; targets without mass are 0."""
    m = mass.join(sources, "i").groupBy("j", "dim").agg(F.sum(F.col("mass") * F.col("value")).alias("s"), F.sum("mass").alias("w"))
    return m.select("j", "dim", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("value"))
