"""State maps and binned curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import nice_step
from .ordering import group_quantiles, same_keys


def grid_index(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """ix, iy: nearest node of a bins x bins grid from floor(min) - 1 to ceil(max) + 1, the lower one on ties."""
    lim = df.agg(*[e for c in (x, y) for e in ((F.floor(F.min(c)) - 1).alias(f"__lo_{c}"), (F.ceil(F.max(c)) + 1).alias(f"__hi_{c}"))])
    at = lambda c: F.ceil((F.col(c) - F.col(f"__lo_{c}")) / ((F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) / (bins - 1)) - 0.5).cast("int")
    return df.join(F.broadcast(lim)).withColumn("ix", at(x)).withColumn("iy", at(y)).drop(*lim.columns)  # one row


def occupancy(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    return grid_index(df, x, y, bins).groupBy("ix", "iy").agg(F.count("*").alias("n"))


def transition_field(df: DataFrame, x: str, y: str, bins: int, keys: list[str], time: str) -> DataFrame:
    """Per node: mean length and mean vector of the steps that start there."""
    w = W.partitionBy(*keys).orderBy(time)
    s = grid_index(df, x, y, bins).withColumn("dx", F.lead(x).over(w) - F.col(x)).withColumn("dy", F.lead(y).over(w) - F.col(y)).where("dx is not null")
    return s.groupBy("ix", "iy").agg(F.avg(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("speed"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))


def binned_curve(df: DataFrame, x: str, y: str, start: float, step: float, end: float, by: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation, standard error and 95 % normal error of y in bins [i, i + step) of x."""
    b = F.floor((F.col(x) - start) / step)
    s = df.where((F.col(x) >= start) & (F.col(x) < end)).withColumn("bin", (start + b * step).cast("double"))
    sem = F.stddev_samp(y) / F.sqrt(F.count(y))
    keys = [*(by or []), "bin"]
    rest = s.groupBy(*keys).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), sem.alias("sem"), (1.959964 * sem).alias("ci"))
    return same_keys(rest, group_quantiles(s, keys, y, {"median": 0.5}), keys, "left").select(*keys, "n", "mean", "median", "std", "sem", "ci")


def density(df: DataFrame, x: str, y: str, nodes: int) -> DataFrame:
    """Gaussian kernel density (Scott's width, sample covariance) on nodes x nodes places from floor(min) - 1 to ceil(max) + 1, summing to 1.

    Every row adds to every node, and tasks sum per node before the shuffle: nodes^2 rows a task.
    """
    a, b = F.col(x), F.col(y)
    s = df.agg(F.count("*").alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vc"), *[e for c, k in ((x, "x"), (y, "y")) for e in ((F.floor(F.min(c)) - 1).alias(f"l{k}"), (F.ceil(F.max(c)) + 1).alias(f"h{k}"))])
    s = s.withColumn("f", F.pow("n", F.lit(-1 / 3))).withColumn("det", F.expr("(vx * vy - vc * vc) * f"))
    at = F.sequence(F.lit(0), F.lit(nodes - 1))
    p = df.select(a.alias("__x"), b.alias("__y")).join(F.broadcast(s)).withColumn("ix", F.explode(at)).withColumn("iy", F.explode(at))  # one row
    p = p.withColumn("dx", F.expr(f"lx + ix * (hx - lx) / {nodes - 1}") - F.col("__x")).withColumn("dy", F.expr(f"ly + iy * (hy - ly) / {nodes - 1}") - F.col("__y"))
    g = p.groupBy("ix", "iy").agg(F.sum(F.exp(F.expr("-(vy * dx * dx - 2 * vc * dx * dy + vx * dy * dy) / (2 * det)"))).alias("g"))
    return g.select("ix", "iy", (F.col("g") / F.sum("g").over(W.partitionBy())).alias("density"))


def automatic_range(df: DataFrame, condition: str, x: str, y: str, fewest: int = 3, most: int = 10, least: int = 2) -> DataFrame:
    """One row (first, last, step, bins): start of the first and last bin of the longest run of bins in which every condition has `least` values of y.

    Steps are the nice ones near the range over most .. fewest; runs shorter than `fewest` do not
    count; ties go to the wider run, then the finer step, then the lower run. No row if there is none.
    """
    d = df.select(F.col(condition).alias("g"), F.col(x).cast("double").alias("v"), F.col(y).cast("double").alias("w")).where("g is not null and abs(v) < double('infinity') and abs(w) < double('infinity')")
    lim = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_distinct("g").alias("groups")).withColumn("tried", F.explode(F.sequence(F.lit(most), F.lit(fewest), F.lit(-1))))
    lim = lim.withColumn("step", nice_step((F.col("hi") - F.col("lo")) / F.col("tried"))).where("step is not null").groupBy("lo", "hi", "groups", "step").agg(F.max("tried").alias("tried"))
    lim = lim.withColumn("start", F.floor(F.col("lo") / F.col("step")) * F.col("step")).withColumn("end", F.ceil(F.col("hi") / F.col("step")) * F.col("step"))
    at = d.join(F.broadcast(lim)).withColumn("i", F.floor((F.col("v") - F.col("start")) / F.col("step"))).where("start + i * step < end")  # a row per candidate
    full = at.groupBy("tried", "step", "start", "groups", "i", "g").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    full = full.groupBy("tried", "step", "start", "groups", "i").agg(F.count("*").alias("k")).where("k = groups")
    run = full.withColumn("r", F.col("i") - F.row_number().over(W.partitionBy("tried").orderBy("i"))).groupBy("tried", "step", "start", "r").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("bins"))
    best = run.where(F.col("bins") >= fewest).orderBy(F.desc("bins"), F.desc(F.col("step") * F.col("bins")), F.desc("tried"), "a").limit(1)
    return best.select((F.col("start") + F.col("a") * F.col("step")).alias("first"), (F.col("start") + F.col("b") * F.col("step")).alias("last"), "step", "bins")
