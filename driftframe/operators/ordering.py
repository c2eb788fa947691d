"""Ranks and running totals over whole columns, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PARTS = 64


def value_parts(df: DataFrame, x: str, parts: int = PARTS) -> Column:
    """Number of the part that x falls into; null falls into 0. Equal values share a part.

    The cuts are approximate quantiles of df, at most parts - 1 numbers. They are fetched and
    written into the column, so that every use of it, and every rerun of a task, cuts alike.
    """
    cuts = df.agg(F.percentile_approx(F.col(x).cast("double"), [k / parts for k in range(1, parts)], F.lit(1000))).first()[0]
    cuts = sorted({c for c in cuts or [] if c == c})
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.coalesce(F.col(x).cast("double"), F.lit(cuts[0]))))


def running_before(df: DataFrame, x: str, amount: str, part: Column, within: list[str] | None = None) -> DataFrame:
    """df with `before`, the sum of `amount` over smaller x of the group; x occurs once in a group, `part` is ordered like x."""
    within = within or []
    s = df.withColumn("__part", part)
    earlier = W.unboundedPreceding, -1
    zero = lambda e: F.coalesce(e, F.lit(0))
    sums = s.groupBy(*within, "__part").agg(F.sum(amount).alias("__n"))  # at most `parts` rows a group
    sums = sums.withColumn("__off", zero(F.sum("__n").over(W.partitionBy(*within).orderBy("__part").rowsBetween(*earlier)))).drop("__n")
    s = s.withColumn("__in", zero(F.sum(amount).over(W.partitionBy(*within, "__part").orderBy(x).rowsBetween(*earlier))))
    return s.join(sums, [*within, "__part"]).withColumn("before", F.col("__off") + F.col("__in")).drop("__part", "__off", "__in")


def group_quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each share): exact quantiles of x in every group, linear between neighbours.

    Values are counted, their counts added up in parts, and the values at the two ranks picked, so
    that no task holds a group. Null x do not count; a group without others has no row; null keys are
    keys like others.
    """
    own = df.where(F.col(x).isNotNull()).select(F.struct(*keys).alias("__k"), F.col(x).cast("double").alias("__x"))
    v = own.groupBy("__k", "__x").agg(F.count("*").alias("__n")).withColumn("__part", value_parts(own, "__x"))
    sums = v.groupBy("__k", "__part").agg(F.sum("__n").alias("__held"))  # at most PARTS rows a group
    group = W.partitionBy("__k")
    off = F.coalesce(F.sum("__held").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__k", "__part", off.alias("__off"), F.sum("__held").over(group).alias("__all"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__k", "__part").orderBy("__x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("__in", before).join(sums, ["__k", "__part"]).withColumn("__at", F.col("__off") + F.col("__in"))
    place = {n: F.lit(q) * (F.col("__all") - 1) for n, q in shares.items()}
    holds = lambda rank: F.max(F.when((F.col("__at") <= rank) & (rank < F.col("__at") + F.col("__n")), F.col("__x")))
    picked = v.groupBy("__k").agg(*[e for n, at in place.items() for e in (holds(F.floor(at)).alias(f"__l_{n}"), holds(F.ceil(at)).alias(f"__h_{n}"))], F.max("__all").alias("__all"))
    value = lambda n: F.col(f"__l_{n}") + (place[n] - F.floor(place[n])) * (F.col(f"__h_{n}") - F.col(f"__l_{n}"))
    return picked.select(*[F.col("__k")[k].alias(k) for k in keys], *[value(n).alias(n) for n in shares])


def same_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of `other` for the same keys, null ones included."""
    right = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def places(df: DataFrame, x: str, ties: list[str], falling: bool = False) -> DataFrame:
    """df with `place`, 1 for the first of the order by x (nulls last), ties by the other columns: numbered in parts, for sorted reports."""
    x_ = F.col(x).cast("double")
    d = df.withColumn("__x", -x_ if falling else x_)
    d = d.withColumn("__part", F.when(F.col("__x").isNull(), F.lit(1 << 20)).otherwise(value_parts(d, "__x")))
    sums = d.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a part
    off = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(W.partitionBy("__part").orderBy("__x", *ties))
    return d.withColumn("__at", at).join(F.broadcast(sums.select("__part", off.alias("__off"))), "__part").withColumn("place", F.col("__off") + F.col("__at")).drop("__x", "__part", "__at", "__off")
