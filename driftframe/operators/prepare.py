"""Rows, columns and blocks made ready for the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import to_voxel
from .ordering import group_quantiles, same_keys
from .stats import order_clusters


def rename_containing(df: DataFrame, part: str, other: str) -> DataFrame:
    """Columns whose name holds `part` have it replaced by `other`."""
    return df.withColumnsRenamed({c: c.replace(part, other) for c in df.columns if part in c})


def prefix_features(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """All columns but the keys renamed with a prefix."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def cut_times(df: DataFrame, limits: dict[str, int], video: str = "Video", time: str = "Time") -> DataFrame:
    """Rows up to the time limit of their video; videos without one stay whole."""
    limit = F.lit(None).cast("long")
    for name, most in limits.items():
        limit = F.when(F.col(video) == name, most).otherwise(limit)
    return df.where(limit.isNull() | (F.col(time) <= limit))


def leave_out_by_place(df: DataFrame, column: str, places: list[int]) -> DataFrame:
    """df without the values of `column` at the given places (from 0; -1 is the last) in their order.

    The distinct values (recordings) are ranked in one small window.
    """
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    at = names.withColumn("__at", F.row_number().over(W.orderBy(column)) - 1).withColumn("__n", F.count("*").over(W.partitionBy()))
    out = at.where(F.col("__at").isin([p for p in places if p >= 0]) | (F.col("__at") - F.col("__n")).isin([p for p in places if p < 0]))
    return df.join(out.select(column), column, "left_anti")


def complete_columns(df: DataFrame) -> DataFrame:
    """df without the columns that hold a null, found in one aggregation (a single row comes to the driver)."""
    bad = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not bad[c]])


def holds_term(x: Column, words: list[str]) -> Column:
    """Whether x holds any of the words, whatever their case; null is false."""
    return F.coalesce(x.rlike("(?i)" + "|".join(f"\\Q{w}\\E" for w in words)), F.lit(False))


def codes(x: Column, names: list[str]) -> Column:
    """The place of x among the names; null if it is none of them."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), x), F.lit(0)) - 1


def without_listed(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*keys).distinct(), keys, "left_anti")


def only_listed(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are listed; null keys are none."""
    return df.join(listed.select(*keys).dropna().distinct(), keys, "left_semi")


def label_frames(frames: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with the columns of their track's row in labels; a frame without one is an error when the result is run."""
    out = frames.join(labels.withColumn("__has", F.lit(True)), keys, "left")
    known = F.coalesce("__has", F.raise_error(F.lit("label_frames: a frame's track has no label")).cast("boolean"))
    return out.where(known).drop("__has")


def clipped_voxels(df: DataFrame, axes: dict[str, tuple[float, int]]) -> DataFrame:
    """Voxel indices v_<axis> of positions, and how many axes of a row were clipped to the stack. axes: size, count."""
    inside = [F.bround(F.col(c) / size).between(0, n - 1) for c, (size, n) in axes.items()]
    out = df.withColumns({f"v_{c}": to_voxel(F.col(c), size, n) for c, (size, n) in axes.items()})
    return out.withColumn("clipped", sum((F.when(i, 0).otherwise(1) for i in inside), F.lit(0)))


def zone_of_voxel(positions: DataFrame, zones: DataFrame, keys: list[str], missing: int = 0) -> DataFrame:
    """positions with the zone of their voxel; voxels that are not stored are `missing`."""
    return positions.join(zones.select(*keys, "zone"), keys, "left").withColumn("zone", F.coalesce("zone", F.lit(missing)))


def wide_features(blocks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Feature blocks (one row a key each) side by side, for every key that one of them holds, null ones too; what a block lacks is null.

    The blocks are stacked and aggregated once, so that no block costs a join.
    """
    names = [c for b in blocks for c in b.columns if c not in keys]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
    return whole.groupBy(*keys).agg(*[F.any_value(c, F.lit(True)).alias(c) for c in names])


def keep_recoded(cells: DataFrame, column: str, keep: list[str], names: dict[str, str]) -> DataFrame:
    """Rows whose column is one of `keep`, some of them renamed by `names`; null is none of them."""
    new = F.col(column)
    for old, name in names.items():
        new = F.when(F.col(column) == old, name).otherwise(new)
    return cells.where(F.col(column).isin(keep)).withColumn(column, new)


def label_clusters(features: DataFrame, frames: DataFrame, cluster: str, feature: str, keys: list[str], by: str = "median") -> tuple[DataFrame, DataFrame]:
    """Tracks and their frames with the cluster renumbered by its ascending feature; a frame without a track is an error when it is run."""
    order = order_clusters(features, cluster, feature, by)
    tracks = same_keys(features, order, [cluster], "left").drop(cluster).withColumnRenamed("new_label", cluster)
    return tracks, label_frames(frames, tracks.select(*keys, cluster), keys)


def lag_features(long: DataFrame, keys: list[str], lag: str, value: str, lags: list[int], prefix: str) -> DataFrame:
    """One row per key, a column for each lag; an aggregation, so no lag costs a join."""
    return long.where(F.col(lag).isin(lags)).groupBy(*keys).agg(*[F.max(F.when(F.col(lag) == k, F.col(value))).alias(f"{prefix}_{k}") for k in lags])


def stack(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Tables of different columns below each other, with the name of each; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def complement(n: int, listed: DataFrame, column: str) -> DataFrame:
    """The numbers 0 .. n - 1 that are not listed."""
    return listed.sparkSession.range(n).withColumnRenamed("id", column).join(listed.select(F.col(column).cast("long").alias(column)), column, "left_anti")


def two_conditions(df: DataFrame, category: str, condition: str, x: str, one, two) -> DataFrame:
    """Per category: means, medians and errors of both conditions, Cohen's d, pooled and Welch's t."""
    a, b = F.when(F.col(condition) == one, F.col(x)), F.when(F.col(condition) == two, F.col(x))
    na, nb, va, vb = F.count(a), F.count(b), F.var_samp(a), F.var_samp(b)
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / F.nullif(na + nb - 2, F.lit(0)))
    diff = F.avg(b) - F.avg(a)
    out = df.groupBy(category).agg(
        F.avg(a).alias("mean_one"), F.avg(b).alias("mean_two"),
        (F.stddev_samp(a) / F.sqrt(na)).alias("sem_one"), (F.stddev_samp(b) / F.sqrt(nb)).alias("sem_two"),
        (diff / F.nullif(pooled, F.lit(0.0))).alias("cohen_d"),
        (diff / F.nullif(pooled * F.sqrt(1 / na + 1 / nb), F.lit(0.0))).alias("t_pooled"),
        (diff / F.nullif(F.sqrt(va / na + vb / nb), F.lit(0.0))).alias("t_welch"),
    )
    for side, name in ((one, "one"), (two, "two")):
        out = same_keys(out, group_quantiles(df.where(F.col(condition) == side), [category], x, {f"median_{name}": 0.5}), [category], "left")
    return out
