"""Tracks: cutting, filtering and normalising the frames of (Type, Label) in Time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TRACK = ["Type", "Label"]
SEGMENT = ["Type", "Label", "seg"]


def in_order(keys: list[str], by: str = "pt") -> W:
    return W.partitionBy(*keys).orderBy(by)


def cut_segments(df: DataFrame, duration: int, keys: list[str] = TRACK, time: str = "Time") -> DataFrame:
    """Whole segments of `duration` frames: seg, pt (0 .. duration-1), Time_span; leftovers go. One shuffle by the track."""
    rn = F.row_number().over(in_order(keys, time)) - 1
    df = df.withColumn("__rn", rn).withColumn("Time_span", F.count("*").over(W.partitionBy(*keys)))
    df = df.withColumn("seg", F.floor(F.col("__rn") / duration).cast("int")).withColumn("pt", (F.col("__rn") % duration).cast("int"))
    return df.where(F.col("seg") < F.floor(F.col("Time_span") / duration)).withColumn("pseudo_Label", F.concat_ws("_", "Label", "seg")).drop("__rn")


def recut_segments(df: DataFrame, cut: int, keys: list[str] = TRACK, time: str = "Time", label: str = "Label") -> DataFrame:
    """Tracks cut again into whole pieces of `cut` frames: pseudo_<label> with _1, _2, .. and pseudo_<time> from 1; leftovers go."""
    out = cut_segments(df.drop("seg", "pt", "Time_span", "pseudo_Label"), cut, keys, time)
    return out.withColumns({f"pseudo_{label}": F.concat(F.col(label).cast("string"), F.lit("_"), F.col("seg") + 1), f"pseudo_{time}": F.col("pt") + 1}).drop("seg", "pt", "Time_span")


def keep_long(df: DataFrame, least: int | Column, keys: list[str] = TRACK) -> DataFrame:
    """Tracks with at least `least` frames (a number, or a column that is the same all along a track), with Time_span."""
    return df.withColumn("Time_span", F.count("*").over(W.partitionBy(*keys))).where(F.col("Time_span") >= least)


def keep_consecutive(df: DataFrame, keys: list[str] = TRACK, time: str = "Time") -> DataFrame:
    """Tracks whose sorted frame numbers all differ by one; single frames stay."""
    step = F.col(time) - F.lag(time).over(in_order(keys, time))
    return df.withColumn("__step", step).withColumn("__ok", F.coalesce(F.bool_and(F.col("__step") == 1).over(W.partitionBy(*keys)), F.lit(True))).where("__ok").drop("__step", "__ok")


def keep_separate(df: DataFrame, columns: list[str], limit: float = 0.6, keys: list[str] = SEGMENT) -> DataFrame:
    """Tracks of which every frame has all `columns` below `limit`."""
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return df.withColumn("__top", F.max(top).over(W.partitionBy(*keys))).where(F.col("__top") < limit).drop("__top")


def steps(df: DataFrame, coords: list[str], keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """df with the step from the last frame (d_<c>) and its length `step` (null in the first frame)."""
    w = in_order(keys, time)
    for c in coords:
        df = df.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(w))
    return df.withColumn("step", F.sqrt(sum((F.col(f"d_{c}") * F.col(f"d_{c}") for c in coords[1:]), F.col(f"d_{coords[0]}") * F.col(f"d_{coords[0]}"))))


def turns(df: DataFrame, coords: list[str], keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """df of `steps` with `angle` between consecutive steps: 0 if one has no length, null in the first two frames."""
    w = in_order(keys, time)
    dot = sum((F.col(f"d_{c}") * F.lag(f"d_{c}").over(w) for c in coords[1:]), F.col(f"d_{coords[0]}") * F.lag(f"d_{coords[0]}").over(w))
    size = F.col("step") * F.lag("step").over(w)
    return df.withColumn("__dot", dot).withColumn("__size", size).withColumn("angle", F.when(F.col("__size") == 0, 0.0).when(F.col("__size").isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__dot") / F.nullif("__size", F.lit(0.0))))))).drop("__dot", "__size")


def instant_movements(df: DataFrame, coords: list[str], time_unit: float = 0.5, keys: list[str] = SEGMENT, time: str = "pt", divide_angle: bool = True) -> DataFrame:
    """instant_speed and instant_angle per frame, 0 where there is no step yet; tracks of varying length take undivided angles and pseudo_frame, from 0."""
    out = turns(steps(df, coords, keys, time), coords, keys, time)
    out = out.withColumn("instant_speed", F.coalesce(F.col("step") / time_unit, F.lit(0.0)))
    out = out.withColumn("instant_angle", F.coalesce(F.col("angle") / (time_unit if divide_angle else 1.0), F.lit(0.0)))
    if not divide_angle:
        out = out.withColumn("pseudo_frame", F.row_number().over(in_order(keys, time)) - 1)
    return out.drop("step", "angle", *[f"d_{c}" for c in coords])


def direction_states(df: DataFrame, feature: str, threshold: float = 0.1, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """diff_<feature> and quality_<feature>: departure, approach or stay; 'None' in the first frame or without a value."""
    diff = F.col(feature) - F.lag(feature).over(in_order(keys, time))
    df = df.withColumn(f"diff_{feature}", F.when(~F.isnan(diff), diff))
    d = F.col(f"diff_{feature}")
    return df.withColumn(f"quality_{feature}", F.when(d.isNull(), "None").when(d > threshold, "departure").when(d < -threshold, "approach").otherwise("stay"))


def normalise(df: DataFrame, feature: str, keys: list[str] = SEGMENT) -> DataFrame:
    """z_<feature> by the track's mean and population deviation; null where that is 0 (all-zero tracks stay 0)."""
    w = W.partitionBy(*keys)
    mean, dev = F.avg(feature).over(w), F.stddev_pop(feature).over(w)
    flat = (F.max(F.abs(F.col(feature))).over(w) == 0)
    return df.withColumn(f"z_{feature}", F.when(flat, 0.0).when(dev > 0, (F.col(feature) - mean) / dev))


def recentre(df: DataFrame, coords: list[str], keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    for c in coords:
        df = df.withColumn(f"rel_{c}", F.col(c) - F.first(c).over(in_order(keys, time)))
    return df


def reduce_labels(df: DataFrame, column: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """One row per track: the column's values in order, and whether they are all the same."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(time, column))), lambda s: s[column])  # a track's frames
    return df.groupBy(*keys).agg(listed.alias(column)).withColumn("is_constant", F.size(F.array_distinct(column)) == 1)


def sample_tracks(df: DataFrame, label: str, n: int, key: Column, seed: int = 0) -> DataFrame:
    """n rows of each label by a hash of the key: the same at every run."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), key))).where(F.col("__r") <= n).drop("__r")


def keep_moving(df: DataFrame, coords: list[str], keys: list[str] = TRACK, time: str = "Time") -> DataFrame:
    """Tracks with at least one interior angle over 0; a step without length makes the angle 0, as does a straight way back."""
    w = in_order(keys, time)
    s = steps(df, coords, keys, time)
    dot = sum((-F.col(f"d_{c}") * F.lead(f"d_{c}").over(w) for c in coords[1:]), -F.col(f"d_{coords[0]}") * F.lead(f"d_{coords[0]}").over(w))
    s = s.withColumn("__dot", dot).withColumn("__size", F.col("step") * F.lead("step").over(w))
    bent = (F.col("__size") > 0) & (F.col("__dot") / F.nullif("__size", F.lit(0.0)) < 1 - 1e-12)
    return s.withColumn("__moves", F.coalesce(F.bool_or(bent).over(W.partitionBy(*keys)), F.lit(False))).where("__moves").drop("__dot", "__size", "__moves", "step", *[f"d_{c}" for c in coords])


def difference(df: DataFrame, feature: str, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """diff_<feature>: change from the frame before; null in the first."""
    return df.withColumn(f"diff_{feature}", F.col(feature) - F.lag(feature).over(in_order(keys, time)))


def as_series(df: DataFrame, feature: str, length: int | None = None, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """One array per track in order of time; with `length`, of that many places by frame number, null where no frame is."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(feature).alias("v"))))  # a track's frames
    if length is None:
        return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(feature))
    held = df.groupBy(*keys).agg(F.map_from_entries(pairs).alias("__m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.try_element_at("__m", i)).alias(feature))


def frame_numbers(df: DataFrame, index: str, duration: int) -> DataFrame:
    """One row per frame of each track number: index * duration and on."""
    return df.withColumn("frame", F.explode(F.sequence(F.col(index) * duration, F.col(index) * duration + duration - 1)))


def resample(df: DataFrame, coords: list[str], step: float, keys: list[str] = TRACK, time: str = "Time", bend: float = 2.01) -> DataFrame:
    """Positions at min(time), + step, + 2 step, ... up to the last frame.

    Grid point g between two frames lies at share a of the way, plus a (1 - a) d / bend on the axis
    that moves most (the first of ties). Each stretch makes its own grid points, so nothing is joined.
    """
    w, c = in_order(keys, time), F.col
    s = df.select(*keys, c(time).alias("__t"), F.coalesce(F.lead(time).over(w), c(time)).alias("__u"), F.min(time).over(W.partitionBy(*keys)).alias("__o"), *coords, *[F.coalesce(F.lead(x).over(w) - c(x), F.lit(0.0)).alias(f"__d{x}") for x in coords])
    low = F.when(c("__t") == c("__o"), F.lit(0)).otherwise(F.floor((c("__t") - c("__o")) / step) + 1).cast("long")
    high = F.floor((c("__u") - c("__o")) / step).cast("long")
    s = s.withColumn("__lo", low).withColumn("__hi", high).where("__lo <= __hi").withColumn("n", F.explode(F.sequence("__lo", "__hi")))
    s = s.withColumn(time, c("__o") + c("n") * step).withColumn("__a", F.when(c("__u") > c("__t"), (c(time) - c("__t")) / (c("__u") - c("__t"))).otherwise(0.0))
    top = F.greatest(*[F.abs(c(f"__d{x}")) for x in coords]) if len(coords) > 1 else F.abs(c(f"__d{coords[0]}"))
    first = F.array_position(F.array(*[F.abs(c(f"__d{x}")) for x in coords]), top)
    at = [(c(x) + c("__a") * c(f"__d{x}") + F.when(first == k + 1, c("__a") * (1 - c("__a")) * c(f"__d{x}") / bend).otherwise(0.0)).alias(x) for k, x in enumerate(coords)]
    return s.select(*keys, "n", time, *at)


def fit_interval(df: DataFrame, coords: list[str], interval: int, wanted: int, keys: list[str] = TRACK, time: str = "Time", bend: float = 2.01) -> DataFrame:
    """Positions at wanted, 2 wanted, ... of steps that last `interval`: (keys, n, time, coords, kept).

    A step gives one position at most; where steps are longer than wanted, the n-th position lies on
    the line through the n-th step. A position on a frame is kept as it is (`kept`); others are
    moved by d / bend on the axis that moves most (the first of ties).
    """
    w, c = in_order(keys, time), F.col
    s = df.select(*keys, c(time), *coords, (F.row_number().over(w) - 1).alias("__i"), *[(c(x) - F.lag(x).over(w)).alias(f"__d{x}") for x in coords], (c(time) - F.lag(time).over(w)).alias("__dt"))
    n = c("__i") if wanted <= interval else F.floor(c("__i") * interval / wanted).cast("int")
    s = s.withColumn("n", n).where((c("__i") > 0) & (c("n") > 0) & (c("n") * wanted > (c("__i") - 1) * interval if wanted > interval else F.lit(True)))
    left = (c("n") * wanted - c("__i") * interval) / interval  # from the end of the step, in steps
    kept = c("n") * wanted == c("__i") * interval
    sizes = [F.abs(c(f"__d{x}")) for x in coords]
    first = F.array_position(F.array(*sizes), F.array_max(F.array(*sizes)))
    at = [(c(x) + left * c(f"__d{x}") + F.when((first == k + 1) & ~kept, c(f"__d{x}") / bend).otherwise(0.0)).alias(x) for k, x in enumerate(coords)]
    return s.select(*keys, "n", (c(time) + left * c("__dt")).alias(time), *at, kept.alias("kept"))


def with_fitted(df: DataFrame, coords: list[str], interval: int, wanted: int, keys: list[str] = TRACK, time: str = "Time", bend: float = 2.01) -> DataFrame:
    """The frames (keys, time, coords) together with the positions of `fit_interval` that are no frames."""
    own = df.select(*keys, F.col(time).cast("double").alias(time), *coords)
    return own.unionByName(fit_interval(df, coords, interval, wanted, keys, time, bend).where("not kept").select(*own.columns))
