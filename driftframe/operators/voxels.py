"""Voxel tables (t, z, y, x, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordering import group_quantiles, running_before, same_keys, value_parts


def zones(df: DataFrame, keys: list[str], value: str, s: float = 0.5, d: float = 0.2) -> DataFrame:
    """zone 0 up to the 1-s quantile of its frame, 2 from the 1-d*s quantile on, else 1."""
    q = group_quantiles(df, keys, value, {"__low": 1 - s, "__high": 1 - d * s})
    v = F.col(value)
    return same_keys(df, q, keys).withColumn("zone", F.when(v <= F.col("__low"), 0).when(v >= F.col("__high"), 2).otherwise(1)).drop("__low", "__high")


def zone_share(df: DataFrame, keys: list[str]) -> DataFrame:
    n = df.groupBy(*keys, "zone").agg(F.count("*").alias("n"))
    return n.withColumn("share", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def objects(df: DataFrame, label: str) -> DataFrame:
    """Centroid and volume of each label."""
    return df.groupBy(label).agg(*[F.avg(c).alias(f"c{c}") for c in "zyx"], F.count("*").alias("volume"))


def focus_plane(df: DataFrame, label: str, value: str) -> DataFrame:
    """z of least variance over mean, per object."""
    p = df.groupBy(label, "z").agg((F.var_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("v"))
    return p.where("v is not null").groupBy(label).agg(F.min(F.struct("v", "z"))["z"].alias("focus_z"))


def paint(df: DataFrame, offsets: list[tuple[int, int, int]], value: str, shape: tuple[int, int, int], once: bool = False) -> DataFrame:
    """Each row paints its value on the offsets around its (z, y, x): mean and hits per voxel inside shape; with `once` only voxels hit once."""
    o = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets])
    p = df.select("z", "y", "x", value, F.explode(o).alias("o")).select((F.bround("z") + F.col("o.dz")).cast("int").alias("z"), (F.bround("y") + F.col("o.dy")).cast("int").alias("y"), (F.bround("x") + F.col("o.dx")).cast("int").alias("x"), value)
    inside = [F.col(c).between(0, n - 1) for c, n in zip("zyx", shape)]
    out = p.where(inside[0] & inside[1] & inside[2]).groupBy("z", "y", "x").agg(F.avg(value).alias("mean"), F.count("*").alias("hits"))
    return out.where("hits = 1") if once else out


def vote(df: DataFrame, label: str, track: str) -> DataFrame:
    """Most frequent label per voxel; of ties the one that voted first (least track)."""
    n = df.groupBy("z", "y", "x", label).agg(F.count("*").alias("n"), F.min(track).alias("first"))
    return n.groupBy("z", "y", "x").agg(F.min(F.struct(-F.col("n"), "first", label))[label].alias(label))


#: Children of a tile along an axis, and the distance that rounding may take from a bound.
SPLIT, SLACK = 4, 1e-9


def last_filled(points: DataFrame, targets: DataFrame, frame: list[str], time: str) -> DataFrame:
    """(frame, __from): for each frame of points the last one, up to itself, of the same others of `frame` that holds targets."""
    rest = [c for c in frame if c != time]
    frames = targets.select(*frame, F.lit(True).alias("__t")).distinct().unionByName(points.select(*frame, F.lit(False).alias("__t")).distinct())
    frames = frames.groupBy(*frame).agg(F.bool_or("__t").alias("__t"))  # a row a frame
    seen = F.last(F.when(F.col("__t"), F.col(time)), ignorenulls=True).over(W.partitionBy(*rest).orderBy(time))
    return frames.select(*frame, seen.alias("__from"))


def nearest_in_frame(points: DataFrame, targets: DataFrame, frame: list[str], tile: float, carry: str | None = None) -> DataFrame:
    """points (id, x, y, z) with the distance to the nearest target of their frame, whatever it is.

    Targets lie in tiles of width `tile`, those in tiles SPLIT times as wide, and so on up to a few for
    a frame, each with the box around its targets. A point goes down from the widest tiles and keeps
    those whose box can hold a target no farther than the nearest farthest corner seen so far; at
    the bottom it meets the targets themselves. With `carry`, one of the columns of `frame`, a frame
    without targets takes those of the last one before it. Without any target, or with a null
    coordinate, the distance is null.
    """
    axes = "xyz"
    fine = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in axes))
    at = fine(targets.select(*frame, *[F.col(c).cast("double").alias(c) for c in axes])).withColumns({f"k{c}": F.floor(F.col(c) / tile) for c in axes})
    if carry:
        points = same_keys(points, last_filled(points, at, frame, carry), frame, "left")
    source = ["__from" if c == carry else c for c in frame]
    wide = at.agg(F.max(F.greatest(*[F.abs(f"k{c}") for c in axes]))).first()[0]
    if wide is None:
        return points.drop("__from").withColumn("distance", F.lit(None).cast("double"))
    tiles, keys = [], [f"k{c}" for c in axes]
    box = [f(c).alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))]
    tiles.append(at.groupBy(*frame, *keys).agg(*box))
    while wide >= 1:
        up = tiles[-1].select(*frame, *[F.floor(F.col(k) / SPLIT).alias(k) for k in keys], *[f"{n}_{c}" for c in axes for n in ("lo", "hi")])
        tiles.append(up.groupBy(*frame, *keys).agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))]))
        wide //= SPLIT
    own = fine(points.select(*[F.col(s).alias(f"__f{i}") for i, s in enumerate(source)], *[F.col(c).cast("double").alias(c) for c in axes])).distinct()
    frames = [f"__f{i}" for i in range(len(frame))]
    place = [*frames, *axes]
    named = lambda df: df.withColumnsRenamed(dict(zip(frame, frames)))

    def pruned(df: DataFrame) -> DataFrame:
        out = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
        far = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"lo_{c}")), F.abs(F.col(c) - F.col(f"hi_{c}")))
        length = lambda f: F.sqrt(sum((f(c) * f(c) for c in axes), F.lit(0.0)))
        best = F.min(length(far)).over(W.partitionBy(*place))
        return df.withColumn("__best", best).where(length(out) <= F.col("__best") * (1 + SLACK) + SLACK).select(*place, *keys)

    held = pruned(own.join(named(tiles[-1]), frames))
    for level in tiles[-2::-1]:
        parents = [f"p{c}" for c in axes]
        below = named(level).withColumns({p: F.floor(F.col(k) / SPLIT) for p, k in zip(parents, keys)})
        held = pruned(held.withColumnsRenamed(dict(zip(keys, parents))).join(below, [*frames, *parents]))
    there = named(at).withColumnsRenamed({c: f"t{c}" for c in axes})
    gap = F.sqrt(sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in axes), F.lit(0.0)))
    near = held.join(there, [*frames, *keys]).groupBy(*place).agg(F.min(gap).alias("distance"))
    near = near.withColumnsRenamed(dict(zip(place, [*[f"__g{i}" for i in range(len(frame))], *[f"__{c}" for c in axes]])))
    on = F.lit(True)
    for i, s in enumerate(source):
        on = on & (F.col(s) == F.col(f"__g{i}"))
    for c in axes:
        on = on & (F.col(c).cast("double") == F.col(f"__{c}"))
    return points.join(near, on, "left").drop("__from", *[f"__g{i}" for i in range(len(frame))], *[f"__{c}" for c in axes])


def box_sum(df: DataFrame, value: str, sizes: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """Sum of the values in the box of odd `sizes` (z, y, x) around each voxel that a box reaches: axis by axis, so each value is copied once per place along one axis."""
    out = df.groupBy(*keys, "z", "y", "x").agg(F.sum(value).alias("sum"))
    for axis, n in zip("zyx", sizes):
        moved = F.explode(F.sequence(F.col(axis) - n // 2, F.col(axis) + n // 2))
        out = out.withColumn(axis, moved).groupBy(*keys, "z", "y", "x").agg(F.sum("sum").alias("sum"))
    return out


def scale(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(v - min) / max of the stack; the two numbers per stack are counted first and joined."""
    m = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(m, keys).withColumn("scaled", (F.col(value) - F.col("__lo")) / F.nullif("__hi", F.lit(0.0))).drop("__lo", "__hi")


def fill_slices(df: DataFrame, value: str, extra: int, keys: list[str]) -> DataFrame:
    """`extra` slices between neighbouring ones (z, one voxel each), on a straight line; z becomes z * (extra + 1)."""
    w = W.partitionBy(*keys, "y", "x").orderBy("z")
    s = df.withColumn("__n", F.lead(value).over(w)).withColumn("__z", F.lead("z").over(w))
    s = s.withColumn("__k", F.explode(F.when(F.col("__z") == F.col("z") + 1, F.sequence(F.lit(0), F.lit(extra))).otherwise(F.array(F.lit(0)))))
    step = F.col("__k") / (extra + 1)
    return s.select(*keys, (F.col("z") * (extra + 1) + F.col("__k")).alias("z"), "y", "x", (F.col(value) + step * F.coalesce(F.col("__n") - F.col(value), F.lit(0.0))).alias(value))


def clean_objects(df: DataFrame, label: str, least: int, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels of objects with at least `least` voxels that do not touch the border, labels renumbered from 1 in order."""
    inside = [e for c, n in zip("zyx", shape) for e in (F.min(c) > 0, F.max(c) < n - 1)]
    keep = df.groupBy(label).agg(F.count("*").alias("__n"), F.bool_and(F.lit(True)).alias("__t"), *[e.alias(f"__b{k}") for k, e in enumerate(inside)])
    keep = keep.where(F.col("__n") >= least).where(" and ".join(f"__b{k}" for k in range(len(inside))))
    keep = keep.select(label, F.lit(1).alias("__one"))
    names = running_before(keep, label, "__one", value_parts(keep, label)).select(label, (F.col("before") + 1).alias("new_label"))
    return df.join(names, label)


def smooth(df: DataFrame, value: str, axes: dict[str, tuple[float, int]], keys: list[str], reach: float = 4.0) -> DataFrame:
    """Gaussian mean along each axis {name: (sigma, length)}, up to `reach` sigmas, mirrored at both ends; absent voxels are 0.

    Axis by axis: a voxel's value is spread with weights over the places along one axis and summed
    there, so no neighbourhood is brought together.
    """
    names = list(axes)
    out = df.groupBy(*keys, *names).agg(F.sum(F.col(value).cast("double")).alias("smooth"))
    for axis, (sigma, n) in axes.items():
        r = int(reach * sigma + 0.5)
        w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
        spread = F.posexplode(F.array(*[F.lit(v / sum(w)) for v in w])).alias("__k", "__w")
        at = F.pmod(F.col(axis) + F.col("__k") - r, F.lit(2 * n))
        out = out.select(*keys, *names, "smooth", spread).withColumn(axis, F.when(at < n, at).otherwise(2 * n - 1 - at))
        out = out.groupBy(*keys, *names).agg(F.sum(F.col("smooth") * F.col("__w")).alias("smooth"))
    return out


def crop_totals(df: DataFrame, centres: DataFrame, value: str, size: tuple[int, int, int], shape: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """(keys, label, dz, dy, dx, n, total): how many rows each place of the box around a label's centres holds, and the sum of their values.

    Rows are added up by voxel and centres by place before they meet, so a box costs its voxels, however many
    rows they hold, and is cut once for all labels that share it. Only labels with several centres are grouped again.
    """
    held = df.groupBy(*keys, "z", "y", "x").agg(F.struct(F.count("*").alias("n"), F.sum(value).alias("total")).alias("held"))
    at = [*keys, "z", "y", "x"]
    own = centres.groupBy("label", *at).agg(F.count("*").alias("__times")).withColumn("__several", F.count("*").over(W.partitionBy("label")) > 1)
    place = F.struct(*at)
    boxes = crops(held, own.select(*at).distinct().withColumn("label", place), "held", size, shape, keys).withColumnRenamed("label", "__place").drop(*keys)
    out = own.withColumn("__place", place).join(boxes, "__place")
    cols = [*keys, "label", "dz", "dy", "dx"]
    out = out.select(*cols, "__several", (F.col("held.n") * F.col("__times")).alias("n"), (F.col("held.total") * F.col("__times")).alias("total"))
    several = out.where("__several").groupBy(*cols).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.where("not __several").drop("__several").unionByName(several)


def crops(df: DataFrame, centres: DataFrame, value: str, size: tuple[int, int, int], shape: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """(keys, label, dz, dy, dx, value): the voxels in the box around each centre (keys, label, z, y, x), places counted from its corner.

    Centres whose box reaches a border are left out. Boxes and voxels meet in tiles as large as a
    box: a box lies in at most two tiles along each axis.
    """
    half = [n // 2 for n in size]
    c = centres.select(*keys, "label", *[F.bround(F.col(a).cast("double")).cast("int").alias(f"__{a}") for a in "zyx"])
    for a, h, n in zip("zyx", half, shape):
        c = c.where((F.col(f"__{a}") - h > 0) & (F.col(f"__{a}") + h < n))
    for a, h in zip("zyx", half):
        low = F.col(f"__{a}") - h
        c = c.withColumn(f"__t{a}", F.explode(F.sequence(F.floor(low / (2 * h)), F.floor((low + 2 * h - 1) / (2 * h)))))
    tiled = df.select(*keys, "z", "y", "x", value, *[F.floor(F.col(a) / (2 * h)).alias(f"__t{a}") for a, h in zip("zyx", half)])
    met = tiled.join(c, [*keys, "__tz", "__ty", "__tx"])
    place = {a: F.col(a) - F.col(f"__{a}") + h for a, h in zip("zyx", half)}
    for (a, e), h in zip(place.items(), half):
        met = met.where((e >= 0) & (e < 2 * h))
    return met.select(*keys, "label", *[e.cast("int").alias(f"d{a}") for a, e in place.items()], value)
