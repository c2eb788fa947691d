"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(x: Column, edges: list[float], names: list[str], outside: str = "nan") -> Column:
    """Name of the right-open interval that holds x, `outside` if none does."""
    out = F.when(F.lit(False), F.lit(outside))
    for lo, hi, name in zip(edges, edges[1:], names):
        out = out.when((x >= lo) & (x < hi), name)
    return out.otherwise(outside)


def recode(x: Column, pairs: dict[str, str]) -> Column:
    """x with the given values replaced, others kept."""
    out = F.when(F.lit(False), x)
    for a, b in pairs.items():
        out = out.when(x == a, b)
    return out.otherwise(x)


def has_keywords(x: Column, words: list[str], mode: str = "or") -> Column:
    """Whether x holds any (or) or all (and) of the words."""
    f = F.exists if mode == "or" else F.forall
    return f(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))


def first_parts(x: Column, n: int, symbol: str) -> Column:
    """The first n parts of x split at the symbol."""
    return F.slice(F.split(x, f"\\Q{symbol}\\E"), 1, n)


def shannon_entropy(p: Column) -> Column:
    """-sum p ln(p + 1e-10) over an array."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(x + 1e-10))


def nice_step(raw: Column) -> Column:
    """The nearest of 1, 2, 2.5, 5, 10 times a power of ten, the first of ties; null unless positive and finite."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    cands = F.array(*[F.struct(F.abs(F.lit(c) * scale - raw).alias("d"), F.lit(i).alias("i"), (F.lit(c) * scale).alias("v")) for i, c in enumerate((1.0, 2.0, 2.5, 5.0, 10.0))])
    return F.when((raw > 0) & (raw < float("inf")), F.array_min(cands)["v"])


def project_on_line(start: list[Column], end: list[Column], target: list[Column], segment: bool = False) -> Column:
    """t of the projection on start + t (end - start), clamped to [0, 1] for a segment; null if start = end."""
    d = [e - s for s, e in zip(start, end)]
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    t = dot([p - s for s, p in zip(start, target)], d) / F.nullif(dot(d, d), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) if segment else t


def point_on_line(start: list[Column], end: list[Column], t: Column) -> list[Column]:
    """The point start + t (end - start), coordinate by coordinate; null where t is."""
    return [a + t * (b - a) for a, b in zip(start, end)]


def video_label(video: Column, track: Column) -> Column:
    """Label of a track: its recording and number; null if either is."""
    return F.concat(video.cast("string"), F.lit("_"), track.cast("string"))


def track_label(video: Column, kind: Column, label: Column) -> Column:
    """Label of a feature row: recording, type and label of its track; null if one of them is."""
    return F.concat(video.cast("string"), F.lit("_"), kind.cast("string"), F.lit("_"), label.cast("string"))


def day_and_group(name: Column) -> tuple[Column, Column]:
    """Day (the letter after the second `-`, then its number without leading zeros) and the one-letter group after it."""
    part = F.split_part(name, F.lit("-"), F.lit(3))
    day = F.regexp_extract(part, "^[A-Za-z][0-9]+", 0)
    return F.regexp_replace(day, "^([A-Za-z])0+(?=[0-9])", "$1"), F.substr(part, F.length(day) + 1, F.lit(1))


def frame_interval(name: Column) -> Column:
    """Seconds between frames by the recording's name."""
    return F.when(F.contains(F.lower(name), F.lit("int15s")), 15).otherwise(30)


def least_duration(name: Column, short: int = 20, fine: int = 40) -> Column:
    """Frames that a track must have by the recording's name: `fine` at 15 seconds between frames, else `short`."""
    return F.when(frame_interval(name) == 15, fine).otherwise(short)


def to_voxel(x: Column, size: float, count: int) -> Column:
    """Index of the voxel at x: rounded half to even, clipped to the stack."""
    return F.least(F.lit(count - 1), F.greatest(F.lit(0), F.bround(x / size).cast("int")))


def significance(z: Column, p: Column, z_limit: float, p_limit: float) -> Column:
    return F.when((F.abs(z) < z_limit) | (p < p_limit), "NoChange").otherwise("Change")
