"""Track features by name: one aggregation brings a track's frames together, the rest are expressions on its arrays.

Names of whole tracks, each giving a column (or one for each lag up to tau_limit, with _1, _2, ...):

    total_distance avg_speed max_speed min_speed net_distance progressivity
    total_angle avg_angle max_angle min_angle msds alphas
    displ_<p> and angle_<p>, p: variance cov skewness kurtosis ngaussalpha gini autocorr partial_autocorr hurst_RS

of one axis, with the coordinate's name at the end (steps along it count without their sign):

    total_distance_<c> avg_speed_<c> max_speed_<c> min_speed_<c> net_distance_<c> progressivity_<c>
    speed_distribution_<c> (an array) msd_<c> alpha_<c> displ_<p>_<c>

of three axes: exy_max eyz_max exz_max phi_max exy_total eyz_total exz_total phi_total; and of any
other column s of the frames, as <s>_<p>: total maximum peak_to_peak slope rms crestfactor formfactor
pulseindicator average and the p above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import register

PROPERTIES = "variance cov skewness kurtosis ngaussalpha gini autocorr partial_autocorr hurst_RS".split()
DISTANCES = "total_distance avg_speed max_speed min_speed net_distance progressivity".split()
ANGLES = "total_angle avg_angle max_angle min_angle".split()
ELONGATIONS = [f"{e}_{k}" for k in ("max", "total") for e in ("exy", "eyz", "exz", "phi")]
SIGNALS = "total maximum peak_to_peak slope rms crestfactor formfactor pulseindicator average".split()


def known_names(coords: list[str], signals: list[str] = ()) -> list[str]:
    """All names that `features` takes for these coordinates and signals."""
    out = [*DISTANCES, *ANGLES, "msds", "alphas", *[f"{s}_{p}" for s in ("displ", "angle") for p in PROPERTIES]]
    for c in coords:
        out += [f"{n}_{c}" for n in (*DISTANCES, "speed_distribution", "msd", "alpha", *[f"displ_{p}" for p in PROPERTIES])]
    return out + (ELONGATIONS if len(coords) == 3 else []) + [f"{s}_{p}" for s in signals for p in (*SIGNALS, *PROPERTIES)]


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _ahead(a: Column, k: Column | int, f) -> Column:
    """f(earlier, later) of all entries k apart."""
    rest = F.greatest(F.size(a) - k, F.lit(0))
    return F.zip_with(F.slice(a, 1, rest), F.slice(a, F.lit(1) + k, rest), f)


class _Stages:
    """A table that grows by columns; each stage reads the one before, so nothing is computed twice."""

    def __init__(self, df: DataFrame):
        self.df, self.made = df, set()

    def add(self, **columns: Column) -> None:
        fresh = {k: c for k, c in columns.items() if k not in self.made}
        if fresh:
            self.df, self.made = self.df.withColumns(fresh), self.made | fresh.keys()


def _slope(t: _Stages, name: str, points: Column) -> Column:
    """Of the line through an array of structs (x, y); null without two different x. The points and their means are made once, as columns."""
    t.add(**{f"__line{name}_xy": points})
    points = F.col(f"__line{name}_xy")
    n = F.nullif(F.size(points), F.lit(0))
    total = lambda f: _sum(points, f)
    t.add(**{f"__line{name}_{k}": total(lambda p: p[k]) / n for k in ("x", "y")})  # noqa: B023
    x, y = F.col(f"__line{name}_x"), F.col(f"__line{name}_y")
    return _ratio(total(lambda p: p["x"] * p["y"]) / n - x * y, total(lambda p: p["x"] * p["x"]) / n - x * x)


def _series(t: _Stages, a: str, names: list[str], lags: int) -> dict[str, Column]:
    """The properties of the array column `a`; null where it is constant or has no entries."""
    x, out = F.col(a), {}
    t.add(**{f"{a}_n": F.nullif(F.size(x), F.lit(0)), f"{a}_s": _sum(x), f"{a}_varies": F.coalesce(F.array_max(x) > F.array_min(x), F.lit(False))})
    n, mean = F.col(f"{a}_n"), F.col(f"{a}_s") / F.col(f"{a}_n")
    t.add(**{f"{a}_c": F.transform(x, lambda v: v - mean)})
    c = F.col(f"{a}_c")
    t.add(**{f"{a}_v": _sum(c, lambda v: v * v) / n})
    var = F.col(f"{a}_v")
    power = lambda q: _sum(x, lambda v: v**q) / n
    own = {
        "variance": lambda: var,
        "cov": lambda: _ratio(F.sqrt(var), mean),
        "skewness": lambda: _ratio(_sum(c, lambda v: v * v * v) / n, var * F.sqrt(var)),
        "kurtosis": lambda: _ratio(_sum(c, lambda v: v * v * v * v) / n, var * var) - 3,
        "ngaussalpha": lambda: _ratio(power(4), 3 * power(2) * power(2)) - 1,
        "gini": lambda: _ratio(_sum(F.transform(F.array_sort(x), lambda v, i: (2 * (i + 1) - n - 1) * v)), n * n * mean),
    }
    varies = lambda e: F.when(F.col(f"{a}_varies"), e)
    for p in names:
        if p in own:
            out[p] = varies(own[p]())
        elif p in ("autocorr", "partial_autocorr"):
            t.add(**{f"{a}_p{k}": _sum(_ahead(c, k, lambda u, v: u * v)) for k in range(1, lags + 1)})
            if p == "autocorr":
                out |= {f"{p}_{k}": varies(_ratio(F.col(f"{a}_p{k}"), n * var)) for k in range(1, lags + 1)}
                continue
            # Durbin's recursion on covariances over the number of their pairs
            t.add(**{f"{a}_r{k}": _ratio(F.col(f"{a}_p{k}"), F.nullif(n - k, F.lit(0)) * var) for k in range(1, lags + 1)})
            r, phi = lambda k: F.col(f"{a}_r{k}"), {}
            for k in range(1, lags + 1):
                top, under = r(k) - sum((phi[j] * r(k - j) for j in range(1, k)), F.lit(0.0)), F.lit(1.0) - sum((phi[j] * r(j) for j in range(1, k)), F.lit(0.0))
                t.add(**{f"{a}_f{k}_{k}": _ratio(top, under)})
                last = F.col(f"{a}_f{k}_{k}")
                t.add(**{f"{a}_f{k}_{j}": phi[j] - last * phi[k - j] for j in range(1, k)})
                phi = {j: F.col(f"{a}_f{k}_{j}") for j in range(1, k + 1)}
                out[f"{p}_{k}"] = varies(last)
        elif p == "hurst_RS":
            out[p] = _hurst(t, a)
        else:
            rms = F.sqrt(power(2))
            out[p] = {
                "total": lambda: F.when(n > 0, F.col(f"{a}_s")), "average": lambda: mean, "maximum": lambda: F.array_max(x), "peak_to_peak": lambda: F.array_max(x) - F.array_min(x),
                "slope": lambda: _slope(t, f"_slope{a}", F.transform(x, lambda v, i: F.struct(i.cast("double").alias("x"), v.alias("y")))), "rms": lambda: rms,
                "crestfactor": lambda: _ratio(F.array_max(x), rms), "formfactor": lambda: _ratio(rms, mean), "pulseindicator": lambda: _ratio(F.array_max(F.transform(x, lambda v: F.abs(v))), mean),
            }[p]()
    return out


def _hurst(t: _Stages, a: str) -> Column:
    """Slope of ln(mean R/S) on ln(size) for blocks of floor(n / 2^i) entries, i + 1 < floor(log2 n); blocks without deviation do not count.

    A lambda works out anew, for every entry, whatever it does not get as an argument; so blocks are
    handed on with their mean, and then as deviations, and an entry costs the same in blocks of any size.
    """
    x, n = F.col(a), F.col(f"{a}_n")
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float("-inf")).alias("top"), F.lit(float("inf")).alias("low"))
    step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.greatest(s["top"], s["at"] + v).alias("top"), F.least(s["low"], s["at"] + v).alias("low"))

    def rescaled(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(n / w).cast("int") - 1), lambda b: F.slice(x, b * w + 1, w))
        meant = F.transform(blocks, lambda v: F.struct(v.alias("v"), (_sum(v) / w).alias("mean")))
        centred = F.transform(meant, lambda b: F.transform(b["v"], lambda v: v - b["mean"]))
        parts = F.transform(centred, lambda c: F.struct(F.sqrt(_sum(c, lambda v: v * v) / w).alias("dev"), F.aggregate(c, start, step, lambda s: s["top"] - s["low"]).alias("range")))
        return F.transform(F.filter(parts, lambda p: p["dev"] > 1e-12), lambda p: p["range"] / p["dev"])

    count = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int") - 1
    halves = F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    widths = F.transform(halves, lambda i: F.floor(n / F.pow(F.lit(2.0), i)).cast("int"))
    both = F.transform(widths, lambda w: F.struct(w.alias("w"), rescaled(w).alias("rs")))
    means = F.transform(both, lambda s: F.struct(s["w"].alias("w"), (_sum(s["rs"]) / F.nullif(F.size(s["rs"]), F.lit(0))).alias("rs")))
    return _slope(t, f"_hurst{a}", F.transform(F.filter(means, lambda s: s["rs"] > 0), lambda s: F.struct(F.ln(s["w"]).alias("x"), F.ln(s["rs"]).alias("y"))))


def features(df: DataFrame, key: list[str], order: str, coords: list[str], names: list[str], time_unit: float = 0.5, tau_limit: int = 3, signals: list[str] = ()) -> DataFrame:
    """One row a track (key) with the named features; see the top of the module.

    Frames with a null or NaN among coordinates and signals are left out; frames come in the order of
    `order`, equal ones in the order of their values. What a track is too short for is null. Unknown
    names are an error; other columns are ignored; a null key is a track as others are.
    """
    allowed = known_names(coords, signals)
    if unknown := [n for n in names if n not in allowed]:
        raise ValueError(f"unknown features: {unknown}")
    used = [*coords, *[s for s in signals if any(n.startswith(f"{s}_") for n in names)]]
    fine = df.select(*[F.col(k) for k in key], F.col(order).alias("__o"), *[F.col(c).cast("double").alias(f"__{c}") for c in used])
    for c in used:
        fine = fine.where(F.col(f"__{c}").isNotNull() & ~F.isnan(f"__{c}"))
    t = _Stages(fine.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__o", *[f"__{c}" for c in used]))).alias("__f")))  # a track's frames
    f = F.col("__f")
    t.add(**{f"__p_{c}": F.transform(f, lambda p: p[f"__{c}"]) for c in used})  # noqa: B023
    t.add(**{f"__d_{c}": _ahead(F.col(f"__p_{c}"), 1, lambda a, b: b - a) for c in coords})
    t.add(**{f"__a_{c}": F.transform(f"__d_{c}", lambda v: F.abs(v)) for c in coords})
    square = lambda p, q: sum(((q[f"__{c}"] - p[f"__{c}"]) * (q[f"__{c}"] - p[f"__{c}"]) for c in coords), F.lit(0.0))
    t.add(__moves=_ahead(f, 1, lambda p, q: F.struct(*[(q[f"__{c}"] - p[f"__{c}"]).alias(c) for c in coords], F.sqrt(square(p, q)).alias("size"))))
    t.add(__step=F.transform("__moves", lambda m: m["size"]))
    dot = lambda p, q: sum((p[c] * q[c] for c in coords), F.lit(0.0))
    t.add(__angle=_ahead(F.col("__moves"), 1, lambda p, q: F.when(p["size"] * q["size"] == 0, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p, q) / F.nullif(p["size"] * q["size"], F.lit(0.0))))))))

    def lagged(array: Column, gap) -> Column:
        """Mean of gap(earlier, later) for every lag from 1."""
        every = F.when(F.size(array) > 1, F.sequence(F.lit(1), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda k: _sum(_ahead(array, k, gap)) / (F.size(array) - k))

    def moved(msd: str, name: str, slope: str) -> dict[str, Column]:
        """Columns of the mean squared displacements; lags without any are left out of the slope."""
        out = {f"{name}_{k}": F.get(msd, k - 1) for k in range(1, tau_limit + 1)}
        points = F.filter(F.transform(msd, lambda v, i: F.struct(F.ln(i + 1).alias("x"), F.when(v > 0, F.ln(v)).alias("y"))), lambda p: p["y"].isNotNull())
        return out | {slope: _slope(t, msd, points)}

    def distances(step: str, net: Column, end: str) -> dict[str, Column]:
        s, some = F.col(step), F.size(step) > 0
        return {f"total_distance{end}": F.when(some, _sum(s)), f"avg_speed{end}": _sum(s) / F.nullif(F.size(s), F.lit(0)) / time_unit, f"max_speed{end}": F.array_max(s) / time_unit, f"min_speed{end}": F.array_min(s) / time_unit, f"net_distance{end}": F.when(some, net), f"progressivity{end}": _ratio(net, _sum(s))}

    wanted, out = set(names), {}
    first, last = F.get("__f", F.lit(0)), F.get("__f", F.size("__f") - 1)
    out |= distances("__step", F.sqrt(square(first, last)), "")
    n = F.nullif(F.size("__angle"), F.lit(0))
    out |= {"total_angle": F.when(n > 0, _sum(F.col("__angle"))), "avg_angle": _sum(F.col("__angle")) / n / time_unit, "max_angle": F.array_max("__angle") / time_unit, "min_angle": F.array_min("__angle") / time_unit}
    if wanted & {"msds", "alphas"}:
        t.add(__msd=lagged(f, square))
        out |= moved("__msd", "msds", "alphas")
    for prefix, a, end in (("displ_", "__step", ""), ("angle_", "__angle", ""), *[("displ_", f"__a_{c}", f"_{c}") for c in coords], *[(f"{s}_", f"__p_{s}", "") for s in used[len(coords) :]]):
        mine = [p for p in (*SIGNALS, *PROPERTIES) if f"{prefix}{p}{end}" in wanted]
        if mine:
            out |= {prefix + (p.replace("autocorr_", f"autocorr{end}_") if "autocorr" in p else p + end): e for p, e in _series(t, a, mine, tau_limit).items()}
    for c in coords:
        out |= distances(f"__a_{c}", F.abs(last[f"__{c}"] - first[f"__{c}"]), f"_{c}")
        out[f"speed_distribution_{c}"] = F.transform(f"__a_{c}", lambda v: v / time_unit)
        if wanted & {f"msd_{c}", f"alpha_{c}"}:
            t.add(**{f"__msd_{c}": lagged(F.col(f"__p_{c}"), lambda a, b: (b - a) * (b - a))})
            out |= moved(f"__msd_{c}", f"msd_{c}", f"alpha_{c}")
    if wanted & set(ELONGATIONS):
        for kind, of in (("max", lambda c: F.array_max(f"__p_{c}") - F.array_min(f"__p_{c}")), ("total", lambda c: _sum(F.col(f"__a_{c}")))):
            x, y, z = map(of, coords)
            out |= {f"exy_{kind}": _ratio(y, x), f"eyz_{kind}": _ratio(z, y), f"exz_{kind}": _ratio(z, x), f"phi_{kind}": F.cbrt(_ratio(z * z, x * y))}
    columns = [c for n in names for c in ([f"{n}_{k}" for k in range(1, tau_limit + 1)] if n.startswith("msd") or "autocorr" in n else [n])]
    return t.df.select(*key, *[out[c].alias(c) for c in columns])


def aligned_features(df: DataFrame, key: list[str], order: str, coords: list[str], names: list[str], **options) -> DataFrame:
    """`features` of tracks turned to their own axes, the longest named as the first coordinate."""
    turned = register(df, coords, keys=key, time=order)
    return features(turned.select(*key, order, *[F.col(f"Rotated_{c}").alias(c) for c in coords]), key, order, coords, names, **options)
