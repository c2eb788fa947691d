"""Tracks turned to their own axes, and random-walk fits on them: numpy on thousands of tracks at a time.

One aggregation brings a track's frames together; a task then takes all tracks of a batch that are
equally long as one array (tracks, frames, axes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tracks import SEGMENT

#: Curves fitted together, first values of P, and how often and with how many values the best one is looked at closer.
CURVES, COARSE, CLOSER, FINE = 2000, 120, 4, 16

#: Tracks that a task turns or fits at once.
TRACKS = 1000


def listed(df: DataFrame, columns: list[str], keys: list[str], time: str) -> DataFrame:
    """(keys, __t, __p): a track's times and the values of `columns` frame by frame, in order; one row a track."""
    frames = F.array_sort(F.collect_list(F.struct(time, *columns)))
    out = df.groupBy(*keys).agg(frames.alias("__f"))
    place = F.transform("__f", lambda f: F.array(*[f[c].cast("double") for c in columns]))
    return out.select(*keys, F.transform("__f", lambda f: f[time]).alias("__t"), place.alias("__p"))


def _pieces(batches):
    """The batches of a task cut to TRACKS rows, so that what a task holds does not grow with its tracks."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TRACKS):
            yield batch.slice(lo, TRACKS)


def _together(batch: pa.RecordBatch, axes: int):
    """(rows, frames, array) of the batch's tracks of each length that hold finite numbers only: their places, those of their frames, their coordinates."""
    tracks = batch.column("__p")
    sizes = pc.list_value_length(tracks).to_numpy(zero_copy_only=False)
    flat = tracks.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, axes)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        frames = starts[rows, None] + np.arange(n)
        at = flat[frames]
        fine = np.isfinite(at).all(axis=(1, 2))
        if fine.any():
            yield rows[fine], frames[fine], at[fine]


def turned(at: np.ndarray, mode: str = "displacements") -> np.ndarray:
    """Tracks (m, frames, axes) on their principal axes: of the lag displacements that give the longest extent, or of the positions."""
    mid = at - at.mean(axis=1, keepdims=True)
    spread = lambda p: p.max(axis=1) - p.min(axis=1)
    axes = lambda d: np.linalg.eigh(np.einsum("mti,mtj->mij", d, d))[1]
    if mode == "positions":
        return mid @ axes(mid)[:, :, ::-1]
    best, most = mid.copy(), np.full(len(at), -1.0)
    for lag in range(1, at.shape[1]):
        p = mid @ axes(at[:, lag:] - at[:, :-lag])
        extent = spread(p).max(axis=1)
        more = extent > most + 1e-12
        best[more], most[more] = p[more], extent[more]
    return np.take_along_axis(best, np.argsort(-spread(best), axis=1, kind="stable")[:, None], axis=2)


def register(df: DataFrame, coords: list[str], mode: str = "displacements", reflect: bool = False, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Frames with Rotated_<c>: the track centred and turned to its axes, the longest first.

    With `reflect` tracks start at the origin and axes point where the track goes farther; with mode
    'positions' they start there too. Lengths between frames stay as they are. A track with a null or
    non-finite coordinate has null ones.
    """

    def of(batches):
        for batch in _pieces(batches):
            sizes = pc.list_value_length(batch.column("__p")).to_numpy(zero_copy_only=False)
            out = np.full((int(sizes.sum()), len(coords)), np.nan)
            for _, frames, at in _together(batch, len(coords)):
                p = turned(at, mode)
                if reflect or mode == "positions":
                    p = p - p[:, :1]
                if reflect:
                    p = p * np.where(-p.min(axis=1) > p.max(axis=1), -1.0, 1.0)[:, None]
                out[frames] = p
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(coords), pa.int32()), pa.array(out.ravel(), from_pandas=True))
            turned_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), places)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, "__t")], turned_], [*keys, "__t", "__r"])

    tracks = listed(df.select(*keys, time, *coords), coords, keys, time)
    schema = T.StructType([tracks.schema[c] for c in (*keys, "__t")] + [T.StructField("__r", T.ArrayType(T.ArrayType(T.DoubleType())))])
    frames = tracks.mapInArrow(of, schema).select(*keys, "__r", F.posexplode("__t").alias("__k", time))
    return frames.select(*keys, time, *[F.col("__r")[F.col("__k")][k].alias(f"Rotated_{c}") for k, c in enumerate(coords)])


def squared_displacements(at: np.ndarray) -> np.ndarray:
    """(m, lags, axes): mean squared displacement of every lag along every axis."""
    return np.stack([((at[:, k:] - at[:, :-k]) ** 2).mean(axis=1) for k in range(1, at.shape[1])], axis=1)


def fit_walks(msd: np.ndarray, frames: int, dt: float, speed: float, noise: float, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(S, P, e) of S^2 P (t - P (1 - exp(-t / P))) + 2 e for curves (n, lags) over the lags below lags / share.

    Least squares with variances (wif^2 y), wif = (2 k^2 + 1) / (3 k (N - k + 1)) for lag k of the N
    fitted ones, within 0 <= S <= speed, 0 <= P <= frames * dt, 0 <= e <= noise. For one P the
    model is linear in S^2 and e, whose best values within their bounds are known; P is searched on a
    grid, then closer around the best of it.
    """
    lag = np.arange(1, msd.shape[1] / share)
    t, y = lag * dt, msd[:, : len(lag)] + 1e-30
    w = 1 / (((2 * lag**2 + 1) / (3 * lag * (len(lag) - lag + 1))) ** 2 * y)
    w /= w.max(axis=1, keepdims=True)
    out = np.zeros((3, len(y)))
    for lo in range(0, len(y), CURVES):
        out[:, lo : lo + CURVES] = _fit(t, y[lo : lo + CURVES], w[lo : lo + CURVES], frames * dt, speed**2, noise)
    return out[0], out[1], out[2]


def _fit(t: np.ndarray, y: np.ndarray, w: np.ndarray, top: float, square: float, noise: float) -> np.ndarray:
    def best(p: np.ndarray):
        """Of each curve's values p (n, g): the place of the best, and its S^2 and e."""
        f = p[:, :, None] * (t - p[:, :, None] * -np.expm1(-t / p[:, :, None]))
        dot = lambda a, b: (w[:, None] * a * b).sum(axis=2)
        one, yy = np.ones((1, 1, 1)), y[:, None]
        a, b, c = dot(f, f), 2 * dot(f, one), 4 * dot(one, one)
        u, v = dot(f, yy), 2 * dot(one, yy)
        det = np.where(a * c - b * b > 1e-14 * a * c, a * c - b * b, np.inf)
        tried = [((u * c - v * b) / det, (a * v - u * b) / det)]
        tried += [((u - b * e) / a, np.full_like(a, e)) for e in (0.0, noise)] + [(np.full_like(a, s), (v - b * s) / c) for s in (0.0, square)]
        least, at_s, at_e = np.full(a.shape, np.inf), np.zeros_like(a), np.zeros_like(a)
        for s, e in tried:
            s, e = np.clip(s, 0, square), np.clip(np.broadcast_to(e, a.shape), 0, noise)
            err = (w[:, None] * (f * s[:, :, None] + 2 * e[:, :, None] - yy) ** 2).sum(axis=2)
            less = err < least
            least, at_s, at_e = np.where(less, err, least), np.where(less, s, at_s), np.where(less, e, at_e)
        i, r = least.argmin(axis=1), np.arange(len(p))
        return i, at_s[r, i], at_e[r, i]

    grid = np.broadcast_to(np.geomspace(top * 1e-4, top, COARSE), (len(y), COARSE))
    for k in range(CLOSER + 1):
        i, s, e = best(grid)
        r = np.arange(len(y))
        p, low, high = grid[r, i], grid[r, np.maximum(i - 1, 0)], grid[r, np.minimum(i + 1, grid.shape[1] - 1)]
        grid = np.exp(np.linspace(np.log(low), np.log(high), FINE, axis=1))
        grid = np.concatenate([grid, p[:, None]], axis=1)
        grid.sort(axis=1)
    return np.stack([np.sqrt(s), p, e])


def largest_average_speed(df: DataFrame, coords: list[str], dt: float, keys: list[str] = SEGMENT, time: str = "pt") -> float:
    """The largest of the tracks' average speeds; 0 without a step."""
    p = F.transform("__p", lambda f: f)
    square = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(len(coords))), F.lit(0.0))))
    mean = F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(square), F.lit(0))
    return (listed(df, coords, keys, time).select((mean / dt).alias("v")).where(~F.isnan("v")).agg(F.max("v")).first()[0]) or 0.0


def random_walks(df: DataFrame, coords: list[str], dt: float = 0.5, max_speed: float | None = None, max_noise: float = 1000.0, share: int = 2, keys: list[str] = SEGMENT, time: str = "pt") -> DataFrame:
    """Persistence, speed and diffusion per axis of each registered track, with MSD10 (lag 2), MSD100 (last lag), Dtot and phi.

    Speeds are at most max_speed, by default the largest average speed of all tracks (an aggregation
    of its own). Tracks that leave fewer than two lags to fit, or hold a null or non-finite
    coordinate, have nulls.
    """
    speed = largest_average_speed(df, coords, dt, keys, time) if max_speed is None else max_speed
    names = [f"{v}_{k + 1}" for k in range(len(coords)) for v in ("P", "S", "D")] + ["MSD10", "MSD100", "Dtot", "phi"]

    def of(batches):
        for batch in _pieces(batches):
            got = np.full((batch.num_rows, len(names)), np.nan)
            for rows, _, at in _together(batch, len(coords)):
                if len(np.arange(1, (at.shape[1] - 1) / share)) < 2:
                    continue
                msd = squared_displacements(turned(at))
                m, lags, axes = msd.shape
                s, p, _ = fit_walks(msd.transpose(0, 2, 1).reshape(m * axes, lags), at.shape[1], dt, speed, max_noise, share)
                d = (s * s * p / 4).reshape(m, axes)
                got[rows, : 3 * axes] = np.stack([p.reshape(m, axes), s.reshape(m, axes), d], axis=2).reshape(m, 3 * axes)
                under = d[:, 1] + (axes > 2)
                got[rows, 3 * axes :] = np.stack([msd[:, 1].sum(axis=1), msd[:, -1].sum(axis=1), d[:, 0] + d[:, 1], np.where(under > 0, d[:, 0] / np.where(under > 0, under, 1), np.nan)], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(c) for c in got.T.copy()]], [*keys, *names])

    tracks = listed(df.select(*keys, time, *coords), coords, keys, time)
    schema = T.StructType([tracks.schema[c] for c in keys] + [T.StructField(c, T.DoubleType()) for c in names])
    out = tracks.mapInArrow(of, schema)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in names})
