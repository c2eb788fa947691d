"""Neighbours, fuzzy neighbour graph and two-dimensional layout of a table of vectors.

Equal vectors are one point, named by their smallest id, and share its place in the layout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nearest import Best, exact_pairs
from .rounds import Rounds

#: Points of a cell on average, points and queries of one task's part of it, cells at most and sampled points a cell.
PER_CELL, BLOCK, CELLS, SAMPLED = 512, 1024, 4096, 16
#: Points that one task lays out, points that repel, epochs between two synchronisations.
TOGETHER, REPEL, EPOCHS = 2048, 4096, 25


def points(df: DataFrame) -> DataFrame:
    """(id, v, copies): the different vectors of (id, v); null, empty and non-finite ones go, and so do null ids."""
    v = F.col("v").cast("array<double>")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select("id", v.alias("v")).where(F.col("id").isNotNull() & fine).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies")


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _bounds(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the distances from rows of v to the centres; rounding is inside them."""
    middle = centres.mean(0)
    q, c = v - middle, centres - middle
    qq, cc = (q * q).sum(1)[:, None], (c * c).sum(1)
    slack = (v.shape[1] + 16) * 1e-15 * (qq + cc.max()) + 1e-300
    square = qq - 2 * q @ c.T + cc
    return np.sqrt(np.maximum(square - slack, 0)), np.sqrt(np.maximum(square, 0) + slack)


def _open(low: np.ndarray, radius: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which cells may hold a point as near as the k-th: none does where the centre's distance less the radius is over it."""
    kth = kth[:, None]
    return ~(low - radius > kth + 1e-12 * (low + radius + kth)) & (radius >= 0)


def _dealt(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number as often as it has parts, and the parts' numbers."""
    rows = np.repeat(np.arange(len(parts)), parts)
    return rows, (np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.int32)


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(id, near array of (distance, near)): the k first of each id, ties by id."""
    return pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "near"))), 1, k).alias("near"))


def centres_of(pts: DataFrame, n: int, per_cell: int, seed: int) -> np.ndarray:
    """Means of a coarse k-means on a bounded sample; one for few points."""
    cells = min(CELLS, -(-n // per_cell))
    share = min(1.0, SAMPLED * cells / n)
    if cells == 1:
        return np.zeros((1, 1))
    thin = pts.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").collect()
    x = np.array([r.v for r in thin])
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(5):
        own = np.concatenate([_square(x[lo : lo + 4096], at).argmin(1) for lo in range(0, len(x), 4096)])
        held = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], at)
    return at


def neighbours(pts: DataFrame, k: int, rounds: Rounds, per_cell: int = PER_CELL, probes: int = 4, audited: int = 256, seed: int = 3) -> tuple[DataFrame, float]:
    """(id, near) for every point of (id, v): its k nearest others as (distance, near), ties by id, and the audited recall.

    Points lie in the cells of a coarse k-means (fitted on a bounded sample). A point looks into its `probes`
    nearest cells and then into every other one that may hold a point as near as its k-th so far, which the centre's
    distance and the cell's radius tell, so that no neighbour is lost. The lists of `audited` points, chosen by
    hash, are found among all points first: if they would look into over four times `probes` cells each, or into half
    of all, the vectors do not cluster, and every point meets every other one (`nearest.exact_pairs`), as the
    cells would shuffle a copy of a vector each. A full cell is searched in several parts.
    """
    pts = rounds.keep(pts.select("id", "v"), "points")
    n, kind = pts.count(), dict(pts.dtypes)["id"]
    if n < 2:
        return pts.select("id", F.array().cast(f"array<struct<distance:double,near:{kind}>>").alias("near")).limit(0), 1.0

    def all_pairs() -> tuple[DataFrame, float]:
        return rounds.keep(_lists(exact_pairs(pts, pts, k, rounds), k), "neighbours"), 1.0

    if n <= max(per_cell, k + 1):
        return all_pairs()
    centres = centres_of(pts, n, per_cell, seed)
    probes = min(probes, len(centres))
    found = T.StructType.fromDDL(f"id {kind}, near {kind}, distance double")

    def parts(rows: pd.DataFrame, size: int = 1024):
        for lo in range(0, len(rows), size):
            part = rows[lo : lo + size]
            yield part, np.stack(part["v"].to_numpy())

    def home(batches):
        for df in batches:
            for part, v in parts(df):
                _, high = _bounds(v, centres)
                cell = high.argmin(1)
                probed = np.argpartition(high, probes - 1, axis=1)[:, :probes]
                yield part.assign(cell=cell, far=high[np.arange(len(v)), cell], cells=list(probed))

    homed = rounds.keep(pts.mapInPandas(home, f"id {kind}, v array<double>, cell long, far double, cells array<long>"), "homed")
    size, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
    for r in homed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        size[r.cell], radius[r.cell] = r.n, r.far if r.far == r.far else np.inf
    own_parts = np.maximum(1, -(-size // BLOCK))

    chosen = pts.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(audited).collect()
    asked, names = np.array([r.v for r in chosen]), np.array([r.id for r in chosen])

    def exact(batches):
        best = Best(names, asked, k)
        for df in batches:
            for part, v in parts(df):
                best.meet(part["id"].to_numpy(), v)
        yield best.found()

    truth = {r.id: r.near for r in _lists(pts.mapInPandas(exact, found), k).collect()}  # `audited` lists
    looks = _open(_bounds(asked, centres)[0], radius, np.array([truth[i][-1].distance for i in names.tolist()])).sum(1).mean()
    if looks > min(4 * probes, len(centres) / 2):
        return all_pairs()

    def looked(asks: DataFrame) -> DataFrame:
        """The k nearest that points (id, v, cells) find in each part of these cells."""
        asking = np.zeros(len(centres), np.int64)
        for r in asks.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # a number a cell
            asking[r.cell] = r["count"]
        ask_parts = -(-asking // (4 * BLOCK))  # none where no point asks

        def copies(df, cell, own, ask, rows, query):
            for i in range(0, len(rows), TOGETHER):  # a task holds so many copies at once
                at = slice(i, i + TOGETHER)
                r = rows[at]
                yield pd.DataFrame({"cell": cell[at], "own": own[at], "ask": ask[at], "query": query, "id": df["id"].to_numpy()[r], "v": df["v"].to_numpy()[r]})

        def salted(df):
            return pd.util.hash_array(df["id"].to_numpy()) >> np.uint64(8)

        def held(batches):
            for df in batches:
                if len(df):
                    cell = df["cell"].to_numpy()
                    rows, ask = _dealt(ask_parts[cell])
                    own = (salted(df) % own_parts[cell].astype(np.uint64)).astype(np.int32)
                    yield from copies(df, cell[rows], own[rows], ask, rows, False)

        def sent(batches):
            for df in batches:
                if len(df):
                    row, cell = np.repeat(np.arange(len(df)), df["cells"].map(len)), np.concatenate(list(df["cells"]))
                    at, own = _dealt(own_parts[cell])
                    ask = (salted(df)[row] % ask_parts[cell].astype(np.uint64)).astype(np.int32)
                    yield from copies(df, cell[at], own, ask[at], row[at], True)

        def search(group: pd.DataFrame) -> pd.DataFrame:
            query = group["query"].to_numpy(bool)
            if query.all() or not query.any():
                return pd.DataFrame({"id": group["id"][:0], "near": group["id"][:0], "distance": np.zeros(0)})
            v, ids = np.stack(group["v"].to_numpy()), group["id"].to_numpy()
            best = Best(ids[query], v[query], k)
            best.meet(ids[~query], v[~query])
            return best.found()

        copied = f"cell long, own int, ask int, query boolean, id {kind}, v array<double>"
        both = homed.select("id", "v", "cell").mapInPandas(held, copied).unionByName(asks.mapInPandas(sent, copied))
        return both.groupBy("cell", "own", "ask").applyInPandas(search, found)

    def rest(batches):
        for df in batches:
            for part, v in parts(df):
                may = _open(_bounds(v, centres)[0], radius, part["kth"].to_numpy())
                np.put_along_axis(may, np.stack(part["cells"].to_numpy()), False, 1)
                yield part[["id", "v"]].assign(cells=[np.flatnonzero(m) for m in may])

    lists = rounds.keep(_lists(looked(homed.select("id", "v", "cells")), k), "probed")
    kth = F.coalesce(F.when(F.size("near") == k, F.element_at("near", -1)["distance"]), F.lit(float("inf")))
    late = homed.select("id", "v", "cells").join(lists, "id", "left").select("id", "v", "cells", kth.alias("kth"))
    late = rounds.keep(late.mapInPandas(rest, f"id {kind}, v array<double>, cells array<long>").where(F.size("cells") > 0), "late")
    pairs = lists.select("id", F.explode("near").alias("e")).select("id", "e.near", "e.distance")
    lists = rounds.keep(_lists(pairs.unionByName(looked(late)), k), "neighbours")
    got = lists.where(F.col("id").isin(names.tolist())).collect()
    right = sum(len({x.near for x in truth[r.id]} & {x.near for x in r.near}) for r in got)
    return lists, right / sum(map(len, truth.values()))


def membership(lists: DataFrame, k: int, steps: int = 64) -> DataFrame:
    """(id, near, distance, weight): exp(-max(0, d - rho) / sigma) along each list.

    rho is the distance to the nearest other point; sigma is found by bisection, so that a list's
    weights add up to log2 of k (of its length, if that is less).
    """

    @F.pandas_udf("array<double>")
    def weights(d: pd.Series) -> pd.Series:
        if not len(d):
            return pd.Series([], dtype=object)
        size = d.map(len).to_numpy()
        x = np.full((len(d), max(1, size.max())), np.inf)
        x[np.arange(x.shape[1]) < size[:, None]] = np.concatenate(list(d))
        over = np.maximum(x - np.where(x > 0, x, np.inf).min(1, keepdims=True), 0)
        over[np.isnan(over)] = 0
        over[x == np.inf] = np.inf
        lo, hi = np.zeros(len(d)), np.full(len(d), np.inf)
        sigma, want = np.ones(len(d)), np.log2(np.maximum(1, np.minimum(k, size)))
        for _ in range(steps):
            much = np.exp(-over / sigma[:, None]).sum(1) > want
            hi, lo = np.where(much, sigma, hi), np.where(much, lo, sigma)
            sigma = np.where(np.isinf(hi), sigma * 2, (lo + np.where(np.isinf(hi), 0, hi)) / 2)
            sigma = np.maximum(sigma, 1e-300)
        w = np.exp(-over / sigma[:, None])
        return pd.Series([w[i, :n] for i, n in enumerate(size)])

    w = lists.select("id", "near", weights(F.transform("near", lambda e: e["distance"])).alias("w"))
    return w.select("id", F.explode(F.arrays_zip("near", "w")).alias("e")).select("id", F.col("e.near.near").alias("near"), F.col("e.near.distance").alias("distance"), F.col("e.w").alias("weight"))


def union(edges: DataFrame) -> DataFrame:
    """(a, b, weight, sides): one row for each pair that one or both name, a < b; p + q - p q of the two weights."""
    up = F.col("id") < F.col("near")
    both = edges.groupBy(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).agg(F.coalesce(F.max(F.when(up, F.col("weight"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(~up, F.col("weight"))), F.lit(0.0)).alias("q"), F.count("*").alias("sides"))
    return both.select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("weight"), "sides")


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b), fitted by least squares to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    at, damp, log = np.zeros(2), 1e-2, np.log(d)  # logarithms of a and b

    def off(at):
        return 1 / (1 + np.exp(at[0] + 2 * np.exp(at[1]) * log)) - y

    for _ in range(200):
        e = off(at)
        f = e + y
        j = np.stack([-f * (1 - f), -f * (1 - f) * 2 * np.exp(at[1]) * log], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ e)
        better = (off(at + step) ** 2).sum() < (e**2).sum()
        at, damp = (at + step, damp / 3) if better else (at, damp * 5)
    return float(np.exp(at[0])), float(np.exp(at[1]))


def _start(pts: DataFrame) -> DataFrame:
    """(id, x, y): the first two principal components, at most 10 from the middle."""
    v = pts.select("id", array_to_vector("v").alias("v"))
    size = len(pts.first().v)
    p = vector_to_array("p")
    if size > 1:
        out = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("id", p[0].alias("x"), p[1].alias("y"))
    else:
        out = pts.select("id", F.col("v")[0].alias("x"), F.lit(0.0).alias("y"))
    m = out.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max("x").alias("hx"), F.min("x").alias("lx"), F.max("y").alias("hy"), F.min("y").alias("ly")).first()
    half = max(m.hx - m.lx, m.hy - m.ly) / 2 or 1.0
    return out.select("id", ((F.col("x") - m.mx) * 10 / half).alias("x"), ((F.col("y") - m.my) * 10 / half).alias("y"))


def _move(at: np.ndarray, own: np.ndarray, other: np.ndarray, weight: np.ndarray, far: np.ndarray, a: float, b: float, times: range, total: int, rng: np.random.Generator, negatives: int = 5, rate: float = 1.0) -> np.ndarray:
    """Coordinates after some epochs; edges lead from a row of `at` to another, where `far` ones stay in place."""
    n = len(at)
    at, degree = np.concatenate([at, far]), np.bincount(own, minlength=n).astype(float)
    for t in times:
        step = rate * (1 - t / total)
        use = rng.random(len(own)) < weight
        i, j = own[use], other[use]
        d = at[i] - at[j]
        square = (d * d).sum(1)
        pull = np.where(square > 0, -2 * a * b * square ** (b - 1) / (1 + a * square**b), 0)
        move = np.clip(pull[:, None] * d, -4, 4)
        out = np.zeros_like(at)
        np.add.at(out, i, move)
        np.add.at(out, j, -move)
        for _ in range(negatives):
            d = at[i] - at[rng.integers(0, len(at), len(i))]
            square = (d * d).sum(1)
            push = 2 * b / ((0.001 + square) * (1 + a * square**b))
            np.add.at(out, i, np.where(square[:, None] > 0, np.clip(push[:, None] * d, -4, 4), 0))
        # a point moves by the mean of what its edges ask of it, so that no epoch overshoots
        at[:n] += step * out[:n] / np.maximum(1, degree[:, None] / 4)
    return at[:n]


def layout(pts: DataFrame, lists: DataFrame, graph: DataFrame, rounds: Rounds, min_dist: float = 0.1, times: int = 8, seed: int = 0) -> DataFrame:
    """(id, x, y): points drawn together along the graph and pushed off a sample of all, `times` rounds of EPOCHS.

    Each round cuts the plane into strips of at most about TOGETHER points, alternately by x and by y.
    A task moves the points of its strip; ends of its edges in other strips keep the place they had
    when the round began. Edges belong to the point that lists them, so a point brings its list only.
    """
    a, b = curve(min_dist)
    kind = dict(pts.dtypes)["id"]
    top = graph.agg(F.max("weight")).first()[0]
    named = lists.select("id", F.explode("near").alias("e")).select("id", F.col("e.near").alias("near"))
    weighted = named.withColumn("a", F.least("id", "near")).withColumn("b", F.greatest("id", "near")).join(graph, ["a", "b"])
    edges = rounds.keep(weighted.select("id", "near", (F.col("weight") / F.lit(top) * F.when(F.col("sides") == 1, 2).otherwise(1)).alias("weight")), "edges")
    at = rounds.keep(_start(pts), "at")
    n = at.count()
    strips = -(-n // TOGETHER)
    out = T.StructType.fromDDL(f"id {kind}, x double, y double")
    def mover(push: np.ndarray, r: int):
        def of(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["id", "near"])
            ids, first = np.unique(group["id"].to_numpy(), return_index=True)
            start = group[["x", "y"]].to_numpy()[first]
            own = np.searchsorted(ids, group["id"].to_numpy())
            near = group["near"].to_numpy()
            place = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            inside = ids[place] == near
            outer, which = np.unique(near[~inside], return_index=True)
            halo = group.loc[~inside, ["nx", "ny"]].to_numpy()[which]
            other = np.where(inside, place, len(ids) + np.searchsorted(outer, near) if len(outer) else 0)
            rng = np.random.default_rng([seed, r, int(group["strip"].iloc[0])])
            moved = _move(start, own, other, group["weight"].to_numpy(), np.concatenate([halo, push]), a, b, range(r * EPOCHS, (r + 1) * EPOCHS), times * EPOCHS, rng)
            return pd.DataFrame({"id": ids, "x": moved[:, 0], "y": moved[:, 1]})

        return of

    for r in range(times):
        axis = "xy"[r % 2]
        cuts = sorted(set(at.agg(F.percentile_approx(axis, [k / strips for k in range(1, strips)], F.lit(1000))).first()[0])) if strips > 1 else []
        strip = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(axis))) if cuts else F.lit(0)  # noqa: B023
        placed = at.withColumn("strip", strip)
        few = at.where(F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(1 << 30)) < int(min(1.0, REPEL / n) * (1 << 30))).select("x", "y").collect()  # about REPEL
        push = np.array([(p.x, p.y) for p in few]).reshape(-1, 2)

        there = at.select(F.col("id").alias("near"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        at = rounds.keep(edges.join(there, "near").join(placed, "id").groupBy("strip").applyInPandas(mover(push, r), out), "at")
    return at


def embed(df: DataFrame, k: int = 20, min_dist: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, x, y) for every row of (id, v); rows whose vector is null, empty or not finite, or whose id is null, have no place.

    Rows of equal vectors share one; a table with a single point puts it in the middle.
    """
    rounds = Rounds(df.sparkSession)
    pts = rounds.keep(points(df), "distinct")
    lists, _ = neighbours(pts, k, rounds)
    if lists.isEmpty():
        at = pts.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    else:
        at = layout(pts, lists, rounds.keep(union(membership(lists, k)), "graph"), rounds, min_dist, seed=seed)
    rows = df.select("id", F.col("v").cast("array<double>").alias("v"))
    return rows.join(pts.select("v", F.col("id").alias("point")), "v").join(at.withColumnRenamed("id", "point"), "point").select("id", "x", "y")
