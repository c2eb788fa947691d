"""Fused transport between two feature tables whose vectors need not share their dimensions.

The coupling is kept in factors, so nothing has a row for each pair. Both sides are reduced to at most
`most` anchors (rows of one label, by nearest mean); a table of no more rows than that is its own
anchors, and then the result is that of the dense rounds. The rounds run on anchors: cost
(1 - alpha) M + alpha G(T), scaled to both marginals with entropy epsilon. With more source rows each
of them then gets its own row over the target's anchors, from its distances to the source's anchors,
and the target's potentials are settled again by Newton steps, a pass over all rows each. Target rows share the mass of
their anchor evenly, so T[i, j] = mass[i][anchor of j] * share of j.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .rounds import Rounds

MOST, LLOYD = 256, 3


@dataclass
class Anchors:
    """Mass (adds up to 1), mean vector, mean score and label of each anchor."""

    mass: np.ndarray
    at: np.ndarray
    score: np.ndarray
    label: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def _nearest(anchors: Anchors, spread: float):
    """The nearest anchor of the row's own label, by vector and score."""

    @F.pandas_udf("int")
    def of(v: pd.Series, score: pd.Series, label: pd.Series) -> pd.Series:
        x = np.concatenate([np.stack(v.to_numpy()) / spread, score.to_numpy(float)[:, None]], 1) if len(v) else np.zeros((0, 1))
        own, out = np.concatenate([anchors.at / spread, anchors.score[:, None]], 1), np.zeros(len(v), np.int32)
        names = label.to_numpy(object)
        for name in set(names):
            mine, rows = np.flatnonzero(anchors.label == name), np.flatnonzero(names == name)
            out[rows] = mine[distances(x[rows], own[mine]).argmin(1)]
        return pd.Series(out)

    return of("v", "score", "label")


def _means(side: DataFrame, n: int) -> Anchors:
    """Of the anchors that have rows; their numbers stay in order."""
    got = side.groupBy("anchor").agg(F.count("*").alias("k"), vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("v"), F.avg("score").alias("score"), F.first("label").alias("label")).orderBy("anchor").collect()  # one row an anchor
    return Anchors(np.array([r.k for r in got]) / n, np.array([r.v for r in got], float), np.array([r.score for r in got], float), np.array([r.label for r in got], object))


def reduce_side(side: DataFrame, rounds: Rounds, name: str, most: int = MOST, lloyd: int = LLOYD) -> tuple[DataFrame, Anchors]:
    """side (id, v, score, label) with `anchor`, and the anchors; rows with a null among them go.

    Anchors are dealt to labels by their rows, one each at least, start from rows by hash and move to
    the mean of their rows `lloyd` times. More labels than `most` are an error.
    """
    side = rounds.keep(side.select("id", F.col("v").cast("array<double>").alias("v"), F.col("score").cast("double").alias("score"), F.col("label").cast("string").alias("label")).dropna(), f"{name}_rows")
    counts = {r.label: r.k for r in side.groupBy("label").agg(F.count("*").alias("k")).limit(most + 1).collect()}
    n = sum(counts.values())
    if len(counts) > most or not n:
        raise ValueError(f"{name}: no rows" if not n else f"{name}: more labels than anchors ({most})")
    if n <= most:
        numbered = rounds.keep(side.withColumn("anchor", F.row_number().over(W.orderBy("id")) - 1), name)  # at most `most` rows
        return numbered, _means(numbered, n)
    # the largest labels give way, so that the sum stays within `most`
    quota = {k: max(1, int(most * c / n)) for k, c in counts.items()}
    while sum(quota.values()) > most:
        quota[max(quota, key=quota.get)] -= 1
    table = side.sparkSession.createDataFrame([(k, q, counts[k]) for k, q in quota.items()], "label string, quota int, k long")
    u = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / float(1 << 30)
    few = side.join(F.broadcast(table), "label").withColumn("u", u).where(F.col("u") * F.col("k") <= 4.0 * F.col("quota") + 20)
    start = few.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("u", "id"))).where("r <= quota").orderBy("label", "r").collect()
    anchors = Anchors(np.full(len(start), 1 / len(start)), np.array([r.v for r in start], float), np.array([r.score for r in start]), np.array([r.label for r in start], object))
    spread = float(np.sqrt(((anchors.at - anchors.at.mean(0)) ** 2).sum(1).mean())) or 1.0
    for _ in range(lloyd):
        anchors = _means(side.withColumn("anchor", _nearest(anchors, spread)), n)
    out = rounds.keep(side.withColumn("anchor", _nearest(anchors, spread)), name)
    held = {r.anchor: i for i, r in enumerate(out.select("anchor").distinct().orderBy("anchor").collect())}
    if len(held) < len(anchors.mass):  # an anchor that lost all its rows
        out = out.withColumn("anchor", F.element_at(F.create_map(*[F.lit(x) for kv in held.items() for x in kv]), F.col("anchor")))
    return out, _means(out, n)


def shared_cost(score: np.ndarray, label: np.ndarray, other: np.ndarray, names: np.ndarray, weight: float) -> np.ndarray:
    """max((s - t)^2, weight where labels differ)."""
    return np.maximum((score[:, None] - other[None]) ** 2, np.where(label[:, None] != names[None], weight, 0.0))


def scale(cost: np.ndarray, p: np.ndarray, q: np.ndarray, epsilon: float, g: np.ndarray | None = None, most: int = 20_000, within: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The entropic plan between p and q and its column potentials: rows and columns scaled in turn.

    Scalings are taken into the potentials when they grow large, so that no kernel entry that matters
    is lost.
    """
    g = np.zeros(len(q)) if g is None else g
    top = ((g[None] - cost) / epsilon).max(1)
    f = -epsilon * (top + np.log(np.exp((g[None] - cost) / epsilon - top[:, None]).sum(1)))
    done = 0
    while True:
        k = np.exp((f[:, None] + g[None] - cost) / epsilon)
        u, v = np.ones(len(p)), np.ones(len(q))
        while done < most:
            done += 1
            u = p / np.maximum(k @ v, 1e-300)
            v = q / np.maximum(k.T @ u, 1e-300)
            if max(np.abs(np.log(u)).max(), np.abs(np.log(v)).max()) > 60:
                break
            if done % 10 == 0 and np.abs(u * (k @ v) - p).sum() < within:
                most = done
        f, g = f + epsilon * np.log(u), g + epsilon * np.log(v)
        if done >= most:
            return np.exp((f[:, None] + g[None] - cost) / epsilon), g


@dataclass
class Plan:
    """A coupling of anchors, its objective after each round, and what rows need for theirs."""

    mass: np.ndarray
    objective: list[float]
    potential: np.ndarray
    structure: np.ndarray  # T C2, applied to a source row's distances


def dense_rounds(m: np.ndarray, c1: np.ndarray, c2: np.ndarray, p: np.ndarray, q: np.ndarray, alpha: float, epsilon: float, rounds: int = 200, within: float = 1e-9) -> Plan:
    """T scaled on (1 - alpha) M + alpha G(T), from T = p q' until it stays."""
    first, second = (c1 * c1) @ p, (c2 * c2) @ q
    t, g, objective = p[:, None] * q[None], None, []
    for _ in range(rounds):
        applied = t @ c2
        cost = (1 - alpha) * m + 2 * alpha * (first[:, None] + second[None] - 2 * c1 @ applied)
        nxt, g = scale(cost, p, q, epsilon, g)
        moved = np.linalg.norm(nxt - t)
        t = nxt
        square = first @ p + second @ q - 2 * (t * (c1 @ t @ c2)).sum()
        entropy = (t * np.log(np.maximum(t, 1e-300))).sum()
        objective.append(float((1 - alpha) * (m * t).sum() + alpha * square + epsilon * entropy))
        if moved < within:
            break
    return Plan(t, objective, g, applied)


def _row_mass(a: Anchors, b: Anchors, plan: Plan, alpha: float, epsilon: float, weight: float):
    """log of a source row's kernel over the target's anchors, up to a constant of the row."""
    second = (distances(b.at, b.at) ** 2) @ b.mass

    def of(v: np.ndarray, score: np.ndarray, label: np.ndarray) -> np.ndarray:
        m = shared_cost(score, label, b.score, b.label, weight)
        return -((1 - alpha) * m + 2 * alpha * (second[None] - 2 * distances(v, a.at) @ plan.structure)) / epsilon

    return of


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _rows(df: pd.DataFrame):
    return np.stack(df["v"].to_numpy()), df["score"].to_numpy(float), df["label"].to_numpy(object)


@dataclass
class Coupling:
    """left: (id, v, label, mass array over the target's anchors); right: (id, v, anchor, share); T[i, j] = mass[anchor j] * share."""

    left: DataFrame
    right: DataFrame
    plan: Plan
    source: Anchors
    target: Anchors
    gap: float


def fused_transport(source: DataFrame, target: DataFrame, alpha: float = 0.1, epsilon: float = 1.3, weight: float = 100.0, most: int = MOST, rounds: int = 200, passes: int = 40, within: float = 1e-7) -> Coupling:
    """The coupling of source and target, both (id, v, score, label), between uniform weights.

    Scores are compared across sides (standardise them first), vectors within a side only. Rows with a
    null go, so that weights are uniform over the others; equal rows and ids count each. An empty side
    is an error. `gap` is the sum over anchors by which the column sums miss their marginal.
    """
    written = Rounds(source.sparkSession)
    left, a = reduce_side(source, written, "source", most)
    right, b = reduce_side(target, written, "target", most)
    plan = dense_rounds(shared_cost(a.score, a.label, b.score, b.label, weight), distances(a.at, a.at), distances(b.at, b.at), a.mass, b.mass, alpha, epsilon, rounds)
    n = left.count()
    kernel, g, width = _row_mass(a, b, plan, alpha, epsilon, weight), plan.potential, len(b.mass)
    best, gap = g, np.inf
    for _ in range(passes):

        def columns(batches, g=g):
            held, both = np.zeros(width), np.zeros((width, width))
            for df in batches:
                if len(df):
                    s = _softmax(kernel(*_rows(df)) + g / epsilon)
                    held, both = held + s.sum(0) / n, both + s.T @ s / n
            at = np.flatnonzero(both > 1e-18)
            yield pd.DataFrame({"anchor": at // width, "other": at % width, "k": both.ravel()[at]})
            yield pd.DataFrame({"anchor": np.arange(width), "other": np.full(width, -1), "k": held})

        sums = left.select("v", "score", "label").mapInPandas(columns, "anchor int, other int, k double").groupBy("anchor", "other").agg(F.sum("k").alias("k")).toPandas()  # at most most * (most + 1) rows
        one = sums["other"] < 0
        held, both = np.zeros(width), np.zeros((width, width))
        held[sums["anchor"][one]] = sums["k"][one]
        both[sums["anchor"][~one], sums["other"][~one]] = sums["k"][~one]
        now = float(np.abs(held - b.mass).sum())
        if now < gap:
            # Newton's step on the column sums, of at most 4 epsilon
            best, gap = g, now
            step = np.linalg.lstsq(np.diag(held) - both, b.mass - held, rcond=1e-11)[0]
            step *= min(1, 4 / max(np.abs(step).max(), 1e-300))
        else:
            step = np.log(b.mass / np.maximum(held, 1e-300))
            gap = np.inf if now > 2 * gap else gap
        if gap < within:
            break
        g = g + epsilon * step
    g = best

    def masses(batches, g=g):
        for df in batches:
            mass = _softmax(kernel(*_rows(df)) + g / epsilon) / n if len(df) else np.zeros((0, len(g)))
            yield pd.DataFrame({"id": df["id"], "v": df["v"], "label": df["label"], "mass": list(mass)})

    kind = dict(left.dtypes)["id"]
    out = written.keep(left.select("id", "v", "score", "label").mapInPandas(masses, f"id {kind}, v array<double>, label string, mass array<double>"), "coupling")
    size = right.groupBy("anchor").agg(F.count("*").alias("k"))
    return Coupling(out, right.join(F.broadcast(size), "anchor").select("id", "v", "label", "anchor", (1 / F.col("k")).alias("share")), plan, a, b, gap)


def projected(coupling: Coupling) -> DataFrame:
    """(id, label, vector): target rows in the source's space, the mean of source vectors weighted by mass; without mass all 0."""
    width = len(coupling.target.mass)

    def sums(batches):
        held = weight = None
        for df in batches:
            mass, v = np.stack(df["mass"].to_numpy()), np.stack(df["v"].to_numpy())
            held = mass.T @ v + (0 if held is None else held)
            weight = mass.sum(0) + (0 if weight is None else weight)
        if held is not None:
            yield pd.DataFrame({"anchor": np.repeat(np.arange(width), held.shape[1]), "dim": np.tile(np.arange(held.shape[1]), width), "s": held.ravel(), "w": np.repeat(weight, held.shape[1])})

    mean = coupling.left.select("v", "mass").mapInPandas(sums, "anchor int, dim int, s double, w double").groupBy("anchor", "dim").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    value = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0)
    vector = mean.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", value.alias("x")))), lambda e: e["x"]).alias("vector"))  # a value a dimension
    return coupling.right.join(F.broadcast(vector), "anchor").select("id", "label", "vector")


def structure_terms(side: DataFrame) -> DataFrame:
    """(id, eccentricity): a row's mean squared distance to all rows, the constant part of the structure cost.

    From the means of coordinates and squares, so no pair is formed. Rows with a null vector go.
    """
    side = side.select("id", F.col("v").cast("array<double>").alias("v")).dropna()
    m = side.agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("__m"))
    away = F.aggregate(F.zip_with("v", "__m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    off = side.join(F.broadcast(m)).select("id", away.alias("__d"))
    return off.join(F.broadcast(off.agg(F.avg("__d").alias("__e")))).select("id", (F.col("__d") + F.col("__e")).alias("eccentricity"))
