"""Fused transport against dense loops; neighbours, weights, union and layout against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.operators import fused, layout
from driftframe.operators.rounds import Rounds

ROW = "id long, v array<double>, score double, label string"


def side(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    v, score, label = rng.normal(size=(n, d)), rng.normal(size=n), rng.integers(0, 3, n).astype(str).astype(object)
    return v, score, label, spark.createDataFrame([(i, v[i].tolist(), float(score[i]), label[i]) for i in range(n)], ROW)


def full(coupling):
    left, right = coupling.left.toPandas().sort_values("id"), coupling.right.toPandas().sort_values("id")
    return np.stack(left["mass"])[:, right["anchor"]] * right["share"].to_numpy()


def test_fused_transport_is_the_dense_loop(spark):
    (x, s, l, one), (y, t, k, two) = side(spark, 60, 5, 1), side(spark, 40, 3, 2)
    got = fused.fused_transport(one, two)
    far = lambda a: np.sqrt(((a[:, None] - a[None]) ** 2).sum(2))
    c1, c2, p, q, eps = far(x), far(y), np.full(60, 1 / 60), np.full(40, 1 / 40), 1.3
    m = np.maximum((s[:, None] - t[None]) ** 2, 100.0 * (l[:, None] != k[None]))
    plan = np.outer(p, q)
    for _ in range(30):
        grad = 2 * (np.outer((c1**2) @ p, np.ones(40)) + np.outer(np.ones(60), (c2**2) @ q) - c1 @ plan @ (2 * c2).T)
        cost, g, before = 0.9 * m + 0.1 * grad, np.zeros(40), plan
        for _ in range(4000):
            f = -eps * (np.logaddexp.reduce((g[None] - cost) / eps, axis=1) - np.log(p))
            g = -eps * (np.logaddexp.reduce((f[:, None] - cost) / eps, axis=0) - np.log(q))
        plan = np.exp((f[:, None] + g[None] - cost) / eps)
        if np.linalg.norm(plan - before) < 1e-9:
            break
    np.testing.assert_allclose(full(got), plan, atol=1e-9)
    assert all(b <= a + 1e-9 for a, b in zip(got.plan.objective, got.plan.objective[1:]))
    vector = fused.projected(got).toPandas().sort_values("id")
    np.testing.assert_allclose(np.stack(vector["vector"]), plan.T @ x / plan.sum(0)[:, None], atol=1e-6)


def test_anchored_transport_keeps_both_marginals_and_comes_near(spark):
    (x, *_, one), (y, *_, two) = side(spark, 500, 3, 3), side(spark, 300, 2, 4)
    exact, some = fused.fused_transport(one, two, most=512), fused.fused_transport(one, two, most=60)
    a, b = full(exact), full(some)
    assert len(some.source.mass) <= 60 and len(some.target.mass) <= 60 and some.gap < 1e-6
    for plan in (a, b):
        np.testing.assert_allclose(plan.sum(1), 1 / 500, atol=1e-9)
        np.testing.assert_allclose(plan.sum(0), 1 / 300, atol=1e-6)
    assert np.abs(a - b).sum() < 0.5 * np.abs(np.outer(a.sum(1), a.sum(0)) - a).sum()
    first, second = (fused.projected(c).toPandas().sort_values("id") for c in (exact, some))
    assert np.corrcoef(np.stack(first["vector"]).ravel(), np.stack(second["vector"]).ravel())[0, 1] > 0.9


def test_fused_transport_of_awkward_rows(spark):
    rows = [(1, [0.0, 1.0], 0.0, "a"), (1, [0.0, 1.0], 0.0, "a"), (2, None, 0.0, "a"), (3, [1.0, 1.0], None, "a"), (4, [2.0, 1.0], 1.0, None), (None, [5.0, 5.0], 1.0, "b"), (5, [2.0, 2.0], 1.0, "b")]
    one = spark.createDataFrame(rows, ROW).withColumn("anchor", F.lit("clash"))
    got = fused.fused_transport(one, one)
    assert got.left.count() == 3 and got.right.count() == 3
    with pytest.raises(ValueError, match="no rows"):
        fused.fused_transport(one, one.limit(0))
    with pytest.raises(ValueError, match="more labels"):
        fused.fused_transport(one, one, most=1)


def test_structure_terms(spark):
    x, *_, df = side(spark, 50, 4, 5)
    got = fused.structure_terms(df).toPandas().sort_values("id")["eccentricity"]
    np.testing.assert_allclose(got, ((x[:, None] - x[None]) ** 2).sum(2).mean(1), atol=1e-9)


def cloud(n=900, d=8, seed=0):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 6, n)
    v = (rng.normal(size=(6, d)) * 5)[own] + rng.normal(size=(n, d))
    v[40:60] = v[39]  # copies
    return own, v


def brute(v, k):
    """By point (its first row): the k nearest different vectors with distances, ties by row."""
    first = {}
    for i, r in enumerate(map(tuple, v)):
        first.setdefault(r, i)
    ids = np.array(sorted(first.values()))
    d = np.sqrt(((v[ids][:, None] - v[ids][None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    return {int(i): [(d[r, c], int(ids[c])) for c in order[r]] for r, i in enumerate(ids)}


@pytest.mark.parametrize("per_cell, block", [(10_000, 4096), (60, 16)])
def test_neighbours(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(layout, "BLOCK", block)
    _, v = cloud()
    df = spark.createDataFrame([*[(i, r.tolist()) for i, r in enumerate(v)], (None, [1.0] * 8), (1000, None), (1001, []), (1002, [float("nan")] * 8)], "id long, v array<double>")
    rounds = Rounds(spark)
    lists, recall = layout.neighbours(layout.points(df), 10, rounds, per_cell=per_cell, probes=1)
    want, got = brute(v, 10), {r.id: [(x.distance, x.near) for x in r.near] for r in lists.collect()}
    assert got.keys() == want.keys()
    right = np.mean([len({x for _, x in got[i]} & {x for _, x in want[i]}) / 10 for i in want])
    assert recall >= 0.95 and right > 0.93
    if per_cell > 900:
        assert recall == right == 1 and all(np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]]) for i in want)


def test_weights_and_union(spark):
    _, v = cloud(300)
    lists, _ = layout.neighbours(layout.points(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")), 15, Rounds(spark))
    w = layout.membership(lists, 15)
    sums = w.groupBy("id").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).toPandas()
    np.testing.assert_allclose(sums["s"], np.log2(15), atol=1e-6)
    assert (sums["m"] == 1).all()
    one = {(r.id, r.near): r.weight for r in w.collect()}
    both = {(r.a, r.b): (r.weight, r.sides) for r in layout.union(w).collect()}
    assert both.keys() == {(min(k), max(k)) for k in one}
    for (a, b), (weight, sides) in both.items():
        p, q = one.get((a, b), 0.0), one.get((b, a), 0.0)
        assert abs(weight - (p + q - p * q)) < 1e-12 and sides == ((a, b) in one) + ((b, a) in one)


def test_curve():
    assert np.allclose(layout.curve(0.1), (1.577, 0.895), atol=2e-3) and np.allclose(layout.curve(0.5), (0.583, 1.334), atol=2e-3)


def test_layout_keeps_neighbours(spark, monkeypatch):
    monkeypatch.setattr(layout, "TOGETHER", 300)  # three strips
    own, v = cloud()
    df = spark.createDataFrame([*[(i, r.tolist()) for i, r in enumerate(v)], (2000, None)], "id long, v array<double>").withColumn("x", F.lit("clash"))
    got = layout.embed(df, 15).toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(900))
    at = got[["x", "y"]].to_numpy()
    assert np.isfinite(at).all() and (at[39:60] == at[39]).all()
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near, want = np.argsort(d, axis=1)[:, :15], brute(v, 15)
    kept = np.mean([len(set(near[i]) & {x for _, x in want[i]}) / 15 for i in want])
    assert kept > 10 * 15 / 900 and (own[near] == own[:, None]).mean() > 0.95
    again = layout.embed(df, 15).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    assert np.array_equal(at, again)


def test_layout_of_few_points(spark):
    schema = "id long, v array<double>"
    assert layout.embed(spark.createDataFrame([], schema)).count() == 0
    one = layout.embed(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted(map(tuple, one)) == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert layout.embed(spark.createDataFrame([(1, [1.0]), (2, [4.0]), (3, [9.0])], schema)).count() == 3
