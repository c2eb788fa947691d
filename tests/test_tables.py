"""Nearest zones, quantiles of groups, corrections within groups and communities against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftframe.operators import expression, maps, ordering, stats, voxels
from driftframe.plans.tables import FITTED


def explained(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(v)) for k, n in (("a", 501), ("b", 2), ("c", 1), (None, 30)) for v in rng.integers(0, 40, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("clash", F.lit(1))
    got = ordering.group_quantiles(df, ["g"], "x", {"low": 0.1, "half": 0.5, "high": 0.9, "least": 0.0, "most": 1.0})
    assert "percentile(" not in explained(got) and "median(" not in explained(got)
    got = {r.g: r for r in got.collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g, r in got.items():
        v = [x for k, x in rows if k == g and x is not None]
        np.testing.assert_allclose([r.low, r.half, r.high, r.least, r.most], np.quantile(v, [0.1, 0.5, 0.9, 0, 1]), atol=1e-12)
    assert ordering.group_quantiles(df.limit(0), ["g"], "x", {"half": 0.5}).count() == 0
    zones = voxels.zones(df, ["g"], "x").where("g is null").select("x", "zone").collect()
    low, high = np.quantile([x for k, x in rows if k is None], [0.5, 0.9])
    assert len(zones) == 30 and all(r.zone == (0 if r.x <= low else 2 if r.x >= high else 1) for r in zones)
    curve = maps.binned_curve(df.withColumn("at", F.lit(3.0)), "at", "x", 0.0, 10.0, 20.0, ["g"]).collect()
    assert {r.g for r in curve} == {"a", "b", "c", "d", None} and next(r for r in curve if r.g == "d").median is None


@pytest.mark.parametrize("tile", [0.5, 3.0, 1000.0])
def test_nearest_targets_however_far(spark, tile):
    rng = np.random.default_rng(1)
    points = [(f, i, *map(float, rng.normal(size=3) * s)) for f in range(4) for i, s in enumerate([1, 1, 5, 40, 900] * 5)]
    targets = [(f, *map(float, rng.normal(size=3) * 6 + 20 * f)) for f in (0, 2) for _ in range(60)] + [(2, -500.0, 0.0, 0.0), (0, None, 1.0, 1.0)]
    points += [(0, 77, None, 0.0, 0.0), (None, 78, 0.0, 0.0, 0.0), points[3]]
    p = spark.createDataFrame(points, "t int, id int, x double, y double, z double").withColumn("kx", F.lit("clash"))
    t = spark.createDataFrame(targets, "t int, x double, y double, z double").withColumn("id", F.lit(0))

    def brute(f, at):
        held = np.array([r[1:] for r in targets if r[0] == f and r[1] is not None])
        return None if f is None or None in at or not len(held) else float(np.sqrt(((held - np.array(at)) ** 2).sum(1)).min())

    for carry in (None, "t"):
        got = voxels.nearest_in_frame(p, t, ["t"], tile, carry)
        assert got.columns == [*p.columns, "distance"]
        rows = got.collect()
        assert len(rows) == len(points)
        for r in rows:
            want = brute(r.t if carry is None or r.t is None else r.t // 2 * 2, (r.x, r.y, r.z))
            assert (want is None) == (r.distance is None) and (want is None or abs(want - r.distance) < 1e-9)
    assert voxels.nearest_in_frame(p, t.limit(0), ["t"], tile).where("distance is not null").count() == 0


def test_adjusting_within_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(p)) for g, n in (("a", 40), (None, 7), ("b", 1)) for i, p in enumerate(np.round(rng.random(n), 2))] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "g string, id int, p double")
    got = stats.adjust(df, "p", ["id"], within=["g"]).toPandas()
    capped = stats.adjust(df, "p", ["id"], "bonferroni", ["g"]).toPandas()
    assert len(got) == len(capped) == 48
    for g, part in got.groupby("g", dropna=False):
        p = np.sort(part["p"].to_numpy())
        want = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        np.testing.assert_allclose(np.sort(part["adjusted"]), want, atol=1e-12)
        own = capped[capped["g"].isna() if pd.isna(g) else capped["g"] == g]
        np.testing.assert_allclose(own["adjusted"], np.minimum(1, own["p"] * len(own)), atol=1e-12)


def test_tied_mann_whitney_and_gate(spark):
    same = spark.createDataFrame([(g, 1.0) for g in "aabb"], "g string, x double")
    row = stats.mann_whitney(same, "g", "x").first()
    assert row.u == 2 and row.z is None and row.p is None
    apart = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i + 5)) for i in range(10)] + [("c", float(i % 3)) for i in range(10)], "g string, x double")
    row = {(r.one, r.two): r for r in stats.mann_whitney(apart, "g", "x").collect()}[("a", "b")]
    assert row.u == 12.5 and abs(row.p - 0.00509) < 2e-4  # z = (87.5 - 50 - 0.5) / sqrt(100 / 12 * (21 - 30 / 380))
    assert stats.post_hoc(apart, "g", "x").count() == 3
    level = spark.createDataFrame([(g, float(i)) for g in "abc" for i in range(9)], "g string, x double")
    assert stats.post_hoc(level, "g", "x").count() == 0


def modularity(edges, member, resolution=1.0):
    total = 2 * sum(w for *_, w in edges)
    inside = sum(2 * w for a, b, w in edges if member[a] == member[b]) / total
    held = {}
    for a, b, w in edges:
        for v in (a, b):
            held[member[v]] = held.get(member[v], 0) + w
    return inside - resolution * sum((k / total) ** 2 for k in held.values())


def sequential(edges, rng):
    """Plain greedy moves, level by level, nodes in random order."""
    nodes = sorted({v for e in edges for v in e[:2]})
    member, now = {v: v for v in nodes}, edges
    while True:
        ids = sorted({v for e in now for v in e[:2]})
        at, total = {v: v for v in ids}, 2 * sum(w for *_, w in now)
        degree = {v: sum(w * ((a == v) + (b == v)) for a, b, w in now) for v in ids}
        moved = any_moved = True
        while moved:
            moved = False
            for v in rng.permutation(ids).tolist():
                gain = {}
                for a, b, w in now:
                    if a != b and v in (a, b):
                        o = at[b if a == v else a]
                        gain[o] = gain.get(o, 0) + w
                gain.setdefault(at[v], 0)
                score = {c: g - degree[v] * sum(degree[u] for u in ids if at[u] == c and u != v) / total for c, g in gain.items()}
                best = max(sorted(score), key=lambda c: (round(score[c], 12), c == at[v]))
                if best != at[v]:
                    at[v], moved = best, True
        any_moved = any(at[v] != v for v in ids)
        member = {v: at[c] for v, c in member.items()}
        if not any_moved:
            return member
        joined = {}
        for a, b, w in now:
            k = tuple(sorted((at[a], at[b])))
            joined[k] = joined.get(k, 0) + w
        now = [(*k, w) for k, w in joined.items()]


@pytest.mark.parametrize("block", [50_000, 60])
def test_communities_are_no_worse_than_sequential_ones(spark, block):
    """A sequential run depends on its order: over three graphs the modularity is at least the mean of four orders of each."""
    ours, others = [], []
    for seed in (7, 8, 9):
        rng = np.random.default_rng(seed)
        own = rng.integers(0, 4, 40)
        edges = [(i, j, float(rng.integers(1, 4))) for i in range(40) for j in range(i) if rng.random() < (0.5 if own[i] == own[j] else 0.05)]
        got = {r.id: r.community for r in expression.communities(spark.createDataFrame(edges, "one long, two long, weight double"), block=block).collect()}
        want = [sequential(edges, rng) for _ in range(4)]
        assert got.keys() == want[0].keys() and all(c == min(v for v in got if got[v] == c) for c in got.values())
        ours.append(modularity(edges, got))
        others.append(np.mean([modularity(edges, w) for w in want]))
    print(ours, others)
    assert np.mean(ours) >= np.mean(others) - (1e-9 if block > 1000 else 0.02)


def test_set_communities(spark):
    got = FITTED["r9_communities"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.community >= r.component and r.label.startswith(f"Component_{r.component}_Community_") for r in got)
    sets = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, None), (4, "c"), (5, "c"), (5, "d"), (6, "d"), (7, None)], "set_name long, gene string")
    got = {r.set_name: r.component for r in expression.set_communities(sets).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4, 6: 4}


def test_marker_table_and_enrichment(spark):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(i, "one" if i < 30 else "two") for i in range(60)], "cell_id long, cluster string")
    rows = [(i, f"g{g}", float(rng.random() + (2 if g == 3 and i < 30 else 0))) for i in range(60) for g in range(8) if rng.random() < 0.7]
    t = expression.marker_table(spark.createDataFrame(rows, "cell_id long, gene string, value double"), cells)
    got = t.toPandas()
    assert len(got) == 16
    for _, part in got.groupby("cluster"):
        order = part.sort_values(["distinctive", "gene"], ascending=[False, True])
        assert order["place"].tolist() == list(range(1, 9))
    top = {(r.cluster, r.place): r.gene for r in expression.top_markers(t, 1).collect()}
    assert top == {("one", 1): "g3", ("two", 1): "g3"}
    sets = spark.createDataFrame([("s", f"x{i}") for i in range(10)] + [("t", f"x{i}") for i in range(90, 100)] + [("t", None)], "set_name string, gene string")
    up, down = (spark.createDataFrame([(f"x{i}",) for i in r] + [(None,), (f"x{r[0]}",)], "gene string") for r in (range(0, 8), range(92, 99)))
    found = {(r.direction, r.set_name): r for r in expression.enriched_sets(up, down, sets, 100).collect()}
    assert found.keys() == {("UP", "s"), ("DOWN", "t")} and found[("UP", "s")].hits == 8


def test_tails_of_many_means():
    # tabled 5 percent points of the studentised range, and of two-sided comparisons with one control
    for q, groups, dof in ((3.877, 3, 10), (4.232, 5, 20), (26.98, 3, 1), (8.331, 3, 2), (3.314, 3, 1e6)):
        assert stats.range_tail(q, groups, dof) == pytest.approx(0.05, abs=1e-4)
    assert stats.many_to_one_tail(2.57, [5, 5], 5, 10) == pytest.approx(0.05, abs=3e-4)
    assert stats.many_to_one_tail(-2.54, [5, 5, 5], 5, 20) == pytest.approx(0.05, abs=3e-4)
    # with two groups both are Student's test
    for q, dof in ((3.0, 1), (2.0, 3), (4.0, 30), (1.0, 5000)):
        one = stats.beta_share(dof / 2, 0.5, dof / (dof + q * q / 2))
        assert stats.range_tail(q, 2, dof) == pytest.approx(one, abs=1e-9) and stats.many_to_one_tail(q / 2**0.5, [7.0], 3.0, dof) == pytest.approx(one, abs=1e-9)
    # unequal groups against draws
    rng, n = np.random.default_rng(4), np.array([3, 8, 5, 12])
    dof = n.sum() - 4
    means = rng.standard_normal((400_000, 4)) / np.sqrt(n)
    s = np.sqrt(rng.chisquare(dof, 400_000) / dof)
    t = (np.abs(means[:, 1:] - means[:, :1]) / np.sqrt(1 / n[1:] + 1 / n[0])).max(axis=1) / s
    assert stats.many_to_one_tail(2.3, list(n[1:]), n[0], dof) == pytest.approx((t >= 2.3).mean(), abs=0.004)
    assert stats.range_tail(0.0, 3, 5) == 1.0 and stats.range_tail(200.0, 3, 50) == pytest.approx(0, abs=1e-12)


def test_post_hoc_of_means(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 12), "b": rng.normal(2, 1, 7), "c": rng.normal(0.2, 1, 20)}
    rows = [(g, float(v), 1) for g, x in groups.items() for v in x] + [("a", None, 1), (None, 3.0, 1), ("d", None, 1)]
    df = spark.createDataFrame(rows, "k string, y double, m int")
    dof = 39 - 3
    within = sum(((x - x.mean()) ** 2).sum() for x in groups.values()) / dof
    got = {(r.one, r.two): r for r in stats.tukey(df, "k", "y").collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for (one, two), r in got.items():
        x, y = groups[one], groups[two]
        q = abs(x.mean() - y.mean()) / np.sqrt(within / 2 * (1 / len(x) + 1 / len(y)))
        assert r.q == pytest.approx(q) and r.difference == pytest.approx(x.mean() - y.mean()) and r.p == pytest.approx(stats.range_tail(q, 3, dof), abs=1e-9)
    got = {r.g: r for r in stats.dunnett(df, "k", "y", "a").collect()}
    assert got.keys() == {"b", "c"}
    for g, r in got.items():
        t = (groups[g].mean() - groups["a"].mean()) / np.sqrt(within * (1 / len(groups[g]) + 1 / 12))
        assert r.t == pytest.approx(t) and r.p == pytest.approx(stats.many_to_one_tail(t, [7, 20], 12, dof), abs=1e-9)
    alike = df.withColumn("y", F.col("y") - F.when(F.col("k") == "b", F.lit(2.0)).otherwise(F.lit(0.0)))
    assert stats.tukey(alike, "k", "y").count() == 0 and stats.dunnett(alike, "k", "y", "a").count() == 0 and stats.tukey(alike, "k", "y", 1.0).count() == 3
    assert stats.dunnett(df, "k", "y", "none").count() == 0
    for few in (df.limit(0), df.where("k = 'a'"), df.where("k = 'd'"), df.withColumn("y", F.lit(1.0))):
        assert stats.tukey(few, "k", "y").count() == 0 and stats.dunnett(few, "k", "y", "a").count() == 0
