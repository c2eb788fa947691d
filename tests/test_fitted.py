"""Invariants of fitted results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftframe.operators import alignment, expression, learning, signals, stats
from driftframe.sources import io
from driftframe.plans import spaces, tables, wide_features  # noqa: F401
from driftframe.plans.features import FITTED
from driftframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(5)
    rows = [("T", str(k), 0, t, *p) for k in range(6) for t, p in enumerate(np.cumsum(rng.normal(size=(20, 3)) * [1, 4, 2], axis=0).tolist())]
    return spark.createDataFrame(rows, "Type string, Label string, seg int, pt int, x double, y double, z double")


@pytest.mark.parametrize("mode, reflect", [("displacements", False), ("displacements", True), ("positions", False)])
def test_register_keeps_distances_and_orders_extents(walks, mode, reflect):
    got = alignment.register(walks, ["x", "y", "z"], mode, reflect).toPandas().sort_values(["Label", "pt"])
    want = walks.toPandas().sort_values(["Label", "pt"])
    for label, a in got.groupby("Label"):
        p, q = a.filter(like="Rotated").to_numpy(), want[want.Label == label][["x", "y", "z"]].to_numpy()
        far = lambda v: np.linalg.norm(v[:, None] - v[None], axis=2)
        np.testing.assert_allclose(far(p), far(q), atol=1e-8)
        if mode == "displacements":
            assert (np.diff(np.ptp(p, axis=0)) <= 1e-9).all()
        if reflect:
            assert (np.abs(p[0]) < 1e-12).all() and (p.max(axis=0) >= -p.min(axis=0) - 1e-12).all()


def test_walk_finds_what_made_the_curve():
    t = np.arange(1, 40) * 0.5
    y = 9.0 * 2.0 * (t - 2.0 * (1 - np.exp(-t / 2.0))) + 0.2
    s, p, e = alignment.fit_walks(np.stack([y, 3 * y]), 40, 0.5, 100.0, 1000.0, 2)
    np.testing.assert_allclose(s, [3, 3 * 3**0.5], rtol=1e-3)
    np.testing.assert_allclose(p, [2, 2], rtol=1e-3)
    np.testing.assert_allclose(e, [0.1, 0.3], rtol=1e-2)


@pytest.mark.parametrize("share, noise, frames", [(2, 1000.0, 20), (3, 0.05, 20), (2, 1000.0, 21), (3, 100.0, 26)])
def test_walks_against_a_dense_grid(share, noise, frames):
    """Noisy tracks: the weighted error is that of a dense grid over P and S with the best e, a point at a time."""
    rng = np.random.default_rng(frames)
    v = np.zeros((6, frames, 2))
    for k in range(1, frames):
        v[:, k] = 0.7 * v[:, k - 1] + rng.normal(size=(6, 2))
    at = v.cumsum(axis=1) + 0.2 * rng.normal(size=v.shape)
    msd = alignment.squared_displacements(at).transpose(0, 2, 1).reshape(12, -1)
    speed = 1.1
    got = np.stack(alignment.fit_walks(msd, frames, 0.5, speed, noise, share), axis=1)
    lag = np.arange(1, msd.shape[1] / share)
    weight = ((2 * lag**2 + 1) / 3 / lag / (len(lag) - lag + 1)) ** 2

    def error(y, s, p, e):
        return float(((s * s * p * (lag * 0.5 - p * (1 - np.exp(-lag * 0.5 / p))) + 2 * e - y) ** 2 / (weight * y)).sum())

    for y, (s, p, e) in zip(msd[:, : len(lag)] + 1e-30, got):
        assert 0 <= s <= speed + 1e-9 and 0 < p <= frames * 0.5 + 1e-9 and 0 <= e <= noise
        own, best = error(y, s, p, e), np.inf
        for q in np.geomspace(frames * 0.5e-3, frames * 0.5, 150):
            f = q * (lag * 0.5 - q * (1 - np.exp(-lag * 0.5 / q)))
            for r in np.linspace(0, speed, 150):
                w = 1 / (weight * y)
                d = np.clip((w * (y - r * r * f)).sum() / (2 * w.sum()), 0, noise)
                best = min(best, error(y, r, q, d))
        assert own <= best * 1.0001 + 1e-12


def test_walks_take_the_largest_average_speed(spark, walks):
    w = walks.toPandas()
    steps = {k: np.linalg.norm(np.diff(g.sort_values("pt")[["x", "y"]].to_numpy(), axis=0), axis=1).mean() / 0.5 for k, g in w.groupby("Label")}
    assert abs(alignment.largest_average_speed(walks, ["x", "y"], 0.5) - max(steps.values())) < 1e-9
    got = alignment.random_walks(walks, ["x", "y"]).toPandas()
    assert len(got) == 6 and (got[["S_1", "S_2"]] <= max(steps.values()) + 1e-9).all().all()
    p = w[w.Label == "0"].sort_values("pt")[["x", "y"]].to_numpy()
    far = ((p[2:] - p[:-2]) ** 2).sum(1).mean()
    row = got.set_index("Label").loc["0"]
    assert abs(row.MSD10 - far) < 1e-9 and abs(row.MSD100 - ((p[-1] - p[0]) ** 2).sum()) < 1e-9
    assert abs(row.Dtot - row.D_1 - row.D_2) < 1e-12 and abs(row.D_1 - row.S_1**2 * row.P_1 / 4) < 1e-12 and abs(row.phi - row.D_1 / row.D_2) < 1e-9


def test_awkward_tracks(spark):
    rows = [("T", "short", 0, t, float(t), 1.0) for t in range(3)] + [("T", "null", 0, t, None if t == 4 else float(t), 1.0) for t in range(20)] + [("T", "still", 0, t, 1.0, 1.0) for t in range(20)]
    df = spark.createDataFrame(rows, "Type string, Label string, seg int, pt int, x double, y double").withColumn("P_1", F.lit("clash"))
    got = alignment.random_walks(df, ["x", "y"]).toPandas().set_index("Label")
    assert got.loc[["short", "null"], "P_1"].isna().all() and got.loc["still", "D_1"] == 0
    turned = alignment.register(df, ["x", "y"]).toPandas()
    assert len(turned) == 43 and turned[turned.Label == "null"]["Rotated_x"].isna().all() and turned[turned.Label == "short"]["Rotated_x"].notna().all()
    empty = df.limit(0)
    assert alignment.random_walks(empty, ["x", "y"]).count() == 0 and alignment.register(empty, ["x", "y"]).count() == 0


def test_components_hold_the_variance(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4))
    df = spark.createDataFrame(pd.DataFrame(a, columns=list("abcd")))
    pcs = np.array(learning.components(df, list("abcd")).toPandas()["pcs"].tolist())
    assert pcs.shape[1] <= 2 and pcs.var(axis=0).sum() > 0.95 * 4


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_queries_return_rows(spark, name):
    assert FITTED[name](spark, SF).count() > 0


def test_entropies_against_loops(spark):
    v = np.random.default_rng(2).normal(size=15)
    df = spark.createDataFrame([("T", k, 0, t, float(x)) for k, s in (("a", v), ("flat", np.ones(15))) for t, x in enumerate(s)], "Type string, Label string, seg int, pt int, v double")
    got = signals.entropies(df, "v", 2).toPandas().set_index("Label")

    def phi(m):
        w = [v[i : i + m] for i in range(len(v) - m + 1)]
        return np.mean([np.log(np.mean([max(abs(a - b)) <= 0.2 * v.std() for b in w])) for a in w])

    assert abs(got.loc["a", "approximate_entropy"] - (phi(2) - phi(3))) < 1e-9
    assert got.loc["flat"].filter(like="entropy").isna().all()


def test_gene_sets(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("S1\tu\tg1\tg2\nS2\tu\tg3\nS3\tu\n")
    assert sorted(map(tuple, io.read_gene_sets(spark, str(tmp_path / "a.gmt")).collect())) == [("S1", "g1"), ("S1", "g2"), ("S2", "g3")]


def test_measures_are_joined_by_key(spark, tmp_path):
    head = "a\nb\nc\nValue,Unit,Category,TrackID,Time,ID\n"
    (tmp_path / "v_Volume.csv").write_text(head + "2.5,um,x,7,1,1\n3.5,um,x,8,1,2\n")
    (tmp_path / "v_Overlapped Ratio=T.csv").write_text(head + "0.25,um,x,8,1,9\n")
    long = io.read_measures(spark, str(tmp_path))
    got = io.widen(long, ["TrackID", "Time"], ["Volume", "Overlapped Ratio=T"]).orderBy("TrackID").collect()
    assert [tuple(r) for r in got] == [(7, 1, 2.5, 0.0), (8, 1, 3.5, 0.25)]


def test_normal_p_and_shape_tracks(spark):
    rows = FITTED["c8_rank_p"](spark, SF).collect()
    assert len(rows) == 10
    for r in rows:
        x = np.linspace(abs(r.z), 12, 200_001)
        assert abs(r.p - 2 * np.trapezoid(np.exp(-x * x / 2), x) / np.sqrt(2 * np.pi)) < 1e-6
    paths = FITTED["m12_shape_motility"](spark, SF).toPandas()
    assert len(paths) == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert (paths.net_distance <= paths.total_distance + 1e-9).all()


def test_ranks_in_parts_match_a_sort(spark):
    rng = np.random.default_rng(3)
    v = pd.DataFrame({"id": range(3000), "g": rng.choice(list("aab"), 3000), "x": np.where(rng.random(3000) < 0.4, 0.0, rng.integers(0, 300, 3000) / 7)})
    df = spark.createDataFrame(v)
    for within in ([], ["g"]):
        got = stats.mid_ranks(df, "x", within).toPandas().sort_values("id")["mid_rank"].to_numpy()
        want = (v.groupby(within)["x"] if within else v["x"]).rank().to_numpy()
        np.testing.assert_allclose(got, want)
    p = v.assign(p=np.where(v.x > 40, np.nan, v.x / 50))[["id", "p"]].dropna()
    got = stats.adjust(spark.createDataFrame(p), "p", ["id"]).toPandas().sort_values(["p", "id"])
    q = got.p.to_numpy() * len(got) / np.arange(1, len(got) + 1)
    np.testing.assert_allclose(got.adjusted, np.minimum.accumulate(q[::-1])[::-1])
    assert stats.mid_ranks(df.where("false"), "x").count() == 0
    assert stats.adjust(spark.createDataFrame(p).where("false"), "p", ["id"]).count() == 0


def test_whole_gene_sets_against_loops(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_returnflag", "l_linenumber").toPandas()
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    lists, sets = {}, {}
    for sup, part, flag, line in rows.itertuples(index=False):
        a, b = sorted((top(sup), top(part + 1000000)))
        parent[b] = a
        lists.setdefault(f"{flag}{line}", set()).add(part)
        sets.setdefault(sup, set()).add(part)
    assert {r.id: r.component for r in FITTED["r9_components"](spark, SF).collect()} == {x: top(x) for x in parent}
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    got = {(r.list_name, r.set_name): r for r in QUERIES["r8_over_representation"][0](spark, SF).collect()}
    assert {k: r.hits for k, r in got.items()} == {(a, b): len(x & y) for a, x in lists.items() for b, y in sets.items() if x & y}
    for (a, b), r in got.items():
        m, k = len(lists[a]), len(sets[b])
        tail = sum(math.comb(k, x) * math.comb(n - k, m - x) for x in range(r.hits, min(m, k) + 1)) / math.comb(n, m)
        assert abs(r.p - tail) < 1e-5


def test_tails_at_tabled_values():
    for h, d, p in [(3.841459, 1, 0.05), (9.487729, 4, 0.05), (18.307038, 10, 0.05), (0.711, 4, 0.9500), (0, 3, 1.0)]:
        assert abs(stats.gamma_tail(d / 2, h / 2) - p) < 1e-4
    for t, d, p in [(2.570582, 5, 0.05), (12.7062, 1, 0.05), (1.959964, 1e8, 0.05), (0.0, 7, 1.0), (3.169273, 10, 0.01)]:
        assert abs(stats.beta_share(d / 2, 0.5, d / (d + t * t)) - p) < 1e-6
    for f, a, b, p in [(3.4780, 4, 10, 0.05), (5.9943, 4, 10, 0.01), (0.0, 3, 9, 1.0)]:
        assert abs(stats.beta_share(b / 2, a / 2, b / (b + a * f)) - p) < 1e-5


def test_tests_of_nulls_and_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 2.0), ("c", None), ("b", 1.0)], "g string, x double")
    assert [tuple(r) for r in stats.dunn(df, "g", "x").collect()] == [("a", "b", None)]
    got = stats.dunn(df, "g", "x").withColumn("p", stats.t_p("z", stats.F.lit(3))).first()
    assert got.p is None
    assert stats.dunn(df.where("false"), "g", "x").count() == 0


def test_communities_are_the_cliques_of_a_ring(spark):
    rows = [(6 * c + i, 6 * c + j, 1.0) for c in range(4) for i in range(6) for j in range(i)]
    rows += [(6 * c, (6 * c + 7) % 24, 0.2) for c in range(4)]
    rows += [(100, 101, 2.0), (5, 5, 9.0), (3, None, 1.0), (1, 2, None)]
    got = {r.id: r.community for r in expression.communities(spark.createDataFrame(rows, "one long, two long, weight double")).collect()}
    assert got == {i: i // 6 * 6 for i in range(24)} | {100: 100, 101: 100}
    assert expression.communities(spark.createDataFrame([], "one long, two long, weight double")).count() == 0
