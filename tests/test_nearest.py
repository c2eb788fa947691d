"""Exact neighbours from packed blocks: against loops, with ties, far apart values and odd vectors, and without shuffled vectors."""

import numpy as np
import pytest

from driftframe.operators import joins, layout, nearest
from driftframe.operators.rounds import Rounds


@pytest.mark.parametrize("kind", ["plain", "grid", "far"])
def test_exact_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "PACKED", 16)
    monkeypatch.setattr(nearest, "MEASURED", 50)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 6)) if kind == "plain" else rng.integers(0, 3, (150, 3)).astype(float)
    if kind == "far":
        v = v * 1e-6 + 1e9 * (np.arange(150) % 2)[:, None] + rng.normal(size=(150, 3))
    df = spark.createDataFrame([(f"i{i:03}", r.tolist()) for i, r in enumerate(v)], "id string, v array<double>").repartition(3)
    for asked in (df, df.where("id < 'i040'")):
        got = {}
        for r in layout._lists(nearest.exact_pairs(asked, df, 7, Rounds(spark)), 7).collect():
            got[int(r.id[1:])] = [(x.distance, int(x.near[1:])) for x in r.near]
        assert len(got) == asked.count()
        for i, near in got.items():
            square = np.zeros(150)
            for c in range(v.shape[1]):
                square += (v[i, c] - v[:, c]) ** 2
            assert near == sorted((d, j) for j, d in enumerate(np.sqrt(square)) if j != i)[:7]


def test_odd_vectors_meet_row_by_row(spark):
    rows = [(i, [float(i % 5), float(i)]) for i in range(60)] + [(60, [1.0, float("nan")]), (61, [2.0, None]), (62, None), (63, [3.0, float("inf")])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    df.createOrReplaceTempView("odd_vectors")
    want = spark.sql("""SELECT query, neighbour, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM (
        SELECT q.id AS query, v.id AS neighbour, sqrt(aggregate(zip_with(q.v, v.v, (a, b) -> (a - b) * (a - b)), 0d, (s, x) -> s + x)) AS distance FROM odd_vectors q JOIN odd_vectors v ON q.id % 10 = 0 AND q.id <> v.id)) WHERE rank <= 4""").collect()
    got = joins.nearest_vectors(df.where("id % 10 = 0"), df, 4).collect()
    assert sorted((r.query, r.neighbour, r.rank) for r in got) == sorted(map(tuple, want)) and len(got) == 7 * 4


def test_vectors_that_do_not_cluster_are_not_shuffled_for_each_cell(spark):
    v = np.random.default_rng(6).normal(size=(900, 24))
    pts = layout.points(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>"))
    lists, recall = layout.neighbours(pts, 10, Rounds(spark), per_cell=30, probes=1)
    assert recall == 1
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for r in lists.collect():
        assert [x.near for x in r.near] == np.argsort(d[r.id])[:10].tolist()
