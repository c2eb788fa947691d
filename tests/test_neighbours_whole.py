"""Neighbours found in cells are all of them: against loops, for flat clouds, far from the origin, with equal distances and an outlier."""

import numpy as np
import pytest

from driftframe.operators import layout
from driftframe.operators.rounds import Rounds


def brute(v, k):
    square = np.zeros((len(v), len(v)))
    for c in range(v.shape[1]):
        square += (v[:, None, c] - v[None, :, c]) ** 2
    d = np.sqrt(square)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(v)), d.shape), d), axis=1)[:, :k]
    return {i: [(d[i, j], int(j)) for j in order[i]] for i in range(len(v))}


@pytest.mark.parametrize("kind, probes", [("flat", 2), ("far", 4), ("grid", 2)])
def test_no_neighbour_is_lost(spark, monkeypatch, kind, probes):
    def never(*_):
        raise AssertionError("these vectors cluster")

    monkeypatch.setattr(layout, "exact_pairs", never)
    monkeypatch.setattr(layout, "BLOCK", 16)
    rng = np.random.default_rng(8)
    v = rng.random((1500, 2))
    if kind == "far":
        v += 1e6
    if kind == "grid":
        v = np.stack(np.divmod(rng.permutation(1500), 40), 1).astype(float)
        v[7] = 1e5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>").repartition(3)
    lists, recall = layout.neighbours(layout.points(df), 10, Rounds(spark), per_cell=50, probes=probes)
    assert recall == 1 and {r.id: [(x.distance, x.near) for x in r.near] for r in lists.collect()} == brute(v, 10)
