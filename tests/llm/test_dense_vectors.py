"""Links between vectors of one narrow cone, where buckets and lists tell little."""

import numpy as np

from driftframe.llm import neardup


def test_lone_pairs_inside_a_cone(spark):
    """9300 vectors of 512 numbers, cosines about 0.97, 300 of them with a partner at 0.985: the links are found and the audit says so."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    axis = unit(rng.standard_normal((1, 512)))
    off = lambda n: unit((y := rng.standard_normal((n, 512))) - (y @ axis.T) * axis)
    side = off(9000)
    near = unit(0.5 * side[:300] + np.sqrt(0.75) * off(300))
    x = np.concatenate([np.sqrt(0.97) * axis + np.sqrt(0.03) * side, np.sqrt(0.97) * axis + np.sqrt(0.03) * near])
    true = (unit(x) @ unit(x).T >= 0.98).sum(axis=1) - 1
    assert 500 < true.sum() < 700
    got = neardup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links.to_numpy() <= true).all() and got.n_links.sum() >= 0.95 * true.sum()
    assert got.audited.iloc[0] >= 0.95
    pairs = [(i, int(j)) for i in range(300) for j in np.flatnonzero(unit(x)[i] @ unit(x).T >= 0.98) if j != i]
    assert all(got.component_id[i] == got.component_id[j] for i, j in pairs)


def test_without_a_link_nothing_is_audited(spark):
    rows = [(i, [float(i == j) for j in range(20)], 1) for i in range(20)]
    got = neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.audited is None and r.n_links == 0 and r.kept for r in got)


def test_crowded_ties_join_what_links_join(spark):
    rng = np.random.default_rng(6)
    at = np.cumsum(rng.choice([0.05, 0.15, 0.4], 90))  # angles on a circle: chains with gaps
    v = np.stack([np.cos(at), np.sin(at)], axis=1)
    nodes = spark.createDataFrame([(i, 1, v[i].tolist()) for i in range(90)], "node long, block long, v array<double>")
    side, neardup.SIDE = neardup.SIDE, 16
    try:
        got = neardup.crowded_ties(nodes, nodes.select("node"), 0.98, neardup.Scratch(spark), "t").collect()
    finally:
        neardup.SIDE = side
    link = v @ v.T >= 0.98

    def parts(near):
        label = np.arange(90)
        for _ in range(90):
            label = np.where(near, label, 90).min(axis=1)
        return label

    tied = np.eye(90, dtype=bool)
    for r in got:
        tied[r.a, r.b] = tied[r.b, r.a] = True
    assert (parts(tied) == parts(link)).all()
