"""Communities keep a row a node: no edge is a row of a written table, and hubs, repeated edges and both ways of adding up agree."""

import numpy as np
import pytest

from driftframe.operators import expression


def run(spark, edges, **more):
    return {r.id: r.community for r in expression.communities(spark.createDataFrame(edges, "one long, two long, weight double"), **more).collect()}


@pytest.mark.parametrize("block", [1_000_000, 2_000])
def test_no_written_table_has_a_row_an_edge(spark, monkeypatch, block):
    rows, keep = [], expression.Rounds.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(expression.Rounds, "keep", counted)
    edges = [(i, j, 1.0) for i in range(160) for j in range(i) if i // 40 == j // 40] + [(i, (i + 40) % 160, 1.0) for i in (0, 40, 80, 120)]
    assert run(spark, edges, block=block) == {i: i // 40 * 40 for i in range(160)}
    assert rows and max(rows) <= 160  # of 6248 directed edges


def test_loops_and_numpy_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    own = rng.integers(0, 3, 90)
    edges = [(int(i), int(j), float(rng.integers(1, 4))) for i in range(90) for j in range(i) if rng.random() < (0.4 if own[i] == own[j] else 0.05)]
    edges += [(200, int(i), 0.25) for i in range(90)] + [(int(i), 200, 0.25) for i in range(40)]  # a hub, some edges both ways
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # nodes end in later batches
    try:
        got = {}
        for block in (1_000_000, 300):
            for many in (0, 20, 1_000):
                monkeypatch.setattr(expression, "MANY", many)
                got[block, many] = run(spark, edges, block=block)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for block in (1_000_000, 300):
        assert got[block, 0] == got[block, 20] == got[block, 1_000] and len(got[block, 0]) == 91


def test_packed_rows(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 6, 200), rng.integers(0, 9, 200), rng.integers(1, 5, 200))]
    edges += [(50, b, 1.0) for b in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = {r.a: (r.k, dict(zip(r.near, r.w))) for r in expression._packed(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for a, b, w in edges:
        want.setdefault(a, {})[b] = want.setdefault(a, {}).get(b, 0.0) + w
    assert got == {a: (sum(m.values()), m) for a, m in want.items()}
