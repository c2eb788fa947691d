"""A graph that fits a block takes one round of moves a level."""

from driftframe.operators import expression


def test_a_graph_in_one_block_takes_a_round_a_level(spark, monkeypatch):
    moves, keep = [], expression.Rounds.keep
    monkeypatch.setattr(expression.Rounds, "keep", lambda self, df, name: (name == "moved" and moves.append(1), keep(self, df, name))[1])
    groups, size = 12, 100  # 59,400 edges within groups, twice: over the 50,000 of the former blocks
    edges = spark.sql(f"SELECT g * {size} + i AS one, g * {size} + j AS two, 1.0D AS weight FROM range({groups}) AS a(g), range({size}) AS b(i), range({size}) AS c(j) WHERE i < j UNION ALL SELECT g * {size}, (g + 1) % {groups} * {size}, 1.0D FROM range({groups}) AS d(g)")
    got = expression.communities(edges).collect()
    assert all(r.community == r.id // size * size for r in got) and len(got) == groups * size
    assert len(moves) <= 4
