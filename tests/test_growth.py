"""Steps whose cost must not grow faster than their input: what is exchanged and how often the input is read."""

import itertools
import math
import random
import re

import pyarrow as pa
import pytest

from driftframe.operators import alignment, expression, motility, stats, wide


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moments_copy_no_rows(spark):
    rows = [(k, t, float(t * t % 7 if k else 0), float(t % 3 if k else 0)) for k in range(3) for t in range(9)] + [(9, 0, 1.0, 1.0)]
    out = motility.basic_motility(spark.createDataFrame(rows, "id long, pt long, x double, y double"), ["x", "y"], keys=["id"])
    assert "Expand" not in plan(out)
    got = {r.id: r for r in out.collect()}
    assert got[0].displ_variance is None and got[9].displ_variance is None and got[1].displ_variance > 0


def test_post_hoc_ranks_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(12) + 2 * g)) for g in range(4) for _ in range(50)] + [(1, None)]
    spark.createDataFrame(rows, "g long, x double").write.parquet(f"{tmp_path}/rows")
    out = stats.post_hoc(spark.read.parquet(f"{tmp_path}/rows"), "g", "x")
    assert str(tmp_path) + "/rows" not in plan(out)  # what ranks gave is kept, and the input read no more
    x = sorted(v for _, v in rows if v is not None)
    n, mid = len(x), {v: (2 * x.index(v) + x.count(v) + 1) / 2 for v in set(x)}
    own = {g: [mid[v] for h, v in rows if h == g and v is not None] for g in range(4)}
    spread = n * (n + 1) / 12 - sum(x.count(v) ** 3 - x.count(v) for v in set(x)) / (12 * (n - 1))
    got = {(r.one, r.two): r.z for r in out.collect()}
    assert len(got) == 6
    for (a, b), z in got.items():
        assert z == pytest.approx((sum(own[a]) / 50 - sum(own[b]) / 50) / math.sqrt(spread * (1 / len(own[a]) + 1 / len(own[b]))), abs=1e-9)


def test_over_representation_without_pairs(spark):
    rng = random.Random(6)
    lists = [(rng.choice("abc"), g) for g in range(60) for _ in range(2)] + [("a", 3), ("a", 3), (None, 4)]
    sets = [(rng.randrange(5), g) for g in range(80)] + [(7, 79), (1, 3), (1, 3)]
    out = expression.over_representation(spark.createDataFrame(lists, "list_name string, gene long"), spark.createDataFrame(sets, "set_name long, gene long"), 100)
    assert "sequence(" not in plan(out) and not re.search(r"hashpartitioning\((?:list_name|set_name)#\w+, (?:list_name|set_name)#", plan(out))
    of = lambda rows, k: {g for n, g in rows if n == k}
    want = {}
    for a in "abc":
        for s in {s for s, _ in sets}:
            m, k, h = len(of(lists, a)), len(of(sets, s)), len(of(lists, a) & of(sets, s))
            if h:
                want[a, s] = (h, sum(math.comb(k, i) * math.comb(100 - k, m - i) for i in range(h, min(m, k) + 1)) / math.comb(100, m))
    got = {(r.list_name, r.set_name): (r.hits, r.p) for r in out.collect()}
    assert got.keys() == want.keys()
    for key, (h, p) in want.items():
        assert got[key][0] == h and got[key][1] == pytest.approx(p, rel=1e-10)


def test_tails_at_their_ends(spark):
    rows = [(10, 4, 3, 0), (10, 4, 3, 3), (10, 0, 3, 0), (10, 10, 3, 3), (1_000_000_000, 400_000_000, 1_000_000, 400_500), (2, 4, 3, 1)]
    got = stats.hypergeometric_tails(spark.createDataFrame(rows, "n long, k long, d long, h long"), "n", "k", "d", "h").collect()
    assert [round(r.p_over, 12) for r in got[:4]] == [1, round(4 / 120, 12), 1, 1] and round(got[0].p_under, 12) == round(20 / 120, 12)
    assert got[4].p_over + got[4].p_under == pytest.approx(1, abs=1e-3) and 0.1 < got[4].p_over < 0.2
    assert got[5].p_over is None  # more are marked than there are


def test_turned_in_pieces():
    """A task holds a bounded number of tracks at once, and null or short tracks keep their places in it."""
    rows = [[[float(i + t), 2.0 * t] for t in range(2 + i % 2)] for i in range(2 * alignment.TRACKS + 5)]
    rows[3] = [[None, 1.0], [2.0, 3.0], [4.0, 5.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["__p"])
    pieces = list(alignment._pieces([batch]))
    assert [b.num_rows for b in pieces] == [alignment.TRACKS, alignment.TRACKS, 5]
    seen, before = 0, 0
    for b in pieces:
        first = [0]
        for r in b.column("__p").to_pylist():
            first.append(first[-1] + len(r))
        for own, frames, at in alignment._together(b, 2):
            for r, f, a in zip(own.tolist(), frames.tolist(), at.tolist()):
                assert a == rows[before + r] and f == list(range(first[r], first[r + 1]))
                seen += 1
        before += b.num_rows
    assert seen == len(rows) - 1


def test_markers_exchange_values_by_gene_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, f"g{g}", rng.choice([0.5, 1.0, 1.5, 2.0 + c / 100])) for c in range(12) for g in range(6) if (c + g) % 3]
    rows += [(3, "lone", 1.0)]
    spark.createDataFrame(rows, "cell_id long, gene string, value double").write.parquet(f"{tmp_path}/values")
    cells = spark.createDataFrame([(c, c % 3) for c in range(12)], "cell_id long, cluster long")
    values = spark.read.parquet(f"{tmp_path}/values")
    out = expression.markers(values, cells)
    assert plan(out).count("Exchange hashpartitioning(gene#") == 1 and "hashpartitioning(gene#" in plan(out)
    assert str(tmp_path) + "/values" not in plan(expression.marker_scores(values, cells))
    full = {g: [next((v for c_, h, v in rows if c_ == c and h == g), 0.0) for c in range(12)] for g in {g for _, g, _ in rows}}
    got = {(r.gene, r.cluster): r for r in out.collect()}
    assert len(got) == 3 * len(full)
    for (g, k), r in got.items():
        x = sorted(full[g])
        w = sum((2 * x.index(v) + x.count(v) + 1) / 2 for c, v in enumerate(full[g]) if c % 3 == k)
        assert r.z == pytest.approx((w - 4 * 13 / 2) / math.sqrt(4 * 8 * 13 / 12), abs=1e-9)
        own, rest = sum(v for c, v in enumerate(full[g]) if c % 3 == k) / 4, sum(v for c, v in enumerate(full[g]) if c % 3 != k) / 8
        assert r.logfc == pytest.approx(math.log2((math.expm1(own) + 1e-9) / (math.expm1(rest) + 1e-9)), abs=1e-9)


def test_blocks_are_cut_once(spark):
    """An entry costs the same in blocks of any size: a block is cut once and handed on with its mean, and points of a line are made once."""
    rng = random.Random(8)
    at = [0.0]
    for k in range(700):
        at.append(at[-1] + rng.gauss(0, 1 + k % 5))
    out = wide.features(spark.createDataFrame(list(enumerate(at)), "t long, x double").selectExpr("1L as id", "t", "x"), ["id"], "t", ["x"], ["displ_hurst_RS_x", "alpha_x"])
    assert len(re.findall(r"slice\(__a_x#", plan(out))) == 1
    assert plan(out).count("isnotnull(lambda") == 1
    slope = lambda p: (sum(x * y for x, y in p) / len(p) - (mx := sum(x for x, _ in p) / len(p)) * (sum(y for _, y in p) / len(p))) / (sum(x * x for x, _ in p) / len(p) - mx * mx)
    v, points = [abs(b - a) for a, b in zip(at, at[1:])], []
    for i in range(int(math.log2(len(v))) - 1):
        w, rs = len(v) // 2**i, []
        for block in (v[b * w : b * w + w] for b in range(len(v) // w)):
            y = list(itertools.accumulate(u - sum(block) / w for u in block))
            rs.append((max(y) - min(y)) / math.sqrt(sum((u - sum(block) / w) ** 2 for u in block) / w))
        points.append((math.log(w), math.log(sum(rs) / len(rs))))
    msd = [sum((b - a) ** 2 for a, b in zip(at, at[k:])) / (len(at) - k) for k in range(1, len(at))]
    got = out.first()
    assert got.displ_hurst_RS_x == pytest.approx(slope(points), abs=1e-9)
    assert got.alpha_x == pytest.approx(slope([(math.log(k + 1), math.log(m)) for k, m in enumerate(msd)]), abs=1e-9)
