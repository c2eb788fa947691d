"""More registered queries: resampling, track features, comparisons, joins and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalar
from ..operators import alignment, expression, joins, learning, maps, motility, ranking, signals, stats, tracks, voxels
from .queries import BY, COUNTS, FRAMES, KEY, VOXELS, XYZ, _r, cells, counts, frames, query, read, segments

W_PT = f"WINDOW w AS (PARTITION BY {BY} ORDER BY pt)"
T = '"Type", "Label"'


@query("t4_series", FRAMES + f"SELECT {KEY}, array_to_string(list_transform(range(25), lambda i: coalesce(cast(list(zone ORDER BY pt)[i + 1] AS varchar), '-')), ',') AS padded FROM s GROUP BY {BY}")
def _(s, d):
    out = tracks.as_series(segments(s, d), "zone", 25)
    return out.select(*tracks.SEGMENT, F.array_join("zone", ",", "-").alias("padded"))


@query("t5_moving", FRAMES + f"""SELECT {KEY}, count(*) AS n FROM (
  SELECT *, count(*) FILTER (WHERE b > 0) OVER (PARTITION BY {BY}) AS bent FROM (SELECT *, (zone - lag(zone) OVER w) * (lead(zone) OVER w - zone) AS b FROM s {W_PT})) WHERE bent > 0 GROUP BY {BY}""")
def _(s, d):
    return tracks.keep_moving(segments(s, d), ["zone"], tracks.SEGMENT, "pt").groupBy(*tracks.SEGMENT).agg(F.count("*").alias("n"))


@query("t7_consecutive", """WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, count(*) AS n FROM k GROUP BY 1 HAVING max(l_linenumber) - min(l_linenumber) + 1 = count(*)""")
def _(s, d):
    k = read(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return tracks.keep_consecutive(k, ["l_orderkey"], "l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("t11_frame_numbers", "SELECT c_custkey, c_custkey * 5 + i AS frame FROM customer, (SELECT unnest(range(5)) AS i)")
def _(s, d):
    return tracks.frame_numbers(read(s, d, "customer").select("c_custkey"), "c_custkey", 5)


@query("t12_resampled", f"""WITH e AS (SELECT user_id, event_id, value AS x, cast(regexp_extract(props, '[0-9]+') AS double) AS y, min(event_id) OVER (PARTITION BY user_id) AS o,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS u FROM events),
e2 AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT user_id, unnest(range(0, (max(event_id) - min(event_id)) // 40 + 1)) AS n, min(event_id) AS o FROM events GROUP BY 1),
j AS (SELECT g.user_id, g.n, g.o + 40 * g.n AS t, e2.x, e2.y, dx, dy, (g.o + 40 * g.n - event_id)::double / (u - event_id) AS a FROM g JOIN e2 ON g.user_id = e2.user_id
  AND ((g.o + 40 * g.n > event_id AND g.o + 40 * g.n <= u) OR (g.n = 0 AND event_id = g.o)))
SELECT user_id, n, t AS event_id, {_r('x + a * dx + CASE WHEN abs(dx) >= abs(dy) THEN a * (1 - a) * dx / 2.01::double ELSE 0 END', 'x')},
{_r('y + a * dy + CASE WHEN abs(dx) < abs(dy) THEN a * (1 - a) * dy / 2.01::double ELSE 0 END', 'y')} FROM j""")
def _(s, d):
    e = read(s, d, "events").select("user_id", "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return tracks.resample(e, ["x", "y"], 40, ["user_id"], "event_id").select("user_id", "n", "event_id", "x", "y")


@query("t15_difference", FRAMES + f"SELECT {KEY}, cast(pt AS bigint) AS pt, {_r('dist - lag(dist) OVER w', 'diff_dist')} FROM s {W_PT}")
def _(s, d):
    return tracks.difference(segments(s, d), "dist").select(*tracks.SEGMENT, "pt", "diff_dist")


@query("t16_examples", """SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':0'), c_custkey) AS r FROM customer) WHERE r <= 5""")
def _(s, d):
    return tracks.sample_tracks(read(s, d, "customer"), "c_mktsegment", 5, F.col("c_custkey")).select("c_mktsegment", "c_custkey")


@query("m9_partial_autocorrelation", FRAMES + f""", c AS (SELECT {BY}, pt, step - avg(step) OVER (PARTITION BY {BY}) AS c FROM t WHERE step IS NOT NULL),
a AS (SELECT {BY}, avg(p1) / avg(c * c) AS r1, avg(p2) / avg(c * c) AS r2, avg(p3) / avg(c * c) AS r3 FROM (SELECT *, c * lag(c) OVER w AS p1, c * lag(c, 2) OVER w AS p2, c * lag(c, 3) OVER w AS p3 FROM c {W_PT}) GROUP BY {BY})
SELECT {KEY}, {_r('r1', 'pacf_1')}, {_r('(r2 - r1 * r1) / (1 - r1 * r1)', 'pacf_2')},
{_r('(r1 * r1 * r1 - 2 * r1 * r2 + r3 - r1 * r1 * r3 + r1 * r2 * r2) / (1 - 2 * r1 * r1 + 2 * r1 * r1 * r2 - r2 * r2)', 'pacf_3')} FROM a""")
def _(s, d):
    return motility.partial_autocorrelations(tracks.steps(segments(s, d), XYZ), "step")


@query("m10_hurst", FRAMES + f""", v AS (SELECT {BY}, step, row_number() OVER (PARTITION BY {BY} ORDER BY pt) - 1 AS r, count(*) OVER (PARTITION BY {BY}) AS n FROM t WHERE step IS NOT NULL),
b AS (SELECT *, r // w AS b FROM (SELECT *, n // (1 << i) AS w FROM (SELECT v.*, unnest(range(0, cast(floor(log2(n)) AS bigint) - 1)) AS i FROM v)) WHERE r // w < n // w),
c AS (SELECT *, step - avg(step) OVER (PARTITION BY {BY}, i, b) AS c FROM b),
y AS (SELECT *, sum(c) OVER (PARTITION BY {BY}, i, b ORDER BY r) AS y FROM c),
q AS (SELECT {BY}, i, w, b, (max(y) - min(y)) / stddev_pop(step) AS rs FROM y GROUP BY {BY}, i, w, b HAVING stddev_pop(step) > 1e-12)
SELECT {KEY}, {_r('regr_slope(ln(m), ln(w))', 'hurst')} FROM (SELECT {BY}, i, w, avg(rs) AS m FROM q GROUP BY {BY}, i, w) GROUP BY {BY}""")
def _(s, d):
    return motility.hurst(tracks.steps(segments(s, d), XYZ), "step")


@query("a5_elongations", FRAMES + f""", e AS (SELECT {BY}, max(x) - min(x) AS x, max(y) - min(y) AS y, max(z) - min(z) AS z, sum(abs(dx)) AS a, sum(abs(dy)) AS b, sum(abs(dz)) AS c FROM d GROUP BY {BY})
SELECT {KEY}, {_r('x', 'x_max')}, {_r('y', 'y_max')}, {_r('z', 'z_max')}, {_r('y / x', 'exy_max')}, {_r('z / y', 'eyz_max')}, {_r('z / x', 'exz_max')}, {_r('cbrt(z * z / (x * y))', 'phi_max')},
{_r('b / a', 'exy_total')}, {_r('c / b', 'eyz_total')}, {_r('c / a', 'exz_total')}, {_r('cbrt(c * c / (a * b))', 'phi_total')} FROM e""")
def _(s, d):
    return motility.elongations(segments(s, d), XYZ)


@query("a6_axis_alpha", FRAMES + f"""SELECT {KEY}, {_r('regr_slope(ln(msd), ln(tau))', 'alpha')} FROM (
  SELECT a."Type", a."Label", a.seg, b.pt - a.pt AS tau, avg((b.x - a.x) * (b.x - a.x)) AS msd
  FROM s a JOIN s b ON a."Type" = b."Type" AND a."Label" = b."Label" AND a.seg = b.seg AND b.pt > a.pt GROUP BY 1, 2, 3, 4) WHERE msd > 0 GROUP BY {BY}""")
def _(s, d):
    return motility.alpha(motility.mean_squared_displacements(segments(s, d), ["x"]))


@query("g2_moments", FRAMES + f"SELECT {KEY}, {_r('avg(dist)', 'average')}, {_r('var_pop(dist)', 'variance')}, {_r('stddev_pop(dist) / avg(dist)', 'cov')}, {_r('avg(dist * dist * dist * dist) / (3 * avg(dist * dist) * avg(dist * dist)) - 1', 'ngaussalpha')} FROM s GROUP BY {BY}")
def _(s, d):
    return signals.moment_features(segments(s, d), "dist").select(*tracks.SEGMENT, "average", "variance", "cov", "ngaussalpha")


def _runs(states: dict[str, str]) -> str:
    return ", ".join(f"cast(coalesce(sum(CASE WHEN q = '{v}' THEN k END), 0) AS bigint) AS \"{n}_times\", cast(coalesce(max(CASE WHEN q = '{v}' THEN k END), 0) AS bigint) AS \"{n}_persistence\"" for v, n in states.items())


ISLANDS = f"SELECT {BY}, q, g, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY pt) - row_number() OVER (PARTITION BY {BY}, q ORDER BY pt) AS g FROM q) GROUP BY {BY}, q, g"


@query("g4_contacts", FRAMES + f", q AS (SELECT *, CASE WHEN overlap > 0 THEN 'contact' ELSE 'noncontact' END AS q FROM s) SELECT {KEY}, {_runs({'contact': 'contact', 'noncontact': 'noncontact'})} FROM ({ISLANDS}) GROUP BY {BY}")
def _(s, d):
    return signals.state_runs(segments(s, d), F.when(F.col("overlap") > 0, "contact").otherwise("noncontact"), ["contact", "noncontact"])


@query("g6_direction_runs", FRAMES + f""", q AS (SELECT *, CASE WHEN dd IS NULL THEN 'None' WHEN dd > 0.1 THEN 'departure' WHEN dd < -0.1 THEN 'approach' ELSE 'stay' END AS q FROM (SELECT *, dist - lag(dist) OVER w AS dd FROM s {W_PT}))
SELECT {KEY}, {_runs({k: k for k in ('approach', 'departure', 'stay')})} FROM ({ISLANDS}) GROUP BY {BY}""")
def _(s, d):
    return signals.state_runs(tracks.direction_states(segments(s, d), "dist"), F.col("quality_dist"), ["approach", "departure", "stay"])


@query("g7_references", FRAMES + f"""SELECT {KEY}, r AS ref, {_r('sum(v)', 'total')}, {_r('regr_slope(v, pt)', 'slope')} FROM (
SELECT {BY}, pt, 'core' AS r, x AS v FROM s UNION ALL SELECT {BY}, pt, 'rim', y FROM s UNION ALL SELECT {BY}, pt, 'cell', dist FROM s) GROUP BY {BY}, r""")
def _(s, d):
    long = signals.references(segments(s, d), {"core": "x", "rim": "y", "cell": "dist"})
    return signals.shape_features(long, "value", [*tracks.SEGMENT, "ref"]).select(*tracks.SEGMENT, "ref", "total", "slope")


@query("g9_sample_entropy", FRAMES + f""", v AS (SELECT {BY}, pt AS i, 0.2::double * stddev_pop(x) OVER (PARTITION BY {BY}) AS tol, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM s {W_PT}),
n AS (SELECT p."Type", p."Label", p.seg, sum((abs(p.a - q.a) < p.tol AND abs(p.b - q.b) < p.tol)::int) AS b, sum((abs(p.a - q.a) < p.tol AND abs(p.b - q.b) < p.tol AND abs(p.c - q.c) < p.tol)::int) AS a
  FROM v p JOIN v q ON p."Type" = q."Type" AND p."Label" = q."Label" AND p.seg = q.seg AND p.i < q.i WHERE p.c IS NOT NULL AND q.c IS NOT NULL GROUP BY 1, 2, 3)
SELECT {KEY}, CASE WHEN a > 0 AND b > 0 THEN round(-ln(a::double / b), 6) + 0.0::double END AS sample_entropy FROM n""")
def _(s, d):
    return signals.sample_entropy(segments(s, d), "x")


@query("g9_increment_entropy", FRAMES + f""", v AS (SELECT {BY}, pt, x - lag(x) OVER w AS v FROM s {W_PT}), u AS (SELECT *, stddev_pop(v) OVER (PARTITION BY {BY}) AS sd FROM v WHERE v IS NOT NULL),
k AS (SELECT {BY}, pt, sign(v) * least(4, floor(abs(v) * 4 / sd)) AS k FROM u), f AS (SELECT {BY}, k AS a, lag(k) OVER w AS b, lag(k, 2) OVER w AS c FROM k {W_PT}),
n AS (SELECT {BY}, a, b, c, count(*) AS n FROM f WHERE c IS NOT NULL GROUP BY {BY}, a, b, c), p AS (SELECT *, n / sum(n) OVER (PARTITION BY {BY}) AS p FROM n)
SELECT {KEY}, {_r('-sum(p * ln(p))', 'increment_entropy')} FROM p GROUP BY {BY}""")
def _(s, d):
    return signals.increment_entropy(segments(s, d), "x")


PAIRS = "SELECT a.event_id FROM o a JOIN o b ON abs(a.x - b.x) < 0.5 AND a.f = b.f AND a.event_id <> b.event_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.5"
OBJECTS = "WITH o AS (SELECT event_id, user_id % 5 AS f, value AS x, cast(regexp_extract(props, '[0-9]+') AS double) % 20 AS y, cast(event_id % 7 AS double) AS z FROM events) "


@query("j5_separate_objects", OBJECTS + f"SELECT event_id AS id FROM o WHERE event_id NOT IN ({PAIRS})")
def _(s, d):
    o = read(s, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("f"), F.col("value").alias("x"), (F.get_json_object("props", "$.k").cast("double") % 20).alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))
    return joins.drop_close(o, 0.5, ["f"]).select("id")


@query("j3_nearest", "SELECT a.l_linenumber AS z, a.id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) + 0.0::double AS distance FROM (SELECT DISTINCT l_linenumber, l_partkey % 32 AS x, l_suppkey % 32 AS y, (l_partkey % 32) * 32 + l_suppkey % 32 AS id FROM lineitem) a LEFT JOIN (SELECT DISTINCT l_linenumber, l_partkey % 32 AS x, l_suppkey % 32 AS y FROM lineitem WHERE l_quantity >= 50 AND l_discount < 0.03) b ON a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def _(s, d):
    v = read(s, d, "lineitem").select(F.col("l_linenumber").alias("f"), (F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), F.lit(0).alias("z"), ((F.col("l_quantity") >= 50) & (F.col("l_discount") < 0.03)).alias("core"))
    points = v.select("f", "x", "y", "z", (F.col("x") * 32 + F.col("y")).alias("id")).distinct()
    near = voxels.nearest_in_frame(points, v.where("core").select("f", "x", "y", "z").distinct(), ["f"], 4.0)
    return near.select(F.col("f").alias("z"), "id", "distance")


@query("j6_paired_differences", "WITH a AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS p, avg(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT b.o_custkey, b.o_orderstatus, round(b.p - a.p, 4) + 0.0::double AS d_p, round(b.k - a.k, 4) + 0.0::double AS d_k FROM a JOIN a b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus <> 'O'")
def _(s, d):
    a = read(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("p"), F.avg("o_orderkey").alias("k"))
    out = joins.paired_differences(a, "o_custkey", "o_orderstatus", "O", ["p", "k"])
    return out.select("o_custkey", "o_orderstatus", F.round("d_p", 4).alias("d_p"), F.round("d_k", 4).alias("d_k"))


@query("j7_mapped_genes", "SELECT cast(p_size AS varchar) AS set_name, coalesce(s_name, 'g' || p_partkey) AS gene, s_name IS NOT NULL AS converted FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def _(s, d):
    g = lambda c: F.concat(F.lit("g"), F.col(c))
    sets = read(s, d, "part").select(F.col("p_size").cast("string").alias("set_name"), g("p_partkey").alias("gene"))
    return joins.map_genes(sets, read(s, d, "supplier").select(g("s_suppkey").alias("source"), F.col("s_name").alias("target")))


@query("j10_large_groups", "SELECT o_custkey, o_orderkey, n AS group_size FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE n >= 4")
def _(s, d):
    return joins.keep_large_groups(read(s, d, "orders"), ["o_custkey", "o_orderstatus"], 4).select("o_custkey", "o_orderkey", "group_size")


@query("j11_label_cost", "SELECT a.s_suppkey AS i, b.n_nationkey AS j, round(greatest((a.s_acctbal / 1000 - b.n_nationkey) * (a.s_acctbal / 1000 - b.n_nationkey), CASE WHEN a.s_nationkey % 5 <> b.n_regionkey THEN 100.0 ELSE 0.0 END), 6) + 0.0::double AS cost FROM supplier a, nation b")
def _(s, d):
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 1000).alias("score"), (F.col("s_nationkey") % 5).alias("label"))
    b = read(s, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_nationkey").cast("double").alias("score"), F.col("n_regionkey").alias("label"))
    return joins.label_cost(a, b)


@query("e6_nearest_vectors", """WITH d AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))) AS distance
FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query, neighbour, round(distance, 6) + 0.0::double AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 10""")
def _(s, d):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return joins.nearest_vectors(v.where("id % 50 = 0"), v, 10)


@query("c11_enrichment", """WITH h AS (SELECT o_orderpriority AS g, o_orderstatus AS c, count(*) AS hits FROM orders GROUP BY 1, 2),
a AS (SELECT *, cast(sum(hits) OVER () AS bigint) AS n, cast(sum(hits) OVER (PARTITION BY c) AS bigint) AS k, cast(sum(hits) OVER (PARTITION BY g) AS bigint) AS m FROM h),
x AS (SELECT *, unnest(range(greatest(0, m + k - n), least(m, k) + 1)) AS x FROM a),
p AS (SELECT *, exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(m - x + 1) - lgamma(n - k - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) AS p FROM x)
SELECT g, c, hits, round(sum(CASE WHEN x >= hits THEN p ELSE 0 END), 6) + 0.0::double AS p_over, round(sum(CASE WHEN x <= hits THEN p ELSE 0 END), 6) + 0.0::double AS p_under FROM p GROUP BY 1, 2, 3""")
def _(s, d):
    o = read(s, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("c"))
    return stats.enrichment(o, "g", "c").select("g", "c", "hits", "p_over", "p_under")


@query("c14_density", """WITH p AS (SELECT c_acctbal / 1000 AS x, c_nationkey AS y FROM customer),
s AS (SELECT count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vc, floor(min(x)) - 1 AS lx, ceil(max(x)) + 1 AS hx, floor(min(y)) - 1 AS ly, ceil(max(y)) + 1 AS hy FROM p),
t AS (SELECT *, (vx * vy - vc * vc) * power(n, -1.0::double / 3) AS det FROM s),
g AS (SELECT ix, iy, sum(exp(-(vy * dx * dx - 2 * vc * dx * dy + vx * dy * dy) / (2 * det))) AS g FROM (
  SELECT ix, iy, vx, vy, vc, det, lx + ix * (hx - lx) / 11.0::double - x AS dx, ly + iy * (hy - ly) / 11.0::double - y AS dy FROM p, t, (SELECT unnest(range(12)) AS ix), (SELECT unnest(range(12)) AS iy)) GROUP BY 1, 2)
SELECT ix, iy, round(g / sum(g) OVER (), 6) + 0.0::double AS density FROM g""")
def _(s, d):
    return maps.density(read(s, d, "customer").select((F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y")), "x", "y", 12)


@query("c15_transition_field", FRAMES + f"""SELECT ix, iy, {_r('avg(sqrt(dx1 * dx1 + dy1 * dy1))', 'speed')}, {_r('avg(dx1)', 'dx')}, {_r('avg(dy1)', 'dy')} FROM (SELECT
cast(ceil((x - lx) / ((hx - lx) / 19.0::double) - 0.5) AS bigint) AS ix, cast(ceil((y - ly) / ((hy - ly) / 19.0::double) - 0.5) AS bigint) AS iy, lead(x) OVER w - x AS dx1, lead(y) OVER w - y AS dy1
FROM f0, (SELECT floor(min(x)) - 1 AS lx, ceil(max(x)) + 1 AS hx, floor(min(y)) - 1 AS ly, ceil(max(y)) + 1 AS hy FROM f0) WINDOW w AS (PARTITION BY {T} ORDER BY "Time")) WHERE dx1 IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    return maps.transition_field(frames(s, d), "x", "y", 20, tracks.TRACK, "Time")


@query("c18_two_level_curve", """WITH m AS (SELECT l_returnflag, l_suppkey, cast(floor(l_quantity / 10) * 10 AS double) AS bin, avg(l_extendedprice) AS m FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1, 2, 3 HAVING count(*) >= 30)
SELECT l_returnflag, bin, round(avg(m), 4) + 0.0::double AS mean, round(stddev_pop(m), 4) + 0.0::double AS std, count(*) AS units FROM m GROUP BY 1, 2""")
def _(s, d):
    out = stats.two_level_curve(read(s, d, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice", 0.0, 10.0, 50.0, 30)
    return out.select("l_returnflag", "bin", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "units")


@query("c20_confusion", """WITH p AS (SELECT o_orderstatus AS truth, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS predicted FROM orders), n AS (SELECT truth, predicted, count(*) AS n FROM p GROUP BY 1, 2)
SELECT truth, predicted, n, round(n::double / sum(n) OVER (PARTITION BY truth), 6) AS share, round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) OVER ()::double / sum(n) OVER (), 6) AS accuracy FROM n""")
def _(s, d):
    p = F.col("o_totalprice")
    return stats.confusion(read(s, d, "orders").select(F.col("o_orderstatus").alias("truth"), F.when(p > 250000, "F").when(p > 100000, "O").otherwise("P").alias("predicted")), "truth", "predicted")


@query("c22_votes", """WITH n AS (SELECT l_linenumber AS z, l_suppkey % 32 AS y, l_partkey % 32 AS x, l_returnflag AS label, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT cast(z AS bigint) AS z, y, x, label FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC, f, label) AS r FROM n) WHERE r = 1""")
def _(s, d):
    return voxels.vote(read(s, d, "lineitem").select(F.col("l_linenumber").alias("z"), (F.col("l_suppkey") % 32).alias("y"), (F.col("l_partkey") % 32).alias("x"), F.col("l_returnflag").alias("label"), "l_orderkey"), "label", "l_orderkey")


@query("o1_top_by_size", "SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10")
def _(s, d):
    return ranking.top_by_size(read(s, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", 10).select("c_mktsegment", "c_custkey", "rank")


@query("o2_extremes", "(SELECT c_custkey, 'low' AS \"end\" FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10) UNION ALL (SELECT c_custkey, 'high' FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")
def _(s, d):
    return ranking.extremes(read(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10).select("c_custkey", "end")


@query("o3_gap_outliers", """WITH g AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT o_totalprice AS v FROM orders)), t AS (SELECT v FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, v LIMIT 1),
n AS (SELECT sum((o_totalprice >= v)::int) AS up, sum((o_totalprice < v)::int) AS down FROM orders, t)
SELECT o_orderkey FROM orders, t, n WHERE CASE WHEN up <= down THEN o_totalprice >= v ELSE o_totalprice < v END""")
def _(s, d):
    return ranking.split_at_gap(read(s, d, "orders"), "o_totalprice").where("outlier").select("o_orderkey")


@query("o6_set_sizes", """WITH w AS (SELECT conv_id, list_distinct(list(role)) AS a, list_distinct(list(CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'tool' END)) AS b FROM conversations GROUP BY 1)
SELECT conv_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS joint FROM w""")
def _(s, d):
    w = read(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("a"), F.collect_set(F.when(F.col("turn") % 2 == 0, "user").otherwise("tool")).alias("b"))
    return ranking.set_sizes(w, "a", "b").select("conv_id", "shared", "joint")


@query("v7_focus_plane", VOXELS + """, p AS (SELECT t, z, var_pop(value) / avg(value) AS v FROM v GROUP BY 1, 2) SELECT cast(t AS bigint) AS t, cast(z AS bigint) AS focus_z FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v, z) AS r FROM p) WHERE r = 1""")
def _(s, d):
    return voxels.focus_plane(cells(s, d), "t", "value")


@query("r4_variable_genes", COUNTS + """, n AS (SELECT count(DISTINCT cell_id) AS n FROM c), g AS (SELECT gene, sum(exp(value) - 1) / max(n) AS m, (sum((exp(value) - 1) * (exp(value) - 1)) - sum(exp(value) - 1) * sum(exp(value) - 1) / max(n)) / (max(n) - 1) AS s FROM v, n GROUP BY 1),
h AS (SELECT gene, ln(1 + m) AS m, ln(s / m) AS disp FROM g WHERE s > 0), l AS (SELECT min(m) AS lo, max(m) AS hi FROM h), b AS (SELECT *, least(19, floor((m - lo) / ((hi - lo) / 20))) AS bin FROM h, l),
z AS (SELECT gene, CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE (disp - avg(disp) OVER (PARTITION BY bin)) / stddev_samp(disp) OVER (PARTITION BY bin) END AS z FROM b)
SELECT gene, round(z, 5) + 0.0::double AS normalised FROM z ORDER BY z DESC NULLS LAST, gene LIMIT 100""")
def _(s, d):
    c = counts(s, d)
    n = c.select("cell_id").distinct().count()
    return expression.variable_genes(expression.normalise(c), n, 100).select("gene", F.round("normalised", 5).alias("normalised"))


@query("v1_box_sum", VOXELS + """, b AS (SELECT t, z, y, x, sum(value) AS s FROM v GROUP BY 1, 2, 3, 4), o AS (SELECT unnest([-1, 0, 1]) AS o)
SELECT cast(t AS bigint) AS t, cast(z + a.o AS bigint) AS z, y + b1.o AS y, x + c.o AS x, round(sum(s), 6) + 0.0::double AS sum FROM b, o a, o b1, o c GROUP BY 1, 2, 3, 4""")
def _(s, d):
    return voxels.box_sum(cells(s, d), "value", (3, 3, 3), ["t"])


@query("v3_scaled", VOXELS + "SELECT cast(t AS bigint) AS t, cast(z AS bigint) AS z, y, x, round(avg((value - lo) / hi), 6) + 0.0::double AS scaled FROM v JOIN (SELECT t, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1) m USING (t) GROUP BY 1, 2, 3, 4")
def _(s, d):
    return voxels.scale(cells(s, d), "value", ["t"]).groupBy("t", "z", "y", "x").agg(F.avg("scaled").alias("scaled"))


@query("v4_filled_slices", VOXELS + """, b AS (SELECT t, z, y, x, avg(value) AS v FROM v GROUP BY 1, 2, 3, 4)
SELECT cast(t AS bigint) AS t, cast(z * 3 AS bigint) AS z, y, x, round(v, 6) + 0.0::double AS value FROM b
UNION ALL SELECT cast(a.t AS bigint), cast(a.z * 3 + k AS bigint), a.y, a.x, round(a.v * (3 - k) / 3 + c.v * k / 3, 6) + 0.0::double FROM b a JOIN b c ON a.t = c.t AND a.y = c.y AND a.x = c.x AND c.z = a.z + 1, (SELECT unnest([1, 2]) AS k)""")
def _(s, d):
    one = cells(s, d).groupBy("t", "z", "y", "x").agg(F.avg("value").alias("value"))
    return voxels.fill_slices(one, "value", 2, ["t"])


@query("v5_clean_objects", """WITH v AS (SELECT l_orderkey AS label, l_linenumber AS z, l_suppkey % 32 AS y, l_partkey % 32 AS x FROM lineitem),
k AS (SELECT label, row_number() OVER (ORDER BY label) AS new_label FROM v GROUP BY label HAVING count(*) >= 3 AND min(z) > 0 AND max(z) < 7 AND min(y) > 0 AND max(y) < 31 AND min(x) > 0 AND max(x) < 31)
SELECT label, new_label, count(*) AS n FROM v JOIN k USING (label) GROUP BY 1, 2""")
def _(s, d):
    v = read(s, d, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("z"), (F.col("l_suppkey") % 32).alias("y"), (F.col("l_partkey") % 32).alias("x"))
    return voxels.clean_objects(v, "label", 3, (8, 32, 32)).groupBy("label", "new_label").agg(F.count("*").alias("n"))


@query("e2_clipped", "SELECT c_custkey, round(greatest(-1.5::double, least(1.5::double, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ())), 6) + 0.0::double AS c_acctbal FROM customer")
def _(s, d):
    return learning.standardise(read(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], False, 1.5)


def _sinkhorn(rounds: int) -> str:
    c = "greatest((a.s_acctbal / 1000 - b.n_nationkey) * (a.s_acctbal / 1000 - b.n_nationkey), CASE WHEN a.s_nationkey % 5 <> b.n_regionkey THEN 100.0 ELSE 0.0 END)"
    sql = f"WITH k AS (SELECT s_suppkey AS i, n_nationkey AS j, exp(-{c} / 50.0::double) AS k FROM supplier a, nation b), n AS (SELECT count(DISTINCT i) AS n, count(DISTINCT j) AS m FROM k), v0 AS (SELECT DISTINCT j, 1.0::double AS v FROM k)"
    for r in range(rounds):
        sql += f", u{r + 1} AS (SELECT i, 1 / (max(n) * sum(k * v)) AS u FROM k JOIN v{r} USING (j), n GROUP BY 1), v{r + 1} AS (SELECT j, 1 / (max(m) * sum(k * u)) AS v FROM k JOIN u{r + 1} USING (i), n GROUP BY 1)"
    return sql + f", w AS (SELECT i, j, k * u * v AS mass FROM k JOIN u{rounds} USING (i) JOIN v{rounds} USING (j)) "


def _plan(s, d):
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 1000).alias("score"), (F.col("s_nationkey") % 5).alias("label"))
    b = read(s, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_nationkey").cast("double").alias("score"), F.col("n_regionkey").alias("label"))
    return learning.transport(joins.label_cost(a, b), 50.0, 3)


@query("x4_transport", _sinkhorn(3) + "SELECT i, cast(j AS bigint) AS j, round(mass, 6) + 0.0::double AS mass FROM w")
def _(s, d):
    return _plan(s, d)


@query("x5_barycentric", _sinkhorn(3) + "SELECT cast(j AS bigint) AS j, 'acctbal' AS dim, round(sum(mass * s_acctbal) / sum(mass), 4) + 0.0::double AS value FROM w JOIN supplier ON s_suppkey = i GROUP BY 1")
def _(s, d):
    at = read(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.lit("acctbal").alias("dim"), F.col("s_acctbal").alias("value"))
    return learning.barycentric(_plan(s, d), at).select("j", "dim", F.round("value", 4).alias("value"))


@query("r8_over_representation", """WITH l AS (SELECT DISTINCT l_returnflag || l_linenumber AS list_name, l_partkey AS gene FROM lineitem), q AS (SELECT DISTINCT l_suppkey AS set_name, l_partkey AS gene FROM lineitem),
h AS (SELECT list_name, set_name, count(*) AS hits FROM l JOIN q USING (gene) GROUP BY 1, 2), m AS (SELECT list_name, count(*) AS m FROM l GROUP BY 1), k AS (SELECT set_name, count(*) AS k FROM q GROUP BY 1), t AS (SELECT count(*) AS n FROM part),
x AS (SELECT *, unnest(range(hits, least(m, k) + 1)) AS x FROM h JOIN m USING (list_name) JOIN k USING (set_name), t)
SELECT list_name, set_name, hits, round(sum(exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(m - x + 1) - lgamma(n - k - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1))), 6) + 0.0::double AS p FROM x GROUP BY 1, 2, 3""")
def _(s, d):
    i = read(s, d, "lineitem")
    lists = i.select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("list_name"), F.col("l_partkey").alias("gene"))
    sets = i.select(F.col("l_suppkey").alias("set_name"), F.col("l_partkey").alias("gene"))
    return expression.over_representation(lists, sets, read(s, d, "part").count())


@query("p1_recoded", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", scalar.recode(F.col("o_orderstatus"), {"F": "filled", "O": "open"}).alias("status"))


@query("p4_day_and_group", """WITH n AS (SELECT c_custkey, 'x-y-D' || lpad(cast(c_custkey % 30 AS varchar), 2, '0') || chr(cast(65 + c_custkey % 3 AS int)) || '-int' || CASE WHEN c_custkey % 2 = 0 THEN '15S' ELSE '30s' END AS n FROM customer)
SELECT c_custkey, 'D' || (c_custkey % 30) AS day, chr(cast(65 + c_custkey % 3 AS int)) AS exp_group, CASE WHEN c_custkey % 2 = 0 THEN 15 ELSE 30 END AS frame_interval FROM n""")
def _(s, d):
    k = F.col("c_custkey")
    n = F.concat(F.lit("x-y-D"), F.lpad((k % 30).cast("string"), 2, "0"), F.char(65 + k % 3), F.lit("-int"), F.when(k % 2 == 0, "15S").otherwise("30s"))
    day, group = scalar.day_and_group(n)
    return read(s, d, "customer").select("c_custkey", day.alias("day"), group.alias("exp_group"), scalar.frame_interval(n).alias("frame_interval"))


@query("p14_first_parts", "SELECT p_partkey, array_to_string(string_split(p_type, ' ')[1:2], '+') AS parts FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", F.array_join(scalar.first_parts(F.col("p_type"), 2, " "), "+").alias("parts"))


@query("p18_significance", "SELECT c_custkey, CASE WHEN abs(c_acctbal / 5000) < 0.5 OR c_nationkey / 25.0 < 0.05 THEN 'NoChange' ELSE 'Change' END AS flag FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", scalar.significance(F.col("c_acctbal") / 5000, F.col("c_nationkey") / 25.0, 0.5, 0.05).alias("flag"))


@query("p20_nice_step", """SELECT o_orderkey, v AS step FROM (SELECT o_orderkey, c * power(10, floor(log10(o_totalprice))) AS v, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(c * power(10, floor(log10(o_totalprice))) - o_totalprice), c) AS r
FROM orders, (SELECT unnest([1, 2, 2.5, 5, 10])::double AS c) WHERE o_totalprice > 0) WHERE r = 1""")
def _(s, d):
    return read(s, d, "orders").where("o_totalprice > 0").select("o_orderkey", scalar.nice_step(F.col("o_totalprice")).alias("step"))


@query("f5_voxel_index", "SELECT event_id, cast(least(31, greatest(0, round_even(value / 4, 0))) AS bigint) AS i FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", scalar.to_voxel(F.col("value"), 4.0, 32).alias("i"))


@query("t13_fitted", FRAMES + f"""SELECT {T}, cast(n AS bigint) AS n, {_r('"Time" + l * (case when dx is null then null else 1 end)', 'at')},
{_r("x + l * dx + CASE WHEN l <> 0 AND abs(dx) >= abs(dy) THEN dx / 2.01 ELSE 0 END", 'x')}, {_r("y + l * dy + CASE WHEN l <> 0 AND abs(dx) < abs(dy) THEN dy / 2.01 ELSE 0 END", 'y')}, l = 0 AS kept FROM (
SELECT {T}, "Time", x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, n, (n * 3 - i * 2) / 2.0::double AS l, i FROM (SELECT *, "Time" - 1 AS i, ("Time" - 1) * 2 // 3 AS n FROM f0) WINDOW w AS (PARTITION BY {T} ORDER BY "Time"))
WHERE n > 0 AND n * 3 > (i - 1) * 2""")
def _(s, d):
    out = tracks.fit_interval(frames(s, d), ["x", "y"], 2, 3)
    return out.select(*tracks.TRACK, "n", F.col("Time").alias("at"), "x", "y", "kept")


@query("t13_with_fitted", FRAMES + f"""SELECT {T}, count(*) AS frames, count(*) + (count(*) - 1) * 2 // 3 - (count(*) - 1) // 3 AS n FROM f0 GROUP BY {T}""")
def _(s, d):
    f = frames(s, d)
    n = tracks.with_fitted(f, ["x", "y"], 2, 3).groupBy(*tracks.TRACK).agg(F.count("*").alias("n"))
    return f.groupBy(*tracks.TRACK).agg(F.count("*").alias("frames")).join(n, tracks.TRACK)


@query("g8_bubble_entropy", FRAMES + f"""SELECT {KEY}, {_r("(h4 - h3) / ln(2)", 'bubble_entropy')} FROM (SELECT {BY}, -ln(sum(p * p) FILTER (WHERE k = 3)) AS h3, -ln(sum(p * p) FILTER (WHERE k = 4)) AS h4 FROM (
  SELECT {BY}, k, n / sum(n) OVER (PARTITION BY {BY}, k) AS p FROM (
    SELECT {BY}, 3 AS k, (b > c)::int + (b > e)::int + (c > e)::int AS q, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY ALL
    UNION ALL SELECT {BY}, 4, (a > b)::int + (a > c)::int + (a > e)::int + (b > c)::int + (b > e)::int + (c > e)::int AS q, count(*) FROM w WHERE a IS NOT NULL GROUP BY ALL)) GROUP BY {BY})""".replace("FROM w ", f"FROM (SELECT {BY}, lag(x, 3) OVER w AS a, lag(x, 2) OVER w AS b, lag(x) OVER w AS c, x AS e FROM s {W_PT}) "))
def _(s, d):
    return signals.bubble_entropy(segments(s, d), "x")


@query("g8_cosine_entropy", FRAMES + f"""SELECT {KEY}, {_r("CASE WHEN p > 0 AND p < 1 THEN -p * ln(p) - (1 - p) * ln(1 - p) ELSE 0 END", 'cosine_entropy')} FROM (SELECT {BY}, avg((acos(greatest(-1, least(1, (a0 * b0 + a1 * b1 + a2 * b2) / sqrt((a0 * a0 + a1 * a1 + a2 * a2) * (b0 * b0 + b1 * b1 + b2 * b2))))) / pi() < 0.1)::int) AS p FROM (
  SELECT u.*, v.a0 AS b0, v.a1 AS b1, v.a2 AS b2 FROM q u JOIN q v ON u."Type" = v."Type" AND u."Label" = v."Label" AND u.seg = v.seg AND u.pt < v.pt) GROUP BY {BY})""".replace("q u", "(Q) u").replace("q v", "(Q) v").replace("(Q)", f"(SELECT * FROM (SELECT {BY}, pt, x - 50 AS a0, lead(x) OVER w - 50 AS a1, lead(x, 2) OVER w - 50 AS a2 FROM s {W_PT}) WHERE a2 IS NOT NULL)"))
def _(s, d):
    return signals.cosine_entropy(segments(s, d).withColumn("v", F.col("x") - 50), "v")


@query("g9_dispersion_entropy", FRAMES + f"""SELECT {KEY}, {_r("-sum(p * ln(p))", 'dispersion_entropy')} FROM (SELECT {BY}, n / sum(n) OVER (PARTITION BY {BY}) AS p FROM (SELECT {BY}, c, count(*) AS n FROM (
  SELECT {BY}, c * 100 + lead(c) OVER w * 10 + lead(c, 2) OVER w AS c FROM (SELECT {BY}, pt, (z >= -0.4307272992954575)::int + (z >= 0.4307272992954575)::int AS c FROM (
    SELECT {BY}, pt, (x - avg(x) OVER (PARTITION BY {BY})) / nullif(stddev_pop(x) OVER (PARTITION BY {BY}), 0) AS z FROM s) WHERE z IS NOT NULL) {W_PT}) WHERE c IS NOT NULL GROUP BY ALL)) GROUP BY {BY}""")
def _(s, d):
    return signals.dispersion_entropy(segments(s, d), "x")


@query("c8_welch", """WITH m AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS m, var_samp(c_acctbal) / count(*) AS v, count(*) AS n FROM customer GROUP BY 1)
SELECT a.g AS one, b.g AS two, round((a.m - b.m) / sqrt(a.v + b.v), 6) + 0.0::double AS t, round((a.v + b.v) * (a.v + b.v) / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)), 4) + 0.0::double AS dof FROM m a JOIN m b ON a.g < b.g""")
def _(s, d):
    out = stats.welch_tests(read(s, d, "customer"), "c_mktsegment", "c_acctbal")
    return out.select("one", "two", "t", F.round("dof", 4).alias("dof"))


@query("c17_automatic_range", """WITH d AS (SELECT o_orderstatus AS g, o_totalprice::double AS v FROM orders), l AS (SELECT min(v) AS lo, max(v) AS hi, count(DISTINCT g) AS groups FROM d),
c AS (SELECT tried, lo, hi, groups, arg_min(u * power(10, floor(log10((hi - lo) / tried))), (abs(u * power(10, floor(log10((hi - lo) / tried))) - (hi - lo) / tried), u)) AS step FROM l, (SELECT unnest(range(3, 11)) AS tried), (SELECT unnest([1, 2, 2.5, 5, 10])::double AS u) GROUP BY ALL),
e AS (SELECT max(tried) AS tried, groups, step, floor(lo / step) * step AS a, ceil(hi / step) * step AS b FROM c GROUP BY groups, step, lo, hi),
n AS (SELECT tried, step, a, i FROM (SELECT tried, step, a, groups, floor((v - a) / step) AS i, g, count(*) AS n FROM d, e WHERE a + floor((v - a) / step) * step < b GROUP BY ALL) WHERE n >= 2 GROUP BY tried, step, a, groups, i HAVING count(*) = groups),
r AS (SELECT tried, step, a, min(i) AS f, max(i) AS t, count(*) AS bins FROM (SELECT *, i - row_number() OVER (PARTITION BY tried ORDER BY i) AS r FROM n) GROUP BY tried, step, a, r)
SELECT round(a + f * step, 6) AS "first", round(a + t * step, 6) AS "last", step, bins FROM r WHERE bins >= 3 ORDER BY bins DESC, bins * step DESC, tried DESC, f LIMIT 1""")
def _(s, d):
    return maps.automatic_range(read(s, d, "orders"), "o_orderstatus", "o_totalprice", "o_totalprice")


@query("r3_set_scores", COUNTS + """, g AS (SELECT gene, round(sum(value) / (SELECT count(*) FROM supplier), 8) AS mean FROM v GROUP BY 1),
k AS (SELECT gene, floor(rank() OVER (ORDER BY mean) / (SELECT greatest(1, round(count(*) / 24.0)) FROM g)) AS bin FROM g),
w AS (SELECT gene, bin FROM k QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5(gene || ':0'), gene) <= 50),
o AS (SELECT DISTINCT p_brand AS set_name, k.gene, k.bin FROM part JOIN k ON k.gene = 'g' || p_partkey),
a AS (SELECT set_name, gene, 1 AS own FROM o UNION ALL SELECT set_name, w.gene, 0 FROM (SELECT DISTINCT set_name, bin FROM o) b JOIN w ON w.bin = b.bin WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.set_name = b.set_name AND o.gene = w.gene)),
n AS (SELECT set_name, sum(own) AS k, sum(1 - own) AS c FROM a GROUP BY 1)
SELECT a.set_name, cell_id, round(sum(own * value) / max(k) - coalesce(sum((1 - own) * value) / nullif(max(c), 0), 0), 6) + 0.0::double AS score FROM a JOIN v ON v.gene = a.gene JOIN n ON n.set_name = a.set_name GROUP BY 1, 2""")
def _(s, d):
    sets = read(s, d, "part").select(F.col("p_brand").alias("set_name"), F.concat(F.lit("g"), "p_partkey").alias("gene"))
    return expression.set_scores(expression.normalise(counts(s, d)), read(s, d, "supplier").count(), sets)


@query("r6_distinctive", """WITH m AS (SELECT l_partkey AS gene, l_returnflag AS cluster, avg(l_tax) - 0.04 AS fold, round(avg(l_discount), 9) AS p FROM lineitem GROUP BY 1, 2)
SELECT gene, cluster, round(CASE WHEN p > 0 THEN coalesce(fold, 0) * -log10(p) / (1 + sum((p < 0.05)::int) OVER (PARTITION BY gene) - (p < 0.05)::int) ELSE 0 END, 6) + 0.0::double AS distinctive FROM m""")
def _(s, d):
    m = read(s, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("cluster")).agg((F.avg("l_tax") - 0.04).alias("fold"), F.round(F.avg("l_discount"), 9).alias("p"))  # a mean of 0.05 is 0.05 in whatever order it is summed
    return expression.distinctive(m, "gene", "cluster", "fold", "p").select("gene", "cluster", "distinctive")


_MIRROR = "CASE WHEN ({c} + k) % {d} + CASE WHEN {c} + k < 0 THEN {d} ELSE 0 END < {n} THEN ({c} + k) % {d} + CASE WHEN {c} + k < 0 THEN {d} ELSE 0 END ELSE {d} - 1 - (({c} + k) % {d} + CASE WHEN {c} + k < 0 THEN {d} ELSE 0 END) END AS {c}"


@query("v1_smooth", VOXELS + f""", k AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
a AS (SELECT t, {_MIRROR.format(c="y", n=32, d=64)}, x, sum(value * w) AS value FROM v, k GROUP BY ALL)
SELECT cast(t AS bigint) AS t, y, x, round(value, 6) + 0.0::double AS smooth FROM (SELECT t, y, {_MIRROR.format(c="x", n=32, d=64)}, sum(value * w) AS value FROM a, k GROUP BY ALL)""")
def _(s, d):
    out = voxels.smooth(cells(s, d), "value", {"y": (1.0, 32), "x": (1.0, 32)}, ["t"])
    return out.select("t", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "smooth")


@query("v8_crops", VOXELS + """, c AS (SELECT c_custkey AS label, c_custkey % 4 AS t, 4 AS z, c_nationkey AS y, c_custkey % 32 AS x FROM customer)
SELECT cast(v.t AS bigint) AS t, label, cast(v.z - c.z + 2 AS bigint) AS dz, cast(v.y - c.y + 3 AS bigint) AS dy, cast(v.x - c.x + 4 AS bigint) AS dx, count(*) AS n, round(sum(value), 4) + 0.0::double AS total FROM v JOIN c ON v.t = c.t
  AND v.z - c.z BETWEEN -2 AND 1 AND v.y - c.y BETWEEN -3 AND 2 AND v.x - c.x BETWEEN -4 AND 3 WHERE c.y - 3 > 0 AND c.y + 3 < 32 AND c.x - 4 > 0 AND c.x + 4 < 32 GROUP BY ALL""")
def _(s, d):
    k = F.col("c_custkey")
    centres = read(s, d, "customer").select(k.alias("label"), (k % 4).alias("t"), F.lit(4).alias("z"), F.col("c_nationkey").alias("y"), (k % 32).alias("x"))
    out = voxels.crop_totals(cells(s, d), centres, "value", (4, 6, 8), (8, 32, 32), ["t"])
    return out.select("t", "label", "dz", "dy", "dx", "n", F.round("total", 4).alias("total"))


def _shape_tracks(s, d):
    """Standardised shape columns as a path through their first two components."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    out = learning.components(read(s, d, "lineitem"), names, k=2).withColumn("pt", F.row_number().over(order))
    path = out.select(F.col("l_suppkey"), "pt", F.col("pcs")[0].alias("pc1"), F.col("pcs")[1].alias("pc2"))
    return motility.basic_motility(path, ["pc1", "pc2"], keys=["l_suppkey"])


def _shape(s, d):
    i = read(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return i.groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in i.columns[1:]])


#: Without SQL: learned or fitted results, tested by their invariants.

def _all_components(s, d):
    """Over every set-gene edge of the table."""
    return expression.linked_sets(read(s, d, "lineitem").select(F.col("l_suppkey").alias("one"), (F.col("l_partkey") + 1000000).alias("two")).distinct())


FITTED = {
    "c8_welch_p": lambda s, d: stats.welch_tests(read(s, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("p", stats.t_p("t", "dof")),
    "a1_registered": lambda s, d: alignment.register(segments(s, d), XYZ),
    "a2_reflected": lambda s, d: alignment.register(segments(s, d), XYZ, reflect=True),
    "a9_random_walks": lambda s, d: alignment.random_walks(segments(s, d), ["x", "y"]),
    "a10_random_walks_3d": lambda s, d: alignment.random_walks(segments(s, d), XYZ, max_noise=100.0, share=3),
    "m12_shape_motility": _shape_tracks,
    "c8_rank_p": lambda s, d: stats.rank_tests(read(s, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("p", stats.two_sided_p("z")),
    "g8_entropies": lambda s, d: signals.entropies(segments(s, d), "x"),
    "r9_components": _all_components,
    "e3_components": lambda s, d: learning.components(_shape(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "e4_clusters": lambda s, d: learning.clusters(read(s, d, "embeddings"), "embedding").select("vec_id", "cluster"),
}
