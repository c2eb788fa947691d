"""Registered queries over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import expression, maps, motility, signals, stats, tracks, voxels

XYZ = ["x", "y", "z"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame table: one track per user of events."""
    e = read(spark, sf_dir, "events")
    w = tracks.in_order(["Type", "Label"], "ts").orderBy("ts", "event_id")
    out = e.select(
        F.concat(F.lit("T"), F.col("user_id") % 3).alias("Type"), F.col("user_id").cast("string").alias("Label"), F.concat(F.lit("V"), F.col("user_id") % 5).alias("Video"), "ts", "event_id",
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("event_id") % 97).cast("double").alias("z"),
        F.abs(F.col("value") - 50).alias("dist"), (F.greatest(F.lit(0.0), F.col("value") - 100) / 400).alias("overlap"),
        F.when(F.col("value") < 35, 0).when(F.col("value") < 115, 1).otherwise(2).alias("zone"), F.col("event_type").alias("state"),
    )
    return out.withColumn("Time", F.row_number().over(w)).drop("ts")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.cut_segments(frames(spark, sf_dir), 20)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits (no negative zero), counts to long."""
    change = {"double": lambda c: (F.round(F.col(c), 6) + 0.0), "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long")}
    return df.select(*[change[t](c).alias(c) if t in change else F.col(c) for c, t in df.dtypes])


FRAMES = """
WITH f0 AS (
  SELECT 'T' || (user_id % 3) AS "Type", cast(user_id AS varchar) AS "Label", 'V' || (user_id % 5) AS "Video", event_id,
    value AS x, cast(regexp_extract(props, '[0-9]+') AS double) AS y, cast(event_id % 97 AS double) AS z,
    abs(value - 50) AS dist, greatest(0.0, value - 100) / 400 AS overlap,
    CASE WHEN value < 35 THEN 0 WHEN value < 115 THEN 1 ELSE 2 END AS zone, event_type AS state,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "Time"
  FROM events
), s0 AS (
  SELECT *, ("Time" - 1) // 20 AS seg, ("Time" - 1) % 20 AS pt, count(*) OVER (PARTITION BY "Type", "Label") AS n FROM f0
), s AS (SELECT * FROM s0 WHERE seg < n // 20),
d AS (
  SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM s WINDOW w AS (PARTITION BY "Type", "Label", seg ORDER BY pt)
), st AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS step FROM d),
tu AS (
  SELECT *, CASE WHEN step * lag(step) OVER w = 0 THEN 0.0
    ELSE acos(greatest(-1.0::double, least(1.0::double, (dx * lag(dx) OVER w + dy * lag(dy) OVER w + dz * lag(dz) OVER w) / nullif(step * lag(step) OVER w, 0)))) END AS a0,
    lag(step) OVER w AS before
  FROM st WINDOW w AS (PARTITION BY "Type", "Label", seg ORDER BY pt)
), t AS (SELECT * EXCLUDE (a0), CASE WHEN step IS NULL OR before IS NULL THEN NULL ELSE a0 END AS angle FROM tu)
"""
KEY = '"Type", "Label", cast(seg AS bigint) AS seg'
BY = '"Type", "Label", seg'


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0::double AS {name}"


def _moments(x: str, p: str) -> str:
    v = f"(avg({x} * {x}) - avg({x}) * avg({x}))"
    when = lambda e, n: f"CASE WHEN count(DISTINCT {x}) > 1 THEN round({e}, 6) + 0.0::double END AS {p}_{n}"
    return when(f"var_pop({x})", "variance") + ", " + when(f"stddev_pop({x}) / avg({x})", "cov")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


@query("t1_segments", FRAMES + f'SELECT {KEY}, cast(pt AS bigint) AS pt, cast(n AS bigint) AS "Time_span", "Label" || \'_\' || seg AS "pseudo_Label" FROM s')
def _(s, d):
    return segments(s, d).select(*tracks.SEGMENT, "pt", "Time_span", "pseudo_Label")


@query("t2_long_tracks", FRAMES + 'SELECT "Type", "Label", count(*) AS n FROM f0 GROUP BY 1, 2 HAVING count(*) >= 60')
def _(s, d):
    return tracks.keep_long(frames(s, d), 60).groupBy("Type", "Label").agg(F.count("*").alias("n"))


@query("t8_separate_tracks", FRAMES + f"SELECT {KEY}, {_r('max(overlap)', 'top')} FROM s GROUP BY {BY} HAVING max(overlap) < 0.6")
def _(s, d):
    return tracks.keep_separate(segments(s, d), ["overlap"]).groupBy(*tracks.SEGMENT).agg(F.max("overlap").alias("top"))


@query("t9_reduced_labels", FRAMES + f"SELECT {KEY}, string_agg(zone, ',' ORDER BY pt) AS zones, count(DISTINCT zone) = 1 AS is_constant FROM s GROUP BY {BY}")
def _(s, d):
    out = tracks.reduce_labels(segments(s, d), "zone")
    return out.select(*tracks.SEGMENT, F.concat_ws(",", F.transform("zone", lambda v: v.cast("string"))).alias("zones"), "is_constant")


@query("t14_normalised", FRAMES + f'SELECT {KEY}, cast(pt AS bigint) AS pt, {_r("(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)", "z_x")} FROM s WINDOW w AS (PARTITION BY {BY})')
def _(s, d):
    return tracks.normalise(segments(s, d), "x").select(*tracks.SEGMENT, "pt", "z_x")


@query("t17_recentred", FRAMES + f"SELECT {KEY}, cast(pt AS bigint) AS pt, {_r('x - first_value(x) OVER w', 'rel_x')}, {_r('y - first_value(y) OVER w', 'rel_y')} FROM s WINDOW w AS (PARTITION BY {BY} ORDER BY pt)")
def _(s, d):
    return tracks.recentre(segments(s, d), ["x", "y"]).select(*tracks.SEGMENT, "pt", "rel_x", "rel_y")


@query("f1_instant_movements", FRAMES + f"SELECT {KEY}, cast(pt AS bigint) AS pt, {_r('coalesce(step / 0.5, 0.0)', 'instant_speed')}, {_r('coalesce(angle / 0.5, 0.0)', 'instant_angle')} FROM t")
def _(s, d):
    return tracks.instant_movements(segments(s, d), XYZ).select(*tracks.SEGMENT, "pt", "instant_speed", "instant_angle")


@query("f4_direction_states", FRAMES + f"""SELECT {KEY}, cast(pt AS bigint) AS pt, CASE WHEN dd IS NULL THEN 'None' WHEN dd > 0.1 THEN 'departure' WHEN dd < -0.1 THEN 'approach' ELSE 'stay' END AS quality
FROM (SELECT *, dist - lag(dist) OVER (PARTITION BY {BY} ORDER BY pt) AS dd FROM s)""")
def _(s, d):
    return tracks.direction_states(segments(s, d), "dist").select(*tracks.SEGMENT, "pt", F.col("quality_dist").alias("quality"))


@query("m1_basic_motility", FRAMES + f"""SELECT {KEY}, {_r('sum(step)', 'total_distance')}, {_r('avg(step) / 0.5', 'avg_speed')}, {_r('max(step) / 0.5', 'max_speed')}, {_r('min(step) / 0.5', 'min_speed')},
{_r('sum(angle)', 'total_angle')}, {_r('avg(angle) / 0.5', 'avg_angle')}, {_r('max(angle) / 0.5', 'max_angle')}, {_moments('step', 'displ')}, {_moments('angle', 'angle')},
{_r('sqrt(power(arg_max(x, pt) - arg_min(x, pt), 2) + power(arg_max(y, pt) - arg_min(y, pt), 2) + power(arg_max(z, pt) - arg_min(z, pt), 2))', 'net_distance')} FROM t GROUP BY {BY}""")
def _(s, d):
    out = motility.basic_motility(segments(s, d), XYZ)
    return out.select(*tracks.SEGMENT, "total_distance", "avg_speed", "max_speed", "min_speed", "total_angle", "avg_angle", "max_angle", "displ_variance", "displ_cov", "angle_variance", "angle_cov", "net_distance")


@query("m3_alpha", FRAMES + f"""SELECT {KEY}, {_r('regr_slope(ln(msd), ln(tau))', 'alpha')} FROM (
  SELECT a."Type", a."Label", a.seg, b.pt - a.pt AS tau, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS msd
  FROM s a JOIN s b ON a."Type" = b."Type" AND a."Label" = b."Label" AND a.seg = b.seg AND b.pt > a.pt GROUP BY 1, 2, 3, 4) WHERE msd > 0 GROUP BY {BY}""")
def _(s, d):
    return motility.alpha(motility.mean_squared_displacements(segments(s, d), XYZ))


@query("m6_gini", FRAMES + f"""SELECT {KEY}, {_r('sum((2 * r - k - 1) * step) / nullif(max(k) * max(k) * avg(step), 0)', 'gini')} FROM (
  SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY step) AS r, count(*) OVER (PARTITION BY {BY}) AS k FROM t WHERE step IS NOT NULL) GROUP BY {BY}""")
def _(s, d):
    return motility.gini(tracks.steps(segments(s, d), XYZ), "step")


@query("m8_autocorrelation", FRAMES + f"""SELECT {KEY}, {', '.join(_r(f'sum(p{k}) / nullif(sum(c * c), 0)', f'acf_{k}') for k in (1, 2, 3))} FROM (
  SELECT *, {', '.join(f'c * lag(c, {k}) OVER (PARTITION BY {BY} ORDER BY pt) AS p{k}' for k in (1, 2, 3))} FROM (
    SELECT *, step - avg(step) OVER (PARTITION BY {BY}) AS c FROM t WHERE step IS NOT NULL)) GROUP BY {BY}""")
def _(s, d):
    return motility.autocorrelations(tracks.steps(segments(s, d), XYZ), "step")


@query("g1_signal_shape", FRAMES + f"""SELECT {KEY}, {_r('sum(dist)', 'total')}, {_r('max(dist)', 'maximum')}, {_r('max(dist) - min(dist)', 'peak_to_peak')}, {_r('regr_slope(dist, pt)', 'slope')},
{_r('sqrt(avg(dist * dist))', 'rms')}, {_r('max(dist) / sqrt(avg(dist * dist))', 'crestfactor')}, {_r('sqrt(avg(dist * dist)) / avg(dist)', 'formfactor')}, {_r('max(abs(dist)) / avg(dist)', 'pulseindicator')} FROM s GROUP BY {BY}""")
def _(s, d):
    return signals.shape_features(segments(s, d), "dist")


@query("g5_zone_runs", FRAMES + f"""SELECT "Type", "Label", cast(seg AS bigint) AS seg, {', '.join(f'cast(coalesce(sum(CASE WHEN zone = {z} THEN k END), 0) AS bigint) AS "{z}_times", cast(coalesce(max(CASE WHEN zone = {z} THEN k END), 0) AS bigint) AS "{z}_persistence"' for z in (0, 1, 2))} FROM (
  SELECT "Type", "Label", seg, zone, g, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY pt) - row_number() OVER (PARTITION BY {BY}, zone ORDER BY pt) AS g FROM s) GROUP BY 1, 2, 3, 4, 5) GROUP BY {BY}""")
def _(s, d):
    return signals.state_runs(segments(s, d), F.col("zone"), ["0", "1", "2"])


@query("g8_permutation_entropy", FRAMES + f"""SELECT {KEY}, {_r('-sum(p * ln(p))', 'permutation_entropy')} FROM (SELECT {BY}, k / sum(k) OVER (PARTITION BY {BY}) AS p FROM (
  SELECT {BY}, (a > b)::int * 4 + (a > c)::int * 2 + (b > c)::int AS code, count(*) AS k FROM (SELECT *, lag(x, 2) OVER w AS a, lag(x, 1) OVER w AS b, x AS c FROM s WINDOW w AS (PARTITION BY {BY} ORDER BY pt)) WHERE a IS NOT NULL GROUP BY {BY}, code)) GROUP BY {BY}""")
def _(s, d):
    return signals.permutation_entropy(segments(s, d), "x")


@query("c2_cluster_shares", """WITH n AS (SELECT o_orderpriority AS c, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT a.c, b.k, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT c FROM n) a CROSS JOIN (SELECT DISTINCT k FROM n) b LEFT JOIN n ON n.c = a.c AND n.k = b.k),
h AS (SELECT *, 100.0::double * n / sum(n) OVER (PARTITION BY c) AS share FROM g)
SELECT c, k, cast(n AS bigint) AS n, round(share, 6) + 0.0::double AS share, round(100 * share / nullif(sum(share) OVER (PARTITION BY k), 0), 6) + 0.0::double AS relative_share FROM h""")
def _(s, d):
    o = read(s, d, "orders").select(F.col("o_orderpriority").alias("c"), F.col("o_orderstatus").alias("k"))
    return stats.shares(o, "c", "k")


@query("c4_cluster_entropy", """SELECT c, round(-sum(p * ln(p)), 6) + 0.0::double AS entropy, (SELECT round(ln(count(DISTINCT o_orderstatus)), 6) FROM orders) AS max_entropy FROM (
SELECT c, n / sum(n) OVER (PARTITION BY c) AS p FROM (SELECT o_orderpriority AS c, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY c""")
def _(s, d):
    return stats.cluster_entropy(read(s, d, "orders").select(F.col("o_orderpriority").alias("c"), F.col("o_orderstatus").alias("k")), "c", "k")


@query("c5_order_clusters", "SELECT c_mktsegment, cast(row_number() OVER (ORDER BY median(c_acctbal), c_mktsegment) - 1 AS bigint) AS new_label FROM customer GROUP BY 1")
def _(s, d):
    return stats.order_clusters(read(s, d, "customer"), "c_mktsegment", "c_acctbal")


@query("c6_average_z", """SELECT c_mktsegment, round(avg((c_acctbal - m) / sd), 6) + 0.0::double AS avg_z FROM customer,
(SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def _(s, d):
    return stats.average_z(read(s, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING")


@query("c7_cohen_d", """SELECT round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) + 0.0::double AS cohen_d FROM
(SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING') a,
(SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY') b""")
def _(s, d):
    return stats.cohen_d(read(s, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")


@query("c8_rank_tests", """WITH p AS (SELECT a.g AS one, b.g AS two FROM (SELECT DISTINCT c_mktsegment AS g FROM customer) a JOIN (SELECT DISTINCT c_mktsegment AS g FROM customer) b ON a.g < b.g),
m AS (SELECT one, two, c_mktsegment AS g, c_acctbal AS x FROM customer JOIN p ON c_mktsegment = one OR c_mktsegment = two),
r AS (SELECT *, rank() OVER (PARTITION BY one, two ORDER BY x) + (count(*) OVER (PARTITION BY one, two, x) - 1) / 2.0::double AS r FROM m),
w AS (SELECT one, two, sum(CASE WHEN g = one THEN r END) AS w, cast(sum((g = one)::int) AS double) AS n1, cast(sum((g <> one)::int) AS double) AS n2 FROM r GROUP BY 1, 2)
SELECT one, two, round(w - n1 * (n1 + 1) / 2, 6) + 0.0::double AS u, round((w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) + 0.0::double AS z FROM w""")
def _(s, d):
    return stats.rank_tests(read(s, d, "customer"), "c_mktsegment", "c_acctbal")


@query("c9_kruskal_wallis", """WITH r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::double AS r, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders),
b AS (SELECT g, sum(r) AS r, cast(count(*) AS double) AS n, sum(t * t - 1.0::double) AS t FROM r GROUP BY 1)
SELECT round((12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - sum(t) / (sum(n) * sum(n) * sum(n) - sum(n))), 4) + 0.0::double AS h FROM b""")
def _(s, d):
    return stats.kruskal_wallis(read(s, d, "orders"), "o_orderpriority", "o_totalprice").select(F.round("h", 4).alias("h"))


@query("c10_adjusted", """WITH p AS (SELECT l_suppkey AS id, avg(l_discount) AS p FROM lineitem GROUP BY 1), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS q FROM p)
SELECT id, round(min(q) OVER (ORDER BY p DESC, id DESC), 6) + 0.0::double AS adjusted FROM q""")
def _(s, d):
    p = read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_discount").alias("p"))
    return stats.adjust(p, "p", ["id"]).select("id", "adjusted")


@query("c12_transitions", """SELECT a AS current, b AS next, count(*) AS n FROM (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    return stats.transitions(read(s, d, "conversations"), ["conv_id"], ["turn", "text"], "role")


@query("c13_occupancy", FRAMES + """SELECT cast(ceil((x - lx) / ((hx - lx) / 19.0::double) - 0.5) AS bigint) AS ix, cast(ceil((y - ly) / ((hy - ly) / 19.0::double) - 0.5) AS bigint) AS iy, count(*) AS n FROM f0,
(SELECT floor(min(x)) - 1 AS lx, ceil(max(x)) + 1 AS hx, floor(min(y)) - 1 AS ly, ceil(max(y)) + 1 AS hy FROM f0) GROUP BY 1, 2""")
def _(s, d):
    return maps.occupancy(frames(s, d), "x", "y", 20)


@query("c16_binned_curve", """SELECT l_returnflag, cast(floor(l_quantity / 10) * 10 AS double) AS bin, count(*) AS n, round(avg(l_extendedprice), 4) + 0.0::double AS mean, round(median(l_extendedprice), 4) + 0.0::double AS median, round(stddev_pop(l_extendedprice), 4) + 0.0::double AS std
FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1, 2""")
def _(s, d):
    out = maps.binned_curve(read(s, d, "lineitem"), "l_quantity", "l_extendedprice", 0.0, 10.0, 50.0, ["l_returnflag"])
    return out.select("l_returnflag", "bin", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")])


VOXELS = "WITH v AS (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, l_linenumber AS z, month(l_shipdate) % 4 AS t, l_quantity AS value FROM lineitem) "


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select((c("l_partkey") % 32).alias("x"), (c("l_suppkey") % 32).alias("y"), c("l_linenumber").alias("z"), (F.month("l_shipdate") % 4).alias("t"), c("l_quantity").alias("value"))


@query("v2_zone_shares", VOXELS + """, q AS (SELECT t, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.9) AS b FROM v GROUP BY 1),
z AS (SELECT v.t, CASE WHEN value <= a THEN 0 WHEN value >= b THEN 2 ELSE 1 END AS zone, count(*) AS n FROM v JOIN q ON v.t = q.t GROUP BY 1, 2)
SELECT cast(t AS bigint) AS t, cast(zone AS bigint) AS zone, n, round(100.0::double * n / sum(n) OVER (PARTITION BY t), 6) + 0.0::double AS share FROM z""")
def _(s, d):
    return voxels.zone_share(voxels.zones(cells(s, d), ["t"], "value"), ["t"])


@query("v6_objects", VOXELS + "SELECT cast(t AS bigint) AS t, round(avg(z), 6) + 0.0::double AS cz, round(avg(y), 6) + 0.0::double AS cy, round(avg(x), 6) + 0.0::double AS cx, count(*) AS volume FROM v GROUP BY t")
def _(s, d):
    return voxels.objects(cells(s, d), "t")


@query("c21_painted", VOXELS + """SELECT cast(z AS bigint) AS z, cast(y AS bigint) AS y, cast(xx AS bigint) AS x, round(avg(value), 6) + 0.0::double AS mean, count(*) AS hits FROM (
SELECT z, y, x + o AS xx, value FROM v, (SELECT unnest([-1, 0, 1]) AS o)) WHERE z BETWEEN 0 AND 7 AND y BETWEEN 0 AND 31 AND xx BETWEEN 0 AND 31 GROUP BY 1, 2, 3""")
def _(s, d):
    return voxels.paint(cells(s, d), [(0, 0, -1), (0, 0, 0), (0, 0, 1)], "value", (8, 32, 32))


COUNTS = "WITH c AS (SELECT l_suppkey AS cell_id, 'g' || l_partkey AS gene, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2), v AS (SELECT cell_id, gene, ln(1 + count * 10000.0::double / sum(count) OVER (PARTITION BY cell_id)) AS value FROM c) "


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.concat(F.lit("g"), "l_partkey").alias("gene"), "l_quantity")
    return i.repartition("cell_id").groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("count"))  # a cell's rows stay together for its total


@query("r2_normalised", COUNTS + "SELECT gene, round(sum(value), 4) + 0.0::double AS total, count(*) AS cells FROM v GROUP BY 1")
def _(s, d):
    return expression.normalise(counts(s, d)).groupBy("gene").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("cells"))


@query("r5_markers", COUNTS + """, k AS (SELECT s_suppkey AS cell_id, s_nationkey % 3 AS cluster FROM supplier), g AS (SELECT DISTINCT gene FROM c),
f AS (SELECT g.gene, k.cluster, coalesce(v.value, 0) AS value FROM g CROSS JOIN k LEFT JOIN v ON v.gene = g.gene AND v.cell_id = k.cell_id),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY gene, round(value, 9)) - 1) / 2.0::double AS r, count(*) OVER (PARTITION BY gene) AS n FROM f),
w AS (SELECT gene, cluster, sum(r) AS w, cast(count(*) AS double) AS n1, cast(max(n) AS double) AS n FROM r GROUP BY 1, 2)
SELECT gene, cast(cluster AS bigint) AS cluster, round((w - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12), 5) + 0.0::double AS z FROM w""")
def _(s, d):
    v = expression.normalise(counts(s, d)).withColumn("value", F.round("value", 9))
    k = read(s, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 3).alias("cluster"))
    return expression.markers(v, k).select("gene", "cluster", F.round("z", 5).alias("z"))


@query("j8_set_overlaps", """WITH s AS (SELECT DISTINCT l_suppkey AS set_name, l_partkey AS gene FROM lineitem), n AS (SELECT set_name, count(*) AS n FROM s GROUP BY 1)
SELECT a.set_name AS one, b.set_name AS two, count(*) AS inter, round(count(*) / (max(n.n) + max(m.n) - count(*))::double, 6) AS jaccard
FROM s a JOIN s b ON a.gene = b.gene AND a.set_name < b.set_name JOIN n ON n.set_name = a.set_name JOIN n m ON m.set_name = b.set_name GROUP BY 1, 2""")
def _(s, d):
    return expression.set_overlaps(read(s, d, "lineitem").select(F.col("l_suppkey").alias("set_name"), F.col("l_partkey").alias("gene")))


@query("p12_cut", "SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN 'low' WHEN o_totalprice >= 100000 AND o_totalprice < 300000 THEN 'mid' ELSE 'nan' END AS band FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", scalar.cut(F.col("o_totalprice"), [0, 100000, 300000], ["low", "mid"]).alias("band"))


@query("p13_keywords", "SELECT p_partkey, contains(p_name, 'red') OR contains(p_name, 'ring') AS any_word, contains(p_name, 'red') AND contains(p_name, 'ring') AS all_words FROM part")
def _(s, d):
    n = F.col("p_name")
    return read(s, d, "part").select("p_partkey", scalar.has_keywords(n, ["red", "ring"]).alias("any_word"), scalar.has_keywords(n, ["red", "ring"], "and").alias("all_words"))


@query("p16_projection", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0::double, least(1.0::double, (l_quantity * 3 + l_tax * 4) / 25)), 6) + 0.0::double AS t FROM lineitem")
def _(s, d):
    zero = F.lit(0.0)
    t = scalar.project_on_line([zero, zero], [F.lit(3.0), F.lit(4.0)], [F.col("l_quantity"), F.col("l_tax")], True)
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.alias("t"))


from . import features  # noqa: E402, F401  (registers its queries)
