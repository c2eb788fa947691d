"""Queries of preparation, joins of feature blocks and comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import motility, prepare, stats, tracks
from .queries import BY, FRAMES, KEY, XYZ, _r, frames, query, read, segments


@query("p2_renamed", "SELECT l_returnflag AS flag_r, l_linestatus AS line_s, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    n = read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("return_r"), F.col("l_linestatus").alias("line_s")).agg(F.count("*").alias("n"))
    return prepare.rename_containing(n, "return", "flag")


@query("p3_prefixed", FRAMES + f"SELECT {KEY}, {_r('avg(x)', 'morpho_x')}, {_r('avg(y)', 'morpho_y')} FROM s GROUP BY {BY}")
def _(s, d):
    return prepare.prefix_features(segments(s, d).groupBy(*tracks.SEGMENT).agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "morpho_", tracks.SEGMENT)


@query("p8_cut_times", FRAMES + """SELECT "Video", count(*) AS n, max("Time") AS last FROM f0 WHERE NOT ("Video" = 'V1' AND "Time" > 30) AND NOT ("Video" = 'V3' AND "Time" > 5) GROUP BY 1""")
def _(s, d):
    return prepare.cut_times(frames(s, d), {"V1": 30, "V3": 5}).groupBy("Video").agg(F.count("*").alias("n"), F.max("Time").alias("last"))


@query("p9_left_out", FRAMES + """SELECT "Video", count(*) AS n FROM f0 WHERE "Video" NOT IN (SELECT "Video" FROM (SELECT "Video", row_number() OVER (ORDER BY "Video") AS r, count(*) OVER () AS k FROM (SELECT DISTINCT "Video" FROM f0)) WHERE r = 2 OR r = k) GROUP BY 1""")
def _(s, d):
    return prepare.leave_out_by_place(frames(s, d), "Video", [1, -1]).groupBy("Video").agg(F.count("*").alias("n"))


@query("p10_later_frames", FRAMES + f"SELECT {KEY}, count(*) AS n, {_r('avg(x)', 'x')} FROM s WHERE pt NOT IN (0, 1) GROUP BY {BY}")
def _(s, d):
    return segments(s, d).where(~F.col("pt").isin(0, 1)).groupBy(*tracks.SEGMENT).agg(F.count("*").alias("n"), F.avg("x").alias("x"))


@query("p11_complete_columns", FRAMES + 'SELECT "Label", "Time", event_id FROM f0')
def _(s, d):
    f = frames(s, d).select("Label", F.col("Time"), "event_id", F.when(F.col("Time") > 1, F.col("x")).alias("before"))
    return prepare.complete_columns(f)


@query("p15_terms", "SELECT o_orderpriority AS term, count(*) AS n FROM orders WHERE regexp_matches(coalesce(nullif(o_orderpriority, '5-LOW'), ''), 'URGENT|high', 'i') GROUP BY 1")
def _(s, d):
    o = read(s, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("term"))
    return o.where(prepare.holds_term(F.col("term"), ["urgent", "HIGH"])).groupBy("term").agg(F.count("*").alias("n"))


@query("p17_codes", "SELECT l_returnflag AS label, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END::bigint AS code, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def _(s, d):
    return read(s, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("label"), prepare.codes(F.col("l_returnflag"), ["R", "A"]).alias("code")).agg(F.count("*").alias("n"))


@query("p19_shannon", FRAMES + f"SELECT {KEY}, {_r('-sum(p * ln(p + 1e-10::double))', 'entropy')} FROM (SELECT {BY}, count(*) / 20.0::double AS p FROM s GROUP BY {BY}, zone) GROUP BY {BY}")
def _(s, d):
    n = segments(s, d).groupBy(*tracks.SEGMENT, "zone").agg((F.count("*") / 20.0).alias("p"))
    return n.groupBy(*tracks.SEGMENT).agg(F.collect_list("p").alias("ps")).select(*tracks.SEGMENT, scalar.shannon_entropy(F.col("ps")).alias("entropy"))


@query("t6_without_listed", FRAMES + 'SELECT "Type", "Label", count(*) AS n FROM f0 WHERE "Label" NOT IN (SELECT "Label" FROM f0 WHERE overlap > 0.6) GROUP BY 1, 2')
def _(s, d):
    f = frames(s, d)
    return prepare.without_listed(f, f.where("overlap > 0.6"), ["Label"]).groupBy("Type", "Label").agg(F.count("*").alias("n"))


@query("t10_labelled_frames", FRAMES + """, m AS (SELECT "Label", avg(x) > 80 AS high FROM f0 GROUP BY 1) SELECT f0."Label", "Time", event_id, CASE WHEN high THEN 'high' ELSE 'low' END AS track_label FROM f0 JOIN m USING ("Label")""")
def _(s, d):
    f = frames(s, d)
    labels = f.groupBy("Label").agg(F.when(F.avg("x") > 80, "high").otherwise("low").alias("track_label"))
    return prepare.label_frames(f.select("Label", "Time", "event_id"), labels, ["Label"])


_VOXEL = "cast(greatest(0, least({n} - 1, round_even({c} / {s}, 0))) AS bigint)"


def _voxel(c: str, size: str, n: int) -> str:
    return _VOXEL.format(c=c, s=f"{size}::double", n=n)


@query("f5_clipped_voxels", FRAMES + f"SELECT event_id, {_voxel('x', '4', 32)} AS v_x, {_voxel('y', '3', 32)} AS v_y, (round_even(x / 4::double, 0) NOT BETWEEN 0 AND 31)::bigint + (round_even(y / 3::double, 0) NOT BETWEEN 0 AND 31)::bigint AS clipped FROM f0")
def _(s, d):
    return prepare.clipped_voxels(frames(s, d), {"x": (4.0, 32), "y": (3.0, 32)}).select("event_id", "v_x", "v_y", "clipped")


@query("j2_zone_of_voxel", FRAMES + f""", q AS (SELECT l_partkey % 32 AS v_x, l_suppkey % 32 AS v_y, max(l_linenumber % 3) AS zone FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2),
p AS (SELECT event_id, {_voxel('x', '4', 32)} AS v_x, {_voxel('y', '3', 32)} AS v_y FROM f0)
SELECT event_id, coalesce(q.zone, 0)::bigint AS zone FROM p LEFT JOIN q USING (v_x, v_y)""")
def _(s, d):
    zones = read(s, d, "lineitem").where("l_partkey % 2 = 0").groupBy((F.col("l_partkey") % 32).alias("v_x"), (F.col("l_suppkey") % 32).alias("v_y")).agg(F.max(F.col("l_linenumber") % 3).alias("zone"))
    at = prepare.clipped_voxels(frames(s, d).drop("zone"), {"x": (4.0, 32), "y": (3.0, 32)})
    return prepare.zone_of_voxel(at, zones, ["v_x", "v_y"]).select("event_id", "zone")


_MSD = """, pr AS (SELECT a."Type", a."Label", a.seg, b.pt - a.pt AS tau, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS msd
  FROM s a JOIN s b ON a."Type" = b."Type" AND a."Label" = b."Label" AND a.seg = b.seg AND b.pt > a.pt GROUP BY 1, 2, 3, 4)"""


@query("m11_wide_features", FRAMES + _MSD + f""", b AS (SELECT {BY}, sum(step) AS total, avg(angle) / 0.5 AS angle FROM t GROUP BY {BY}), r AS (SELECT {BY}, avg(dist) AS dist FROM s GROUP BY {BY}),
w AS (SELECT {BY}, max(msd) FILTER (WHERE tau = 1) AS m1, max(msd) FILTER (WHERE tau = 2) AS m2, max(msd) FILTER (WHERE tau = 3) AS m3 FROM pr GROUP BY {BY})
SELECT {KEY}, {_r('total', 'total_distance')}, {_r('angle', 'avg_angle')}, {_r('m1', 'msd_1')}, {_r('m2', 'msd_2')}, {_r('m3', 'msd_3')}, {_r('dist', 'dist_average')} FROM b JOIN w USING ({BY}) JOIN r USING ({BY})""")
def _(s, d):
    seg = segments(s, d)
    lags = prepare.lag_features(motility.mean_squared_displacements(seg, XYZ), tracks.SEGMENT, "tau", "msd", [1, 2, 3], "msd")
    basic = motility.basic_motility(seg, XYZ).select(*tracks.SEGMENT, "total_distance", "avg_angle")
    near = prepare.prefix_features(seg.groupBy(*tracks.SEGMENT).agg(F.avg("dist").alias("average")), "dist_", tracks.SEGMENT)
    return prepare.wide_features([basic, lags, near], tracks.SEGMENT)


def _central(x: str, k: int) -> str:
    return f"avg(power({x} - m_{x}, {k}))"


def _shape(x: str, p: str) -> str:
    two, three, four = (_central(x, k) for k in (2, 3, 4))
    when = lambda e, n: f"CASE WHEN count(DISTINCT {x}) > 1 THEN round({e}, 6) + 0.0::double END AS {p}_{n}"
    return ", ".join([when(f"{three} / power({two}, 1.5)", "skewness"), when(f"{four} / ({two} * {two}) - 3", "kurtosis"), when(f"avg(power({x}, 4)) / (3 * power(avg({x} * {x}), 2)) - 1", "ngaussalpha")])


@query("m1_progressivity", FRAMES + f"""SELECT {KEY}, {_r('sqrt(power(arg_max(x, pt) - arg_min(x, pt), 2) + power(arg_max(y, pt) - arg_min(y, pt), 2) + power(arg_max(z, pt) - arg_min(z, pt), 2)) / nullif(sum(step), 0)', 'progressivity')},
{_r('min(angle) / 0.5', 'min_angle')}, {_shape('step', 'displ')}, {_shape('angle', 'angle')} FROM (SELECT *, avg(step) OVER g AS m_step, avg(angle) OVER g AS m_angle FROM t WINDOW g AS (PARTITION BY {BY})) GROUP BY {BY}""")
def _(s, d):
    out = motility.basic_motility(segments(s, d), XYZ)
    return out.select(*tracks.SEGMENT, "progressivity", "min_angle", *[f"{p}_{n}" for p in ("displ", "angle") for n in ("skewness", "kurtosis", "ngaussalpha")])


@query("g2_shape", FRAMES + f"SELECT {KEY}, {_shape('dist', 'dist')} FROM (SELECT *, avg(dist) OVER (PARTITION BY {BY}) AS m_dist FROM s) GROUP BY {BY}")
def _(s, d):
    return segments(s, d).groupBy(*tracks.SEGMENT).agg(*[c for c in motility.moments("dist", "dist")[2:]])


@query("a7_axis_moments", FRAMES + f"SELECT {KEY}, {', '.join(_shape(c, c) for c in ('dx', 'dy', 'dz'))} FROM (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY {BY}) AS m_{c}' for c in ('dx', 'dy', 'dz'))} FROM (SELECT * REPLACE (abs(dx) AS dx, abs(dy) AS dy, abs(dz) AS dz) FROM d)) GROUP BY {BY}")
def _(s, d):
    w = tracks.in_order(tracks.SEGMENT, "pt")
    steps = segments(s, d).withColumns({f"d{c}": F.abs(F.col(c) - F.lag(c).over(w)) for c in XYZ})
    return steps.groupBy(*tracks.SEGMENT).agg(*[m for c in ("dx", "dy", "dz") for m in motility.moments(c, c)[2:]])


@query("a4_axis_speeds", FRAMES + f"SELECT {KEY}, {', '.join(_r(f'{f}(abs({c})) / 0.5', f'{f}_speed_{c}') for c in ('dx', 'dy', 'dz') for f in ('avg', 'max', 'min'))} FROM d GROUP BY {BY}")
def _(s, d):
    w = tracks.in_order(tracks.SEGMENT, "pt")
    steps = segments(s, d).withColumns({f"d{c}": F.abs(F.col(c) - F.lag(c).over(w)) / 0.5 for c in XYZ})
    of = {"avg": F.avg, "max": F.max, "min": F.min}
    return steps.groupBy(*tracks.SEGMENT).agg(*[f(c).alias(f"{n}_speed_{c}") for c in ("dx", "dy", "dz") for n, f in of.items()])


@query("j9_listed_genes", "SELECT l_partkey AS gene, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1")
def _(s, d):
    known = read(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("gene"))
    out = read(s, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("cell"))
    li = read(s, d, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell"))
    return prepare.without_listed(prepare.only_listed(li, known, ["gene"]), out, ["cell"]).groupBy("gene").agg(F.count("*").alias("n"))


@query("x6_merged", FRAMES + """SELECT dataset, zone, cluster, count(*) AS n FROM (SELECT 'behaviour' AS dataset, zone::bigint AS zone, state AS cluster FROM f0
UNION ALL SELECT 'rna', (s_nationkey % 3)::bigint, NULL FROM supplier) GROUP BY 1, 2, 3""")
def _(s, d):
    rna = read(s, d, "supplier").select((F.col("s_nationkey") % 3).cast("long").alias("zone"))
    both = prepare.stack({"behaviour": frames(s, d).select(F.col("zone").cast("long").alias("zone"), F.col("state").alias("cluster")), "rna": rna})
    return both.groupBy("dataset", "zone", "cluster").agg(F.count("*").alias("n"))


@query("o6_complement", "SELECT range AS part FROM range(3000) WHERE range NOT IN (SELECT l_partkey FROM lineitem)")
def _(s, d):
    return prepare.complement(3000, read(s, d, "lineitem").select(F.col("l_partkey").alias("part")).distinct(), "part")


@query("c1_counts", FRAMES + 'SELECT "Video", zone::bigint AS zone, count(*) AS n, count(DISTINCT "Label") AS tracks FROM f0 GROUP BY 1, 2')
def _(s, d):
    return frames(s, d).groupBy("Video", "zone").agg(F.count("*").alias("n"), F.count_distinct("Label").alias("tracks"))


@query("c9_anova", """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS m FROM g)
SELECT round((sum(n * (g.m - a.m) * (g.m - a.m)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) + 0.0::double AS f FROM g, a""")
def _(s, d):
    return stats.anova(read(s, d, "customer"), "c_mktsegment", "c_acctbal").select("f")


#: P of F with 4 and d2 degrees of freedom is a short sum: (1 - x)^b (1 + b x), x = 4 f / (4 f + d2), b = d2 / 2.
@query("c9_anova_p", """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS m, count(*) AS k, (sum(n) - count(*))::double AS d2, sum(n * v) AS w FROM g),
f AS (SELECT max(k) - 1 AS d1, max(d2) AS d2, sum(n * (g.m - a.m) * (g.m - a.m)) / 4 / (max(w) / max(d2)) AS f FROM g, a)
SELECT d1::bigint AS d1, d2::bigint AS d2, round(pow(1 - 4 * f / (4 * f + d2), d2 / 2) * (1 + d2 / 2 * (4 * f / (4 * f + d2))), 6) + 0.0::double AS p FROM f WHERE d1 = 4""")
def _(s, d):
    a = stats.anova(read(s, d, "customer"), "c_mktsegment", "c_acctbal")
    return a.select("d1", F.col("d2").cast("long").alias("d2"), stats.f_p("f", "d1", "d2").alias("p"))


RANKED = """WITH r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::double AS r, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders),
b AS (SELECT g, avg(r) AS m, count(*)::double AS n FROM r GROUP BY 1), c AS (SELECT count(*)::double AS n, sum(t * t - 1.0::double) AS t FROM r)
"""


#: P of chi-square with 4 degrees of freedom is exp(-h / 2) (1 + h / 2).
@query("c9_kruskal_p", RANKED + """, h AS (SELECT (12 / (max(c.n) * (max(c.n) + 1)) * sum(b.n * b.m * b.m) - 3 * (max(c.n) + 1)) / (1 - max(c.t) / (max(c.n) * max(c.n) * max(c.n) - max(c.n))) AS h, count(*) - 1 AS dof FROM b, c)
SELECT dof::bigint AS dof, round(exp(-h / 2) * (1 + h / 2), 6) + 0.0::double AS p FROM h WHERE dof = 4""")
def _(s, d):
    return stats.kruskal_wallis(read(s, d, "orders"), "o_orderpriority", "o_totalprice").select("dof", stats.chi_square_p("h", "dof").alias("p"))


@query("c9_dunn", RANKED + """SELECT p.g AS one, q.g AS two, round((p.m - q.m) / sqrt((c.n * (c.n + 1) / 12 - c.t / (12 * (c.n - 1))) * (1 / p.n + 1 / q.n)), 6) + 0.0::double AS z FROM b p, b q, c WHERE p.g < q.g""")
def _(s, d):
    return stats.dunn(read(s, d, "orders"), "o_orderpriority", "o_totalprice")


@query("c10_bonferroni", "SELECT l_suppkey AS id, round(least(1, avg(l_discount) * count(*) OVER ()), 6) + 0.0::double AS adjusted FROM lineitem GROUP BY 1")
def _(s, d):
    p = read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_discount").alias("p"))
    return stats.adjust(p, "p", ["id"], "bonferroni").select("id", "adjusted")


@query("c19_two_conditions", """WITH q AS (SELECT l_linenumber::bigint AS category, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS a, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS b FROM lineitem),
v AS (SELECT category, avg(a) AS ma, avg(b) AS mb, median(a) AS da, median(b) AS db, count(a) AS na, count(b) AS nb, var_samp(a) AS va, var_samp(b) AS vb FROM q GROUP BY 1),
p AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS pooled FROM v)
SELECT category, """ + ", ".join(_r(e, n) for e, n in (("ma", "mean_one"), ("mb", "mean_two"), ("da", "median_one"), ("db", "median_two"), ("sqrt(va / na)", "sem_one"), ("sqrt(vb / nb)", "sem_two"), ("(mb - ma) / pooled", "cohen_d"), ("(mb - ma) / (pooled * sqrt(1.0::double / na + 1.0::double / nb))", "t_pooled"), ("(mb - ma) / sqrt(va / na + vb / nb)", "t_welch"))) + " FROM p")
def _(s, d):
    return prepare.two_conditions(read(s, d, "lineitem").withColumn("category", F.col("l_linenumber")), "category", "l_returnflag", "l_quantity", "A", "R")
