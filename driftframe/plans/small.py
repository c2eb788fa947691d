"""Registered queries of labels, recuts, overlaps and other small steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import ordering, prepare, signals, tracks
from .queries import BY, FRAMES, KEY, _r, frames, query, read, segments


@query("p5_labels", FRAMES + """SELECT DISTINCT "Video" || '_' || "Label" AS label, "Video" || '_' || "Type" || '_' || "Label" AS traj_label FROM f0""")
def _(s, d):
    f = frames(s, d)
    return f.select(scalar.video_label(F.col("Video"), F.col("Label")).alias("label"), scalar.track_label(F.col("Video"), F.col("Type"), F.col("Label")).alias("traj_label")).distinct()


@query("p6_long_enough", FRAMES + """, n AS (SELECT "Type", "Label", count(*) AS n, CASE WHEN "Video" = 'V1' THEN 80 ELSE 40 END AS least FROM f0 GROUP BY "Type", "Label", "Video") SELECT "Type", "Label", n FROM n WHERE n >= least""")
def _(s, d):
    name = F.when(F.col("Video") == "V1", F.lit("day-INT15s")).otherwise("day")
    return tracks.keep_long(frames(s, d), scalar.least_duration(name, 40, 80)).groupBy("Type", "Label").agg(F.count("*").alias("n"))


@query("p16_projected", "SELECT p_partkey, round(t, 6) + 0.0::double AS t, round(1 + 4 * t, 6) + 0.0::double AS x, round(2 - t, 6) + 0.0::double AS y FROM (SELECT p_partkey, greatest(0, least(1, ((p_size - 1) * 4 + (p_retailprice / 1000 - 2) * -1) / 17.0::double)) AS t FROM part)")
def _(s, d):
    start, end = [F.lit(1.0), F.lit(2.0)], [F.lit(5.0), F.lit(1.0)]
    t = scalar.project_on_line(start, end, [F.col("p_size").cast("double"), F.col("p_retailprice") / 1000], True)
    x, y = scalar.point_on_line(start, end, t)
    return read(s, d, "part").select("p_partkey", t.alias("t"), x.alias("x"), y.alias("y"))


@query("t3_recut", FRAMES + """SELECT "Type", "Label" || '_' || (seg * 2 + pt // 10 + 1) AS piece, cast(pt % 10 + 1 AS bigint) AS place, x FROM s""")
def _(s, d):
    cut = segments(s, d).drop("seg", "pt", "Time_span", "pseudo_Label")
    return tracks.recut_segments(cut, 10).select("Type", F.col("pseudo_Label").alias("piece"), F.col("pseudo_Time").alias("place"), "x")


@query("f3_varying_movements", FRAMES + f"""SELECT {KEY}, cast(pt AS bigint) AS frame, {_r('coalesce(sqrt(dx * dx + dy * dy + dz * dz) / 0.5, 0)', 'speed')}, {_r('coalesce(angle, 0)', 'angle')} FROM t""")
def _(s, d):
    out = tracks.instant_movements(segments(s, d), ["x", "y", "z"], divide_angle=False)
    return out.select(*tracks.SEGMENT, F.col("pseudo_frame").alias("frame"), F.col("instant_speed").alias("speed"), F.col("instant_angle").alias("angle"))


@query("g4_overlap", FRAMES + f"""SELECT {KEY}, {_r('avg(overlap)', 'avg_overlap')}, {_r('regr_slope(overlap, pt)', 'overlap_slopes')}, count(*) FILTER (WHERE overlap > 0) AS contact_times, count(*) FILTER (WHERE overlap = 0) AS noncontact_times FROM s GROUP BY {BY}""")
def _(s, d):
    return signals.overlap_features(segments(s, d), "overlap").select(*tracks.SEGMENT, "avg_overlap", "overlap_slopes", "contact_times", "noncontact_times")


@query("r1_recoded", "SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS cluster, count(*) AS n FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD') GROUP BY 1")
def _(s, d):
    out = prepare.keep_recoded(read(s, d, "customer").withColumn("cluster", F.col("c_mktsegment")), "cluster", ["MACHINERY", "BUILDING", "HOUSEHOLD"], {"MACHINERY": "BUILDING"})
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query("o4_sorted", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def _(s, d):
    return ordering.places(read(s, d, "customer"), "c_acctbal", ["c_custkey"], falling=True).select("c_custkey", "place")


@query("e5_labelled", """WITH o AS (SELECT c_mktsegment, row_number() OVER (ORDER BY median(c_acctbal), c_mktsegment) - 1 AS cluster FROM customer GROUP BY 1)
SELECT o_orderkey, cast(cluster AS bigint) AS cluster FROM orders JOIN customer ON o_custkey = c_custkey JOIN o USING (c_mktsegment)""")
def _(s, d):
    frames = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return prepare.label_clusters(read(s, d, "customer").withColumn("cluster", F.col("c_mktsegment")), frames, "cluster", "c_acctbal", ["c_custkey"])[1].select("o_orderkey", "cluster")
