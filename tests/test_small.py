"""Labels, blocks, lists and files of small tables with the awkward cases in them."""

import pytest
from pyspark.sql import functions as F

from driftframe.functions import scalar
from driftframe.operators import ordering, prepare, signals, tracks, voxels
from driftframe.sources import io


def test_blocks_keep_every_track(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, a double")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, b string")
    assert sorted(map(tuple, prepare.wide_features([a, b], ["k"]).collect()), key=str) == [(1, 1.0, "x"), (2, 2.0, None), (3, None, "y"), (None, 3.0, "z")]


def test_clusters_on_tracks_and_frames(spark):
    t = spark.createDataFrame([(1, 5, 9.0), (2, 5, 7.0), (3, 8, 1.0), (4, None, 20.0)], "track int, cluster int, v double")
    f = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (4, 0)], "track int, pt int")
    on_tracks, on_frames = prepare.label_clusters(t, f, "cluster", "v", ["track"])
    assert {r.track: r.cluster for r in on_tracks.collect()} == {1: 1, 2: 1, 3: 0, 4: 2}
    assert sorted((r.track, r.pt, r.cluster) for r in on_frames.collect()) == [(1, 0, 1), (1, 1, 1), (3, 0, 0), (4, 0, 2)]
    with pytest.raises(Exception, match="no label"):
        prepare.label_clusters(t, spark.createDataFrame([(9, 0)], "track int, pt int"), "cluster", "v", ["track"])[1].collect()


def test_names_and_durations(spark):
    df = spark.createDataFrame([("a-Int15s", 1), ("b", None), (None, 2)], "v string, t int")
    got = df.select(scalar.video_label(F.col("v"), F.col("t")), scalar.track_label(F.col("v"), F.lit("T"), F.col("t")), scalar.least_duration(F.col("v"))).collect()
    assert list(map(tuple, got)) == [("a-Int15s_1", "a-Int15s_T_1", 40), (None, None, 20), (None, None, 20)]
    kept = prepare.keep_recoded(df, "v", ["b", "a-Int15s"], {"b": "B"}).collect()
    assert sorted(r.v for r in kept) == ["B", "a-Int15s"]


def test_recut_and_frames(spark):
    df = spark.createDataFrame([("T", "a", i, float(i)) for i in range(7)] + [("T", "b", i, 0.0) for i in range(2)], "Type string, Label string, Time int, x double")
    got = tracks.recut_segments(df, 3).orderBy("Time").collect()
    assert [(r.pseudo_Label, r.pseudo_Time) for r in got] == [(f"a_{k // 3 + 1}", k % 3 + 1) for k in range(6)]
    moved = tracks.instant_movements(df, ["x"], keys=["Type", "Label"], time="Time", divide_angle=False)
    assert [r.pseudo_frame for r in moved.where("Label = 'a'").orderBy("Time").collect()] == list(range(7))


def test_overlap_and_single_hits(spark):
    df = spark.createDataFrame([("T", "a", 0, i, v) for i, v in enumerate([0.0, 0.2, 0.4, 0.0, 0.1])], "Type string, Label string, seg int, pt int, o double")
    r = signals.overlap_features(df, "o").first()
    assert abs(r.avg_overlap - 0.14) < 1e-12 and abs(r.overlap_slopes - 0.0) < 1e-12 and (r.contact_times, r.contact_persistences, r.noncontact_times, r.noncontact_persistences) == (3, 2, 2, 1)
    at = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 3.0)], "z double, y double, x double, v double")
    got = voxels.paint(at, [(0, 0, 0), (0, 0, 1)], "v", (1, 1, 3), once=True).collect()
    assert sorted((r.x, r.mean) for r in got) == [(0, 1.0), (2, 3.0)]


def test_places(spark):
    rows = [(i, float(i * 7 % 11)) for i in range(40)] + [(99, None), (98, None)]
    got = {r.i: r.place for r in ordering.places(spark.createDataFrame(rows, "i int, v double"), "v", ["i"], falling=True).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "genes.csv").write_text("Gene,Function\nCd4,a\n,b\nCxcr5,c\nCd4,d\n Bcl6 ,e\n")
    assert sorted(r.gene for r in io.read_gene_list(spark, str(tmp_path / "genes.csv")).collect()) == ["Bcl6", "Cd4", "Cxcr5"]
    known = spark.createDataFrame([("Cd4",), ("Bcl6",), (None,)], "gene string")
    assert sorted(r.gene for r in io.read_gene_list(spark, str(tmp_path / "genes.csv"), known).collect()) == ["Bcl6", "Cd4"]
    df = spark.createDataFrame([(1, "x,y", [1.0, 2.0]), (2, None, None)], "i int, s string, a array<double>")
    io.write(df, str(tmp_path / "out"), form="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted((r.i, r.s, r.a) for r in back) == [("1", "x,y", "[1.0,2.0]"), ("2", None, None)]
    io.write(df, str(tmp_path / "parts"), ["i"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parts")).select("i", "s", "a").collect())) == [(1, "x,y", [1.0, 2.0]), (2, None, None)]
