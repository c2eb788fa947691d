"""Features by name: one exchange, awkward tracks, and what turning a track to its own axes leaves alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.operators import wide

XYZ = ["x", "y", "z"]
KEY = ["Type", "Label"]


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(3)
    rows = [("T", f"t{k}", t, *p) for k in range(5) for t, p in enumerate(np.cumsum(rng.normal(size=(20, 3)) * [1, 4, 2], axis=0).tolist())]
    rows += [("T", "one", 0, 1.0, 1.0, 1.0), *[("T", "two", t, float(t), 0.0, 0.0) for t in range(2)], *[("T", "still", t, 1.0, 1.0, 1.0) for t in range(6)]]
    rows += [(None, "null", t, None if t == 3 else float(t), float("nan") if t == 5 else 0.0, 0.0) for t in range(12)]
    return spark.createDataFrame(rows, "Type string, Label string, t int, x double, y double, z double").withColumn("avg_speed", F.lit("clash"))


def test_one_exchange(tracks):
    names = ["avg_speed", "avg_angle", "msds", "alphas", "displ_gini", "angle_autocorr", "displ_partial_autocorr", "displ_hurst_RS", "speed_distribution_x", "alpha_y", "phi_total"]
    plan = wide.features(tracks, KEY, "t", XYZ, names)._jdf.queryExecution().sparkPlan().toString()
    ready = wide.features(tracks, KEY, "t", XYZ, names)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and ready.count("Exchange") == 1


def test_awkward_tracks(tracks):
    names = wide.known_names(XYZ)
    rows = {r.Label: r.asDict() for r in wide.features(tracks, KEY, "t", XYZ, names).collect()}
    assert len(rows) == 9
    assert all(v is None or v == [] for k, v in rows["one"].items() if k not in (*KEY, "exy_max", "eyz_max", "exz_max", "phi_max"))
    two = rows["two"]
    assert two["total_distance"] == 1 and two["progressivity"] == 1 and two["avg_speed"] == 2 and two["total_angle"] is None and two["msds_1"] == 1 and two["msds_2"] is None and two["displ_variance"] is None
    still = rows["still"]
    assert still["total_distance"] == 0 and still["progressivity"] is None and still["alphas"] is None and still["avg_angle"] == 0
    null = rows["null"]  # two frames are left out
    assert null["Type"] is None and abs(null["total_distance"] - 11) < 1e-12 and null["net_distance_x"] == 11
    with pytest.raises(ValueError, match="unknown features"):
        wide.features(tracks, KEY, "t", XYZ, ["speed"])
    assert wide.features(tracks.limit(0), KEY, "t", XYZ, names).count() == 0


def test_own_axes(tracks):
    tracks = tracks.where("Label like 't%' and Label <> 'two'")
    names = ["msd", "avg_speed", "net_distance", "displ_variance", "displ_autocorr", "displ_hurst_RS", "alpha"]
    per = [f"{n}_{c}" for n in names for c in XYZ]
    turned = wide.aligned_features(tracks, KEY, "t", XYZ, [*per, *wide.ELONGATIONS]).toPandas().set_index("Label")
    plain = wide.features(tracks, KEY, "t", XYZ, [*per, "msds", "net_distance"]).toPandas().set_index("Label").loc[turned.index]
    for k in (1, 2, 3):
        np.testing.assert_allclose(sum(turned[f"msd_{c}_{k}"] for c in XYZ), plain[f"msds_{k}"], rtol=1e-9)
    np.testing.assert_allclose(np.sqrt(sum(turned[f"net_distance_{c}"] ** 2 for c in XYZ)), plain["net_distance"], rtol=1e-9)
    assert (turned["exy_max"] <= 1 + 1e-9).all() and (turned["eyz_max"] <= 1 + 1e-9).all()  # the longest axis comes first
    assert not np.allclose(turned["avg_speed_x"], plain["avg_speed_x"])
