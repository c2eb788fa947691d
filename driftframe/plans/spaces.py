"""Registered queries of feature spaces: structure terms, fused transport, neighbour graph and layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import fused, layout, learning
from ..operators.rounds import Rounds
from .features import FITTED
from .queries import query, read


def _vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("x2_structure_terms", "SELECT a.vec_id AS id, round(avg(list_distance(a.embedding::double[], b.embedding::double[]) ** 2), 6) + 0.0::double AS eccentricity FROM embeddings a, embeddings b GROUP BY 1")
def _(s, d):
    return fused.structure_terms(_vectors(s, d))


NEIGHBOURS = 20

E6 = f"""WITH RECURSIVE p AS (SELECT embedding::double[] AS v, min(vec_id) AS id FROM embeddings GROUP BY 1),
n AS (SELECT a.id, b.id AS near, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= {NEIGHBOURS}),
l AS (SELECT id, list(d - rho) AS over, log2(least({NEIGHBOURS}, count(*))) AS want FROM (SELECT *, min(d) FILTER (d > 0) OVER (PARTITION BY id) AS rho FROM n) GROUP BY id),
s AS (SELECT id, over, want, 0.0::double AS lo, 1e308::double AS hi, 1.0::double AS sigma, 0 AS step FROM l UNION ALL
  SELECT id, over, want, lo2, hi2, CASE WHEN hi2 = 1e308 THEN sigma * 2 ELSE (lo2 + hi2) / 2 END, step + 1 FROM (SELECT *, CASE WHEN much THEN lo ELSE sigma END AS lo2, CASE WHEN much THEN sigma ELSE hi END AS hi2
    FROM (SELECT *, list_sum(list_transform(over, lambda x: exp(-greatest(x, 0) / sigma))) > want AS much FROM s WHERE step < 64))),
w AS (SELECT n.id, near, exp(-greatest(d - min(d) FILTER (d > 0) OVER (PARTITION BY n.id), 0) / sigma) AS weight FROM n JOIN s ON n.id = s.id AND step = 64),
u AS (SELECT least(id, near) AS a, greatest(id, near) AS b, coalesce(max(weight) FILTER (id < near), 0) AS p, coalesce(max(weight) FILTER (id > near), 0) AS q, count(*) AS sides FROM w GROUP BY 1, 2)
"""


@query("e6_graph", E6 + "SELECT a, b, round(p + q - p * q, 6) + 0.0::double AS weight, sides FROM u")
def _(s, d):
    rounds = Rounds(s)
    lists, _ = layout.neighbours(layout.points(_vectors(s, d)), NEIGHBOURS, rounds)
    return layout.union(layout.membership(lists, NEIGHBOURS))


@query("e6_weight_sums", E6 + "SELECT id, round(sum(weight), 6) + 0.0::double AS total, round(log2(20), 6) AS wanted FROM w GROUP BY id")
def _(s, d):
    lists, _ = layout.neighbours(layout.points(_vectors(s, d)), NEIGHBOURS, Rounds(s))
    return layout.membership(lists, NEIGHBOURS).groupBy("id").agg(F.sum("weight").alias("total")).withColumn("wanted", F.lit(float(np.log2(NEIGHBOURS))))


def sides(s, d):
    """Embeddings and the suppliers' mean lines: two tables of vectors without a dimension in common, a score and three labels each."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = _vectors(s, d).join(read(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("label")), "id")
    one = learning.standardise(one.withColumn("score", F.col("v")[0]), ["score"])
    two = read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(*[F.avg(c).alias(c) for c in names])
    two = learning.standardise(two, names).join(read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("label")), "id")
    return one.select("id", "v", "score", "label"), two.select("id", F.array(*names).alias("v"), F.col("l_quantity").alias("score"), "label")


def _fused(s, d):
    """Per source row its mass and over how many anchors it spreads; per target row its mass and the length of its vector among the sources."""
    coupling = fused.fused_transport(*sides(s, d))

    @F.pandas_udf("double")
    def spread(mass: pd.Series) -> pd.Series:
        m = np.stack(mass.to_numpy()) if len(mass) else np.zeros((0, 1))
        p = m / m.sum(1, keepdims=True)
        return pd.Series(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1)))

    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    left = coupling.left.select(F.lit("source").alias("side"), "id", total.alias("mass"), spread("mass").alias("spread"), F.lit(None).cast("double").alias("length"))
    held = s.createDataFrame([(i, float(m)) for i, m in enumerate(coupling.target.mass)], "anchor int, held double")  # one row an anchor
    right = coupling.right.join(F.broadcast(held), "anchor").select("id", (F.col("share") * F.col("held")).alias("mass"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return left.union(fused.projected(coupling).select("id", length.alias("length")).join(right, "id").select(F.lit("target"), "id", "mass", F.lit(None).cast("double"), "length"))


FITTED["x3_fused_transport"] = _fused
FITTED["e6_embedding"] = lambda s, d: layout.embed(_vectors(s, d), NEIGHBOURS)
