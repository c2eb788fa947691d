"""Joins of individuals, objects and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .nearest import exact_pairs
from .rounds import Rounds


def close_objects(df: DataFrame, threshold: float, frame: list[str] | None = None) -> DataFrame:
    """Ids of objects (id, x, y, z) with another one of their frame nearer than the threshold.

    Objects lie in cells whose diagonal is under the threshold: those that share a cell are all close,
    without a pair. Only objects that are alone in their cell look into the cells around, so a cell's
    rows are met by at most the 124 lone objects beside it. Objects without a frame, an id or a finite
    place are close to nothing.
    """
    frame = frame or []
    side = threshold * 0.505  # the diagonal is 0.875 of the threshold, two cells more than the threshold
    finite = " and ".join([f"abs({c}) < double('infinity')" for c in "xyz"])
    own = df.select(*frame, "id", "x", "y", "z", *[F.floor(F.col(c) / side).alias(f"k{c}") for c in "xyz"]).where(f"id is not null and {finite}")
    for k in frame:
        own = own.where(F.col(k).isNotNull())
    cell = [*frame, "kx", "ky", "kz"]
    held = own.groupBy(*cell).agg(F.min("id").alias("__low"), F.max("id").alias("__high"))
    # rows of a cell by their number, not its rows in one place; a lone object may have several rows
    shared = own.join(held.where("__low <> __high").select(*cell).hint("merge"), cell, "left_semi").select(*frame, "id")
    lone = own.join(held.where("__low = __high").select(*cell).hint("merge"), cell, "left_semi")
    looks = lone.select(*frame, F.col("id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *[f"k{c}" for c in "xyz"])
    around, other = F.sequence(F.lit(-2), F.lit(2)), F.lit(False)
    for c in "xyz":
        here = F.col(f"k{c}")
        looks = looks.withColumn(f"o{c}", F.explode(around)).withColumn(f"k{c}", here + F.col(f"o{c}"))
        other = other | (F.col(f"o{c}") != 0)
    looks = looks.where(other).drop("ox", "oy", "oz")
    d = [(F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"]
    near = own.join(looks.hint("merge"), cell).where((F.col("id") != F.col("id2")) & (F.sqrt(d[0] + d[1] + d[2]) < threshold))
    sides = near.select(*frame, F.explode(F.array("id", "id2")).alias("id"))
    return shared.unionByName(sides).distinct()


def drop_close(df: DataFrame, threshold: float, frame: list[str] | None = None) -> DataFrame:
    """df without objects that have another one nearer than the threshold; both sides of a pair go."""
    return df.join(close_objects(df, threshold, frame), [*(frame or []), "id"], "left_anti")


def paired_differences(df: DataFrame, individual: str, condition: str, reference, values: list[str]) -> DataFrame:
    """d_<value> of each other condition to the reference condition of the same individual."""
    base = df.where(F.col(condition) == reference).select(individual, *[F.col(v).alias(f"__{v}") for v in values])
    other = df.where(F.col(condition) != reference)
    return other.join(base, individual).select(individual, condition, *[(F.col(v) - F.col(f"__{v}")).alias(f"d_{v}") for v in values])


def keep_large_groups(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows; sizes are counted before they are joined, so no group meets in one task."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= least), keys)


def map_genes(sets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Genes by their mapped names (source, target), or their own where there is none, and whether they were converted."""
    return sets.join(mapping, sets["gene"] == mapping["source"], "left").select("set_name", F.coalesce("target", "gene").alias("gene"), F.col("target").isNotNull().alias("converted"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors (Euclid) of each query; both (id, v). Queries are few by contract and meet every vector once, block by block (`nearest.exact_pairs`).

    Vectors that are null, of another length than the first, or hold null or non-finite components meet the others row by row.
    """
    first = vectors.where("size(v) > 0").select(F.size("v").alias("n")).first()
    fine = F.col("id").isNotNull() & (F.size("v") == (first.n if first else 0)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(fine, F.lit(False))
    d = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    def by_rows(asked: DataFrame, met: DataFrame) -> DataFrame:
        q = asked.select(F.col("id").alias("query"), F.col("v").alias("q"))
        return met.crossJoin(q).where("id != query").select("query", F.col("id").alias("neighbour"), d.alias("distance"))

    pairs = exact_pairs(queries.where(fine), vectors.where(fine), k, Rounds(vectors.sparkSession)).toDF("query", "neighbour", "distance")
    if not (vectors.where(~fine).isEmpty() and queries.where(~fine).isEmpty()):
        pairs = pairs.unionByName(by_rows(queries.where(~fine), vectors)).unionByName(by_rows(queries.where(fine), vectors.where(~fine)))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def label_cost(sources: DataFrame, targets: DataFrame, weight: float = 100.0) -> DataFrame:
    """max((s - t)^2, weight where labels differ) for every source and target (i, score, label)."""
    t = targets.select(F.col("i").alias("j"), F.col("score").alias("__t"), F.col("label").alias("__l"))
    gap = F.col("score") - F.col("__t")
    return sources.crossJoin(t).select("i", "j", F.greatest(gap * gap, F.when(F.col("label") != F.col("__l"), F.lit(weight)).otherwise(0.0)).alias("cost"))
