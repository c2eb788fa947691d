"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: What counts as white space between words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a temporary one on a local master and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


class Scratch:
    """Written tables that cut the lineage; `drop` deletes the ones no later step reads, the end of the driver's JVM the others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.marked = spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}", False

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self.marked:
            top = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
            self.marked = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(top)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, name: str, rows: int = 1_000_000) -> DataFrame:
        """df kept; marked for broadcast if it has at most `rows` (narrow) rows, else joined by a shuffle."""
        kept = self.keep(df, name)
        return F.broadcast(kept) if kept.count() <= rows else kept

    def release(self) -> None:
        """Have the driver notice finished jobs, so that executors delete their shuffle files now rather than later."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def global_rank(df: DataFrame, order: list[Column], rank: str, parts: int, scratch: Scratch, name: str) -> DataFrame:
    """df with `rank`, 0.. over the whole table in the given order, without a one-task window.

    Rows are range-partitioned and numbered inside each range; the ranges' counts (one row per
    range) give the offsets. `order` must end in a column that is unique.
    """
    ranged = scratch.keep(
        df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1),
        name,
    )
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranged.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    # one row per range: bounded by `parts`
    return ranged.join(F.broadcast(offsets), "__part").withColumn(rank, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `edges` (a, b).

    Alternating large-star and small-star steps (Kiveris et al. 2014); every round is written to
    the scratch folder. Minima are pre-aggregated and joined, so a node with very many
    neighbours is split by the adaptive skew join. Null ends and loops are ignored.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    size = seen = None
    for i in range(1, rounds):
        # large star: every larger neighbour of u hangs on the smallest node around u
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        nxt = scratch.keep(small.where("a <> b").distinct(), f"{name}_{i}")
        seen, size = size, nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        settled = size == seen and nxt.join(now, ["a", "b"], "left_anti").isEmpty()  # both hold different rows only
        scratch.drop(f"{name}_{i - 1}")
        now = nxt
        if settled:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
