"""Written rounds of iterative operators: tables that cut the lineage and go away when they are done with."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a temporary one on a local master and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


class Rounds:
    """Tables of one run. `keep` writes one and reads it back; a name that is kept again replaces the one before.

    The last ones hold results that are read later; they are deleted when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.at = spark, f"{_folder(spark)}/rounds-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.at:
            self._files(self.top).deleteOnExit(self._path(self.top))
        before, self.at[name] = self.at.get(name), path
        out = self.spark.read.schema(df.schema).parquet(path)
        if before:
            self._delete(before)
        gc.collect()  # have the driver notice finished jobs, so that executors delete their shuffle files now
        self.spark._jvm.System.gc()
        return out

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._files(path).delete(self._path(path), True)
