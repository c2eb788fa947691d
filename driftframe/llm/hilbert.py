"""Sharding along a Hilbert curve over document metadata.

Dimensions (text size, source, language) are quantised to 2^BITS cells each and mapped to their
index on a 3-dimensional Hilbert curve; only the three numbers leave the JVM, in Arrow batches.
Rows in curve order are cut into runs of equal counts, one per shard, so a shard's files span a
compact box of metadata and can be pruned on any of the dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, global_rank

BITS = 8
SHARDS = 24


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the curve of each row (x0, x1, ..) of cells, 0 .. 2^bits - 1 each (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the rotations, coarse cells first
        low = (1 << b) - 1
        for i in range(n):
            hit = (x[i] >> b & 1).astype(bool)
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


@F.pandas_udf(T.LongType())
def hilbert_udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert(np.stack([a, b, c], axis=1)))


def cells(text: Column, source: Column, lang: Column, bits: int = BITS) -> list[Column]:
    """Quantised dimensions: size on a log scale, then source and language by hash; null is cell 0."""
    top = (1 << bits) - 1
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return [
        F.least(F.lit(top), F.floor(F.log2(size + F.lit(1)) * (top / 32))).cast("long"),
        F.when(source.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(source), F.lit(top))).cast("long"),
        F.when(lang.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(lang), F.lit(top))).cast("long"),
    ]


def shard_sizes(n: Column, k: int) -> tuple[Column, Column]:
    """(rows of a short shard, number of shards that hold one more)."""
    return F.floor(n / k).cast("long"), (n % k).cast("long")


PLACED = ("size", "text_crc32", "hilbert", "law", "shard", "slot", "grown_shard")


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", carry: bool = False) -> DataFrame:
    """(id, size, text_crc32, hilbert, shard, slot) of every row; law: counts at most one apart.

    Runs of the order (hilbert, text_crc32, id) are cut so that shards differ by one row at most;
    slot is the place in the shard. Equal texts have equal sizes and checksums, so copies of one
    source and language lie next to each other. Null texts count as size 8 with checksum of the
    empty text; null sources, languages and ids sort first; repeated rows are placed each (which
    of equal rows comes first makes no difference). An empty table gives no rows. With `carry`
    the other columns of docs come along, except those that have one of these names.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text")
    rest = [c for c in docs.columns if carry and c != id_col and c not in PLACED]
    slim = docs.select(
        F.struct(F.lit(0).alias("__none"), *rest).alias("__doc"),
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        hilbert_udf(*cells(text, F.col("source"), F.col("lang"))).alias("hilbert"),
        F.monotonically_increasing_id().alias("__uid"),
    )
    if carry:  # only the key goes through the sort, so that long texts do not meet in one range
        rows = slim = scratch.keep(slim, "rows")
    slim = slim.drop("__doc")
    order = [F.col(c) for c in ("hilbert", "text_crc32", "id", "__uid")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = global_rank(slim, order, "rank", parts, scratch, "ranked")
    low, more = shard_sizes(F.col("n"), shards)
    total = ranked.agg(F.count("*").alias("n"))
    cut = more * (low + 1)
    shard = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (low + 1))).otherwise(more + F.floor((F.col("rank") - cut) / F.greatest(low, F.lit(1))))
    begin = F.col("shard") * low + F.least(F.col("shard"), more)
    placed = ranked.crossJoin(F.broadcast(total)).withColumn("shard", shard.cast("int"))  # one row
    placed = placed.withColumn("slot", (F.col("rank") - begin).cast("long"))
    if carry:
        placed = rows.join(placed.select("__uid", "shard", "slot").hint("merge"), "__uid")
    return placed.select(F.col("id").alias(id_col), *[F.col("__doc")[c].alias(c) for c in rest], "size", "text_crc32", "hilbert", "shard", "slot")


def digest(docs: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """The placement with its law named; rows are dealt out by count, so no other number of shards is prepared."""
    placed = place(docs, shards, carry=carry)
    return placed.select(*[c for c in placed.columns if c not in PLACED], "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet, one folder per shard, rows in curve order inside each file."""
    place(docs, shards, carry=True).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
