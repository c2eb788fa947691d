"""Sources and sinks of track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """Long (measure, value, unit.., TrackID, Time) from exports with preamble lines: one measure per file.

    Rows whose first field is no number (preamble, header) go; the measure is the file name between
    its first `_` and the next `.`.
    """
    raw = spark.read.schema("value string, unit string, category string, track string, time string, id string").csv(path)
    path = F.element_at(F.split(F.input_file_name(), "/"), -1)  # as in an address: blanks and the like are encoded
    name = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    measure = F.substring_index(F.regexp_replace(name, "^[^_]*_", ""), ".", 1)
    return raw.select(measure.alias("measure"), F.expr("try_cast(value as double)").alias("value"), F.expr("try_cast(track as bigint)").alias("TrackID"), F.expr("try_cast(time as int)").alias("Time")).where("value is not null")


def widen(long: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One column per measure, joined by key rather than by position; missing overlaps are 0."""
    wide = long.groupBy(*keys).pivot("measure", measures).agg(F.first("value", ignorenulls=True))
    return wide.fillna(0.0, [c for c in measures if c.startswith("Overlapped")])


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, gene) of a tab-separated file: name, address, genes."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("set_name"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.lit(0), F.size(parts) - 2))).alias("gene")).where("gene <> ''")


def read_gene_list(spark: SparkSession, path: str, known: DataFrame | None = None, column: str = "Gene") -> DataFrame:
    """(gene) of a CSV file with a header, once each, without empty ones; with `known` (gene) only those it holds."""
    genes = spark.read.option("header", True).csv(path).select(F.trim(column).alias("gene")).where("gene <> ''").distinct()
    return genes if known is None else genes.join(known.select("gene").distinct(), "gene", "left_semi")


def write(df: DataFrame, path: str, by: list[str] | None = None, form: str = "parquet") -> None:
    """Parquet or CSV (with a header; arrays as JSON text), partitioned by the given columns."""
    if form == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    out = df.write.partitionBy(*by) if by else df.write
    out.option("header", True).csv(path) if form == "csv" else out.parquet(path)
