"""Near-duplicate lines within one edit, by a deletion-neighbourhood join.

Equal lines are one class. Two lines at most one edit apart agree outside one chunk: cut to the
shorter one's length, some chunk number holds the edit, all before it agrees from the start and
all after it from the end. Lines first emit one hashed key per chunk ("all but this chunk"); only
those that share a key with another line emit the deletion variants of that chunk: without its
i-th character, tagged with i (equal variant and tag: one substitution), and, against lines one
character longer, whole (equal to the other without a character: one insertion). Equal variants
meet in an aggregation that keeps the earliest position, so no group is paired up; the winner's
edit distance is verified. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank

#: Lines that are shorter when trimmed always stay.
LEAST_CHARS = 20
SEPARATOR = "\n"


#: Line numbers in a position, and row numbers in a row's place.
LINES, ROWS = 1 << 31, 1 << 32


def _decimal(n: int) -> Column:
    return F.lit(n).cast("decimal(11,0)")


def _rows(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(of, id, lines): of orders the rows by id, nulls last; rows of equal or no id get a number each, by text hash and key."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    place = F.coalesce("id", F.lit((1 << 63) - 1)).cast("decimal(38,0)") * _decimal(ROWS)

    def out(df: DataFrame, number: Column) -> DataFrame:
        return df.select((place + number).cast("decimal(38,0)").alias("of"), "id", F.split("text", SEPARATOR).alias("lines"))

    again = scratch.small(slim.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 or id is null").select(F.col("id").alias("again")), "again")
    if again.isEmpty():
        return out(slim, F.lit(0))
    same = F.col("id").eqNullSafe(F.col("again"))
    several = scratch.keep(slim.join(again, same, "left_semi").withColumn("uid", F.monotonically_increasing_id()), "several")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = global_rank(several.select("id", F.xxhash64("text").alias("h"), "uid"), [F.col("id").asc_nulls_last(), F.col("h"), F.col("uid")], "rank", parts, scratch, "ranks")
    return out(slim.join(again, same, "left_anti"), F.lit(0)).union(out(several.join(ranks.select("uid", "rank"), "uid"), F.col("rank") + 1))


def _around(c: Column, j: Column) -> tuple[Column, Column]:
    """Characters before and after chunk j of a line cut to c characters."""
    g = _chunk_size(c)
    return g * j, F.greatest(c - g * (j + 1), F.lit(0))


def _chunk_size(c: Column) -> Column:
    return F.ceil(c / F.greatest(F.lit(2), F.ceil(F.cbrt(c) / 2))).cast("int")


NONE = "array<struct<v:bigint,tag:int,whole:boolean>>"


def earlier_lines(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(pos, partner): lines of the distinct (line_id, pos, line) that have an earlier one within one edit, with the earliest found."""
    lines = lines.withColumn("n", F.char_length("line"))
    by = lines.select("line_id", "line", "n", F.explode(F.array("n", F.col("n") - 1)).alias("c"))
    by = by.withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / _chunk_size(F.col("c"))).cast("int") - 1)))
    before, after = _around(F.col("c"), F.col("j"))
    key = F.xxhash64("c", "j", F.substr("line", F.lit(1), before), F.substr("line", F.col("n") - after + 1, after))
    keyed = scratch.keep(by.select("line_id", "c", "j", key.alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    shared = scratch.small(shared, "shared")
    keyed = scratch.keep(keyed.join(shared, "key"), "sharing")
    scratch.drop("keyed")
    # only lines that share a key are looked at from here on
    named = scratch.small(keyed.select("line_id").distinct(), "named")
    lines = scratch.keep(lines.join(named, "line_id", "left_semi"), "candidates")
    chunk = F.substr("line", before + 1, F.col("n") - before - after)
    part = keyed.join(lines, "line_id").select("key", "pos", "c", "n", chunk.alias("x"))
    size = F.char_length("x")
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.xxhash64(F.concat(F.substr("x", F.lit(1), i - 1), F.substr("x", i + 1))).alias("v"), F.when(F.col("n") == F.col("c"), i).otherwise(0).alias("tag"), F.lit(False).alias("whole")))
    cut = F.when(size > 0, F.when(F.col("n") > F.col("c"), F.array_distinct(cut)).otherwise(cut)).otherwise(F.array().cast(NONE))
    whole = F.when(F.col("n") == F.col("c"), F.array(F.struct(F.xxhash64("x").alias("v"), F.lit(0).alias("tag"), F.lit(True).alias("whole")))).otherwise(F.array().cast(NONE))
    variants = scratch.keep(part.select("key", "pos", F.explode(F.concat(cut, whole)).alias("w")).select("key", "pos", "w.*"), "variants")
    met = variants.groupBy("key", "v", "tag").agg(F.min(F.when(F.col("whole"), F.col("pos"))).alias("one"), F.min(F.when(~F.col("whole"), F.col("pos"))).alias("other"), F.count("*").alias("k")).where("k > 1").drop("k")
    # tag > 0: any two differ by a substitution; tag 0: the whole line and those one longer
    partner = F.when(F.col("tag") > 0, F.col("other")).when(F.col("whole"), F.col("other")).otherwise(F.col("one"))
    found = variants.join(met, ["key", "v", "tag"]).select("pos", partner.alias("partner")).where(F.col("partner") < F.col("pos"))
    texts = lines.select("pos", "line")
    both = found.distinct().join(texts, "pos").join(texts.select(F.col("pos").alias("partner"), F.col("line").alias("other")), "partner")
    return both.where(F.levenshtein("line", "other", 1) >= 0).groupBy("pos").agg(F.min("partner").alias("partner"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(id, n_lines, n_kept, kept): every document with its kept lines joined again.

    A line (trimmed of blanks) of `least` characters or more goes if an earlier line, by document
    id and line number, is equal to it or within one edit of it, whether that one stays or not.
    Shorter lines stay. Null texts have no lines and kept is null; an empty text is one empty
    line. Every row is a document of its own: rows of equal id come in the order of their texts'
    hash, rows without an id last, and of repeated rows one keeps its lines. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, scratch)
    lines = rows.select("of", F.posexplode("lines").alias("at", "raw")).select("of", "at", F.trim("raw").alias("line"))
    long = lines.where(F.char_length("line") >= least)
    classes = long.groupBy("line").agg(F.min((F.col("of") * _decimal(LINES) + F.col("at")).cast("decimal(38,0)")).alias("pos"))
    classes = scratch.keep(classes.withColumn("line_id", F.monotonically_increasing_id()), "classes")
    kept = classes.select("pos").join(earlier_lines(classes, scratch).select("pos"), "pos", "left_anti")
    at = F.pmod("pos", _decimal(LINES)).cast("int")
    named = kept.select(((F.col("pos") - at) / _decimal(LINES)).cast("decimal(38,0)").alias("of"), at.alias("at"))
    short = lines.where(F.char_length("line") < least).select("of", "at")
    stay = scratch.keep(named.union(short).groupBy("of").agg(F.array_sort(F.collect_set("at")).alias("stay")), "stay")  # at most a document's lines
    scratch.drop("classes")
    out = rows.join(stay.hint("merge"), "of", "left")  # as long as documents: never broadcast
    held = F.filter(F.coalesce("stay", F.array().cast("array<int>")), lambda i: i < F.size("lines"))
    out = out.withColumn("held", F.when(F.col("lines").isNotNull(), held))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("held"), F.lit(0)).cast("long").alias("n_kept"), F.array_join(F.transform("held", lambda i: F.col("lines")[i]), SEPARATOR).alias("kept"))
