"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Every 23-bit word lies within
3 bits of exactly one codeword of the perfect binary Golay code. A segment's keys are the indices
of the codewords that it, or it with one bit flipped, decodes to (one or six of them): two
segments at most 2 bits apart have a word between them, so they share a key. Of 2 differing bits
in three segments at least one segment has none, so a bucket is "segment i exact, a key of segment
i+1": any two fingerprints at most 2 bits apart meet in a bucket, where the distance is verified.

Very full buckets (a large family of near copies) are not paired: their fingerprints emit
themselves and their 64 one-bit neighbours, and all that emit the same word are linked to the
smallest, which is exact (same word: at most 2 bits apart; at most 2 bits apart: a common word).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import Scratch, components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
FULL_BUCKET = 64


def _remainder(v: np.ndarray) -> np.ndarray:
    """Of 23-bit words by the generator: the 11-bit syndrome."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def _errors() -> np.ndarray:
    """By syndrome, the only error pattern of at most 3 bits."""
    bits = [0] + [1 << i for i in range(23)]
    patterns = np.unique([a | b | c for a in bits for b in bits for c in bits])
    out = np.zeros(2048, np.int64)
    out[_remainder(patterns)] = patterns
    return out


ERRORS = _errors()


def codewords(v: np.ndarray) -> np.ndarray:
    """12-bit codeword indices, shape (n, 24): of each word and its 23 one-bit neighbours; repeats occur."""
    near = v[:, None] ^ np.array([0] + [1 << i for i in range(23)], np.int64)
    return (near ^ ERRORS[_remainder(near)]) >> 11


def simhash(text: str | None) -> int:
    """Unsigned fingerprint of 3-word shingles (fewer words: of all of them; none: 0)."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, 42) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([np.uint64(simhash(t)).astype(np.int64) for t in texts], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def buckets_udf(prints: pd.Series) -> pd.Series:
    u = prints.to_numpy(np.int64).view(np.uint64)
    segs = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [codewords(s) for s in segs]
    keys = np.concatenate([(i << 40) + (segs[i][:, None] << 12) + near[(i + 1) % 3] for i in range(3)], axis=1)
    return pd.Series([np.unique(k) for k in keys])


def links(prints: DataFrame, scratch: Scratch, full: int = FULL_BUCKET) -> DataFrame:
    """(a, b): links among the distinct fingerprints `p` that leave no two within 2 bits unconnected."""
    keyed = scratch.keep(prints.select("p", F.explode(buckets_udf("p")).alias("key")), "keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(keyed.join(sizes, "key"), "shared")
    scratch.drop("keyed")
    some = shared.where(F.col("n") <= full).select("key", "p")
    pairs = some.alias("x").join(some.alias("y"), "key").where("x.p < y.p").select(F.col("x.p").alias("a"), F.col("y.p").alias("b")).where("bit_count(a ^ b) <= 2")
    many = shared.where(F.col("n") > full).select("p").distinct()
    words = many.select("p", F.explode(F.expr("concat(array(p), transform(sequence(0, 63), i -> p ^ shiftleft(1L, i)))")).alias("word"))
    hubs = words.groupBy("word").agg(F.min("p").alias("hub"))
    stars = words.join(hubs, "word").where("p <> hub").select(F.col("p").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: int = FULL_BUCKET) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and blank texts have fingerprint zero and are linked like any other; documents of equal
    fingerprints are one node. Rows with a null id get the component of their fingerprint (null
    where no row of it has an id). Repeated rows come back repeated; an empty table gives none.
    Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("p")), "prints")
    nodes = scratch.keep(prints.groupBy("p").agg(F.min("id").alias("first")), "nodes")
    comp = components(links(nodes.select("p"), scratch, full), scratch)
    # a component's id is the smallest document of all its fingerprints
    named = nodes.join(comp.withColumnRenamed("node", "p"), "p", "left").withColumn("component", F.coalesce("component", "p"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("p", "component_id")
    return prints.join(named, "p").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group of texts linked by five-word shingles, one row stays.

    Candidates meet in the Golay buckets of their fingerprints, as in `links`; as texts of similarity 0.8
    lie beyond 2 bits, bands of minima add theirs. All are verified exactly (see shingles).
    """
    return shingles.keep_first(docs, id_col, text_col, keys=lambda text: buckets_udf(fingerprint_udf(text)))
