"""Near-duplicate texts: sets of 5-word shingles with a Jaccard similarity of at least 0.8.

Each text gets independent fingerprints: 20 bands of 5 minima over its shingles. Two texts of
similarity s agree in a band with chance s^5, so all but 1 in 2800 pairs at 0.8 (fewer above) meet
in a bucket; `simhash.keep_first` adds the Golay buckets of their fingerprints. Candidates are
verified by the exact similarity of their shingle sets.

A bucket is not paired at once: all its members are compared with its smallest, the hub. One minus
the similarity is a metric, so a member near the hub can only be linked to one that the hub is not
linked to if their similarities to it differ by at most 0.2; members for which there is no such one
are settled. What the hubs connect is one component from then on. What is left of buckets with
several components is compared in blocks of texts, whose task gives only links that connect: no
pair becomes a row. A family of texts around the bound, which no hub connects and the bound does
not settle, still costs the square of its size in comparisons (about a microsecond each). Members of
the largest component of a bucket are compared with the others only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components
from .neardup import _groups

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
#: Rows dealt together with their hub; of blocks compared with each other, the mean shingles and texts; different shingles taken together.
BLOCK, WEIGHT, TEXTS, COLUMNS = 64, 1 << 16, 512, 1 << 14
#: For sums of floats at the bound.
SLACK = 1e-9

_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(1 << 62, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_ADD = _RNG.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different 5-word shingles (fewer words: of all of them; none: empty)."""
    words = (text or "").encode().lower().split()  # as simhash.simhash
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1 if k else 0
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
    return np.unique(s)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets from `shingles`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bands(s: np.ndarray) -> np.ndarray:
    """A set's keys, one for each band."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.min([(s[i : i + 1024] * _MUL + _ADD).min(axis=1) for i in range(0, len(s), 1024)], axis=0).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return key.view(np.int64)


@F.pandas_udf(T.StructType().add("same", T.BinaryType()).add("size", T.LongType()).add("bands", T.ArrayType(T.LongType())))
def sketch_udf(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    return pd.DataFrame({"same": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "size": [len(s) for s in sets], "bands": [bands(s) for s in sets]})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, ["g", "a"]):
        node, lead = t["node"].to_numpy(), t["lead"].to_numpy()
        sets = [shingles(x) for x in t["text"].to_pylist()]
        at, rest = np.flatnonzero(lead)[0], np.flatnonzero(~lead)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), node[at])), pa.array(node[rest]), pa.array([similarity(sets[at], sets[i]) for i in rest], pa.float64())], names=["a", "b", "sim"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of one or two blocks, links at SIMILAR that connect different components, as few as do."""
    for t in _groups(batches, ["g"]):
        node, comp, blk = (t[c].to_numpy() for c in ("node", "comp", "blk"))
        sets = [shingles(x) for x in t["text"].to_pylist()]
        size = np.array([len(x) for x in sets])
        named, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        both = np.zeros((len(sets), len(sets)))
        for lo in range(0, len(named), COLUMNS):
            at = (column >= lo) & (column < lo + COLUMNS)
            has = np.zeros((len(sets), min(COLUMNS, len(named) - lo)), np.float32)
            has[row[at], column[at] - lo] = 1
            both += has @ has.T
        link = both >= SIMILAR * (size[:, None] + size[None, :] - both) - SLACK
        link &= comp[:, None] != comp[None, :]
        if len(np.unique(blk)) > 1:
            link &= blk[:, None] != blk[None, :]  # one block against itself is a group of its own
        top = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        a, b = [], []
        for i, j in np.argwhere(np.triu(link, 1)).tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                top[max(x, y)] = min(x, y)
                a.append(node[i])
                b.append(node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, sim) of different pairs (a, b); an `a` of many pairs is dealt out in blocks of them."""
    pairs = scratch.keep(pairs.distinct(), f"{name}_pairs")
    many = scratch.small(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1"), f"{name}_many")
    blocks = pairs.join(many, "a", "left").withColumn("g", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))))
    members = blocks.select("g", "a", F.col("b").alias("node"), F.lit(False).alias("lead")).union(blocks.select("g", "a", F.col("a").alias("node"), F.lit(True)).distinct())
    dealt = members.join(texts, "node").select("g", "a", "node", "lead", "text").repartition("a", "g").sortWithinPartitions("a", "g")
    return scratch.keep(dealt.mapInArrow(_compare, "a long, b long, sim double"), f"{name}_sims")


def links(nodes: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect all nodes (node, size, bands) meeting in a bucket at SIMILAR or more; rows: (node, text).

    What the first hubs connect is one component from then on: only members of different components
    are compared any further, so a family of copies adds a row for each of its members, not for each pair.
    """
    keyed = scratch.keep(nodes.select("node", "size", F.explode("bands").alias("key")), "keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    left = scratch.keep(keyed.join(sizes, "key").select("key", "node", "size"), "shared")
    scratch.drop("keyed")
    texts = scratch.keep(rows.join(left.select("node").distinct(), "node"), "texts")
    hubs = scratch.small(left.groupBy("key").agg(F.min("node").alias("hub")), "hubs0")
    told = left.join(hubs, "key").where("node <> hub")
    sims = _verified(told.select(F.col("hub").alias("a"), F.col("node").alias("b")), texts, scratch, "hub0")
    told = scratch.keep(told.join(sims.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("sim").alias("sim0")), ["hub", "node"]).drop("hub"), "told0")
    rest = scratch.small(told.where(F.col("sim0") < SIMILAR).groupBy("key").agg(F.max("sim0").alias("rest")), "rest0")
    left = told.join(rest, "key").where((F.col("sim0") < SIMILAR) | (F.col("sim0") - F.col("rest") <= 1 - SIMILAR + SLACK)).drop("rest")
    one = scratch.keep(components(sims.where(F.col("sim") >= SIMILAR).select("a", "b"), scratch, "first"), "one")
    found = [one.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))]
    left = left.join(one, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = scratch.small(left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "several")
    left = scratch.keep(left.join(several, "key").select("key", "node", "comp", "size"), "left")
    # members of a bucket's main component, the one with most of them, need no comparison with each other
    counts = left.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    main = counts.groupBy("key").agg(F.max_by(F.struct("comp", "n", "w"), F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / TEXTS), F.ceil(w / WEIGHT))
    others = blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w"))
    parts = main.select("key", F.col("m.comp").alias("main"), others.alias("others"), blocks(F.col("m.n"), F.col("m.w")).alias("mains"))
    placed = left.join(scratch.small(parts, "parts"), "key").withColumn("is_main", F.col("comp") == F.col("main"))
    blk = lambda n: F.pmod(F.xxhash64(F.lit(9), "node"), n)
    placed = placed.withColumn("blk", F.when(F.col("is_main"), F.col("others") + blk(F.col("mains"))).otherwise(blk(F.col("others"))))
    last = F.col("others") + F.when(F.col("is_main"), 0).otherwise(F.col("mains")) - 1
    with_ = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    dealt = placed.select("key", "node", "comp", "blk", with_).select("node", "comp", "blk", F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("g"))
    dealt = dealt.join(texts, "node").repartition("g").sortWithinPartitions("g", "node")
    found.append(scratch.keep(dealt.mapInArrow(_connect, "a long, b long"), "connected"))
    return found[0].union(found[1]).distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, the first by id (nulls last), hash of the text and key.

    Texts of equal shingle sets are one node, those without words too. Every row has its own key in
    a written table, so rows of equal or null id are compared like any other. All columns stay.
    `keys` gives a text's buckets besides those of its bands, as an array of long.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid"), sketch_udf(F.col(text_col)).alias("sketch"), (keys(F.col(text_col)) if keys else F.array().cast("array<long>")).alias("keys")), "rows")
    id_ = F.col("row").getField(id_col)
    text = F.xxhash64(F.col("row").getField(text_col)).alias("text")
    best = F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), text, F.col("uid")))
    nodes = rows.groupBy("sketch.same").agg(F.min("uid").alias("node"), best.alias("best"), F.first("sketch.size").alias("size"), F.array_union(F.first("sketch.bands"), F.min_by("keys", "uid")).alias("bands"))
    nodes = scratch.keep(nodes.drop("same"), "nodes")
    texts = rows.select(F.col("uid").alias("node"), F.col("row").getField(text_col).alias("text"))
    comp = components(links(nodes.select("node", "size", "bands"), texts, scratch), scratch)
    named = nodes.select("node", "best").join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("best").alias("best"))
    return rows.join(named.select(F.col("best.uid").alias("uid")), "uid", "left_semi").select("row.*")
