"""Exact repeated substrings of LENGTH bytes by merging shard Burrows-Wheeler transforms.

Every LENGTH-byte window is assigned to the smallest-hashed GRAM-byte gram in it (the rightmost of
ties): equal windows have equal anchors at equal places. Windows of one anchor fall into pieces
of up to 64 starts that share a core of CORE bytes, with up to 63 bytes left and right of it. Only
pieces whose core occurs twice can hold a repeat; they alone are looked at further.

Pieces stand in two collections of strings, the core as first symbol and then what lies to its
right or, reversed, to its left, in symbols of WORD bytes; so a range of cores is an interval of
the merged transform and tasks own ranges. A task deals its pieces to shards and makes the
Burrows-Wheeler transform of each shard by itself. The transforms are then merged without looking
at the strings again: the interleave starts as the shards in turn and every round moves each
shard's entries to their places by the symbols of its transform (Holt and McMillan 2014), which
orders the interleave by one symbol more. The round in which two neighbours part is their common
prefix. Intervals with common prefixes of y bytes to the right and x to the left, x + y = 63, that
hold more than one piece (equal pieces are one row with its count) are the repeated windows: a
64-bit mask of starts per piece.

A core with over GROUP different pieces is not brought into one task: its pieces are cut in Spark
to 8 starts, and then to single windows, whose digests are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

LENGTH, GRAM = 400, 64
STARTS = 64
CORE = LENGTH - STARTS + 1
#: Bytes of text anchored together; positions must stay below 2^24.
BLOCK = 4 << 20
#: Different pieces around one core that a task takes.
GROUP = 100_000
#: Pieces in one shard transform, and in one merge.
SHARD, MERGE = 1024, 8192
#: Bytes of a symbol of the transforms.
WORD = 8
#: Rows of one piece beyond which its mask is broadcast.
HOT = 4096
POS = np.uint64((1 << 24) - 1)
ODD = 0x9E3779B97F4A7C15

SLIM = "key long, uid long, base long, lo int, hi int"
PIECES = "core long, s long, left binary, right binary, uid long, base long"


def anchored(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of concatenated texts x, text k ending at ends[k]: (core start, least, most bytes to its left)."""
    none = np.empty(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none
    h, b, n = x.astype(np.uint64) + np.uint64(1), ODD, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(b) + h[n:]
        b, n = b * b % (1 << 64), 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(ODD)
    m = (h & ~POS) | (POS - np.arange(len(h), dtype=np.uint64))
    span, width = 1, LENGTH - GRAM + 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    end = np.repeat(ends, np.diff(ends, prepend=0))
    i = np.flatnonzero(end[: len(m)] >= np.arange(len(m)) + LENGTH)
    if not len(i):
        return none, none, none
    a = (POS - (m[i] & POS)).astype(np.int64)
    base = a - ((a - i) & ~(STARTS - 1))
    first = np.flatnonzero(np.concatenate([[True], (base[1:] != base[:-1]) | (i[1:] != i[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(i)]]) - 1
    return base[first], base[first] - i[last], base[first] - i[first]


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int, int]]]]:
    """(bytes, ends, [(text, offset in it, place in the bytes)]); long texts overlap by LENGTH - 1."""
    data, info, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            part = t[at : at + BLOCK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            data.append(part)
            info.append((k, at, size))
            size += len(part)
            if size >= BLOCK:
                yield b"".join(data), np.cumsum([len(d) for d in data]), info
                data, info, size = [], [], 0
    if data:
        yield b"".join(data), np.cumsum([len(d) for d in data]), info


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _emit_slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid = batch.column("uid").to_numpy(zero_copy_only=False)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        for data, ends, info in _blocks(texts):
            base, lo, hi = anchored(np.frombuffer(data, np.uint8), ends)
            if len(base):
                of = np.searchsorted(ends, base, "right")
                owner, shift = np.array([k for k, _, _ in info])[of], np.array([at - place for _, at, place in info])[of]
                digest = xxhash.xxh3_64_intdigest
                yield pa.RecordBatch.from_arrays([_signed([digest(data[b : b + CORE]) for b in base.tolist()]), pa.array(uid[owner]), pa.array(base + shift), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["key", "uid", "base", "lo", "hi"])


def _emit_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row in batch.to_pylist():
            data = row["text"].encode("utf-8", "surrogatepass")
            for p in row["places"]:
                b, lo, hi = p["base"], p["lo"], p["hi"]
                core, left, right = data[b : b + CORE], data[b - hi : b], data[b + CORE : b + CORE + STARTS - 1 - lo]
                c, s = xxhash.xxh3_64_intdigest(core), xxhash.xxh64_intdigest(b"%d:" % hi + left + core + right)
                for o, v in zip(out, (c, s, left, right, row["uid"], b)):
                    o.append(v)
        if out[0]:
            arrays = [_signed(o) for o in out[:2]] + [pa.array(o, pa.binary()) for o in out[2:4]] + [pa.array(o, pa.int64()) for o in out[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["core", "s", "left", "right", "uid", "base"])


def _stable(x: np.ndarray) -> np.ndarray:
    """A stable order of small integers, 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and x.max() > 0xFFFF:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def transform(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all rotations of the strings (n, symbols) in order: the string of each, and the symbol before it."""
    n, size = strings.shape
    turned = [np.concatenate([strings[:, (r + k) % size] for r in range(size)]) for k in range(size)]
    order = np.lexsort(turned[::-1])
    return order % n, turned[-1][order]


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of shard transforms of strings of `symbols` symbols, and common prefixes.

    Returns for every rank of the merged order the place in the shards, one after the other, and
    how many symbols its rotation shares with the rank before.
    """
    before = np.concatenate([b for _, b in shards])
    source = np.repeat(np.arange(len(shards)), [len(b) for _, b in shards])
    place = np.arange(len(before))
    block = np.zeros(len(before), np.int64)
    lcp = np.full(len(before), symbols)
    for depth in range(symbols):
        symbol = before[place]
        to = _stable(symbol)
        symbol, block, source = symbol[to], block[to], source[to]
        edge = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])])
        lcp[edge & (lcp == symbols)] = depth
        block = np.cumsum(edge) - 1
        place[_stable(source)] = np.arange(len(before))  # a shard's entries keep their own order
        if edge.all():
            break
    return place, lcp


def merge_order(block: np.ndarray, sym: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the rows of sym (n, columns; bytes) below their block (0 ..), and common prefixes.

    lcp[k] is the number of columns that rows order[k-1] and order[k] share, -1 between blocks.
    """
    n, columns = sym.shape
    words = -(-columns // WORD)
    padded = np.zeros((n, words * WORD), np.uint8)
    padded[:, :columns] = sym
    coded = np.unique(padded.view(f">u{WORD}"), return_inverse=True)[1].reshape(n, words)
    strings = np.concatenate([block[:, None], coded + (int(block.max()) + 1)], axis=1)
    many = -(-n // shard)
    rows = [np.arange(k, n, many) for k in range(many)]  # every block's rows go to all shards
    shards = [transform(strings[r]) for r in rows]
    place, lcp = merge_transforms(shards, words + 1)
    # block symbols are the smallest: the first n ranks are the strings from their start
    order = np.concatenate([r[which] for r, (which, _) in zip(rows, shards)])[place[:n]]
    same, cells = lcp[:n] - 1, padded.reshape(n, words, WORD)
    split = np.flatnonzero((same >= 0) & (same < words))
    own = cells[order[split], same[split]] == cells[order[split - 1], same[split]]
    out = np.where(same < 0, -1, columns)
    out[split] = np.minimum(columns, same[split] * WORD + own.argmin(axis=1))
    return order, out


def repeated_starts(block: np.ndarray, left: list[bytes], right: list[bytes], count: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For each piece, a mask of the x for which its block has more than one row (by `count`) with the
    same x bytes to the left and 63 - x to the right."""
    n, most = len(block), STARTS - 1
    r = np.frombuffer(b"".join(s.ljust(most, b"\0") for s in right), np.uint8).reshape(n, most)
    l = np.frombuffer(b"".join(s[::-1].ljust(most, b"\0") for s in left), np.uint8).reshape(n, most)
    hi, lo = np.array([len(s) for s in left]), most - np.array([len(s) for s in right])
    (ro, rl), (lo_, ll) = merge_order(block, r, shard), merge_order(block, l, shard)
    mask = np.zeros(n, np.uint64)
    rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(STARTS):
        has = np.flatnonzero((lo <= x) & (x <= hi))
        if len(has):
            rid[ro], lid[lo_] = np.cumsum(rl < most - x), np.cumsum(ll < x)
            _, inv = np.unique(rid[has] * (n + 1) + lid[has], return_inverse=True)
            mask[has[np.bincount(inv, count[has])[inv] > 1]] |= np.uint64(1 << x)
    return mask


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core; whole groups are merged, at least MERGE pieces at a time."""

    def masks(t: pa.Table) -> pa.RecordBatch:
        c, n = t["core"].to_numpy(), t["n"].to_numpy()
        same = np.concatenate([[False], c[1:] == c[:-1]])
        several = same | np.concatenate([same[1:], [False]]) | (n > 1)
        t, c, n = t.filter(pa.array(several)), c[several], n[several]
        m = np.zeros(0, np.uint64)
        if len(c):
            block = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]]))
            m = repeated_starts(block, t["left"].to_pylist(), t["right"].to_pylist(), n)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(t["s"].to_numpy()), pa.array(m.view(np.int64))], names=["core", "s", "mask"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= MERGE:
            t = pa.Table.from_batches(held)
            c = t["core"].to_numpy()
            other = np.flatnonzero(c != c[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield masks(t.slice(0, cut))
            held, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if size:
        yield masks(pa.Table.from_batches(held))


def _narrow(step: int):
    """Pieces' starts in runs of `step`: (core, s, k1, k2, x, n): digest of the run's own core, first start, rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                hi, lo = len(left), STARTS - 1 - len(right)
                for x in range(0, STARTS, step):
                    top = min(x + step - 1, STARTS - 1)
                    if top < lo or x > hi or not row["live"] >> x & ((1 << step) - 1):
                        continue
                    k = xxhash.xxh3_128_intdigest(b"%d,%d:" % (row["core"], x) + left[hi - x :] + b"|" + right[: STARTS - 1 - top])
                    for o, v in zip(out, (row["core"] % (1 << 64), row["s"] % (1 << 64), k >> 64, k & (1 << 64) - 1, x, row["n"])):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([_signed(o) for o in out[:4]] + [pa.array(out[4], pa.int32()), pa.array(out[5], pa.int64())], names=["core", "s", "k1", "k2", "x", "n"])

    return emit


def _narrowed(strings: DataFrame, step: int) -> DataFrame:
    """(core, s, live): for pieces with a mask `live`, the starts in runs of `step` that some other piece has too."""
    rows = strings.select("core", "s", "left", "right", "live", "n").mapInArrow(_narrow(step), "core long, s long, k1 long, k2 long, x int, n long")
    shared = rows.groupBy("k1", "k2").agg(F.sum("n").alias("__n")).where("__n > 1").drop("__n")
    bits = F.expr(f"shiftleft({(1 << step) - 1}L, x)")
    return rows.join(shared, ["k1", "k2"]).groupBy("core", "s").agg(F.bit_or(bits).alias("live"))


def repeated_pieces(docs: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(uid, base, mask): starts base - x, x a bit of mask, whose window occurs elsewhere. docs: (uid, text).

    A core is known by 64 bits of hash, a piece by 64 more; equal windows also agree in their 63
    bytes beside the core, which are compared.
    """
    slim = scratch.keep(docs.select("uid", "text").mapInArrow(_emit_slim, SLIM), "slim")
    again = scratch.keep(slim.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "again")
    hot = scratch.small(again.where(F.col("n") > HOT).select("key"), "hot_keys")
    shared = slim.join(hot, "key").unionByName(slim.join(hot, "key", "left_anti").join(again.where(F.col("n") <= HOT).select("key"), "key"))
    places = shared.groupBy("uid").agg(F.collect_list(F.struct("base", "lo", "hi")).alias("places"))  # at most a text's
    places = scratch.keep(places, "places")
    scratch.drop("slim")
    pieces = scratch.keep(docs.select("uid", "text").join(places, "uid").mapInArrow(_emit_pieces, PIECES), "pieces")
    scratch.drop("places")
    strings = scratch.keep(pieces.groupBy("core", "s", "left", "right").agg(F.count("*").alias("n")), "strings")
    large = scratch.small(strings.groupBy("core").agg(F.count("*").alias("size")).where(F.col("size") > group).select("core"), "large")
    some = strings.join(large, "core", "left_anti").select("core", "s", "left", "right", "n")
    masks = some.repartition("core").sortWithinPartitions("core").mapInArrow(_merge, "core long, s long, mask long")
    if not large.isEmpty():
        many = strings.join(large, "core")
        live = many.withColumn("live", F.lit(-1).cast("long"))
        runs = scratch.keep(_narrowed(live, 8), "runs")
        masks = masks.union(_narrowed(many.join(runs, ["core", "s"]), 1).withColumnRenamed("live", "mask"))
    hot = scratch.small(strings.where(F.col("n") > HOT).select("core", "s"), "hot")
    masks = scratch.keep(masks.where("mask <> 0"), "masks")
    hot_masks = scratch.small(masks.join(hot, ["core", "s"]), "hot_masks")
    scratch.drop("strings")
    valid = F.expr(f"shiftleft(-1L, {STARTS - 1} - length(right)) & shiftrightunsigned(-1L, {STARTS - 1} - length(left))")
    own = pieces.select("core", "s", "uid", "base", valid.alias("valid"))
    found = own.join(hot_masks, ["core", "s"]).unionByName(own.join(hot, ["core", "s"], "left_anti").join(masks, ["core", "s"]))
    return found.select("uid", "base", F.col("mask").bitwiseAND(F.col("valid")).alias("mask"))


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])


def removed_spans(size: int, base: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs [start, end) of a text of `size` bytes."""
    x = np.arange(STARTS)
    at = base[:, None] - x
    at = np.unique(at[(mask.view(np.uint64)[:, None] >> x.astype(np.uint64) & np.uint64(1)).astype(bool)])
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + LENGTH


@F.pandas_udf(RESULT)
def _clean_udf(texts: pd.Series, bases: pd.Series, masks: pd.Series) -> pd.DataFrame:
    rows = []
    for t, b, m in zip(texts, bases, masks):
        data = (t or "").encode("utf-8", "surrogatepass")
        starts, ends = removed_spans(len(data), np.asarray(b, np.int64), np.asarray(m, np.int64)) if b is not None else ([], [])
        kept, at = hashlib.sha256(), 0
        for s, e in zip(starts, ends):
            kept.update(data[at:s])
            at = e
        kept.update(data[at:])
        rows.append((len(data), int(sum(ends) - sum(starts)), len(starts), kept.hexdigest(), list(starts), list(ends)))
    return pd.DataFrame(rows, columns=RESULT.names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of every row.

    Bytes covered by a LENGTH-byte string that also starts anywhere else (in the text itself or
    any other) are removed; null texts are empty; shorter texts stay whole; repeated rows are each
    other's repeats; ids may be null or repeated; other columns are ignored; an empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id()), "rows")
    found = repeated_pieces(rows, scratch, group).groupBy("uid").agg(F.collect_list("base").alias("bases"), F.collect_list("mask").alias("masks"))
    found = scratch.keep(found, "found")
    scratch.drop("pieces")
    done = rows.join(found, "uid", "left").select("id", _clean_udf("text", "bases", "masks").alias("r"))
    return done.select(F.col("id").alias(id_col), "r.*")
