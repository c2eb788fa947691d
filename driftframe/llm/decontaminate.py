"""Benchmark decontamination: q-gram lemma filter, then banded alignment.

A passage of m characters that occurs in a text with at most e edits (e = a tenth of m) shares at
least m - q + 1 - q*e of its q-grams with it, all on diagonals (text position - passage position)
at most e apart. The shared q-grams are counted in overlapping bands of 2(e+1) diagonals; bands
that meet the bound are aligned (free ends in the text) inside the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

Q = 8
#: Edits allowed, as a share of the passage's characters.
BUDGET = 0.1
#: Shorter items have no q-gram and are not searched for.
LEAST_CHARS = Q
#: Longer items are cut into passages of this length that overlap by half.
PASSAGE = 400
#: Characters of benchmark text in one broadcast index; more make several passes.
INDEX_CHARS = 2_000_000
#: Shared grams and aligned windows that are looked at together.
HITS, WINDOWS = 1 << 20, 1024
#: Characters of text looked at together.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
EDGE = 0x110000  # no character

REGION = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())])


def codes(text: str) -> np.ndarray:
    """Lower-cased code points, one for each character of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 8-character gram, by doubling."""
    h = x.astype(np.uint64) + np.uint64(1)
    b, n = BASE, 1
    while n < Q:
        h = h[:-n] * np.uint64(b) + h[n:]
        b, n = b * b % (1 << 64), 2 * n
    return h * np.uint64(BASE)


def align(passage: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of the passage against each window, free ends, and where that match ends (exclusive).

    windows: (n, m + B); the band holds the diagonals 0..B.
    """
    m = len(passage)
    width = windows.shape[1] - m + 1
    ar = np.arange(width, dtype=np.int32)
    d = np.zeros((len(windows), width), np.int32)
    for i in range(m):
        new = d + (windows[:, i : i + width] != passage[i])
        np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
        d = np.minimum.accumulate(new - ar, axis=1) + ar
    best = d.argmin(axis=1)
    return d[np.arange(len(d)), best], best + m


class Index:
    """Sorted q-gram postings of a bounded set of benchmark passages."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_CHARS):
        self.item, self.passage = [], []
        for item, text in items:
            x = codes(text or "")
            for at in range(0, max(1, len(x) - PASSAGE // 2), PASSAGE // 2) if len(x) > PASSAGE else [0]:
                if len(x[at : at + PASSAGE]) >= max(Q, least):
                    self.item.append(item)
                    self.passage.append(x[at : at + PASSAGE].copy())
        m = np.array([len(p) for p in self.passage], np.int64)
        self.m, self.e = m, np.minimum((m * BUDGET).astype(np.int64), (m - Q) // Q)  # short ones: as many edits as leave a gram
        self.bound = np.maximum(1, m - Q + 1 - Q * self.e)
        h = np.concatenate([gram_hashes(p) for p in self.passage] or [np.empty(0, np.uint64)])
        n = m - Q + 1
        order = np.argsort(h, kind="stable")
        self.pat = np.repeat(np.arange(len(m)), n)[order]
        self.off = (np.concatenate([np.arange(k) for k in n]) if len(n) else np.empty(0, np.int64))[order]
        self.gram, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(h >> np.uint64(42)).astype(np.int64)] = True

    def search(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) in the code points x, best first for each passage and place."""
        if len(x) < Q or not len(self.gram):
            return []
        h = gram_hashes(x)
        pos = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.gram, h[pos])
        at[at == len(self.gram)] = 0
        same = self.gram[at] == h[pos]
        pos, at = pos[same], at[same]
        n = self.count[at]
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):  # a frequent gram meets many postings: a bounded number of them at a time
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HITS, "right")))
            k = n[lo:hi]
            post = np.repeat(self.start[at[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            pat = self.pat[post]
            cell = (np.repeat(pos[lo:hi], k) - self.off[post] + PASSAGE) // (self.e[pat] + 1)
            key, cnt = np.unique((pat << 40) | cell, return_counts=True)
            keys.append(key)
            counts.append(cnt)
            lo = hi
        key, inv = np.unique(np.concatenate(keys), return_inverse=True)
        cnt = np.bincount(inv, np.concatenate(counts), len(key)).astype(np.int64)
        band = cnt.copy()
        if len(key) > 1:
            near = key[1:] == key[:-1] + 1
            band[:-1] += np.where(near, cnt[1:], 0)
        keep = band >= self.bound[key >> 40]
        out = []
        pats, cells = key[keep] >> 40, key[keep] & ((1 << 40) - 1)
        for p in np.unique(pats):
            m, e, passage = self.m[p], self.e[p], self.passage[p]
            every = cells[pats == p] * (e + 1) - PASSAGE - e
            for lo in range(0, len(every), WINDOWS):
                self._verify(x, int(p), int(m), int(e), passage, every[lo : lo + WINDOWS], out)
        return out

    @staticmethod
    def _verify(x: np.ndarray, p: int, m: int, e: int, passage: np.ndarray, starts: np.ndarray, out: list) -> None:
        take = starts[:, None] + np.arange(m + 4 * e + 3)
        windows = np.where((take >= 0) & (take < len(x)), x[np.clip(take, 0, len(x) - 1)], EDGE).astype(np.uint32)
        needle, left = passage.tobytes(), []
        for k, w in enumerate(windows):
            hay = w.tobytes()
            found = hay.find(needle)
            while found % 4 and found >= 0:
                found = hay.find(needle, found + 1)
            if found >= 0:
                out.append((p, int(starts[k] + found // 4), int(starts[k] + found // 4 + m), 0))
            else:
                left.append(k)
        for lo in range(0, len(left), 256):
            part = left[lo : lo + 256]
            edits, end = align(passage, windows[part])
            for k, d, z in zip(part, edits, end):
                if d <= e:
                    back = windows[k][:z][::-1]
                    back = np.concatenate([back, np.full(max(0, len(passage) + 2 * e + 1 - len(back)), EDGE, np.uint32)])[None, : m + 2 * e + 1]
                    _, size = align(passage[::-1], back)
                    out.append((p, int(starts[k] + z - min(size[0], z)), int(starts[k] + z), int(d)))


def places(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of overlapping regions united to the one of fewest edits, then the earliest."""
    out: list[tuple[int, int, int]] = []
    reach = -1
    for s, z, d in sorted(found):
        if out and s < reach:
            out[-1] = min(out[-1], (s, z, d), key=lambda r: (r[2], r[0]))
        else:
            out.append((s, z, d))
        reach = max(reach, z)
    return out


def find(texts: list[str | None], index: Index) -> list[list[dict]]:
    """Regions of each text: every place of every item."""
    found: list[dict[int, list]] = [{} for _ in texts]
    overlap = 2 * PASSAGE
    block: list[tuple[int, int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal block, size
        if block:
            gap = np.full(1, EDGE, np.uint32)
            tops = np.array([b[2] for b in block])
            x = np.concatenate([y for b in block for y in (b[3], gap)])
            for p, start, end, edits in index.search(x):
                k = int(np.searchsorted(tops, max(start, 0), "right")) - 1
                doc, base, top, _ = block[k]
                found[doc].setdefault(index.item[p], []).append((base + start - top, base + end - top, edits))
        block, size = [], 0

    for doc, text in enumerate(texts):
        x = codes(text or "")
        for base in range(0, max(1, len(x) - overlap), BLOCK):
            piece = x[base : base + BLOCK + overlap]
            block.append((doc, base, size, piece))
            size += len(piece) + 1
            if size >= BLOCK:
                flush()
    flush()
    return [[{"item_id": i, "start": s, "end": z, "edits": d} for i, r in sorted(f.items()) for s, z, d in places(r)] for f in found]


def _finder(shared):
    @F.pandas_udf(T.ArrayType(REGION))
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(find(list(texts), shared.value))

    return udf


def finders(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", least: int = LEAST_CHARS, chars: int = INDEX_CHARS) -> Iterator[tuple]:
    """(number, of how many, column function) for each part of the benchmark, of at most about `chars` characters.

    One part at a time comes to the driver and is broadcast; the one before is given up first. A
    column function maps a text column to array<struct<item_id,start,end,edits>>.
    """
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.length("t") >= max(Q, least))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = 1 + 2 * total // chars
    for g in range(parts):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == g) if parts > 1 else items
        shared = sc.broadcast(Index([(r.i, r.t) for r in mine.toLocalIterator()], least))
        yield g, parts, _finder(shared)
        if parts > 1:
            shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row for each place of a benchmark item in a document.

    Null and empty texts hold nothing; items that are null or shorter than `least` (by default
    the q-gram) are not searched for; an empty benchmark finds nothing; repeated items and
    repeated rows are found each; ids may be null; other columns are ignored; an empty table gives
    no rows. Overlapping places of one item are one: the one of fewest edits. A benchmark of
    several parts makes a pass over docs for each, with its rows written in between.
    """
    scratch, out = Scratch(docs.sparkSession), None
    for g, parts, finder in finders(benchmark, **options):
        found = docs.select(F.col(id_col), finder(F.col(text_col)).alias("__found"))
        found = found.select(id_col, F.explode("__found").alias("r")).select(id_col, "r.*")
        found = scratch.keep(found, f"found{g}") if parts > 1 else found
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item; every column and clean row stays, whatever else is null, repeated or empty."""
    scratch = Scratch(docs.sparkSession)
    for g, parts, finder in finders(benchmark, **options):
        docs = docs.withColumn("__found", finder(F.col(text_col))).where(F.size("__found") == 0).drop("__found")
        if parts > 1:
            docs = scratch.keep(docs, f"left{g}")
            if g:
                scratch.drop(f"left{g - 1}")
    return docs
