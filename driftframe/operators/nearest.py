"""Exact nearest vectors: packed blocks of queries meet packed blocks of points, and nothing but lists is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds

#: Vectors of a packed block, and pairs that are measured together.
PACKED, MEASURED = 512, 1 << 16


def _packed(df: DataFrame, size: int, rounds: Rounds, name: str) -> DataFrame:
    """(block, ids, v): runs of at most `size` rows of (id, v), v as the bytes of doubles."""
    kind = dict(df.dtypes)["id"]

    def pack(batches):
        for rows in batches:
            for lo in range(0, len(rows), size):
                part = rows[lo : lo + size]
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "v": [np.stack(part["v"].to_numpy()).astype(np.float64).tobytes()]})

    blocks = df.select("id", "v").repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(pack, f"ids array<{kind}>, v binary")
    return rounds.keep(blocks.select(F.monotonically_increasing_id().alias("block"), "ids", "v"), name)


class Best:
    """The k nearest points met so far by the queries of a block, ties by id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.row, self.distance, self.near = np.zeros(0, np.int64), np.zeros(0), ids[:0]
        self.kth = np.full(len(ids), np.inf)

    def meet(self, names: np.ndarray, v: np.ndarray) -> None:
        # single precision, around the queries' mean, finds what may be among the k nearest; `slack` bounds its error
        middle = self.v.mean(0)
        q, p = self.v - middle, v - middle
        scale = max(np.abs(q).max(), np.abs(p).max()) or 1.0
        q, p = (q / scale).astype(np.float32), (p / scale).astype(np.float32)
        qq, pp = (q * q).sum(1), (p * p).sum(1)
        slack = (q.shape[1] + 16) * 2.5e-7 * (qq + pp.max() + np.float32(1e-30))  # squares below 1e-38 lose digits
        about = pp - (2 * q) @ p.T
        limit = np.minimum((self.kth / scale) ** 2 - qq, np.float32(3e38))
        if np.isinf(self.kth).any() and len(p) > self.k + 1:
            limit = np.minimum(limit, np.partition(about, self.k, axis=1)[:, self.k] + slack)  # k and the query itself
        near = about <= (limit + slack).astype(np.float32)[:, None]
        # squares of doubles that overflow or vanish make distances equal that the filter tells apart: none is left out
        hit = np.flatnonzero(near) if 1e-140 < scale < 1e140 else np.arange(near.size)
        for lo in range(0, len(hit), MEASURED):
            self._add(*np.divmod(hit[lo : lo + MEASURED], len(p)), names, v)

    def _add(self, row: np.ndarray, at: np.ndarray, names: np.ndarray, v: np.ndarray) -> None:
        other = self.ids[row] != names[at]
        row, at = row[other], at[other]
        square = np.zeros(len(row))
        for c in range(v.shape[1]):  # in the order of the components, as a sum over them runs
            step = self.v[row, c] - v[at, c]
            square += step * step
        row, distance, near = np.append(self.row, row), np.append(self.distance, np.sqrt(square)), np.append(self.near, names[at])
        order = np.lexsort((near, distance, row))
        row, distance, near = row[order], distance[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.row, self.distance, self.near = (x[place < self.k] for x in (row, distance, near))
        full = np.bincount(self.row, minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.row, np.flatnonzero(full), "right") - 1
        self.kth[full] = self.distance[last]

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"id": self.ids[self.row], "near": self.near, "distance": self.distance})


def exact_pairs(queries: DataFrame, points: DataFrame, k: int, rounds: Rounds) -> DataFrame:
    """(id, near, distance): for each query at least its k nearest points of another id, and few others.

    Both (id, v), vectors finite and of one length. Every query is compared with every point: a task meets a part of
    the packed queries with a part of the packed points (as the written files are read: 128 MB at most), holds
    one block's lists at a time and gives k rows a query. So time is the product of the tables, but
    memory is bounded, and what goes to a shuffle grows with the queries alone.
    """
    kind = dict(points.dtypes)["id"]
    left = _packed(queries, PACKED, rounds, "packed_queries")
    right = (left if queries is points else _packed(points, PACKED, rounds, "packed_points")).select(F.col("ids").alias("names"), F.col("v").alias("w"))

    def vectors(raw: pa.Scalar, n: int) -> np.ndarray:
        return np.frombuffer(raw.as_buffer(), np.float64).reshape(n, -1)

    def search(batches):
        block, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["block"][i].as_py() != block:
                    if best:
                        yield pa.RecordBatch.from_pandas(best.found(), preserve_index=False)
                    ids = batch["ids"][i].values.to_numpy(zero_copy_only=False)
                    block, best = batch["block"][i].as_py(), Best(ids, vectors(batch["v"][i], len(ids)).copy(), k)
                names = batch["names"][i].values.to_numpy(zero_copy_only=False)
                best.meet(names, vectors(batch["w"][i], len(names)))
        if best:
            yield pa.RecordBatch.from_pandas(best.found(), preserve_index=False)

    # a cartesian product: a task goes through its points once for each of its blocks of queries
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(search, f"id {kind}, near {kind}, distance double")
