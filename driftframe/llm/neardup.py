"""Near-duplicate vectors by NN-descent.

Equal vectors of one label are one node. Neighbour lists start from random-hyperplane buckets of
bounded size and are refined by joining each node's neighbours (forward and reverse) with each
other until few entries change. Edges at the threshold tie nodes into groups; a node whose list is
saturated with such edges has its list enlarged to its whole group: links inside a group are
counted exactly, in blocks. Members within half the threshold's angle of their group's centre are
all linked to each other, so only the rest is compared. Audited against all rows are only
sampled nodes that have a link: the mean share of their links that was found, over all of them (a lone
node that lost its only link counts as lost) and for small and large groups apart. While a share is too low, the nodes of
crowded buckets (clouds too dense for the hyperplanes, cut at random before the descent) are compared
with each other exactly, in blocks, and more starting buckets are added; in the end it is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Scratch, components

THRESHOLD = 0.98
#: Entries of a neighbour list.
K = 8
#: Best entries that a bucket or neighbourhood always passes on, and the cosine for more of them.
BEST, NEAR = 2, 0.5
#: Aimed size of a starting bucket, the size up to which it is compared whole, and rows of a block.
BUCKET, WHOLE, BLOCK = 64, 256, 64
#: Members of a group that go to one task of a join.
SALTED = 4096
#: The chance that a pair at the threshold shares no starting bucket of a seed.
MISSED = 0.001
ROUNDS, SEEDS, AUDITED, LEAST_RECALL = 4, 6, 256, 0.95
#: The share of links from which on no more buckets are tried.
ENOUGH = 0.99
#: Nodes without a group that are audited, and nodes of a side where crowded ones are compared.
LONE, SIDE = 2048, 1024


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit_udf(vectors: pd.Series) -> pd.Series:
    """Vectors of length one in double precision; null if null, empty, zero or not all finite."""
    out = []
    for v in vectors:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64) if getattr(v, "dtype", None) == object else np.asarray(v, np.float64)
        if x is not None and (not len(x) or not np.isfinite(x).all() or not x.any()):
            x = None
        if x is not None:
            x = x / np.abs(x).max()
            x = x / np.sqrt((x * x).sum())
        out.append(x)
    return pd.Series(out, dtype="object")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, one table for each group."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, final: bool):
        k = np.stack([t[c].to_numpy() for c in keys], axis=1)
        at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        ends = np.append(at[1:], len(k))
        whole = list(zip(at, ends)) if final else list(zip(at, ends))[:-1]
        return [t.slice(a, b - a) for a, b in whole], None if final else t.slice(at[-1])

    for batch in batches:
        held.append(batch)
        done, rest = cut(pa.Table.from_batches(held), False)
        yield from done
        held = rest.combine_chunks().to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held), True)[0]


def _edges(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(c) for c in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "sim"])


def _local_join(keys: list[str], k: int):
    """All members of a bounded group against each other: each one's k most similar, those below NEAR only among the BEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for t in _groups(batches, keys):
            if t.num_rows < 2:
                continue
            node, x = t["node"].to_numpy(), _matrix(t["v"])
            s = x @ x.T
            s[node[:, None] == node[None, :]] = -2
            most = min(k, len(node))
            top = np.argpartition(-s, most - 1, axis=1)[:, :most]
            sim = np.take_along_axis(s, top, axis=1)
            order = np.argsort(-sim, axis=1, kind="stable")
            top, sim = np.take_along_axis(top, order, axis=1), np.take_along_axis(sim, order, axis=1)
            i, j = np.nonzero((sim > -2) & ((np.arange(most) < BEST) | (sim >= NEAR)))
            if len(i):
                out.append((node[i], node[top[i, j]], sim[i, j]))
                n += len(i)
            if n > 50_000:
                yield _edges(out)
                out, n = [], 0
        if out:
            yield _edges(out)

    return run


EDGE = "a long, b long, sim double"


def _signatures(bits: int, tables: int, seed: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
            sign = (np.stack([vectors.iloc[i] for i in at]) @ planes > 0).reshape(len(at), tables, bits)
            keys = (sign * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)
            for i, row in zip(at, keys):
                out[i] = row
        return pd.Series(out, dtype="object")

    return udf


def _start(nodes: DataFrame, n: int, seed: int, scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges from random-hyperplane buckets of about BUCKET, compared whole up to WHOLE; and the nodes of crowded ones.

    Fuller ones are split by up to 12 further planes; what then still holds more than WHOLE is a
    dense cloud, cut at random and joined again by the descent. n: nodes of the largest block.
    There are as many tables as keep a pair at the threshold apart with chance MISSED.
    """
    bits = int(np.clip(np.ceil(np.log2(max(1, n / BUCKET))), 0, 24))
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    tables = 8 if agree >= 1 else max(8, int(np.ceil(np.log(MISSED) / np.log(1 - agree))))
    keyed = nodes.select("node", "block", F.posexplode(_signatures(bits + 12, tables, seed)("v")).alias("t", "full"))
    keyed = scratch.keep(keyed.withColumn("key", F.col("full").bitwiseAND((1 << bits) - 1)), f"keyed{seed}")
    full = keyed.groupBy("block", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE)
    full = scratch.small(full, f"full{seed}")
    mask = "full & (shiftleft(1L, {0} + least(12, cast(ceil(log2(n / {1})) as int))) - 1)".format(bits, BUCKET)
    keyed = keyed.join(full, ["block", "t", "key"], "left").withColumn("fine", F.coalesce(F.expr(mask), F.lit(-1)))
    over = keyed.where("n is not null").groupBy("block", "t", "key", "fine").agg(F.ceil(F.count("*") / WHOLE).alias("parts")).where("parts > 1")
    over = scratch.small(over, f"over{seed}")
    part = F.coalesce(F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.col("parts")), F.lit(0))
    parts = keyed.join(over, ["block", "t", "key", "fine"], "left").select("node", F.xxhash64("block", "t", "key", "fine", part).alias("g"))
    dealt = parts.join(nodes.select("node", "v"), "node").repartition("g").sortWithinPartitions("g", "node")
    crowded = keyed.join(over.drop("parts"), ["block", "t", "key", "fine"]).select("node").distinct()
    return dealt.mapInArrow(_local_join(["g"], K), EDGE), crowded


def _tied(threshold: float):
    """Of both sides of a group, edges that tie what links join: each node with the least of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g"]):
            side, node, x = t["side"].to_numpy(), t["node"].to_numpy(), _matrix(t["v"])
            one, two = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            i, j = np.nonzero(x[one] @ x[two].T >= threshold)
            a, b = one[i], two[j]
            part = np.arange(len(node))
            while len(a):
                low = part.copy()
                np.minimum.at(low, a, part[b])
                np.minimum.at(low, b, part[a])
                low = low[low]
                if (low == part).all():
                    break
                part = low
            at = np.flatnonzero(part != np.arange(len(node)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[part[at]])], names=["a", "b"])

    return run


def crowded_ties(nodes: DataFrame, crowded: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): edges that join whatever links join among the crowded nodes of a block, all compared with all in blocks of about SIDE.

    Exact; the square of a block's crowded nodes in comparisons, but two rows a node and pair of blocks
    at most in results.
    """
    here = scratch.keep(crowded.join(nodes.select("node", "block", "v"), "node"), f"{name}_crowd")
    sides = scratch.small(here.groupBy("block").agg(F.ceil(F.count("*") / SIDE).alias("sides")), f"{name}_sides")
    dealt = here.join(sides, "block").withColumn("own", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("sides")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("g"), side.cast("int").alias("side"), "node", "v")
    return scratch.keep(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_tied(threshold), "a long, b long"), f"{name}_ties")


def _lists(edges: DataFrame, k: int = K) -> DataFrame:
    """The k best edges of every node, in both directions."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= k).drop("r")


def _descend(nodes: DataFrame, edges: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins until they bring under 1 % new edges at the threshold.

    New edges of a list that held K such edges before do not count: its group is counted whole.
    """
    now = scratch.keep(_lists(edges), f"{name}_0")
    for i in range(1, ROUNDS + 1):
        near = now.where(F.col("sim") >= threshold)
        size, full = near.count(), near.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") >= K).select("a")
        around = now.select(F.col("a").alias("g"), F.col("b").alias("node")).union(_lists(now).select(F.col("a").alias("g"), F.col("b").alias("node"))).distinct()
        dealt = around.join(nodes.select("node", "v"), "node").repartition("g").sortWithinPartitions("g", "node")
        found = dealt.mapInArrow(_local_join(["g"], K), EDGE)
        nxt = scratch.keep(_lists(now.union(found)), f"{name}_{i}")
        fresh = nxt.where(F.col("sim") >= threshold).join(full, "a", "left_anti").join(now, ["a", "b"], "left_anti").count()
        scratch.drop(f"{name}_{i - 1}")
        now = nxt
        if fresh <= 0.01 * size:
            break
    return now


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        comp, x = batch.column("component").to_numpy(), _matrix(batch.column("v")) if batch.num_rows else None
        if batch.num_rows:
            u, inv = np.unique(comp, return_inverse=True)
            total = np.zeros((len(u), x.shape[1]))
            np.add.at(total, inv, x)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(list(total), pa.list_(pa.float64()))], names=["component", "v"])


def _centre(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf.v).sum(axis=0)
    return pd.DataFrame({"component": pdf.component[:1], "centre": [x / max(np.sqrt((x * x).sum()), 1e-300)]})


def _count_links(threshold: float):
    """Links between the two sides (block i, block j) of each group, per node, weighted by copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, links, n = [], [], 0
        for t in _groups(batches, ["g"]):
            side, node, copies = (t[c].to_numpy() for c in ("side", "node", "copies"))
            x = _matrix(t["v"])
            one, two = side != 2, side != 1
            hit = x[one] @ x[two].T >= threshold
            hit &= node[one][:, None] != node[two][None, :]
            ids += [node[one]]
            links += [hit @ copies[two]]
            if (side != 0).any():  # two different blocks: the other side gets its links too
                ids += [node[two]]
                links += [hit.T @ copies[one]]
            n += t.num_rows
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], names=["node", "links"])
                ids, links, n = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], names=["node", "links"])

    return run


def _told(members: DataFrame, groups: DataFrame, large: DataFrame) -> DataFrame:
    """members joined to groups (a row for each component); large components' members go by (component, salt)."""
    salted = members.join(large, "component", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0))).drop("salts")
    spread = groups.join(large, "component", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(spread, ["component", "salt"]).drop("salt")


def _links(nodes: DataFrame, member: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links): links of each node inside its group, counted exactly."""
    sizes = scratch.keep(member.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    large = scratch.small(sizes.where(F.col("size") > BLOCK).select("component", F.ceil(F.col("size") / SALTED * 8).alias("salts")), "large")
    m = scratch.keep(_told(member, sizes, large).join(nodes.select("node", "copies", "v"), "node"), "members")
    wide = m.where(F.col("size") > 4 * BLOCK)
    centres = wide.select("component", "v").mapInArrow(_sums, "component long, v array<double>").groupBy("component").applyInPandas(_centre, "component long, centre array<double>")
    near = F.expr("aggregate(zip_with(v, centre, (a, b) -> a * b), 0D, (s, x) -> s + x)") >= float(np.cos(np.arccos(threshold) / 2) + 1e-9)
    cored = _told(wide, scratch.keep(centres, "centres"), large).withColumn("core", near).drop("centre")
    plain = m.where(F.col("size") <= 4 * BLOCK).withColumn("core", F.lit(False))
    m = scratch.keep(cored.unionByName(plain), "cored")
    # one row for each component: what is in its core, and blocks of about BLOCK of the rest and of the core
    counts = m.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies"))).alias("in_core"), F.ceil(F.count_if(~F.col("core")) / BLOCK).alias("rests"), F.ceil(F.count_if("core") / BLOCK).alias("cores"))
    m = _told(m, scratch.keep(counts, "counts"), large)
    inside = m.where("core").select("node", (F.col("in_core") - F.col("copies")).alias("links"))
    m = m.where("rests > 0")
    m = m.withColumn("blk", F.pmod(F.xxhash64(F.lit(3), "node"), F.greatest(F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests")), F.lit(1))))
    pairs = F.expr("""if(core, transform(sequence(0, rests - 1), i -> named_struct('i', i, 'j', -1 - blk, 'side', 2)),
      concat(transform(sequence(0, rests - 1), i -> named_struct('i', least(i, blk), 'j', greatest(i, blk), 'side', if(i = blk, 0, if(blk < i, 1, 2)))),
        if(cores > 0, transform(sequence(1, cores), j -> named_struct('i', blk, 'j', -j, 'side', 1)), array())))""")
    dealt = m.select("component", "node", "copies", "v", F.explode(pairs).alias("p")).select(F.xxhash64("component", "p.i", "p.j").alias("g"), F.col("p.side").cast("int").alias("side"), "node", "copies", "v")
    outside = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_count_links(threshold), "node long, links long")
    return inside.union(outside).groupBy("node").agg(F.sum("links").alias("links"))


def _true_links(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, node, copies = (batch.column(c).to_numpy() for c in ("block", "node", "copies"))
            for own, (asked, q) in shared.value.items():
                at = np.flatnonzero(block == own)
                if len(at):
                    hit = _matrix(batch.column("v").take(pa.array(at))) @ q.T >= threshold
                    hit &= node[at][:, None] != asked[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(copies[at] @ hit)], names=["node", "links"])

    return run


def audited_links(nodes: DataFrame, links: DataFrame, groups: DataFrame, threshold: float, asked: int = AUDITED, lone: int = LONE) -> dict[str, tuple[float, int, float]]:
    """By kind of node (single, without a group; small and large groups), of sampled nodes that have a link: the sum of the shares of their links that were found, how many they are, and how many nodes each stands for.

    About `asked` nodes of small and of large groups and `lone` others, all against all rows; kinds whose
    nodes have no link are left out.
    """
    known = groups.groupBy("component").agg(F.count("*").alias("size"))
    large = F.broadcast(known.where(F.col("size") > K).orderBy(F.desc("size"), "component").limit(asked))  # at most `asked` rows; other large ones tell small
    named = groups.join(large, "component", "left").select("node", F.when(F.col("size").isNotNull(), "large").otherwise("small").alias("kind"))
    told = nodes.select("node").join(named, "node", "left").select("node", F.coalesce("kind", F.lit("single")).alias("kind"))
    u = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 30)) / float(1 << 30)
    share, shares = F.lit(0.0), {}
    for r in told.groupBy("kind").count().collect():  # three kinds
        shares[r.kind] = min(1.0, (lone if r.kind == "single" else asked) / r["count"])
        share = F.when(F.col("kind") == r.kind, F.lit(shares[r.kind])).otherwise(share)
    picked = told.where(u < share)
    sample = {r.node: (r.kind, r.block, np.array(r.v)) for r in nodes.select("node", "block", "v").join(F.broadcast(picked), "node").collect()}  # about `lone` rows
    if not sample:
        return {}
    asks: dict = {}
    for node, (_, block, v) in sample.items():
        asks.setdefault(block, []).append((node, v))
    shared = nodes.sparkSession.sparkContext.broadcast({b: (np.array([n for n, _ in x], np.int64), np.stack([v for _, v in x])) for b, x in asks.items()})
    true = nodes.select("block", "node", "copies", "v").mapInArrow(_true_links(shared, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).where("links > 0").collect()
    found = {r.node: r.links for r in links.join(F.broadcast(picked.select("node")), "node").collect()}
    out: dict = {}
    for r in true:
        kind = sample[r.node][0]
        got, all_, each = out.get(kind, (0, 0, 1 / shares[kind]))
        out[kind] = (got + min(found.get(r.node, 0), r.links) / r.links, all_ + 1, each)
    return out


def audit(nodes: DataFrame, links: DataFrame, groups: DataFrame, threshold: float, asked: int = AUDITED) -> dict[str, float]:
    """By kind of node the mean share of a sampled node's links that were found, among those that have one; kinds without are left out."""
    return {k: got / all_ for k, (got, all_, _) in audited_links(nodes, links, groups, threshold, asked).items()}


def recall(counts: dict[str, tuple[float, int, float]]) -> float | None:
    """The least of the mean shares found: over all nodes with a link as the samples tell them, over those of small and of large groups; None without a link.

    By node and not by link, so that a large group's many links hide no lost pairs.
    """
    if not counts:
        return None
    whole = sum(got * each for got, _, each in counts.values()) / sum(all_ * each for _, all_, each in counts.values())
    return min([whole, *[got / all_ for k, (got, all_, _) in counts.items() if k != "single"]])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, least_recall: float = LEAST_RECALL) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): vec_id, n_links, component_id, kept, audited.

    Vectors of one label link at a cosine of at least `threshold` in double precision. Vectors
    that are null, empty, zero or not all finite, those without a label, and those of different
    lengths link with nothing. Equal vectors and repeated rows are other vectors, linked directly.
    A null id's row takes part and is kept only if its component has no id at all. Other columns
    are ignored; an empty table gives no rows. audited: the share of links found (see recall), null
    where the sampled nodes have none; below ENOUGH crowded nodes are compared exactly and more
    starting buckets are added, up to SEEDS times; then a share below `least_recall` is an error.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", unit_udf("embedding").alias("v"))
    block = F.when(F.col("label").isNotNull() & F.col("v").isNotNull(), F.xxhash64("label", F.size("v")))
    rows = scratch.keep(rows.withColumn("block", block).withColumn("h1", F.xxhash64("v", "label")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label")), "rows")
    good = rows.where(F.col("block").isNotNull())
    nodes = good.groupBy("block", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    edges = ties = None

    def linked(name: str) -> tuple[DataFrame, DataFrame, float | None]:
        tied = edges.where(F.col("sim") >= threshold).select("a", "b")
        groups = scratch.keep(components(tied if ties is None else tied.union(ties), scratch, f"cc{name}"), f"groups{name}")
        links = scratch.keep(_links(nodes, groups, threshold, scratch), f"links{name}")
        return groups, links, recall(audited_links(nodes, links, groups, threshold))

    for seed in range(SEEDS):
        fresh, crowded = _start(nodes, n, seed, scratch, threshold)
        edges = _descend(nodes, fresh if edges is None else fresh.union(edges), threshold, scratch, f"lists{seed}")
        groups, links, share = linked(str(seed))
        if share is not None and share < max(ENOUGH, least_recall) and ties is None and not crowded.isEmpty():
            ties = crowded_ties(nodes, crowded, threshold, scratch, f"exact{seed}")
            groups, links, share = linked(f"{seed}e")
        if share is None or share >= max(ENOUGH, least_recall):
            break
    if share is not None and share < least_recall:
        raise RuntimeError(f"near_vectors: share of links found after {SEEDS} seeds: {share}")
    told = nodes.select("node", "block", "h1", "h2", "first", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = told.groupBy("component").agg(F.min("first").alias("component_id"))
    told = told.join(least, "component").join(links, "node", "left").select("block", "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = good.select("vec_id", "block", "h1", "h2").join(told, ["block", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("block").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.withColumn("audited", F.lit(share).cast("double"))
