"""Gene counts as a long table (cell_id, gene, count) and gene sets (set_name, gene)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordering import running_before, same_keys, value_parts
from .rounds import Rounds
from .stats import adjust, hypergeometric_tails, two_sided_p


#: Clusters of cells that are broadcast.
FEW = 10_000
#: Neighbours of a node whose communities are added up in a loop.
MANY = 64


def normalise(counts: DataFrame, total: float = 10_000.0) -> DataFrame:
    """value = ln(1 + count * total / sum of the cell)."""
    return counts.withColumn("value", F.log1p(F.col("count") * total / F.sum("count").over(W.partitionBy("cell_id"))))


def gene_moments(values: DataFrame, cells: int) -> DataFrame:
    """Mean, sample variance of expm1(value) and dispersion per gene; absent pairs count as zeros."""
    x = F.expm1("value")
    mean = F.sum(x) / cells
    var = (F.sum(x * x) - F.sum(x) * F.sum(x) / cells) / (cells - 1)
    return values.groupBy("gene").agg(mean.alias("mean"), var.alias("variance"), F.ln(F.nullif(var, F.lit(0.0)) / F.nullif(mean, F.lit(0.0))).alias("dispersion"))


def variable_genes(values: DataFrame, cells: int, top: int, bins: int = 20) -> DataFrame:
    """The `top` genes by dispersion normalised within equal-width bins of log1p(mean); one-gene bins count 1."""
    g = gene_moments(values, cells).where("dispersion is not null").withColumn("m", F.log1p("mean"))
    lim = g.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    g = g.join(F.broadcast(lim)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("m") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))))  # one row
    w = W.partitionBy("bin")
    norm = F.when(F.count("*").over(w) == 1, 1.0).otherwise((F.col("dispersion") - F.avg("dispersion").over(w)) / F.stddev_samp("dispersion").over(w))
    return g.select("gene", norm.alias("normalised")).withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("normalised"), "gene"))).where(F.col("rank") <= top)


def set_overlaps(sets: DataFrame) -> DataFrame:
    """(one, two, inter, jaccard) of all pairs of sets that share a gene.

    A set gets the larger sets of each of its genes as a list and counts them where its lists meet, so no pair is
    shuffled before it is counted.
    """
    s = sets.select("set_name", "gene").distinct()
    size = s.groupBy("set_name").agg(F.count("*").alias("size"))
    genes = s.where("gene is not null and set_name is not null").groupBy("gene").agg(F.sort_array(F.collect_list("set_name")).alias("sets")).where(F.size("sets") > 1)
    lists = genes.select("sets", F.posexplode("sets").alias("at", "one")).select("one", F.expr("slice(sets, at + 2, size(sets))").alias("larger")).where(F.size("larger") > 0)
    pairs = lists.repartition("one").select("one", F.explode("larger").alias("two")).groupBy("one", "two").agg(F.count("*").alias("inter"))
    few = size.limit(FEW + 1).count() <= FEW
    n1, n2 = (size.withColumnsRenamed({"set_name": k, "size": n}) for k, n in (("one", "n1"), ("two", "n2")))
    j = pairs.join(F.broadcast(n1) if few else n1, "one").join(F.broadcast(n2) if few else n2, "two")
    return j.select("one", "two", "inter", (F.col("inter") / (F.col("n1") + F.col("n2") - F.col("inter"))).alias("jaccard"))


def markers(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Rank-sum z and log fold change of each gene, each cluster against the rest; zeros are one block of ties.

    values: (cell_id, gene, value > 0); cells: (cell_id, cluster), every cell once. Values are exchanged
    by gene once; they are ranked, added up by cluster and met with the clusters that do not hold the gene there.
    """
    per = cells.groupBy("cluster").agg(F.count("*").alias("n1")).withColumn("n", F.sum("n1").over(W.partitionBy()))
    v = values.join(cells, "cell_id").select("gene", "cluster", "value").repartition("gene").groupBy("gene", "cluster", "value").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy("gene").orderBy("value").rangeBetween(W.unboundedPreceding, W.currentRow))
    v = v.withColumn("middle", upto - (F.sum("k").over(W.partitionBy("gene", "value")) - 1) / 2)
    own = v.groupBy("gene", "cluster").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("middle")).alias("m"), F.sum(F.col("k") * F.col("value")).alias("s"))
    one = F.struct("cluster", "k", "m", "s")
    tot = own.groupBy("gene").agg(F.sum("k").alias("nz"), F.sum("s").alias("all_log"), F.collect_list(one).alias("own"))  # at most an entry a cluster
    names = per.agg(F.collect_list(F.struct("cluster")).alias("names"))  # one row
    absent = F.transform(F.array_except("names", F.transform("own", lambda o: F.struct(o["cluster"].alias("cluster")))), lambda c: F.struct(c["cluster"].alias("cluster"), F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")))
    grid = tot.join(F.broadcast(names)).select("gene", "nz", "all_log", F.inline(F.concat("own", absent)))  # every gene with every cluster, by definition
    g = same_keys(grid, F.broadcast(per) if per.limit(FEW + 1).count() <= FEW else per, ["cluster"])
    w = F.col("k") * (F.col("n") - F.col("nz")) + F.col("m") + (F.col("n1") - F.col("k")) * (F.col("n") - F.col("nz") + 1) / 2
    z = (w - F.col("n1") * (F.col("n") + 1) / 2) / F.sqrt(F.col("n1").cast("double") * (F.col("n") - F.col("n1")) * (F.col("n") + 1) / 12)
    fold = F.log2((F.expm1(F.col("s") / F.col("n1")) + 1e-9) / (F.expm1((F.col("all_log") - F.col("s")) / (F.col("n") - F.col("n1"))) + 1e-9))
    return g.select("gene", "cluster", z.alias("z"), fold.alias("logfc"))


def marker_scores(values: DataFrame, cells: DataFrame, level: float = 0.05) -> DataFrame:
    """`markers` with p, its Benjamini-Hochberg adjustment within the cluster and `distinctive`. The markers are a written table, as they are read for the parts, too."""
    m = Rounds(values.sparkSession).keep(markers(values, cells).withColumn("p", two_sided_p("z")), "markers")
    return distinctive(adjust(m, "p", ["gene"], within=["cluster"]), "gene", "cluster", "logfc", "adjusted", level)


def marker_table(values: DataFrame, cells: DataFrame, level: float = 0.05) -> DataFrame:
    """`marker_scores` and the row's place in its cluster.

    The place (1 is the first) is by falling `distinctive`, ties by gene, counted in parts; rows
    stay whole.
    """
    m = Rounds(values.sparkSession).keep(marker_scores(values, cells, level).withColumn("__fall", -F.col("distinctive")), "scores")
    part = W.partitionBy("cluster", "__part")
    s = m.withColumn("__part", value_parts(m, "__fall"))
    sums = s.groupBy("cluster", "__part").agg(F.count("*").alias("__n"))  # a row per part of a cluster
    off = F.coalesce(F.sum("__n").over(W.partitionBy("cluster").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("__at", F.row_number().over(part.orderBy("__fall", "gene"))).join(sums.select("cluster", "__part", off.alias("__off")), ["cluster", "__part"])
    return s.withColumn("place", F.col("__off") + F.col("__at")).drop("__fall", "__part", "__at", "__off")


def top_markers(table: DataFrame, n: int) -> DataFrame:
    """(cluster, gene, place): of each cluster the n genes with the largest |distinctive|, ties by gene; a limit of its own, as the report asks for."""
    size = F.abs(F.col("distinctive"))
    return table.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(size.desc(), "gene"))).where(F.col("place") <= n).select("cluster", "gene", "place")


def enriched_sets(up: DataFrame, down: DataFrame, sets: DataFrame, genes: int, level: float = 0.05) -> DataFrame:
    """(direction, set_name, hits, p, adjusted) of the sets over-represented among the genes that go UP or DOWN.

    up, down: (gene). Each direction is tested and adjusted (Benjamini-Hochberg over the sets that
    share a gene) by itself; rows with adjusted < level are kept. Repeated and null genes count once
    and not at all.
    """
    lists = up.select(F.lit("UP").alias("list_name"), "gene").unionByName(down.select(F.lit("DOWN").alias("list_name"), "gene")).where("gene is not null")
    tested = over_representation(lists, sets.where("gene is not null"), genes)
    return adjust(tested, "p", ["set_name"], within=["list_name"]).where(F.col("adjusted") < level).select(F.col("list_name").alias("direction"), "set_name", "hits", "p", "adjusted")


def over_representation(lists: DataFrame, sets: DataFrame, genes: int) -> DataFrame:
    """Hits and P(X >= hits) of each list in each set that shares a gene, out of `genes`; lists: (list_name, gene).

    A gene carries its lists as one row to its sets, and they are counted where the set's rows are: what
    is exchanged grows with the rows, not with their lists.
    """
    lists, sets = (d.select(k, "gene").repartition("gene").distinct() for d, k in ((lists, "list_name"), (sets, "set_name")))
    held = lists.where("list_name is not null").groupBy("gene").agg(F.collect_list("list_name").alias("lists"))
    met = sets.join(held, "gene", "left").select("set_name", "lists").repartition("set_name")
    hits = met.select("set_name", F.explode("lists").alias("list_name")).groupBy("set_name", "list_name").agg(F.count("*").alias("hits"))
    draws = held.select(F.explode("lists").alias("list_name")).groupBy("list_name").agg(F.count("*").alias("draws"))
    all_ = hits.join(met.groupBy("set_name").agg(F.count("*").alias("k")), "set_name").join(draws, "list_name").withColumn("n", F.lit(genes).cast("long"))
    return hypergeometric_tails(all_, "n", "k", "draws", "hits").select("list_name", "set_name", "hits", F.col("p_over").alias("p"))


def linked_sets(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable over (one, two). Least labels spread and are halved by pointer jumps; each round is a written table."""
    both = edges.select(F.col("one").alias("a"), F.col("two").alias("b")).unionByName(edges.select(F.col("two").alias("a"), F.col("one").alias("b")))
    kept = Rounds(edges.sparkSession)
    both = kept.keep(both, "edges")
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    for k in range(rounds):
        near = both.join(label, both["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = label.join(near, "id").select("id", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        up = label.select(F.col("id").alias("c"), F.col("component").alias("up"))
        new = new.join(up, "c").select("id", F.least("c", "up").alias("component"), "old")
        new = kept.keep(new, f"label{k % 2}")
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")
    raise ValueError(f"labels still change after {rounds} rounds")


def _packed(edges: DataFrame) -> DataFrame:
    """(a, k, near, w): a row a node of (a, b, w), its neighbours in order with their weights, and k, the sum of these.

    A task packs its sorted rows and holds a batch and the node that the batch ends in.
    """

    def rows(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        pair = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b, w = a[pair], b[pair], np.add.reduceat(w, pair)
        node = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        ends = pa.array(np.append(node, len(a)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(a[node]), pa.array(np.add.reduceat(w, node)), pa.ListArray.from_arrays(ends, pa.array(b)), pa.ListArray.from_arrays(ends, pa.array(w))], ["a", "k", "near", "w"])

    def pack(batches):
        last = []  # rows of the node that the batches so far end in
        for batch in batches:
            piece = [batch[c].to_numpy() for c in "abw"]
            if not batch.num_rows:
                continue
            if last and piece[0][-1] != last[0][0][0]:
                piece, last = [np.concatenate(x) for x in zip(*last, piece)], []
            cut = np.searchsorted(piece[0], piece[0][-1])
            if cut:
                yield rows(*(x[:cut] for x in piece))
            last.append([x[cut:] for x in piece])
        if last:
            yield rows(*(np.concatenate(x) for x in zip(*last)))

    return edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(pack, "a long, k double, near array<long>, w array<double>")


class _Block:
    """The nodes of a block in order, their edges, and the labels of all that these touch, as places in sorted arrays."""

    def __init__(self, here: pa.Table, there: pa.Table):
        here, there = here.sort_by("a").combine_chunks(), there.sort_by("id").combine_chunks()
        names, near = there["id"].to_numpy(), here["near"].combine_chunks()
        self.a, self.k, self.w = here["a"].to_numpy(), here["k"].to_numpy(), here["w"].combine_chunks().flatten().to_numpy()
        self.first = np.append(0, np.cumsum(pc.list_value_length(near).to_numpy())).astype(np.int64)
        self.node, self.near = np.searchsorted(names, self.a), np.searchsorted(names, near.flatten().to_numpy())
        self.names, self.label = np.unique(there["c"].to_numpy(), return_inverse=True)
        self.total = np.zeros(len(self.names))
        self.total[self.label] = there["t"].to_numpy()
        self.changed = there["changed"].to_numpy(zero_copy_only=False) if there.num_rows else np.zeros(0, bool)

    def inside(self) -> np.ndarray:
        """A node's weight inside its community."""
        return np.add.reduceat(np.where(self.label[self.near] == np.repeat(self.label[self.node], np.diff(self.first)), self.w, 0.0), self.first[:-1])

    def beside(self, on: np.ndarray) -> np.ndarray:
        """Nodes that are marked or next to one that is."""
        return on[self.node] | np.logical_or.reduceat(on[self.near], self.first[:-1])

    def sweep(self, weight: float, resolution: float) -> None:
        """Nodes beside a change move in turn, to the best community (ties: stay, else the smallest), until none does.

        Communities of up to MANY neighbours are added up in a loop, of more by numpy, in the same order.
        """
        todo = np.flatnonzero(self.beside(self.changed)).tolist()
        node, k, first, at, sums = self.node.tolist(), self.k.tolist(), self.first.tolist(), self.label.tolist(), self.total.tolist()
        few = {i: (self.near[first[i] : first[i + 1]].tolist(), self.w[first[i] : first[i + 1]].tolist()) for i in todo if first[i + 1] - first[i] <= MANY}
        for _ in range(100):
            moved = np.zeros(len(at), bool)
            for i in todo:
                me = node[i]
                own = at[me]
                sums[own] -= k[i]
                self.total[own] = sums[own]
                if i in few:
                    to = {own: 0.0}
                    for b, x in zip(*few[i]):
                        if b != me:
                            to[at[b]] = to.get(at[b], 0.0) + x
                else:
                    to = self._best(i, own, resolution * k[i], weight)
                best = max(to, key=lambda c: (round(to[c] - resolution * k[i] * sums[c] / weight, 12), c == own, -c))  # noqa: B023
                sums[best] += k[i]
                self.total[best] = sums[best]
                if best != own:
                    at[me] = self.label[me] = best
                    moved[me] = True
            if not moved.any():
                break
            again = self.beside(moved)
            todo = [i for i in todo if again[i]]

    def _best(self, i: int, own: int, k: float, weight: float) -> dict[int, float]:
        """The weights from node i to those of its communities that may be the best, as far as rounding tells."""
        near, w = self.near[self.first[i] : self.first[i + 1]], self.w[self.first[i] : self.first[i + 1]]
        label, w = self.label[near], np.where(near == self.node[i], 0.0, w)
        if len(self.names) > 8 * len(near):
            known, label = np.unique(np.append(label, own), return_inverse=True)
            to = np.bincount(label[:-1], w, len(known))
        else:
            to = np.bincount(label, w, len(self.names))
            to[own] = to[own] or -1.0  # kept below, without neighbours too
            known = np.flatnonzero(to)
            to = np.maximum(to[known], 0.0)
        gain = to - k * self.total[known] / weight
        top = np.flatnonzero(gain >= gain.max() - 1e-11)
        return dict(zip(known[top].tolist(), to[top].tolist()))


def communities(edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 20, block: int = 1_000_000) -> DataFrame:
    """(id, community) over (one, two, weight): modularity raised by moving nodes, then communities as nodes of the next level.

    Nodes are dealt anew in every round into blocks of about `block` edges. A task moves the nodes of
    its block one after the other, others staying where they were when the round began; after the
    first round only nodes beside a move are tried. A round that does not raise the modularity is
    dropped and ends the level. When no level brings more, the graph's own nodes are tried once more from
    where they are. A community is named by its least id and never spans components.
    Edges with a null or without weight, and loops, are left out; ids without an edge have no row. A
    node's own edges are in one row. A round exchanges these rows and sends a node's label once to each block
    with a neighbour of it; no edge meets its labels in a join. Rounds are written tables; a graph that fits a
    block takes one round a level.
    """
    kept = Rounds(edges.sparkSession)
    e = edges.where("one <> two and weight > 0").select(F.col("one").cast("long").alias("one"), F.col("two").cast("long").alias("two"), F.col("weight").cast("double").alias("w"))
    base = kept.keep(_packed(e.select(F.col("one").alias("a"), F.col("two").alias("b"), "w").unionByName(e.select(F.col("two").alias("a"), F.col("one").alias("b"), "w"))), "base")

    def sizes(graph: DataFrame) -> tuple[float, int]:
        return graph.agg(F.sum("k"), F.sum(F.size("near"))).first()

    weight, whole = sizes(base)
    member = base.select(F.col("a").alias("id"), F.col("a").alias("community"))
    if not weight:
        return member

    def met(graph: DataFrame, size: int, label: DataFrame, work, schema: str, *deal: int) -> DataFrame:
        """`work` on each block: the rows of its nodes, and (id, c, t, changed) of these and their neighbours: their communities, the weights of these, and whether they moved."""
        part = lambda x: F.pmod(F.xxhash64(x, *map(F.lit, deal)), F.lit(-(-size // block)))
        full = label.join(label.groupBy("c").agg(F.sum("k").alias("t")), "c").select(F.col("a").alias("id"), "c", "t", "changed")
        asked = graph.select(F.col("a").alias("id"), F.explode(F.array_distinct(F.concat(F.array(part("a")), F.transform("near", part)))).alias("part"))
        return graph.withColumn("part", part("a")).groupBy("part").cogroup(asked.join(full, "id").groupBy("part")).applyInArrow(work, schema)

    def swept(here: pa.Table, there: pa.Table) -> pa.Table:
        own = _Block(here, there)
        before = own.inside()
        own.sweep(weight, resolution)
        return pa.table({"a": own.a, "c": own.names[own.label[own.node]], "before": before, "after": own.inside()})

    def joined(here: pa.Table, there: pa.Table) -> pa.Table:
        own = _Block(here, there)
        from_, to = np.repeat(own.label[own.node], np.diff(own.first)), own.label[own.near]
        pair, at = np.unique(from_ * len(own.names) + to, return_inverse=True)
        return pa.table({"a": own.names[pair // len(own.names)], "b": own.names[pair % len(own.names)], "w": np.bincount(at, own.w, len(pair))})

    def quality(moved: DataFrame, inside: str, c: str) -> float:
        """Modularity of the labels c, the weight inside a node's community being known."""
        i, s = moved.groupBy(c).agg(F.sum(inside).alias("i"), F.sum("k").alias("t")).agg(F.sum("i"), F.sum(F.col("t") * F.col("t"))).first()
        return i / weight - resolution * s / weight / weight

    def settled(graph: DataFrame, size: int, label: DataFrame, level: int) -> tuple[DataFrame, float]:
        """Labels (a, k, c) after rounds of moves that each raise the modularity, and its value."""
        top, label = None, label.withColumn("old", F.col("c")).withColumn("changed", F.lit(True))
        for r in range(rounds + 1):
            out = met(graph, size, label, swept, "a long, c long, before double, after double", level, r)
            # three labels a node: after this round's moves, as it began, and as the round before began
            moved = kept.keep(out.join(label.select("a", "k", F.col("c").alias("old"), F.col("old").alias("older")), "a"), "moved")
            now = quality(moved, "before", "old")
            if top is not None and now <= top + 1e-9:
                return moved.select("a", "k", F.col("older").alias("c")), top
            top = now
            if size <= block:  # nothing is left to move, and the block knows all labels
                now = quality(moved, "after", "c")
                return (moved.select("a", "k", "c"), now) if now > top + 1e-9 else (moved.select("a", "k", F.col("old").alias("c")), top)
            label = moved.select("a", "k", "c", "old", (F.col("c") != F.col("old")).alias("changed"))
        return moved.select("a", "k", F.col("old").alias("c")), top

    graph, size, reached = base, whole, None
    for level in range(levels):
        # upwards from single nodes; once that ends, the nodes of the graph itself are tried again in their communities
        label, top = settled(graph, size, graph.select("a", "k", F.col("a").alias("c")), level)
        if reached is not None and top <= reached + 1e-9:
            graph, size = base, whole
            label, top = settled(graph, size, base.select("a", "k").join(member.select(F.col("id").alias("a"), F.col("community").alias("c")), "a"), level)
            if top <= reached + 1e-9:
                break
            member = kept.keep(label.select(F.col("a").alias("id"), F.col("c").alias("community")), "member")
        else:
            member = kept.keep(member.join(label.select(F.col("a").alias("community"), "c"), "community").select("id", F.col("c").alias("community")), "member")
        reached = top
        above = met(graph, size, label.withColumn("changed", F.lit(False)), joined, "a long, b long, w double", level, -1)
        graph = kept.keep(_packed(above), "above")
        size = sizes(graph)[1]
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select("id", F.col("least").alias("community"))


def set_communities(sets: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(set_name, component, community): the graph of sets weighted by their Jaccard similarity, its components and their communities.

    set_name must be a number; sets that share a gene with none other are left out. Components
    are numbered by their least set, communities inside them likewise, from 1.
    """
    graph = Rounds(sets.sparkSession).keep(set_overlaps(sets).select("one", "two", F.col("jaccard").alias("weight")), "graph")
    rows = communities(graph, resolution).join(linked_sets(graph.select("one", "two")), "id")
    order = rows.select("component", "community").distinct()  # a row a community
    order = order.withColumn("number", F.row_number().over(W.partitionBy("component").orderBy("community")))
    return rows.join(order, ["component", "community"]).select(F.col("id").alias("set_name"), "component", "community", F.concat(F.lit("Component_"), F.col("component").cast("string"), F.lit("_Community_"), F.col("number").cast("string")).alias("label"))


def set_scores(values: DataFrame, cells: int, sets: DataFrame, bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """(set_name, cell_id, score): mean of the set's genes less the mean of control genes; cells that hold none of either (score 0) are left out.

    Genes are ranked by mean over all cells (absent pairs are zeros) and cut into `bins` runs. Of
    each run the `controls` genes first by a hash are drawn; those of the runs that a set touches,
    without its own genes, are its controls. Only genes with a count are known; a part without genes counts 0.
    """
    means = values.groupBy("gene").agg(F.round(F.sum("value") / cells, 8).alias("mean"))
    levels = running_before(means.groupBy("mean").agg(F.count("*").alias("n")), "mean", "n", value_parts(means, "mean"))
    size = F.greatest(F.lit(1), F.round(F.count("*") / (bins - 1), 0)).cast("long")
    ranked = means.join(levels.select("mean", "before"), "mean").join(F.broadcast(means.agg(size.alias("size"))))  # one row
    ranked = ranked.select("gene", F.floor((F.col("before") + 1) / F.col("size")).alias("bin"))
    drawn = ranked.withColumn("r", F.row_number().over(W.partitionBy("bin").orderBy(F.md5(F.concat_ws(":", "gene", F.lit(str(seed)))), "gene"))).where(F.col("r") <= controls).select("gene", "bin")
    own = sets.select("set_name", "gene").distinct().join(ranked, "gene")
    other = own.select("set_name", "bin").distinct().join(drawn, "bin").join(own.select("set_name", "gene"), ["set_name", "gene"], "left_anti")
    part = own.select("set_name", "gene", F.lit(True).alias("own")).unionByName(other.select("set_name", "gene", F.lit(False).alias("own")))
    counts = part.groupBy("set_name").agg(F.count_if("own").alias("k"), F.count_if(~F.col("own")).alias("c"))
    s = part.join(values.select("gene", "cell_id", "value"), "gene").groupBy("set_name", "cell_id").agg(F.sum(F.when(F.col("own"), F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("own"), F.col("value")).otherwise(0.0)).alias("b"))
    score = F.col("a") / F.col("k") - F.coalesce(F.col("b") / F.nullif("c", F.lit(0)), F.lit(0.0))
    return s.join(counts, "set_name").select("set_name", "cell_id", score.alias("score"))


def distinctive(df: DataFrame, gene: str, cluster: str, fold: str, p: str, level: float = 0.05) -> DataFrame:
    """df with `distinctive`: fold change times -log10 p over 1 + the other clusters where the gene is significant; a missing fold is 0, p 1; p = 0 gives 0."""
    q = F.coalesce(F.col(p), F.lit(1.0))
    sig = F.when(q < level, 1).otherwise(0)
    others = F.sum(sig).over(W.partitionBy(gene)) - sig
    return df.withColumn("distinctive", F.when(q > 0, F.coalesce(F.col(fold), F.lit(0.0)) * -F.log10(q) / (1 + others)).otherwise(0.0))
