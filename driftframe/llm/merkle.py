"""A Merkle manifest of a dataset: sibling-shift self-joins, level by level.

Nodes of a level are (tree, idx, n): number idx of n. Every node sends its digest to the computed
indices of its siblings (idx XOR 1 in a binary tree, else the other slots of its run), an equijoin
on (tree, idx) hands them over, and the rows of slot zero, which then know their whole run, emit the
parents. A level is written once, an eighth of the one below it. Proofs go the other way: a node's
path is its own siblings and its parent's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(parts: Column) -> Column:
    """Binary sha256 of text."""
    return F.unhex(F.sha2(parts.cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(fields: list[Column]) -> Column:
    """Binary digest of a row: each field as `-` if null, else its UTF-8 byte count, `:` and its text."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _siblings(fanout: int) -> Column:
    """Indices of a node's siblings among the n of its level."""
    idx = F.col("idx")
    if fanout == 2:
        near = F.array(idx.bitwiseXOR(F.lit(1)))
    else:
        slot = idx % fanout
        near = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda k: idx - slot + (slot + k) % fanout)
    return F.filter(near, lambda i: i < F.col("n"))


def levels(nodes: DataFrame, most: int, fanout: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of all trees from the leaves up, each with the digests `before` and `after` a node in its run.

    nodes: (tree, idx, n, h) and columns that the leaves keep; most: the largest n. A tree's last
    node has n = 1; shorter trees end on lower levels.
    """
    out = []
    while True:
        sent = nodes.where("n > 1").select("tree", F.explode(_siblings(fanout)).alias("idx"), (F.col("idx") % fanout).alias("slot"), F.col("h").alias("of"))
        run = nodes.join(sent, ["tree", "idx"], "left").groupBy(*nodes.columns).agg(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "of")))).alias("run"))
        side = "aggregate(filter(run, x -> x.slot {} idx % " + str(fanout) + "), X'', (a, x) -> concat(a, x.of))"
        level = scratch.keep(run.select(*nodes.columns, F.expr(side.format("<")).alias("before"), F.expr(side.format(">")).alias("after")), f"{name}_{len(out)}")
        out.append(level)
        if most <= 1:
            return out
        most = -(-most // fanout)
        first = level.where((F.col("n") > 1) & (F.col("idx") % fanout == 0))
        nodes = first.select("tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), hashed(as_hex(F.concat("h", "after"))).alias("h"))


def tops(built: list[DataFrame]) -> DataFrame:
    """(tree, h): the last node of every tree."""
    out = built[0].where("n = 1").select("tree", "h")
    for level in built[1:]:
        out = out.union(level.where("n = 1").select("tree", "h"))
    return out


def paths(built: list[DataFrame], fanout: int) -> DataFrame:
    """The leaves with `path`: from the leaf up, the digests before and after the node that holds it."""
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    above = None
    for level in reversed(built):
        keep = [c for c in level.columns if c not in ("before", "after")]
        own = F.array(F.struct("before", "after"))
        if above is None:
            above = level.select(*keep, none.alias("path"))  # all of them are last nodes
            continue
        up = above.select("tree", F.col("idx").alias("run"), F.col("path").alias("rest"))
        level = level.withColumn("run", F.expr(f"idx div {fanout}")).join(up, ["tree", "run"], "left")
        above = level.select(*keep, F.when(F.col("n") > 1, F.concat(own, F.coalesce("rest", none))).otherwise(none).alias("path"))
    return above


def fold(start: Column, path: Column) -> Column:
    """The root (hex) that a leaf's digest (binary) and its path give."""
    return F.aggregate(path, as_hex(start), lambda h, s: F.sha2(F.concat(as_hex(s["before"]), h, as_hex(s["after"])).cast("binary"), 256))


def proof(path: Column) -> Column:
    """All siblings of a path as hex text, from the leaf's up, left to right."""
    return F.array_join(F.transform(path, lambda s: as_hex(F.concat(s["before"], s["after"]))), "")


def manifest(rows: DataFrame, group: str, order: str, extra: list[str], fanout: int = FANOUT) -> DataFrame:
    """Rows (order, *extra) with their leaf, subroot and root (hex), and the path from leaf to root.

    rows must hold `h`, the leaf's binary digest. Each value of `group` (null is one, and the
    first) has a tree over its rows by `order` (nulls first; equal ones by digest, and repeated
    rows follow each other); the trees' last nodes, in the order of their values, have one too. An
    empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = scratch.keep(rows.select(F.col(group).alias("__g"), order, "h", *extra).withColumn("__uid", F.monotonically_increasing_id()), "leaves")
    ranked = global_rank(slim, [F.col("__g").asc_nulls_first(), F.col(order).asc_nulls_first(), F.col("h"), F.col("__uid")], "rank", parts, scratch, "ranked")
    groups = scratch.keep(ranked.groupBy("__g").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "counts")
    n, most = groups.agg(F.count("*"), F.max("n")).first()
    groups = scratch.small(global_rank(groups, [F.col("start")], "tree", 4, scratch, "order"), "groups")
    same = F.col("__g").eqNullSafe(F.col("__of"))
    nodes = ranked.join(groups.withColumnRenamed("__g", "__of"), same).select("tree", (F.col("rank") - F.col("start")).alias("idx"), "n", "h", order, *extra)
    built = levels(nodes, most or 0, fanout, scratch, "level")
    last = tops(built).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("n"), "h")
    upper = levels(last, n, fanout, scratch, "upper")
    roots = paths(upper, fanout).select(F.col("idx").alias("tree"), F.col("h").alias("subroot"), F.col("path").alias("upper"))
    roots = scratch.small(roots.crossJoin(F.broadcast(tops(upper).select(F.col("h").alias("root")))), "roots")  # one row
    full = F.concat("path", "upper")
    return paths(built, fanout).join(roots, "tree").select(order, *extra, "h", as_hex(F.col("h")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"), full.alias("path"))


def digest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of documents by language, with proofs, and the root recomputed from leaves of which a third is tampered.

    Nulls in any column count as `-`; rows without an id come first in their language and are never
    tampered; rows of equal id come by digest, repeated ones are leaves of their own. Tampering
    lower-cases A-Z in the text, so a row whose text has none (or is null or empty) still verifies.
    Other columns are ignored; an empty table gives no rows.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = F.when(tampered & F.col("text").rlike("[A-Z]"), leaf([*fields, F.translate("text", UPPER, LOWER)]))
    rows = docs.select("doc_id", "lang", leaf([*fields, F.col("text")]).alias("h"), changed.alias("changed"))
    out = manifest(rows, "lang", "doc_id", ["changed"], fanout)
    out = out.withColumn("folded_root", fold(F.coalesce("changed", "h"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(fanout: int = FANOUT, depth: int = 11) -> str:
    """The same in SQL, level by level, for up to fanout ** depth rows of a language."""
    crc = "list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''), lambda ch: list_concat([ascii(ch)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))), lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end)"
    enc = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"
    row = " || ".join(enc.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    out = [
        f"""with docs as (select doc_id, lang, sha256({row} || {enc.format("text")}) as leaf, case when xor({crc.format("doc_id::varchar")}, 4294967295) % 3 = 0 then sha256({row} || {enc.format(low)}) end as changed from documents),
tree as (select lang, row_number() over (order by lang nulls first) - 1 as tree, n from (select lang, count(*) as n from docs group by lang)),
a0 as (select d.*, tree, n, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, leaf as h from docs d join tree t on d.lang is not distinct from t.lang),
n0 as (select tree, idx, n, h from a0)"""
    ]

    def climb(first: str, to: str) -> None:
        for k in range(depth):
            out.append(f"""{to}{k} as (select a.tree, a.idx, a.n, a.h, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as bef, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as aft
from {first}{k} a left join {first}{k} b on a.tree = b.tree and a.idx // {fanout} = b.idx // {fanout} and a.idx <> b.idx group by all)""")
            out.append(f"{first}{k + 1} as (select tree, idx // {fanout} as idx, (n + {fanout - 1}) // {fanout} as n, case when n > 1 then sha256(h || aft) else h end as h from {to}{k} where idx % {fanout} = 0)")

    climb("n", "s")
    out.append(f"m0 as (select 0 as tree, tree as idx, (select count(*) from tree) as n, h from n{depth})")
    climb("m", "u")
    joins, folds, sibs = [], "coalesce(a0.changed, a0.leaf)", []
    for kind, at, tree, count in (("s", "a0.idx", "a0.tree", "a0.n"), ("u", "a0.tree", "0", "u0.n")):
        for k in range(depth):
            joins.append(f"join {kind}{k} on {kind}{k}.tree = {tree} and {kind}{k}.idx = {at} // {fanout**k}")
            sibs.append(f"{kind}{k}.bef || {kind}{k}.aft")
    steps = [f"{kind}{k}" for kind in "su" for k in range(depth)]
    out.append(f"f0 as (select a0.doc_id, a0.leaf, n{depth}.h as subroot, (select h from m{depth}) as root, sha256({' || '.join(sibs)}) as proof_sha256, {folds} as x, [{', '.join(f'struct_pack(n := {s}.n, b := {s}.bef, a := {s}.aft)' for s in steps)}] as path from a0 join n{depth} on n{depth}.tree = a0.tree {' '.join(joins)})")
    for k in range(len(steps)):
        out.append(f"f{k + 1} as (select doc_id, leaf, subroot, root, proof_sha256, path, case when path[{k + 1}].n > 1 then sha256(path[{k + 1}].b || x || path[{k + 1}].a) else x end as x from f{k})")
    return ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, proof_sha256, x as folded_root, x = root as verified from f{len(steps)}"


ORACLE_SQL = oracle(depth=6)
