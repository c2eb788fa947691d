"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a hashed order on a line of words, gone through twice, which is
cut into blocks. A binary tree over the output shards splits the exact block quotas of all
sources: a node's left half draws its blocks without replacement from the node's. The draw goes
down a second binary tree over the sources' places, each time settling how many fall to the first
half of the sources at hand (a hypergeometric draw by inverted distribution function); as draws are
keyed by shard node and group of sources, every source works out its own way down in its own row.

The quotas settle which blocks are drawn: a source's blocks, in the order of a keyed permutation
(swap-or-not, Hoang, Morris and Rogaway 2012), are divided among the shards in proportion to their
quotas, and each shard draws its quota from the front of its own part. So blocks are disjoint, and
the last one drawn is cut to the target's words. Rows are shuffled inside their shard. DataFrame and
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, Scratch, global_rank

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SHARDS = 16
#: Words of a block, at most; and blocks of a source's target, at least (while a block has a word).
BLOCK, LEAST_BLOCKS = 4096, 64
#: Rounds of the permutation of blocks.
ROUNDS = 16
#: Rows of a source that are ordered together.
RUN = 4096

#: x of Hypergeometric(total v.t, marked v.k, drawn v.n) at the uniform v.u, by the ratio of
#: neighbouring probabilities over 8 standard deviations around the mode.
_DRAW = """
transform(array(named_struct('lo', {lo}, 'hi', {hi})), r ->
  transform(array(aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D),
      (a, x) -> named_struct('w', a.w * {up}, 's', a.s + a.w), a -> a.s)), s ->
    aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D, 'x', r.lo),
      (a, x) -> named_struct('w', a.w * {up}, 's', a.s + a.w, 'x', if(a.s < v.u * s, x, a.x)), a -> a.x))[0])[0]
""".format(
    lo="cast(greatest(0, v.n + v.k - v.t, floor((v.n + 1D) * (v.k + 1) / (v.t + 2)) - 2 - ceil(8 * sqrt(v.n * (v.k / greatest(v.t, 1)) * (1 - v.k / greatest(v.t, 1))))) as bigint)",
    hi="cast(least(v.n, v.k, floor((v.n + 1D) * (v.k + 1) / (v.t + 2)) + 2 + ceil(8 * sqrt(v.n * (v.k / greatest(v.t, 1)) * (1 - v.k / greatest(v.t, 1))))) as bigint)",
    up="coalesce(cast((v.k - x) as double) * (v.n - x) / nullif((x + 1D) * (v.t - v.k - v.n + x + 1), 0), 0D)",
)

#: What falls to a shard node's left half, from the whole node to the source's own place: total and depth
#: settle the first number, held[d] is what the node has of the sources in the d-th group on the way down
#: and low[d] what it has of that group's first half. The result: (got, of held; firsts, of low).
_SPLIT = f"""
aggregate(sequence(0, depth - 1), named_struct('got', array(held[0] div 2), 'firsts', cast(array() as array<bigint>)),
  (s, d) -> transform(array(transform(array(named_struct('t', held[d], 'k', low[d], 'n', s.got[d],
      'u', {{u}} / 4503599627370496D)), v -> {_DRAW})[0]), x ->
    named_struct('got', concat(s.got, array(if(shiftright(at, depth - 1 - d) % 2 = 0, x, s.got[d] - x))), 'firsts', concat(s.firsts, array(x))))[0])
"""


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ..) with at (its place by code point, null last) and target.

    Targets share `share` of all words by weight; those above `most` times their source's size
    stop there and the excess is shared by weight among the rest. The common factor rises until no
    further source reaches its bound: one aggregation a round, a handful of rounds.
    """
    s = global_rank(sources, [F.col("source").asc_nulls_last()], "at", 1 + sources.count() // RUN, scratch, "ranked")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    s = s.withColumn("at", F.col("at").cast("long")).withColumn("__weight", w).withColumn("__cap", F.col("source_size") * float(most))
    factor, rising = 0.0, True
    while rising:
        full = F.col("__cap") < F.col("__weight") * factor
        told = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("__cap"))).alias("caps"), F.sum(F.when(~full, F.col("__weight"))).alias("rest")).first()
        now = (told["all"] * share - (told["caps"] or 0.0)) / told["rest"] if told["rest"] else factor
        factor, rising = max(factor, now), now > factor
    return s.withColumn("target", F.least("__cap", F.col("__weight") * factor)).drop("__weight", "__cap")


def quotas(sources: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(at, upto): for each source, the running sums over the shards of its blocks' quotas.

    sources: (at, blocks), one row for each source, at from 0; shards: a power of two. Every source
    carries what its shard node has of the log2(sources) groups it is in, so no row holds all sources.
    """
    depth = max(1, int(sources.agg(F.max("at")).first()[0] or 0).bit_length())
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")
    each = sources.select("at", "blocks", levels)
    sums = each.groupBy("d", F.expr(f"shiftright(at, {depth} - d)").alias("group")).agg(F.sum("blocks").alias("n"))
    way = sources.select("at", F.explode(F.sequence(F.lit(0), F.lit(2 * depth))).alias("j"))  # depth + 1 groups, then the first halves of all but the last
    way = way.withColumn("d", F.expr(f"if(j <= {depth}, j, j - {depth})")).withColumn("group", F.expr(f"if(j <= {depth}, shiftright(at, {depth} - d), shiftleft(shiftright(at, {depth} - d + 1), 1))"))
    told = way.join(sums, ["d", "group"], "left").groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.coalesce("n", F.lit(0).cast("long")).alias("n")))), lambda x: x["n"]).alias("n"))
    tree = told.select("at", F.lit(depth).alias("depth"), F.lit(1).cast("long").alias("node"), F.slice("n", 1, depth + 1).alias("held"), F.slice("n", depth + 2, depth).alias("low"))
    u = _hash(str(seed), "node", "d", "shiftright(at, depth - d)", digits=13)
    for _ in range(shards.bit_length() - 1):
        rest = "zip_with(held, s.got, (a, b) -> a - b)", "zip_with(low, s.firsts, (a, b) -> a - b)"
        halves = f"array(struct(node * 2 as node, s.got as held, s.firsts as low), struct(node * 2 + 1 as node, {rest[0]} as held, {rest[1]} as low))"
        tree = tree.select("at", "depth", F.expr(f"inline(flatten(transform(array({_SPLIT.format(u=u)}), s -> {halves})))"))
    listed = F.array_sort(F.collect_list(F.struct("node", F.col("held")[depth].alias("quota"))))  # as many as shards
    run = F.expr("transform(sequence(1, size(q)), i -> aggregate(slice(q, 1, i), 0L, (a, x) -> a + x.quota))")
    return tree.groupBy("at").agg(listed.alias("q")).select("at", run.alias("upto"))


def _hash(*parts: str, digits: int) -> str:
    """SQL of the first hexadecimal digits of the md5 of the parts, as a number."""
    told = ", ':', ".join(f"cast({p} as string)" for p in parts)
    return f"cast(conv(substring(md5(cast(concat({told}) as binary)), 1, {digits}), 16, 10) as bigint)"


def _rank(block: str, seed: int) -> str:
    """SQL of a block's place in its source's permutation of `many` blocks; a short block behind them stays last."""
    key = _hash(str(seed), "at", "r", digits=12)
    coin = _hash(str(seed), "at", "r", "greatest(x, pmod(key - x, many))", digits=1)
    step = f"aggregate(array(pmod({key}, many)), x, (x, key) -> if({coin} >= 8, pmod(key - x, many), x))"
    return f"if({block} >= many, {block}, aggregate(sequence(1, {ROUNDS}), {block}, (x, r) -> {step}))"


#: A block's shard, in whose part of the permuted blocks it stands, and its place among all draws; `blocks` if it is not drawn.
_POOL = "greatest(many, blocks)"
_DRAWN = f"""
transform(array(cast(size(filter(upto, q -> q * {_POOL} div blocks <= v.rank)) as int)), s -> named_struct('b', v.b, 'shard', s, 'at',
  transform(array(if(s = 0, 0L, upto[s - 1])), f -> if(v.rank - f * {_POOL} div blocks < get(upto, s) - f, f + v.rank - f * {_POOL} div blocks, blocks))[0]))[0]
"""


def mix(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = 0, id_col: str = "doc_id", carry: bool = True) -> DataFrame:
    """docs with their size, source_size, target, taken and pieces; without `carry` only the id and the source of docs come along.

    pieces: array of (pass, block, shard, start, words), the runs of the document's words that the
    mix takes, by pass over the source and block; taken is the sum of their words, at most twice
    the size. The quotas of the tree settle which blocks are among them. A source's pieces sum to its target, rounded. Null texts have size 0 and are never
    taken; null sources are one source, last in order; repeated rows are documents of their own; an
    empty table gives no rows. Columns of docs stay unless they have one of these names.
    """
    scratch = Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "pieces") and (carry or c in (id_col, "source"))]
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    slim = docs.select(*names, word_count(F.col("text")).alias("size"), key.alias("__key"), F.xxhash64("text").alias("__tie"))
    if not carry:
        slim = scratch.keep(slim, "slim")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    sources = targets(scratch.keep(sources, "sizes"), scratch).withColumn("words", F.round("target").cast("long"))
    sources = sources.withColumn("len", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("words") / LEAST_BLOCKS))).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("words") / F.col("len")).cast("long")).withColumn("many", F.expr("2 * source_size div len"))
    sources = scratch.keep(sources, "sources")
    sources = scratch.keep(sources.join(quotas(sources, shards, seed), "at", "left").withColumnRenamed("source", "__source"), "quotas")
    runs = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / 4294967296.0 * (1 + F.floor(F.col("__n") / RUN))).cast("long")
    placed = slim.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__run", runs)
    order = W.partitionBy("at").orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    begin = placed.groupBy("at", "__run").agg(F.sum("size").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(order), F.lit(0))).drop("__sum")
    inside = W.partitionBy("at", "__run").orderBy("__key", "size", "__tie").rowsBetween(W.unboundedPreceding, 0)
    line = placed.join(begin, ["at", "__run"]).withColumn("__begin", F.col("__before") + F.sum("size").over(inside) - F.col("size"))
    pieces = f"""
    filter(flatten(transform(array(0L, 1L), p -> transform(array(named_struct('lo', p * source_size + __begin, 'hi', p * source_size + __begin + size)), r ->
      if(r.hi > r.lo and words > 0, transform(transform(transform(sequence(r.lo div len, (r.hi - 1) div len), b -> named_struct('b', b, 'rank', {_rank("b", seed)})), v -> {_DRAWN}), v -> named_struct('pass', p, 'block', v.b,
        'shard', v.shard, 'start', greatest(r.lo, v.b * len) - r.lo,
        'words', if(v.at >= blocks, 0L, least(r.hi, v.b * len + if(v.at = blocks - 1, words - v.at * len, len)) - greatest(r.lo, v.b * len)))),
      cast(array() as array<struct<pass:bigint,block:bigint,shard:int,start:bigint,words:bigint>>)))[0])), x -> x.words > 0)"""
    out = line.withColumn("pieces", F.expr(pieces)).withColumn("taken", F.expr("aggregate(pieces, 0L, (a, x) -> a + x.words)"))
    return out.select(*names, "size", "source_size", "target", "taken", "pieces")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces): of the mix of docs, with pieces as pass:block:shard:start:words, comma-joined; empty where nothing is taken.

    Nulls, ties, repeated rows and empty tables are as in `mix`; other columns of docs are left out.
    """
    told = F.array_join(F.transform("pieces", lambda p: F.concat_ws(":", p["pass"], p["block"], p["shard"], p["start"], p["words"])), ",")
    return mix(docs.select("doc_id", "source", "text"), carry=False).select("doc_id", "size", "source_size", "target", "taken", told.alias("pieces"))


def shard_rows(rows: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """rows (shard, block, pass, id, ..), each shard's blocks dealt over tasks and in a hashed order inside."""
    return rows.repartition("shard", "block").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), id_col, "pass", "block"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, in the order of shard_rows.

    A document whose blocks are not all drawn is cut to the words taken (n_chars with it); it
    belongs to the shard of its first piece. Columns are those of docs, whatever they hold; null
    texts are not in the mix; an empty table gives no rows.
    """
    if not {"doc_id", "source", "text"} <= set(docs.columns):
        raise ValueError("docs need doc_id, source and text")
    mixed = mix(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text"), **options)
    each = mixed.select("row", "size", F.explode(F.expr("filter(transform(array(0L, 1L), p -> filter(pieces, x -> x.pass = p)), x -> size(x) > 0)")).alias("p"))
    each = each.withColumn("words", F.expr("aggregate(p, 0L, (a, x) -> a + x.words)"))
    tokens = F.regexp_extract_all("row.text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("p", lambda x: F.slice(F.col("tokens"), x.start.cast("int") + 1, x.words.cast("int")))), "")
    cut = F.col("words") < F.col("size")
    each = each.withColumn("tokens", F.when(cut, tokens)).withColumn("cut", F.when(cut, some))
    row = F.col("row").withField("text", F.coalesce("cut", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.char_length("cut").cast("long")).otherwise(F.col("row.n_chars")))
    each = each.select(row.alias("row"), F.col("p")[0]["shard"].alias("shard"), F.col("p")[0]["block"].alias("block"), F.col("p")[0]["pass"].alias("pass"), F.col("row.doc_id").alias("doc_id"))
    return shard_rows(each).select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat(coalesce(cast(doc_id AS varchar), ''), ':0')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight, source_size * 2.0::double AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM w
), t AS (
  SELECT source, pos, source_size, least(cap, weight * max(factor) OVER ()) AS target FROM f
), u AS (
  SELECT *, cast(round(target) AS bigint) AS words, greatest(1, least({BLOCK}, cast(round(target) AS bigint) // {LEAST_BLOCKS})) AS len FROM t
), h AS (
  SELECT ceil(log2(greatest(2, max(pos) + 1)))::int AS depth FROM u
), n0 AS (
  SELECT 1::bigint AS node, g.d AS d, pos >> (depth - g.d) AS grp, sum((words + len - 1) // len)::bigint AS n
  FROM u, h, range(0, 64) AS g(d) WHERE g.d <= depth GROUP BY ALL
{TREE}), q0 AS (
  SELECT node, grp AS pos, n AS quota FROM n{LEVELS}, h WHERE d = depth
), qs AS (
  SELECT pos, node - {SHARDS} AS shard, quota, sum(quota) OVER (PARTITION BY pos ORDER BY node) - quota AS before FROM q0
), l AS (
  SELECT d.*, u.pos, u.source_size, u.target, u.words, u.len, 2 * u.source_size // u.len AS many, (u.words + u.len - 1) // u.len AS blocks,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS b
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), p AS (
  SELECT *, pass * source_size + b AS lo, pass * source_size + b + size AS hi FROM l, (VALUES (0), (1)) AS v(pass) WHERE size > 0
), x0 AS (
  SELECT *, cast(block AS bigint) AS x FROM (SELECT *, unnest(range(cast(lo // len AS bigint), cast((hi - 1) // len + 1 AS bigint))) AS block FROM p)
{PERMUTED}), y0 AS (
  SELECT doc_id, pass, block, lo, hi, len, pos, blocks, words, greatest(many, blocks) AS pool, CASE WHEN block >= many THEN block ELSE x END AS rank FROM x{ROUNDS}
), y AS (
  SELECT y0.*, shard, before + rank - before * pool // blocks AS draw
  FROM y0 JOIN qs ON y0.pos = qs.pos AND rank >= before * pool // blocks AND rank < before * pool // blocks + quota
), y1 AS (
  SELECT *, greatest(lo, block * len) AS a, least(hi, block * len + CASE WHEN draw = blocks - 1 THEN words - draw * len ELSE len END) AS e FROM y
), q AS (
  SELECT doc_id, sum(e - a) AS taken, string_agg(concat_ws(':', pass, block, shard, a - lo, e - a), ',' ORDER BY pass, block) AS pieces
  FROM y1 WHERE e > a GROUP BY doc_id
)
SELECT l.doc_id, cast(size AS bigint) AS size, cast(source_size AS bigint) AS source_size, cast(target AS double) AS target, cast(coalesce(taken, 0) AS bigint) AS taken, coalesce(pieces, '') AS pieces
FROM l LEFT JOIN q ON l.doc_id IS NOT DISTINCT FROM q.doc_id
"""
_ROUND = """), k{r} AS (
  SELECT *, ((('0x' || substr(md5(concat('0:', pos, ':{r}')), 1, 12))::bigint % greatest(many, 1)) - x + greatest(many, 1)) % greatest(many, 1) AS other FROM x{p}
), x{r} AS (
  SELECT * EXCLUDE (other, x), CASE WHEN substr(md5(concat('0:', pos, ':{r}:', greatest(x, other))), 1, 1) >= '8' THEN other ELSE x END AS x FROM k{r}
"""
#: One level of the tree over the shards: down the groups of sources, from all to one, then both halves of the nodes.
_LEVEL = """), g{p} AS (
  SELECT node, d, grp, n AS t, n // 2 AS x FROM n{p} WHERE d = 0
  UNION ALL
  SELECT node, d + 1, 2 * grp + side, CASE side WHEN 0 THEN k ELSE t - k END, CASE side WHEN 0 THEN got ELSE n - got END FROM (
    SELECT *, list_reduce(range(lo, hi + 1), lambda a, x: {'w': a.w * {up}, 's': a.s + a.w, 'x': CASE WHEN a.s < u * total THEN x ELSE a.x END}, {'w': 1.0::double, 's': 0.0::double, 'x': lo}).x AS got FROM (
    SELECT *, list_reduce(range(lo, hi + 1), lambda a, x: {'w': a.w * {up}, 's': a.s + a.w}, {'w': 1.0::double, 's': 0.0::double}).s AS total FROM (
    SELECT *, greatest(0, n + k - t, mode - 2 - wide)::bigint AS lo, least(n, k, mode + 2 + wide)::bigint AS hi FROM (
    SELECT *, floor((n + 1.0::double) * (k + 1) / (t + 2)) AS mode, ceil(8 * sqrt(n * (k / greatest(t, 1)) * (1 - k / greatest(t, 1)))) AS wide FROM (
    SELECT g.node, g.d, g.grp, g.t, g.x AS n, coalesce(c.n, 0) AS k, ('0x' || substr(md5(concat('0:', g.node, ':', g.d, ':', g.grp)), 1, 13))::bigint / 4503599627370496.0::double AS u
    FROM g{p} g JOIN h ON g.d < h.depth LEFT JOIN n{p} c ON c.node = g.node AND c.d = g.d + 1 AND c.grp = 2 * g.grp))))), (VALUES (0), (1)) AS v(side)
), n{r} AS (
  SELECT 2 * node + side AS node, d, grp, CASE side WHEN 0 THEN x ELSE t - x END AS n FROM g{p}, (VALUES (0), (1)) AS v(side)
""".replace("{up}", "coalesce((k - x)::double * (n - x) / nullif((x + 1.0::double) * (t - k - n + x + 1), 0), 0)")
_LEVELS = SHARDS.bit_length() - 1
ORACLE_SQL = (
    ORACLE_SQL.replace("{PERMUTED}", "".join(_ROUND.format(r=r, p=r - 1) for r in range(1, ROUNDS + 1)))
    .replace("{TREE}", "".join(_LEVEL.replace("{p}", str(k)).replace("{r}", str(k + 1)) for k in range(_LEVELS)))
    .replace("{LEVELS}", str(_LEVELS)).replace("{SHARDS}", str(SHARDS))
    .replace("{ROUNDS}", str(ROUNDS)).replace("{BLOCK}", str(BLOCK)).replace("{LEAST_BLOCKS}", str(LEAST_BLOCKS))
)
