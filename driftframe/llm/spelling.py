"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One edit changes the counts of a word's letters by at most two in L1: a replacement takes one letter
and adds one (+1, -1), an insertion adds one (+1, 0). Words of a length share a k-d tree. Its upper
part, fitted on a bounded sample of the words, cuts them into cells of bounded size; a word is stored
in one cell of its length's tree and sent as a query to every cell of the trees of its own length and
the next one whose box it can reach with its +1 and -1. Each cell is searched in one task by a k-d
tree of its own, a whole batch of queries going down together. Letter order is verified at the leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .merkle import LOWER, UPPER

LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a cell, words of a leaf of a cell's own tree, words the upper trees are fitted on, pairs compared at once.
CELL, LEAF, SAMPLE, BLOCK = 8192, 64, 100_000, 1 << 20
#: a-z and the code points from U+00C0 to U+00FF, as they are numbered in the vectors.
DIMS = 26 + 64
CELLS = "word string, n long, length int, cell long, block int, query boolean"
EDGES = "word string, near string, near_n long"


def words(docs: DataFrame, least: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, every 31st (by a checksum of document and run) without one code point.

    A null text has none; a null id counts as an empty one.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def letters(group: list[str], length: int) -> np.ndarray:
    """(words, length): code points of words of one length."""
    return np.frombuffer("".join(group).encode("latin-1"), np.uint8).reshape(len(group), length)


def vectors(codes: np.ndarray) -> np.ndarray:
    """(words, DIMS): how often each letter comes."""
    dim = np.where(codes >= 0xC0, codes.astype(np.int32) - 0xC0 + 26, codes.astype(np.int32) - 97)
    out = np.bincount((np.arange(len(codes))[:, None] * DIMS + dim).ravel(), minlength=len(codes) * DIMS)
    return out.reshape(len(codes), DIMS).astype(np.int32)


def marks(counts: np.ndarray) -> np.ndarray:
    """64 bits of each vector, of which no two differ in more bits than the vectors' L1 distance.

    Two bits for each of a-z (it comes; it comes twice), and the parities of what is left.
    """
    plain, bit = counts[:, :26], np.arange(26, dtype=np.uint64)
    out = ((plain > 0).astype(np.uint64) << bit).sum(1, dtype=np.uint64) | ((plain > 1).astype(np.uint64) << (bit + np.uint64(26))).sum(1, dtype=np.uint64)
    rest = np.concatenate([np.maximum(plain - 2, 0), counts[:, 26:]], axis=1)
    for k in range(12):
        out |= (rest[:, k::12].sum(1) & 1).astype(np.uint64) << np.uint64(52 + k)
    return out


class Tree:
    """A k-d tree over letter counts: inner nodes cut one letter's count, leaves are numbered from 0.

    In arrays: of node i the letter, the highest count that goes left (`left`), else right. Nodes
    with letter -1 are leaves, `left` their number. A leaf holds at most `most` points or points
    that are all equal.
    """

    def __init__(self, points: np.ndarray, most: int):
        self.dim, self.cut, self.left, self.right, self.size = [], [], [], [], []
        self.members: list[np.ndarray] = []
        todo = [(self._node(), np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            here = points[rows]
            d, at = self._best(here) if len(rows) > most else (-1, 0)
            self.dim[node], self.cut[node] = d, at
            if d < 0:
                self.left[node] = len(self.members)
                self.members.append(rows)
                continue
            low = here[:, d] <= at
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]

    def _node(self) -> int:
        for a in (self.dim, self.cut, self.left, self.right):
            a.append(-1)
        return len(self.dim) - 1

    @staticmethod
    def _best(here: np.ndarray) -> tuple[int, int]:
        """The letter and count that cut nearest to the middle; (-1, 0) if all points are equal."""
        found, off = (-1, 0), len(here)
        for d in np.flatnonzero(here.max(0) > here.min(0)):
            counts = np.cumsum(np.bincount(here[:, d]))
            at = int(np.abs(2 * counts[:-1] - len(here)).argmin())
            if 0 < counts[at] < len(here) and abs(2 * int(counts[at]) - len(here)) < off:
                found, off = (int(d), at), abs(2 * int(counts[at]) - len(here))
        return found

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.dim[node] < 0:
                out[rows] = self.left[node]
                continue
            low = points[rows, self.dim[node]] <= self.cut[node]
            todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def reach(self, queries: np.ndarray, more: int, less: int):
        """Leaves and the queries that reach their box if letters may come `more` and go `less` times in all.

        What is spent on a letter is the distance to the box along it: crossing a second cut of the
        same letter costs the difference only.
        """
        rows = np.arange(len(queries))
        todo = [(0, rows, np.full(len(rows), more, np.int16), np.full(len(rows), less, np.int16), {})]
        while todo:
            node, rows, up, down, spent = todo.pop()
            if not len(rows):
                continue
            d = self.dim[node]
            if d < 0:
                yield self.left[node], rows
                continue
            x, cut = queries[rows, d], self.cut[node]
            paid_up, paid_down = spent.get(d, (np.zeros(len(rows), np.int16),) * 2)
            for child, need_up, need_down in ((self.left[node], paid_up, np.maximum(paid_down, x - cut)), (self.right[node], np.maximum(paid_up, cut + 1 - x), paid_down)):
                rest_up, rest_down = up - (need_up - paid_up), down - (need_down - paid_down)
                ok = (rest_up >= 0) & (rest_down >= 0)
                held = {k: (a[ok], b[ok]) for k, (a, b) in spent.items() if k != d}
                todo.append((child, rows[ok], rest_up[ok], rest_down[ok], held | {d: (need_up[ok], need_down[ok])}))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place."""
    return (a != b).sum(1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of `long` are those of `short` with one code point more."""
    before = np.logical_and.accumulate(short == long[:, :-1], 1).sum(1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], 1).sum(1)
    return before + after >= short.shape[1]


def upper_trees(found: DataFrame, total: int, cell: int, sample: int) -> tuple[dict, dict]:
    """By length: the upper tree, and per cell into how many blocks it is dealt, if over one.

    Fitted on about `sample` words at most, by hash; a cell that no letter count can cut (words of the
    same letters) is dealt into blocks, so that no task gets more than some cells' words.
    """
    share = min(1.0, sample / max(1, total))
    thin = found.where(F.pmod(F.xxhash64(F.lit(12), "word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word")
    by: dict[int, list[str]] = {}
    for (word,) in thin.collect():  # bounded by `sample`
        by.setdefault(len(word), []).append(word)
    most = max(1, int(cell * share))
    trees, blocks = {}, {}
    for length, group in by.items():
        if len(group) > most:
            trees[length] = tree = Tree(vectors(letters(sorted(group), length)), most)
            blocks[length] = np.array([max(1, -(-len(m) // most)) for m in tree.members])
            tree.members = []
    return trees, blocks


def _router(shared):
    def route(batches):
        trees, blocks = shared.value
        for df in batches:
            names, counts = df["word"].to_numpy(object), df["n"].to_numpy()
            sizes = np.array([len(w) for w in names])
            salt = pd.util.hash_array(names, categorize=False)
            made = []

            def keep(rows, to, cell, block, query, made=made):
                full = (np.full(len(rows), x, kind) if np.isscalar(x) else x.astype(kind) for x, kind in ((to, np.int32), (cell, np.int64), (block, np.int32), (query, bool)))
                made.append((rows, *full))

            for length in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == length)
                v = vectors(letters(list(names[at]), length))

                tree = trees.get(length)
                cells = tree.place(v) if tree else np.zeros(len(v), np.int64)
                keep(at, length, cells, salt[at] % blocks[length][cells] if tree else 0, False)
                for to, less in ((length, 1), (length + 1, 0)):
                    tree = trees.get(to)
                    for cell, some in tree.reach(v, 1, less) if tree else [(0, np.arange(len(v)))]:
                        for block in range(blocks[to][cell] if tree else 1):
                            keep(at[some], to, cell, block, True)
            if made:
                row, to, cell, block, query = (np.concatenate(c) for c in zip(*made))
                yield pd.DataFrame({"word": names[row], "n": counts[row], "length": to, "cell": cell, "block": block, "query": query})

    return route


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Edges between a cell's words and the queries sent to it, both ways where the query is shorter."""
    names, counts, query = group["word"].to_numpy(object), group["n"].to_numpy(), group["query"].to_numpy(bool)
    length, found = int(group["length"].iloc[0]), [np.zeros((2, 0), np.int64)]
    sizes, points = np.array([len(w) for w in names]), np.flatnonzero(~query)
    if len(points):
        codes = letters(list(names[points]), length)
        counted = vectors(codes)
        tree, own_marks = Tree(counted, LEAF), marks(counted)
        for size, less, check in ((length, 1, replaced), (length - 1, 0, inserted)):
            asked = np.flatnonzero(query & (sizes == size))
            if not len(asked):
                continue
            own = letters(list(names[asked]), size)
            counted = vectors(own)
            ask_marks = marks(counted)
            for leaf, rows in tree.reach(counted, 1, less):
                held = tree.members[leaf]
                step = max(1, BLOCK // len(held))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    a, b = np.nonzero(np.bitwise_count(ask_marks[some][:, None] ^ own_marks[held][None]) <= 1 + less)
                    a, b = some[a], held[b]
                    ok = check(own[a], codes[b])
                    pair = np.stack([asked[a[ok]], points[b[ok]]])
                    found += [pair] if size == length else [pair, pair[::-1]]
    a, b = np.concatenate(found, axis=1)
    return pd.DataFrame({"word": names[a], "near": names[b], "near_n": counts[b]})


def near_words(found: DataFrame, total: int, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, near, near_n): every ordered pair of the distinct words (word, n) that are one edit apart."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(upper_trees(found, total, cell, sample))  # bounded by `sample`
    routed = found.select("word", "n").mapInPandas(_router(shared), CELLS)
    return routed.groupBy("length", "cell", "block").applyInPandas(_search, EDGES)


def variants(docs: DataFrame, ratio: int = RATIO, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words with the usual spelling they vary.

    A word's form is the most frequent word one edit away (ties: the first in code-point order) if
    that is `ratio` times as frequent; the root is where the forms lead. Null texts have no words, a
    null id counts as empty, repeated rows count again, other columns are ignored; no words, no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.keep(words(docs.select("doc_id", "text")), "words")
    edges = near_words(found, found.count(), cell, sample)
    # the greatest of (near_n, word in falling order): the least of (-near_n, word)
    best = edges.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    out = found.join(best, "word", "left")
    usual = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    out = scratch.keep(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n")), "forms")
    # frequencies grow along the forms, so that they end; doubled steps, over the words with a form only
    step = scratch.keep(out.where("form is not null").select("word", F.col("form").alias("root")), "root0")
    for k in range(1, 64):
        on = step.select(F.col("word").alias("root"), F.col("root").alias("then"))
        nxt = scratch.keep(step.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), f"root{k}")
        moved = not nxt.where("moved").isEmpty()
        step = nxt.drop("moved")
        if not moved:
            break
    roots = step.select("word", "root")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: A deletion-neighbourhood join in place of the trees.
ORACLE_SQL = f"""
with recursive runs as (select doc_id, translate(run, '{UPPER}', '{LOWER}') as run from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) as run from documents)),
kinds as (select doc_id, run, count(*) as k, coalesce(doc_id::varchar, '') || ':' || run as name from runs group by 1, 2),
bits as (select doc_id, run, k, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(name, ''), lambda ch: case when ascii(ch) < 128 then [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] else [(192 + ascii(ch) // 64)::bigint, -1, -1, -1, -1, -1, -1, -1, -1, (128 + ascii(ch) % 64)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] end))), lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end), 4294967295) as h from kinds),
made as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from bits),
w as (select word, sum(k)::bigint as n from made where length(word) >= 7 group by word having sum(k) >= 2),
cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as part from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
pairs as (select a.word, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.part = b.part and a.word <> b.word
  union select c.word, w.word, w.n from cut c join w on c.part = w.word union select w.word, c.word, c.n from cut c join w on c.part = w.word),
best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pairs group by word),
forms as (select w.word, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from w left join best using (word)),
walk as (select word, form as root from forms where form is not null union all select walk.word, f.form from walk join forms f on f.word = walk.root where f.form is not null),
ends as (select walk.word, walk.root from walk join forms f on f.word = walk.root where f.form is null)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near, f.form_n from forms f left join ends e on e.word = f.word
"""
