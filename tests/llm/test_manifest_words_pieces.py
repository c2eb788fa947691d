"""Merkle manifests, spelling variants and SentencePiece coding against brute force and the library."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.llm import merkle, pieces, spelling

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, tree string, ids string, word string, n int"


def corpus():
    """Nulls, empty and long texts, letters outside ASCII, repeated rows and ids, clashing columns."""
    rng = random.Random(7)
    stems = ["recommend", "separate", "definitely", "élévation", "straßenbahn", "aaaaaaaab", "mississippi", "Quantity"]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: rng.randint(1, 8)])
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "x", w[i] * 2, "É"]) + w[i + 1 :]
            words.append(w)
        texts.append(rng.choice([" ", ", ", "\n", "  "]).join(words))
    texts += [None, "", " ", "▁▁ x", "\x00퟿\U0001f600", "z" * 3000, "ab" * 700, "   " * 200, texts[0], texts[0].upper(), "long " * 20000]
    rows = [(i, t, ["en", None, "de", "é", "EN"][i * i % 5], None if i % 9 == 0 else f"s{i % 3}", None if i % 7 == 0 else i, "clash", "t", "i", "w", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[5], None, None, None, *["c"] * 4, 2), (None, None, None, None, None, *["c"] * 4, 2), (4, "another text", "en", None, None, *["c"] * 4, 2), (500, "alone", "xx", None, None, *["c"] * 4, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def climb(nodes, at, fanout):
    """(root, siblings before and after the node `at` on each level)."""
    path = []
    while len(nodes) > 1:
        lo = at // fanout * fanout
        run = nodes[lo : lo + fanout]
        path.append((run[: at - lo], run[at - lo + 1 :]))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return nodes[0], path


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(docs, none, fanout):
    rows = corpus()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in groups[k]], 0, fanout)[0] for k in langs]
    want = collections.Counter()
    for k, lang in enumerate(langs):
        nodes = [x[2] for x in groups[lang]]
        for i, (_, _, own, r) in enumerate(groups[lang]):
            path = climb(nodes, i, fanout)[1] + climb(subroots, k, fanout)[1]
            root = climb(subroots, k, fanout)[0]
            node = leaf(r, lowered(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None else own
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            want[(r[0], own, subroots[k], root, sha("".join("".join(b + a) for b, a in path)), node, node == root)] += 1
    got = collections.Counter(map(tuple, merkle.digest(docs, fanout).collect()))
    assert got == want and any(not k[-1] for k in want) and any(k[-1] for k in want)
    assert merkle.digest(none, fanout).count() == 0


def test_binary_siblings_are_xor(docs):
    plan = merkle.levels(docs.selectExpr("1L as tree", "doc_id as idx", "100L as n", "X'00' as h").where("doc_id < 100"), 1, 2, merkle.Scratch(docs.sparkSession), "t")[0]
    assert all((r.before == b"") == (r.idx % 2 == 0) and (r.after == b"") == (r.idx % 2 == 1) for r in plan.collect())


def brute_variants(rows):
    seen = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        close = sorted((-k, v) for v, k in words.items() if near(w, v))
        form[w] = close[0][1] if close and -close[0][0] >= 10 * n else None
        out[w] = [n, len(close)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], words[form[w]] if form[w] else None)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("cell, sample", [(2048, 100_000), (4, 100_000), (8, 12)])
def test_variants(docs, none, cell, sample):
    want = brute_variants(corpus())
    got = spelling.variants(docs, cell=cell, sample=sample).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert any(r[1] for r in want) and max(r[4] for r in want) > 3
    assert spelling.variants(none).count() == 0


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["abcdefgh"] * 500 + ["abcdefghi"] * 40 + ["abcdefghij"] * 3)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, root string")).collect()}
    chain = brute_variants([(1, text)])
    assert sorted(tuple(got[w][k] for k in ("word", "form", "root", "n", "n_near", "form_n")) for w in got) == sorted(chain)


def test_trees_reach_every_near_box():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (600, spelling.DIMS)) * (rng.random((600, spelling.DIMS)) < 0.06)
    tree = spelling.Tree(points.astype(np.int32), 10)
    place = tree.place(points)
    assert all((place[m] == k).all() for k, m in enumerate(tree.members)) and sum(map(len, tree.members)) == 600
    for more, less in ((1, 1), (1, 0)):
        reached = {(leaf, q) for leaf, rows in tree.reach(points, more, less) for q in rows.tolist()}
        up, down = (np.maximum(s * (points[None] - points[:, None]), 0).sum(2) for s in (1, -1))
        for q, p in zip(*np.nonzero((up <= more) & (down <= less))):
            assert (place[p], q) in reached
        assert len(reached) < 600 * len(tree.members) / 2  # boxes are pruned


def test_same_letters_fall_into_blocks(spark):
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(3000)} | {"abcdefgg", "bbcdefgh"}
    rows = [(0, " ".join(sorted(words) * 2))]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), cell=64).select("word", "form", "root", "n", "n_near", "form_n")
    near = {r.word: r.n_near for r in got.collect()}
    assert near["abcdefgg"] == sum(sum(x != y for x, y in zip(w, "abcdefgg")) == 1 for w in near if len(w) == 8) + sum(len(w) == 7 and any("abcdefgg"[:i] + "abcdefgg"[i + 1 :] == w for i in range(8)) for w in near)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def table():
    return pieces.Pieces(pieces.load(P.path("piece_bpe_32k.model")))


def texts(table):
    rng = random.Random(3)
    some = ["a", "b", " ", "  ", "▁", "é", "日", "語", "\n", "\t", "😀", "ing", "the", "A", "0", "́", "\x00", "zz", "aaa", "①", "<s>", "=", "----", "\\", "    ", "</s>", "<0x41>"]
    out = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += [c for c in map(chr, (rng.randint(1, 0x10FFFF) for _ in range(500))) if not "\ud800" <= c <= "\udfff"]
    out += ["".join(rng.choice("abcdefghij") for _ in range(3000)) for _ in range(3)] + ["a" * 5000, " " * 777, "=" * 3001, None, ""]
    known = [p.replace("▁", " ") for p in pieces.load(P.path("piece_bpe_32k.model"))["pieces"]]
    out += ["".join(rng.choice(known) for _ in range(40)) for _ in range(500)]
    return out + [" " * k + "x" for k in range(40)]


def test_encoding_is_the_library_s(library, table, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 20_000)  # words are forgotten on the way
    every = texts(table)
    for lo in range(0, len(every), 250):
        part = every[lo : lo + 250]
        ids, n = table.encode(part)
        want = library.encode([t or "" for t in part], add_eos=True)
        assert np.split(ids, np.cumsum(n)[:-1]) is not None and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
        assert table.decode(ids, n) == [library.decode(w) for w in want]


def test_decoding_of_any_ids_is_the_library_s(library, table):
    rng = random.Random(4)
    runs = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(0, 262) for _ in range(rng.randint(0, 30))] for _ in range(2000)]
    assert table.decode(np.array([i for r in runs for i in r]), np.array([len(r) for r in runs])) == [library.decode(r) for r in runs]


def test_pieces_digest(docs, none, library):
    path = P.path("piece_bpe_32k.model")
    want = collections.Counter()
    for r in corpus():
        ids = library.encode(r[1] or "", add_eos=True)
        want[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert collections.Counter(map(tuple, pieces.digest(docs, path).collect())) == want
    assert pieces.digest(none, path).count() == 0
    coder = pieces.Coder(docs.sparkSession, path)
    back = docs.sparkSession.createDataFrame([(None,), ([],), ([1, 5, 2],)], "ids array<int>").select(coder.decode(F.col("ids")).alias("t")).collect()
    assert [r.t for r in back] == ["", "", library.decode([1, 5, 2])]


def test_a_text_is_encoded_once(docs):
    plan = pieces.digest(docs, P.path("piece_bpe_32k.model"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(set(re.findall(r"pythonUDF\d+#\d+", plan.split("ArrowEvalPython")[1].splitlines()[0]))) == 1, plan


@pytest.mark.parametrize("run, sql", [(merkle.digest, merkle.ORACLE_SQL), (spelling.variants, spelling.ORACLE_SQL)])
def test_given_documents(spark, run, sql):
    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{path}'")
    want = c.sql(sql)
    got = run(spark.read.parquet(path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
