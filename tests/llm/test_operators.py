"""Each training-data operator against brute force on small tables with the awkward cases in them."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftframe.llm import common, decontaminate, hilbert, langid, linededup, mixing, neardup, pii, quality, repeats, shingles, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size int, shard string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Nulls, empty and long texts, exact and near copies, equal lines, repeated rows, clashing columns."""
    rng = random.Random(5)
    texts = [sentence(rng, 30 + 5 * i) + "\n" + sentence(rng, 12) for i in range(24)]
    long = sentence(rng, 9000)
    texts += [None, "", "   \t\n", "x", texts[0], texts[0].upper(), texts[3], texts[5].replace("alpha", "alphas", 1), long, texts[9][:300] + long[2000:3000] + texts[9][300:], "é" * 900, "Be " * 400]
    texts += ["same line here, quite long\n" + t.split("\n")[0][:40] for t in texts[:4]] + ["same line here, quite lonG\nshort", "same line here, quite  long", "samme line here, quite long"]
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 11 == 0 else f"s{i % 4}", None, "clash", 7, "y") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def fingerprint(spark, text):
    """By the contract, a bit and a shingle at a time, with Spark's own hash."""
    if not hasattr(fingerprint, "known"):
        fingerprint.known = {}
    if text not in fingerprint.known:
        words = [w for w in re.split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for h in (xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams):
            for bit in range(64):
                ones[bit] += h >> bit & 1
        if grams:
            first = spark.range(1).select(F.xxhash64(F.lit(grams[0]))).first()[0]
            assert first % (1 << 64) == xxhash.xxh64(grams[0].encode(), seed=42).intdigest()
        fingerprint.known[text] = f"{sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)):016x}"
    return fingerprint.known[text]


def test_simhash(spark, docs, none):
    for full in (simhash.FULL_BUCKET, 1):
        got = simhash.near_duplicates(docs, full=full).collect()
        assert len(got) == len(corpus())
        want = collections.Counter((r[0], fingerprint(spark, r[1])) for r in corpus())
        assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
        prints = np.array([int(r.fingerprint, 16) for r in got], np.uint64)
        near = np.bitwise_count(prints[:, None] ^ prints) <= 2
        ids = np.array([np.inf if r.doc_id is None else r.doc_id for r in got])
        label = ids.copy()
        for _ in got:
            label = np.where(near, label, np.inf).min(axis=1)
        assert [None if np.isinf(x) else int(x) for x in label] == [r.component_id for r in got]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 1


def test_five_word_copies(spark, none):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]

    def edited(text, n):
        w = text.split()
        for at in rng.sample(range(len(w)), n):
            w[at] = rng.choice(words)
        return " ".join(w)

    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    texts += [edited(t, n) for t in texts[:6] for n in (1, 2, 3, 4, 5, 6, 20)]
    texts += [edited(texts[7], 1 + i % 4) for i in range(60)]  # more than one hub settles
    for _ in range(12):  # a chain: each step one word, its ends far apart
        texts.append(edited(texts[-1] if _ else texts[8], 2))
    texts += [None, "", "a b", "A  b", "a b c"]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set()

    sets = [grams(t) for t in texts]
    link = np.array([[a == b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    first = np.arange(len(texts))
    for _ in texts:
        first = np.where(link, first, len(texts)).min(axis=1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(first.tolist()))
    assert simhash.keep_first(none).count() == 0


def test_rows_of_equal_or_no_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c), (None, a)]
    want = [(None, c), (1, a), (1, b)]
    for docs in (rows, rows[::-1]):
        got = simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    upper = [(1, a.upper()), (1, a)]  # one shingle set, one id: the same text stays whatever the order
    kept = {simhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).first().text for docs in (upper, upper[::-1])}
    assert len(kept) == 1


def test_golay_keys():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 500)
    for bits in ((), (3,), (3, 17)):
        w = v ^ sum(1 << b for b in bits)
        assert all(np.intersect1d(a, b).size for a, b in zip(simhash.codewords(v), simhash.codewords(w)))
    assert all(np.unique(k).size in (1, 6) for k in simhash.codewords(v))


def test_repeats(docs, none):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    seen = collections.Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    want = collections.Counter()
    for d, t in rows:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                covered[i] += 1
                covered[i + 400] -= 1
        covered = np.cumsum(covered)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        want[(d, len(t), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest())] += 1
    for group in (repeats.GROUP, 1):
        assert collections.Counter(tuple(r)[:5] for r in repeats.repeats(docs, group=group).collect()) == want
    assert repeats.repeats(none).count() == 0


def test_merge_order(monkeypatch):
    rng = np.random.default_rng(1)

    def wrong(block, sym, order, lcp):
        keys = [(block[i], sym[i].tobytes()) for i in order]
        if keys != sorted(keys) or sorted(order) != list(range(len(block))):
            return True
        for k in range(1, len(order)):
            same = sym[order[k]] == sym[order[k - 1]]
            if lcp[k] != (-1 if block[order[k]] != block[order[k - 1]] else len(same) if same.all() else int(np.argmin(same))):
                return True
        return False

    for columns, letters in ((12, 2), (63, 3), (7, 2), (63, 1)):
        sym, block = rng.integers(97, 97 + letters, (400, columns)).astype(np.uint8), np.sort(rng.integers(0, 5, 400))
        for shard in (32, 1000):
            assert not wrong(block, sym, *repeats.merge_order(block, sym, shard=shard))
    sym = rng.integers(97, 99, (400, 12)).astype(np.uint8)
    true = repeats.transform

    def broken(strings):
        which, before = true(strings)
        return which[::-1], before

    def dull(strings):
        which, before = true(strings)
        return which, before[::-1]

    for bad in (broken, dull):  # the order comes from the shards' transforms alone
        monkeypatch.setattr(repeats, "transform", bad)
        assert wrong(block, sym, *repeats.merge_order(block, sym, shard=32))


def test_lines(spark, docs, none):
    def within_one(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]

    rows = sorted([(10**9 if r[0] is None else r[0], r[1]) for r in corpus()], key=lambda r: r[0])
    want, before = collections.Counter(), []
    for d, text in rows:
        stay = []
        for raw in [] if text is None else text.split("\n"):
            x = raw.strip(" ")
            if len(x) < 20 or not any(within_one(x, y) for y in before):
                stay.append(raw)
            before.append(x)
        n = 0 if text is None else text.count("\n") + 1
        want[(None if d == 10**9 else d, n, len(stay), None if text is None else "\n".join(stay))] += 1
    got = linededup.dedup_lines(docs).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert any(r.n_kept < r.n_lines for r in got) and linededup.dedup_lines(none).count() == 0
    a, b, c = (f"this is a rather long line of {k * 9}" for k in "abc")
    mine = spark.createDataFrame([(1, a), (5, a), (5, c), (None, a), (None, b), (None, b), ((1 << 63) - 1, b)], "doc_id long, text string")
    left = collections.Counter((r.doc_id, r.kept) for r in linededup.dedup_lines(mine).collect())
    assert left == collections.Counter([(1, a), (5, ""), (5, c), (None, ""), (None, ""), (None, ""), ((1 << 63) - 1, b)])


def test_contamination(spark, docs, none):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) for n in (12, 30, 120)]
    bench = spark.createDataFrame([*enumerate(items), (3, None), (4, "tiny"), (5, items[0])], "item_id long, text string")
    edited = items[1][:50] + "#" + items[1][52:90] + "xy" + items[1][90:]
    far = "".join(c if i % 5 else "#" for i, c in enumerate(items[1]))
    texts = ["zz " + items[0].upper() + " q", "k" * 2000 + edited, far, items[2][:200], None, "", "plain words " * 50, "a" + items[2] + "b"]
    mine = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in decontaminate.contaminated(mine, bench).collect()}
    assert set(got) == {(0, 0), (0, 5), (1, 1), (7, 2)}
    assert got[0, 0] == (3, 3 + len(items[0]), 0) and got[1, 1] == (2000, 2000 + len(edited), 4)
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() and decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.contaminated(mine, bench.limit(0)).count() == 0


def fewest_edits(p, t):
    """Of p against any part of t, by the full table."""
    d = np.zeros(len(t) + 1, int)
    for i, c in enumerate(p, 1):
        new = np.empty_like(d)
        new[0] = i
        for j in range(1, len(t) + 1):
            new[j] = min(d[j - 1] + (c != t[j - 1]), d[j] + 1, new[j - 1] + 1)
        d = new
    return int(d.min())


def test_contamination_against_full_alignment():
    rng = random.Random(21)
    items = [(k, "".join(rng.choice("abcde ") for _ in range(n))) for k, n in enumerate((8, 12, 16, 30, 45, 60, 90))]
    index = decontaminate.Index(items)
    texts = []
    for _ in range(60):
        k, text = rng.choice(items)
        text = list(text)
        for _ in range(rng.randrange(0, len(text) // 6 + 2)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [rng.choice("abcde ")], [text[at], rng.choice("abcde ")]])
        texts.append("".join(rng.choice("abcde ") for _ in range(rng.randrange(60))) + "".join(text) + "".join(rng.choice("abcde ") for _ in range(rng.randrange(60))))
    budget = {k: min(len(p) // 10, (len(p) - 8) // 8) for k, p in items}
    hit = 0
    for text, got in zip(texts, decontaminate.find(texts, index)):
        best = {k: fewest_edits(p, text) for k, p in items}
        want = {k for k, e in best.items() if e <= budget[k]}
        assert {r["item_id"] for r in got} == want
        for r in got:
            assert best[r["item_id"]] <= r["edits"] <= budget[r["item_id"]] and fewest_edits(dict(items)[r["item_id"]], text[r["start"] : r["end"]]) <= r["edits"]
        hit += len(want)
    assert hit >= 25
    twice = items[5][1] + "x" * 50 + items[5][1]
    assert [(r["start"], r["end"]) for r in decontaminate.find([twice], index)[0] if r["item_id"] == 5] == [(0, 60), (110, 170)]


def test_one_character_over_and_over():
    index = decontaminate.Index([(0, "=" * 400), (1, "plain words of an item that is here")])
    import tracemalloc

    tracemalloc.start()
    got = decontaminate.find(["=" * 60_000 + "plain words of an item that is here"], index)[0]
    assert {r["item_id"] for r in got} == {0, 1} and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_benchmark_in_parts(spark, docs):
    rng = random.Random(4)
    items = [(k, sentence(rng, 20)) for k in range(12)]
    mine = spark.createDataFrame([(k, "z " * 30 + items[k][1]) for k in range(0, 12, 2)] + [(99, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(mine, bench, chars=300).collect()}
    assert got == {(k, k) for k in range(0, 12, 2)}
    assert [r.doc_id for r in decontaminate.decontaminate(mine.where("doc_id < 99").union(mine.limit(0)).unionByName(docs.select("doc_id", "text").where("doc_id = 3")), bench, chars=300).collect()] == [3]


def test_align():
    rng = np.random.default_rng(2)
    for _ in range(50):
        p, w = rng.integers(0, 3, 8), rng.integers(0, 3, (1, 14))
        # the table of the band's diagonals only
        width, d = 14 - 8 + 1, {(0, j): 0 for j in range(7)}
        for i in range(1, 9):
            for k in range(width):
                j = i + k
                d[i, j] = min(d[i - 1, j - 1] + (p[i - 1] != w[0, j - 1]) if (i - 1, j - 1) in d else 99, d.get((i - 1, j), 99) + 1, d.get((i, j - 1), 99) + 1)
        assert decontaminate.align(p, w)[0][0] == min(d[8, 8 + k] for k in range(width))


def permuted(block, at, many, seed=0):
    if block >= many:
        return block
    x = block
    for r in range(1, mixing.ROUNDS + 1):
        key = int(hashlib.md5(f"{seed}:{at}:{r}".encode()).hexdigest()[:12], 16) % many
        other = (key - x) % many
        x = other if hashlib.md5(f"{seed}:{at}:{r}:{max(x, other)}".encode()).hexdigest()[0] >= "8" else x
    return x


def test_permutation():
    for many in (1, 2, 7, 100):
        assert sorted(permuted(b, 3, many) for b in range(many)) == list(range(many))


def test_mixing(spark, docs, none):
    mixed = mixing.mix(docs, block=64).collect()
    assert len(mixed) == len(corpus())
    slim = collections.Counter((r.doc_id, r.source, r.taken, str(r.pieces)) for r in mixing.mix(docs, block=64, carry=False).collect())
    assert slim == collections.Counter((r.doc_id, r.source, r.taken, str(r.pieces)) for r in mixed)
    total = sum(r.size for r in mixed)
    by = collections.defaultdict(list)
    for r in mixed:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and sum(p.words for p in r.pieces) == r.taken
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size and sum(r.taken for r in rows) == int(rows[0].target + 0.5)
        assert rows[0].target <= 2 * rows[0].source_size + 1e-9
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6
    # the shards' quotas of the tree and the permutation of the blocks, worked out again
    names = sorted(by, key=lambda s: (s is None, s or ""))
    told = {}
    for at, s in enumerate(names):
        words = int(by[s][0].target + 0.5)
        told[s] = at, max(1, min(64, words // mixing.LEAST_BLOCKS)), words
    blocks = spark.createDataFrame([(at, -(-words // length)) for at, length, words in told.values()], "at long, blocks long")
    upto = {r["at"]: r.upto for r in mixing.quotas(blocks).collect()}
    seen = collections.Counter()
    for r in mixed:
        at, length, words = told[r.source]
        many, blocks = 2 * r.source_size // length, -(-words // length)
        for p in r.pieces:
            rank, first = permuted(p.block, at, many), [0, *upto[at]]
            begin = first[p.shard] * max(many, blocks) // blocks
            assert 0 <= rank - begin < first[p.shard + 1] - first[p.shard]
            seen[at, p.block, first[p.shard] + rank - begin] += p.words
    for (at, block, draw), n in seen.items():
        _, length, words = next(t for t in told.values() if t[0] == at)
        assert n == (words - draw * length if draw == -(-words // length) - 1 else length)
    for at, length, words in told.values():
        assert sorted(d for a, _, d in seen if a == at) == list(range(-(-words // length)))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in mixing.mix(docs).collect())
    whole = {r[1] for r in corpus()}
    assert any(r.text in whole for r in out.collect())


def test_quotas(spark):
    sources = spark.createDataFrame([(0, 1000), (1, 10), (2, 0), (3, 7)], "at long, blocks long")
    got = {r["at"]: r.upto for r in mixing.quotas(sources, 8).collect()}
    assert [got[i][-1] for i in range(4)] == [1000, 10, 0, 7] and all(a <= b for u in got.values() for a, b in zip(u, u[1:]))
    each = np.diff(np.array([[0, *got[i]] for i in range(4)]), axis=1).sum(axis=0)
    assert each.max() - each.min() <= 3
    # over many seeds the first half's draw of a source is hypergeometric
    pair = spark.createDataFrame([(0, 30), (1, 50)], "at long, blocks long")
    first = mixing.quotas(pair, 2, 0).where("at = 0")
    for seed in range(1, 60):
        first = first.union(mixing.quotas(pair, 2, seed).where("at = 0"))
    x = np.array([r.upto[0] for r in first.collect()])
    mean, var = 40 * 30 / 80, 40 * 30 / 80 * (50 / 80) * (40 / 79)
    assert abs(x.mean() - mean) < 4 * np.sqrt(var / len(x)) and 0.5 * var < x.var() < 1.7 * var


def test_quotas_of_many_sources(spark):
    sources = spark.range(3000).select(F.col("id").alias("at"), (F.col("id") % 7).alias("blocks"))
    got = {r["at"]: r.upto for r in mixing.quotas(sources).collect()}
    assert len(got) == 3000 and all(got[i][-1] == i % 7 for i in got)
    each = np.diff(np.array([[0, *got[i]] for i in sorted(got)]), axis=1)
    assert each.min() >= 0 and np.ptp(each.sum(axis=0)) <= mixing.SHARDS


def test_quotas_decide_what_is_drawn(spark, docs, monkeypatch):
    before = collections.Counter((r.doc_id, r.taken) for r in mixing.mix(docs, block=64).collect())
    tree = mixing.quotas
    monkeypatch.setattr(mixing, "quotas", lambda sources, shards, seed: tree(sources, shards, seed + 1))
    assert before != collections.Counter((r.doc_id, r.taken) for r in mixing.mix(docs, block=64).collect())


def test_targets(spark):
    rows = [("a", 10), ("b", 1000), ("é", 500), (None, 3), ("c", 0), ("d", 70)]
    sizes = spark.createDataFrame(rows, "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, common.Scratch(spark)).collect()}
    weights = dict(zip(["a", "b", "c", "d", "é", None], [5, 2, 1, 5, 2, 1]))
    low, high = 0.0, 1e6
    for _ in range(200):  # the common factor by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * n, weights[s] * mid) for s, n in rows) < 1.5 * 1583 else (low, mid)
    assert got == {s: pytest.approx(min(2 * n, weights[s] * low)) for s, n in rows}
    assert mixing.targets(sizes.limit(0), common.Scratch(spark)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in base[i]], i % 2) for i in range(60)]
    rows += [(100 + i, [float(x) for x in base[0] + 0.05 * rng.standard_normal(16)], 0) for i in range(300)]
    rows += [(500, rows[3][1], 1), (501, [2 * x for x in rows[3][1]], 1), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, rows[3][1], None), rows[7], (506, [1.0, 2.0], 1)]
    got = neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) == 16 and np.isfinite(r[1]).all() and np.any(r[1])]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in ok])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.array([r[0] for r in ok])
    for _ in range(6):
        comp = np.minimum(comp, np.where(link, comp, 10**9).min(axis=1))
    want = collections.Counter((r[0], int(n), int(c), r[0] == c) for r, n, c in zip(ok, link.sum(axis=1), comp))
    want.update((i, 0, i, True) for i in (502, 503, 504, 505, 506))
    assert collections.Counter(tuple(r)[:4] for r in got) == want and got[0].audited >= 0.95
    assert neardup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_audit_sees_lost_pairs(spark):
    """A large group with all its links does not hide lost pairs."""
    rows = [(i, 1, 1, [1.0, 0.001 * i]) for i in range(50)] + [(100 + i, 2, 1, [float(j == i // 2) for j in range(20)]) for i in range(40)]
    nodes = spark.createDataFrame([(n, b, c, [float(y) for y in np.array(v) / np.linalg.norm(v)]) for n, b, c, v in rows], "node long, block long, copies long, v array<double>")
    groups = spark.createDataFrame([(i, 0) for i in range(50)], "node long, component long")
    links = spark.createDataFrame([(i, 49) for i in range(50)], "node long, links long")
    assert neardup.audit(nodes, links, groups, 0.98) == {"large": 1.0, "single": 0.0}


def test_lone_pairs_beside_a_dense_cloud(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one, off = unit(rng.standard_normal((2000, 64))), rng.standard_normal((2000, 64))
    off = unit(off - (off * one).sum(axis=1, keepdims=True) * one)
    two = 0.985 * one + np.sqrt(1 - 0.985**2) * off
    cloud = unit(unit(rng.standard_normal((1, 64))) + 0.01 * rng.standard_normal((600, 64)))
    x = np.concatenate([one, two, cloud])
    got = neardup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    true = (unit(x) @ unit(x).T >= 0.98).sum(axis=1) - 1
    assert (got.n_links.to_numpy()[:4000] == true[:4000]).mean() >= 0.99 and (got.n_links.to_numpy()[4000:] == true[4000:]).all()
    assert (got.n_links.to_numpy() <= true).all()


def test_personal_data(spark, docs, none):
    texts = [None, "", "mail a.b@c.example.com now", "ip 10.0.0.256 and 10.0.0.25.", "card 4111 1111 1111 1111 or 4111111111111112", "+1 (555) 123-4567 x", 'token = "b55e8abc1054b786f6b76df9eb5b259bbcc4c9e2" é', "é +49 30 1234567"]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for _, r in sorted(got.items())] == [(0, 0, 0, 0)] * 2 + [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 1)]
    assert got[7].base_sha256 == hashlib.sha256(b"phone:2:16").hexdigest() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6].spans == "secret:9:49" and pii.personal_data(none).count() == 0 and pii.personal_data(docs).count() == len(corpus())


def test_base_spans_against_patterns():
    rng = random.Random(17)
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    found = collections.Counter()
    for _ in range(6000):
        text = "".join(rng.choice(["@", ".", "-", "+", " ", "(", ")", "a", "é", "%", *"0123456789", "4111 1111 1111 1111", "10.0.0.1", "a.b@c.de"]) for _ in range(rng.randrange(40)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if valid(k, m.group()))
        assert pii.base_spans(text) == want, text
        found.update(k for _, k, _ in want)
    assert min(found[k] for k in range(4)) > 30


def test_candidates_of_a_long_text():
    import time

    text = "token=Zm9vYmFyMTIzNDU2Nzg5MA 555 123 4567 a@b.cd " * 4000
    began = time.time()
    got = pii._candidates(text, pii.base_spans(text))
    assert len(got) == 12000 and time.time() - began < 10
    spans = [(s, e) for s, _, e in got]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_sharding(docs, none):
    got = hilbert.digest(docs).collect()
    n = len(corpus())
    count = collections.Counter(r.shard for r in got)
    assert len(got) == n and max(count.values()) - min(count[s] for s in range(24)) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want and hilbert.digest(none).count() == 0
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    h = hilbert.hilbert(cells, 3)
    assert sorted(h) == list(range(512)) and np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(axis=1).max() == 1


def test_languages(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)
    odd = spark.createDataFrame([(0, None, "en"), (1, "", "en"), (2, "123 !", "de"), (3, "a", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.digest(odd).orderBy("doc_id").collect()][:3] == ["und"] * 3 and langid.digest(none).count() == 0
    assert langid.keep_known(odd).columns == odd.columns


def test_recurrent_gradient():
    rng = np.random.default_rng(6)
    net = langid.BiGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 101, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grad = net.gradient(x, y)
    for name, g in grad.items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g), axis=None)[:6]]:
            own, ends = net.p[name][at], []
            for step in (1e-2, -1e-2):
                net.p[name][at] = own + step
                ends.append(net.gradient(x, y)[0])
            net.p[name][at] = own
            assert abs((ends[0] - ends[1]) / 2e-2 - g[at]) < 2e-3 * max(0.05, abs(g[at]))


def test_many_languages_and_cuts():
    letters = [chr(0x100 + k).encode() for k in range(300)]
    net = langid.BiGru([f"l{k}" for k in range(300)], hidden=2)
    seen = []
    true = net.gradient
    net.gradient = lambda x, y: (seen.extend(y.tolist()), true(x, y))[1]
    net.train([c * 3 for c in letters], np.arange(300), steps=3)
    assert set(seen) == set(range(300))
    net = langid.BiGru(["a", "b"])
    assert [r[0] for r in net.predict(["one text alone"])] != [langid.UNKNOWN] and net.predict([None]) == [(langid.UNKNOWN, 0.0)]
    word = b"some words of a text "
    full = net._forward(np.frombuffer(word * 40, np.uint8)[:, None], 0)[0][1:], net._forward(np.frombuffer(word * 40, np.uint8)[::-1][:, None], 1)[0][1:][::-1]
    z = np.concatenate(full, axis=2) @ net.p["w"] + net.p["b"]
    p = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True)
    got = net.probabilities([b"x", word * 40, b"", b"y" * 300])
    assert np.allclose(got[1], p.mean(axis=(0, 1)), atol=1e-4) and not got[2].any()
    assert np.allclose(net.probabilities([word * 40])[0], got[1], atol=1e-6)


def test_line_field_gradient():
    rng = np.random.default_rng(7)
    texts, labels = [b"One line.\n\n!!! $$$\nmore words here", b"x", b"A b c.\nA b c."], np.array([1, 0, 1])
    feats, _, counts = quality.describe(texts)
    first, last = quality.LineField._edges(counts)
    f = quality.LineField()
    f.w, f.turn, f.bias = rng.standard_normal(f.w.shape) * 0.1, rng.standard_normal((2, 2)), 0.2

    def likelihood():
        emit, at, out = f._emissions(feats, first, last), 0, 0.0
        for n, y in zip(counts, labels):
            total = sum(np.exp(sum(emit[at + i] * (c >> i & 1) for i in range(n)) + sum(f.turn[c >> i & 1, c >> (i + 1) & 1] for i in range(n - 1))) for c in range(1 << n))
            out += y * emit[at : at + n].sum() + (n - 1) * f.turn[y, y] - np.log(total)
            at += n
        return out

    p, pairs = f._marginals(f._emissions(feats, first, last), counts)
    d = np.repeat(labels, counts) - p
    own = np.bincount(feats.ravel(), np.repeat(d, feats.shape[1]), quality.SIZE)
    for k in np.argsort(-np.abs(own))[:5]:
        ends = []
        for step in (1e-5, -1e-5):
            f.w[0, k] += step
            ends.append(likelihood())
            f.w[0, k] -= step
        assert abs((ends[0] - ends[1]) / 2e-5 - own[k]) < 1e-5
    true = np.zeros((2, 2))
    np.add.at(true, (labels, labels), counts - 1)
    for a in range(2):
        for b in range(2):
            ends = []
            for step in (1e-5, -1e-5):
                f.turn[a, b] += step
                ends.append(likelihood())
                f.turn[a, b] -= step
            assert abs((ends[0] - ends[1]) / 2e-5 - (true - pairs)[a, b]) < 1e-5


def test_quality(spark, docs, none):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.digest(d, y).join(y, "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in got) > 0.9 * len(got)
    assert quality.digest(docs, y).where("score between 0 and 1").count() == len(corpus()) and quality.digest(none, y).count() == 0


def test_line_field_marginals():
    rng = np.random.default_rng(4)
    f = quality.LineField()
    f.turn = rng.standard_normal((2, 2))
    emit, counts = rng.standard_normal(7), np.array([3, 1, 3])
    p, _ = f._marginals(emit, counts)
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            lab = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(emit[at + i] * x for i, x in enumerate(lab)) + sum(f.turn[a, b] for a, b in zip(lab, lab[1:])))
            total += w
            good += w * np.array(lab)
        assert np.allclose(p[at : at + n], good / total)
        at += n


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, "/root/testdata/sf0.001")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 100


def test_pipeline_stages_on_awkward_rows(spark, docs, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(3).collect()]
    rows = [*corpus(), *[(500 + i, "some words before it " + t + " and after", "en", "s1", None, "clash", 7, "y") for i, t in enumerate(bench)]]
    mine = spark.createDataFrame(rows, DOCS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got, empty = stage(spark, mine, sf), stage(spark, none, sf)
        assert empty.count() == 0 and empty.columns == got.columns
        out = got.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == mine.columns
        texts = collections.Counter(r.text for r in out)
        if name == "near-dedup":
            assert texts[corpus()[0][1]] == 1 and texts[corpus()[12][1]] == 1
        elif name == "decontamination":
            assert sorted(map(str, out)) == sorted(str(r) for r in mine.where("doc_id < 500 or doc_id is null").collect())
        elif name == "sharding":
            assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out if r.doc_id) == sorted((r[0] is None, r[0], r[1]) for r in rows if r[0])
            assert len(out) == len(rows) and len({(r.shard, r.slot) for r in out}) == len(rows)


def test_scratch_without_a_folder():
    from types import SimpleNamespace

    from driftframe.llm import common

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: folder or other), sparkContext=SimpleNamespace(master=master, applicationId="one"))

    assert common.scratch_dir(session("local[2]")) == common.scratch_dir(session("local[2]"))
    assert common.scratch_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        common.scratch_dir(session("spark://host:7077"))


@pytest.mark.parametrize("weight, texts", [(shingles.WEIGHT, shingles.TEXTS), (600, 4)])
def test_shingle_survivors_around_the_bound(spark, monkeypatch, weight, texts):
    """One row of each component of links at 0.8 stays, with one block for a bucket and with many."""
    monkeypatch.setattr(shingles, "WEIGHT", weight)
    monkeypatch.setattr(shingles, "TEXTS", texts)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):  # a family: zero to five words changed, so links lie on both sides of the bound
        own = list(base)
        for at in rng.sample(range(150), i % 6):
            own[at] = f"v{rng.randrange(1000)}"
        rows.append(" ".join(own))
    rows += [" ".join(f"u{rng.randrange(400)}" for _ in range(60)) for _ in range(8)] + [rows[0], None, ""]
    sets = [shingles.shingles(t) for t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not len(sets[i]) and not len(sets[j])) or shingles.similarity(sets[i], sets[j]) >= shingles.SIMILAR:
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    got = shingles.keep_first(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(top))
