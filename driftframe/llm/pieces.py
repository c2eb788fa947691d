"""SentencePiece byte-pair encoding and decoding in numpy, many words at a time.

All different words of a batch lie in one flat array of symbols. A round looks at every pair of
neighbours, takes each word's least pair rank (a segmented minimum), merges all its pairs of that
rank at once, the leftmost first where they overlap, and drops what was merged and the words that
are done. Text is cut into words only where no piece of the vocabulary can reach across: between two
code points that are neighbours in no piece.
"""

from __future__ import annotations

import codecs
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Code points of texts that are encoded together, and of words that a task remembers.
BLOCK, REMEMBER = 1 << 20, 1 << 22

codecs.register_error("pieces", lambda e: ("�", e.start + 1))


def load(path: str) -> dict:
    """Pieces, scores and kinds of a model file, as the library reads them; the model itself stays on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece" for i in n]
    if kinds.count("byte") != 256 or any(model.is_unused(i) for i in n):
        raise ValueError(f"{path}: only models with all byte pieces and without unused ones")
    if model.encode("a  b ", out_type=str)[0][:1] != SPACE or model.decode(model.encode("ﬁ ①  x ")) != "ﬁ ①  x ":
        raise ValueError(f"{path}: only models that put a space before the text and change nothing else")
    return {"pieces": [model.id_to_piece(i) for i in n], "scores": [model.get_score(i) for i in n], "kinds": kinds, "end": model.eos_id()}


class Pieces:
    """The tables of a vocabulary, and encoding and decoding with them."""

    def __init__(self, vocabulary: dict):
        pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.end, self.size = vocabulary["end"], len(pieces)
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == "piece"}
        # symbols: pieces by id, then code points that only come inside pieces, then all others
        symbol = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbol[c] = self.size + len(symbol) - len(ids)
        self.symbols = self.size + len(symbol) - len(ids) + 1
        singles = np.array(sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1), np.int64).reshape(-1, 2)
        self.points, self.of_point = singles[:, 0], singles[:, 1].astype(np.int32)
        rank = {s: k for k, s in enumerate(sorted({vocabulary["scores"][i] for i in ids.values()}, reverse=True))}
        ranks = {p: rank[vocabulary["scores"][i]] for p, i in ids.items()}
        pairs, self.early = [], np.zeros(len(rank) + 1, bool)
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbol and b in symbol:
                    pairs.append((symbol[a] * self.symbols + symbol[b], ranks[p], i))
                    for part in (a, b):  # its merge may make a pair that comes before its equals
                        if part in ranks and len(part) > 1 and ranks[p] <= ranks[part]:
                            self.early[ranks[part]] = True
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.rank, self.made = table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.joined = np.unique(np.array([ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])], np.int64))
        several = [p for p in ids if len(p) > 1]
        single = "".join(c for c in "\n\r\t" if not any(c in p for p in several))
        cut = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.words = re.compile(f"[{single}]|{SPACE}*[^{SPACE}{single}]+|{SPACE}+" if cut and single else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cut else "(?s:.+)")
        byte = [i for i, k in enumerate(kinds) if k == "byte"]
        self.byte = np.array([i for _, i in sorted((int(pieces[i][3:5], 16), i) for i in byte)], np.int32)
        text = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "piece" else " ⁇ ".encode() if k == "unknown" else b"" for p, k in zip(pieces, kinds)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.spaced = np.array([k == "piece" and p.startswith(SPACE) for p, k in zip(pieces, kinds)], bool)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.size_of, self.ids = 0, np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbouring symbols; NEVER where they make none."""
        key = a.astype(np.int64) * self.symbols + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER).astype(np.int32), self.made[at]

    def _in_turn(self, hit: np.ndarray, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which merges to do now: a word's up to the first one whose new pairs come before the rest of its rank."""
        left, right = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
        before = sym[left]
        beside = np.flatnonzero(hit[1:] - hit[:-1] == 2) + 1  # the symbol before is merged in this round
        before[beside] = made[hit[beside - 1]]
        own = made[hit]
        first = np.where((left < hit) & (seg[left] == seg[hit]), self._pairs(before, own)[0], NEVER)
        second = np.where((right == hit + 2) & (seg[right] == seg[hit]), self._pairs(own, sym[right])[0], NEVER)
        stops = np.minimum(first, second) <= rank[hit]
        passed = np.cumsum(stops) - stops  # stops before each merge
        lead = np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])
        return passed == np.maximum.accumulate(np.where(lead, passed, 0))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty) below each other, and how many each word has."""
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), size)
        at = np.minimum(np.searchsorted(self.points, cp), len(self.points) - 1)
        sym = np.where(self.points[at] == cp, self.of_point[at], self.symbols - 1).astype(np.int32)
        # segments: words, cut where two code points are neighbours in no piece
        first = np.ones(len(cp), bool)
        first[1:] = (of[1:] != of[:-1]) | ~np.isin(cp[:-1] << 21 | cp[1:], self.joined)
        seg, place = np.cumsum(first) - 1, np.arange(len(cp))
        rank, made = np.full(len(cp), NEVER, np.int32), np.zeros(len(cp), np.int32)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            length = np.diff(np.append(starts, len(seg)))
            least = np.minimum.reduceat(rank, starts)
            low = np.repeat(least, length)
            over = low == NEVER
            if over.any():
                done.append((place[over], sym[over]))
                sym, seg, place, rank, made, low = (x[~over] for x in (sym, seg, place, rank, made, low))
                if not len(sym):
                    break
            take = rank == low
            # of pairs that share a symbol every other one, from the left
            hit = np.flatnonzero(take)
            run = np.concatenate([[True], np.diff(hit) > 1])
            head = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            if self.early[rank[hit]].any():
                hit = hit[self._in_turn(hit, sym, seg, rank, made)]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.zeros(len(sym), bool)
            new[hit] = True
            sym, seg, place, rank, made, new = (x[keep] for x in (sym, seg, place, rank, made, new))
            # only pairs with a merged symbol change
            changed = np.flatnonzero(new | np.append(new[1:], False))
            same = changed + 1 < len(seg)
            same[same] = seg[changed[same]] == seg[changed[same] + 1]
            rank[changed[~same]] = NEVER
            inner = changed[same]
            rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        place = np.concatenate([p for p, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(place, kind="stable")
        place, sym = place[order], sym[order]
        # code points without a piece become the pieces of their bytes
        odd = np.flatnonzero(sym >= self.size)
        n = np.ones(len(sym), np.int64)
        raw = [chr(c).encode("utf-8", "replace") for c in cp[place[odd]]]
        n[odd] = [len(b) for b in raw]
        out = np.repeat(sym, n)
        if len(odd):
            start = (np.cumsum(n) - n)[odd]
            spots = np.repeat(start, n[odd]) + np.arange(n[odd].sum()) - np.repeat(np.cumsum(n[odd]) - n[odd], n[odd])
            out[spots] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(of[place], weights=n, minlength=len(words)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts below each other, the end id after each, and how many each has."""
        parts = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        different = set().union(*parts)
        if self.held > REMEMBER:
            self._forget()
        fresh = [w for w in different if w not in self.known]
        if fresh:
            ids, n = self.merge(fresh)
            base = len(self.size_of)
            self.known.update(zip(fresh, range(base, base + len(fresh))))
            self.size_of, self.ids = np.append(self.size_of, n), np.append(self.ids, ids)
            self.held += sum(map(len, fresh))
        count = np.array([len(p) for p in parts], np.int64)
        code = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(count.sum()))
        flat, per = gather(self.ids, np.cumsum(self.size_of) - self.size_of, self.size_of, code)
        size = np.bincount(np.repeat(np.arange(len(parts)), count), weights=per, minlength=len(parts)).astype(np.int64) + 1
        out = np.full(int(size.sum()), self.end, np.int32)
        last = np.zeros(len(out), bool)
        last[np.cumsum(size) - 1] = True
        out[~last] = flat
        return out, size

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """The text of each run of ids: no control pieces, bytes as UTF-8 (else U+FFFD each), without the space put first."""
        flat, per = gather(self.text, self.text_at, self.text_size, ids)
        text, bounds, starts = flat.tobytes(), np.append(0, np.cumsum(per)), np.append(0, np.cumsum(size))
        out = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            shown = np.flatnonzero(per[lo:hi])
            skip = len(shown) and self.spaced[ids[lo + shown[0]]]
            start = bounds[lo] + int(skip)
            cuts = [start, *bounds[lo + np.flatnonzero(per[lo:hi] == 0)], bounds[hi]]  # bytes join across no control piece
            out.append("".join(text[max(a, start) : b].decode("utf-8", "pieces") for a, b in zip(cuts, cuts[1:]) if a < b))
        return out


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[start : start + size] of `which`, below each other, and their sizes."""
    n = size[which]
    if not len(which):
        return values[:0], n
    at = np.repeat(start[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return values[at], n


def _blocks(sizes: list[int]):
    lo = held = 0
    for i, s in enumerate(sizes):
        held += s
        if held >= BLOCK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


class Coder:
    """Columns that encode and decode with one vocabulary, whose tables are broadcast (a model file's size)."""

    def __init__(self, spark: SparkSession, path: str):
        vocabulary = load(path)
        shared = spark.sparkContext.broadcast(Pieces(vocabulary))

        @F.arrow_udf("array<int>")
        def encode(text: pa.Array) -> pa.Array:
            texts = text.to_pylist()
            parts = [shared.value.encode(texts[lo:hi]) for lo, hi in _blocks([len(t or "") for t in texts])]
            ids = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int32)
            size = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids))

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(ids.offsets.to_numpy()) if not ids.null_count else np.array([len(x or []) for x in ids.to_pylist()], np.int64)
            ends = np.append(0, np.cumsum(size))
            out = []
            for lo, hi in _blocks(list(size)):
                out += shared.value.decode(flat[ends[lo] : ends[hi]], size[lo:hi])
            return pa.array(out, pa.string())

        @F.arrow_udf("struct<ids: array<int>, decoded: string>")
        def both(text: pa.Array) -> pa.Array:
            texts, flat, sizes, out = text.to_pylist(), [], [], []
            for lo, hi in _blocks([len(t or "") for t in texts]):
                ids, size = shared.value.encode(texts[lo:hi])
                out += shared.value.decode(ids, size)
                flat.append(ids)
                sizes.append(size)
            ends = np.append(0, np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat or [np.zeros(0, np.int32)])))
            return pa.StructArray.from_arrays([ids, pa.array(out, pa.string())], names=["ids", "decoded"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """array<int>: the ids of a text and the end id; a null text counts as empty."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids; null and empty arrays give an empty text. Ids out of the vocabulary are an error."""
        return self._decode(ids)

    def both(self, text: Column) -> Column:
        """(ids, decoded): `encode` and the `decode` of it, each run once; as columns of their own the encoding would run for each."""
        return self._both(text)


def digest(docs, path: str):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document's whole text.

    A null text counts as empty (the end id alone); only doc_id and text are looked at, so nulls
    elsewhere, repeated rows and other columns make no difference. An empty table gives no rows.
    """
    coder = Coder(docs.sparkSession, path)
    text = docs.select("doc_id", coder.both(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.decoded")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
