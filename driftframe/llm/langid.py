"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes that run through the network side by side, each after
the WARM bytes beside it, so that states do not start anew at a cut; every byte position gets
language probabilities, and a document's are their mean over all positions.
The network is trained in numpy by backpropagation through time on a bounded sample of labelled
documents; Spark maps it over whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

UNKNOWN = "und"
HIDDEN, SEGMENT, TRAIN_SEGMENT = 8, 256, 64
#: Bytes before (and, for the backward layer, behind) a segment that set its first state.
WARM = 32
#: A byte's place where there is none: it leaves the state as it is.
BLANK = 256
#: Labelled documents of each language that are learned from, at most; of all languages together, one each at least; and characters of each.
SAMPLE, TOTAL, CHARS = 200, 20_000, 1 << 16
STEPS, BATCH, RATE = 400, 256, 0.02
#: Label values whose counts are broadcast; with more they are joined by a shuffle.
LABELS = 1000
#: Segments that are run together.
BLOCK = 2048
#: A document whose best language is less probable than this is rejected.
LEAST = 0.35

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGru:
    """Two gated recurrent layers (forward, backward) under one softmax, in float32."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p = {k: (rng.standard_normal(s) * d).astype(np.float32) for k, s, d in (("e0", (256, 3 * hidden), 0.3), ("u0", (hidden, 3 * hidden), 0.3), ("e1", (256, 3 * hidden), 0.3), ("u1", (hidden, 3 * hidden), 0.3), ("w", (2 * hidden, len(langs)), 0.3))}
        self.p["b"] = np.zeros(len(langs), np.float32)

    def _forward(self, x: np.ndarray, d: int):
        """x: (steps, n) bytes. States (steps + 1, n, h) and what the way back needs."""
        e, u, k = self.p[f"e{d}"], self.p[f"u{d}"], self.h
        h = np.zeros((len(x) + 1, x.shape[1], k), np.float32)
        saved = []
        for t, row in enumerate(x):
            a, g = e[row], h[t] @ u
            rz = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
            r, z = rz[:, :k], rz[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            h[t + 1] = n + z * (h[t] - n)
            saved.append((r, z, n, g[:, 2 * k :]))
        return h, saved

    def _backward(self, x: np.ndarray, d: int, h: np.ndarray, saved: list, dout: np.ndarray) -> dict:
        u, k = self.p[f"u{d}"], self.h
        du, da = np.zeros_like(u), np.empty((*x.shape, 3 * k), np.float32)
        dh = np.zeros_like(h[0])
        for t in range(len(x) - 1, -1, -1):
            r, z, n, gn = saved[t]
            dh = dh + dout[t]
            dan = dh * (1 - z) * (1 - n * n)
            dg = np.concatenate([dan * gn * r * (1 - r), dh * (h[t] - n) * z * (1 - z), dan * r], axis=1)
            da[t] = dg
            da[t, :, 2 * k :] = dan
            du += h[t].T @ dg
            dh = dh * z + dg @ u.T
        flat, da = x.ravel(), da.reshape(-1, 3 * k)
        de = np.stack([np.bincount(flat, da[:, j], 256) for j in range(3 * k)], axis=1).astype(np.float32)
        return {f"e{d}": de, f"u{d}": du}

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions of x (steps, n) under the labels y (n), and its gradient."""
        hf, sf = self._forward(x, 0)
        hb, sb = self._forward(x[::-1], 1)
        both = np.concatenate([hf[1:], hb[1:][::-1]], axis=2)
        z = both @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        dz = z / z.sum(axis=2, keepdims=True)
        at = np.arange(len(y))
        loss = -float(np.log(np.maximum(dz[:, at, y], 1e-30)).mean())
        dz[:, at, y] -= 1
        dz /= dz.shape[0] * len(y)
        dboth = dz @ self.p["w"].T
        grad = {"w": np.tensordot(both, dz, ((0, 1), (0, 1))), "b": dz.sum(axis=(0, 1))}
        grad |= self._backward(x, 0, hf, sf, dboth[:, :, : self.h])
        grad |= self._backward(x[::-1], 1, hb, sb, dboth[::-1, :, self.h :])
        return loss, grad

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> None:
        """Adam on batches of random segments, languages in turn; every position bears its document's label.

        There are steps enough for each language to be seen 100 times.
        """
        steps = max(steps, -(-100 * len(self.langs) // batch))
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels) if y == k and t] for k in range(len(self.langs))]
        by = [b or [b" "] for b in by]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = (np.arange(batch) + (step - 1) * batch) % len(by)  # all languages in turn, however many
            x = np.full((TRAIN_SEGMENT, batch), 32, np.uint8)
            for i, k in enumerate(y):
                text = by[k][rng.integers(len(by[k]))]
                at = rng.integers(max(1, len(text) - TRAIN_SEGMENT + 1))
                piece = np.frombuffer(text[at : at + TRAIN_SEGMENT], np.uint8)
                x[: len(piece), i] = piece
            grad = self.gradient(x, y)[1]
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.p[k] -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _states(self, x: np.ndarray, d: int) -> np.ndarray:
        """(steps, n, h): the states only, gates in separate contiguous tables."""
        e, u, k = self.p[f"e{d}"], self.p[f"u{d}"], self.h
        half = np.float32(0.5)
        stay = np.zeros((1, 3 * k), np.float32)
        stay[:, k : 2 * k] = 100  # BLANK: the update gate is one
        e = np.concatenate([e, stay])
        e_rz, e_n = np.ascontiguousarray(e[:, : 2 * k]) * half, np.ascontiguousarray(e[:, 2 * k :])
        u_rz, u_n = np.ascontiguousarray(u[:, : 2 * k]) * half, np.ascontiguousarray(u[:, 2 * k :])
        n = x.shape[1]
        out = np.empty((len(x), n, k), np.float32)
        h, a, b, g = np.zeros((n, k), np.float32), np.empty((n, 2 * k), np.float32), np.empty((n, 2 * k), np.float32), np.empty((n, k), np.float32)
        for t, row in enumerate(x):
            np.take(e_rz, row, axis=0, out=a)
            np.matmul(h, u_rz, out=b)
            a += b
            np.tanh(a, out=a)
            a *= half
            a += half
            np.matmul(h, u_n, out=g)
            g *= a[:, :k]
            c = np.take(e_n, row, axis=0, out=out[t])
            c += g
            np.tanh(c, out=c)
            h -= c
            h *= a[:, k:]
            h += c
            out[t] = h
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean over all byte positions; empty texts get zeros."""
        size = np.array([len(t) for t in texts], np.int64)
        count = -(-size // SEGMENT)
        if not count.sum():
            return np.zeros((len(texts), len(self.langs)))
        doc = np.repeat(np.arange(len(texts)), count)
        first = np.cumsum(count) - count
        # a row for each segment, with WARM bytes of its text on both sides
        flat = np.full(int(count.sum()) * SEGMENT + 2 * WARM, BLANK, np.int16)
        for i, t in enumerate(texts):
            flat[WARM + first[i] * SEGMENT : WARM + first[i] * SEGMENT + size[i]] = np.frombuffer(t, np.uint8)
        grid = np.lib.stride_tricks.sliding_window_view(flat, SEGMENT + 2 * WARM)[::SEGMENT][: int(count.sum())]
        length = np.full(len(grid), SEGMENT, np.int64)
        full = count > 0
        length[(first + count - 1)[full]] = (size - (count - 1) * SEGMENT)[full]
        starts, ends = np.zeros(len(grid), bool), np.zeros(len(grid), bool)
        starts[first[full]], ends[(first + count - 1)[full]] = True, True
        total = np.zeros((len(texts), len(self.langs)))
        steps = np.arange(SEGMENT)[:, None]
        for lo in range(0, len(grid), BLOCK):
            x, live = np.array(grid[lo : lo + BLOCK].T, order="C"), steps < length[lo : lo + BLOCK]
            x[:WARM, starts[lo : lo + BLOCK]] = BLANK  # other texts' bytes
            x[WARM + SEGMENT :, ends[lo : lo + BLOCK]] = BLANK
            z = self._states(x[: WARM + SEGMENT], 0)[WARM:] @ self.p["w"][: self.h]
            z += self._states(x[WARM:][::-1], 1)[WARM:][::-1] @ self.p["w"][self.h :]
            z += self.p["b"]
            np.exp(np.clip(z, -30, 30, out=z), out=z)
            z *= (live / z.sum(axis=2))[:, :, None].astype(np.float32)
            np.add.at(total, doc[lo : lo + BLOCK], z.sum(axis=0))
        return total / np.maximum(size, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0)] * len(texts)
        at = 0
        while at < len(known):  # about 4 MB together
            part, size = [], 0
            while at < len(known) and size < 1 << 22:
                part.append(known[at])
                size += len(texts[known[at]])
                at += 1
            p = self.probabilities([texts[i].encode("utf-8", "replace") for i in part])
            for i, k, s in zip(part, p.argmax(axis=1), p.max(axis=1)):
                out[i] = (self.langs[k], min(1.0, float(s)))
        return out


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows of each value of `label`, by a hash of the id, and about TOTAL of all; groups are thinned before they are ranked."""
    counts = docs.groupBy(label).agg(F.count("*").alias("__n"))
    values = counts.where(F.col(label).isNotNull()).count()
    most = max(1, min(most, TOTAL // max(1, values)))
    if values <= LABELS:
        counts = F.broadcast(counts)
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thin = docs.join(counts, label).withColumn("__u", u).where(F.col("__u") * F.col("__n") <= 2.0 * most)
    return thin.withColumn("__at", F.row_number().over(W.partitionBy(label).orderBy("__u", "doc_id"))).where(F.col("__at") <= most).drop("__at", "__u", "__n")


def train(docs: DataFrame, most: int = SAMPLE, **options) -> BiGru:
    """A network learned from documents outside the held-out fold that bear a language."""
    rows = sample(docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))), "lang", most).select("lang", F.substring("text", 1, CHARS).alias("text"), "doc_id").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0))
    langs = sorted({r.lang for r in rows})
    net = BiGru(langs)
    if langs:
        net.train([r.text.encode("utf-8", "replace") for r in rows], np.array([langs.index(r.lang) for r in rows]), **options)
    return net


def _predictor(shared):
    @F.pandas_udf(RESULT)
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(list(texts)), columns=["lang_pred", "score"])

    return udf


def identify(docs: DataFrame, net: BiGru | None = None) -> Column:
    """struct<lang_pred, score> of docs.text; `und` and 0 where the text is null or has no letter.

    The network (a few kilobytes) is broadcast. Without any labelled document all are `und`. Only
    the text is looked at, so nulls elsewhere, repeated rows and other columns make no difference.
    """
    net = net or train(docs)
    return _predictor(docs.sparkSession.sparkContext.broadcast(net))(F.col("text"))


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs whose language is known with a probability of `least` or more."""
    return docs.withColumn("__lang", identify(docs)).where((F.col("__lang.lang_pred") != UNKNOWN) & (F.col("__lang.score") >= least)).drop("__lang")
