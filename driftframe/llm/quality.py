"""Document quality by a linear-chain conditional random field over lines.

Each line gets one-hot features of its make-up (shares of character classes, length, word length,
repeated words, repeats of the line in the document) and those of the lines before and after it.
The field labels every line good or bad; a document's score is the mean of its lines' marginal
probabilities of good (forward-backward), weighted by line length. It is fitted on a bounded
sample of labelled documents, whose lines all bear the document's label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out, sample

#: Labelled documents of each label that are learned from, at most.
SAMPLE = 1500
#: Characters of each that are learned from, at most.
CHARS = 1 << 16
ROUNDS, RATE, RIDGE = 200, 0.1, 1e-5
LEAST = 0.3
#: Bytes of text whose lines are described together.
BLOCK = 1 << 21

#: Byte classes: 0 lower or beyond ASCII, 1 upper, 2 digit, 3 space, 4 sentence mark, 5 bar, 6 exclamation mark, 7 other mark.
CLASSES = 8
SHARES = np.array([1e-9, 0.02, 0.06, 0.12, 0.25, 0.5])
LENGTHS = np.array([1, 20, 60, 150, 400])
WORDS = np.array([2.0, 3.5, 5.0, 7.0, 12.0])
UNIQUE = np.array([0.3, 0.5, 0.7, 0.9])
GROUPS = [len(SHARES) + 1] * CLASSES + [len(LENGTHS) + 1, len(WORDS) + 1, len(UNIQUE) + 1, 2, 2]
OFFSETS = np.concatenate([[0], np.cumsum(GROUPS)])
#: Features of one line; index OFFSETS[-1] stands for "no such line".
SIZE = int(OFFSETS[-1]) + 1


def _table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)
    t[128:] = 0
    t[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
    t[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
    t[np.frombuffer(b"0123456789", np.uint8)] = 2
    t[np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8)] = 3
    t[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 4
    t[ord("|")], t[ord("!")] = 5, 6
    return t


TABLE = _table()


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active features (lines, groups), line lengths in bytes, and lines per text (at least one)."""
    lines, counts, unique, again = [], [], [], []
    for t in texts:
        own = t.split(b"\n")
        counts.append(len(own))
        lines += own
        seen: dict[bytes, int] = {}
        for line in own:
            seen[line] = seen.get(line, 0) + 1
            w = line.split()
            unique.append(len(set(w)) / len(w) if w else 1.0)
        again += [seen[line] > 1 and len(line) > 10 for line in own]
    size = np.array([len(line) for line in lines], np.int64)
    x = TABLE[np.frombuffer(b"".join(lines), np.uint8)]
    end = np.cumsum(size)
    begin = end - size
    feats = np.empty((len(lines), len(GROUPS)), np.int64)
    for c in range(CLASSES):
        run = np.concatenate([[0], np.cumsum(x == c)])
        feats[:, c] = np.searchsorted(SHARES, (run[end] - run[begin]) / np.maximum(size, 1))
        if c == 3:
            words = np.maximum(1, (run[end] - run[begin]) + 1)
    feats[:, CLASSES] = np.searchsorted(LENGTHS, size, "right")
    feats[:, CLASSES + 1] = np.searchsorted(WORDS, size / words)
    feats[:, CLASSES + 2] = np.searchsorted(UNIQUE, np.array(unique))
    feats[:, CLASSES + 3] = np.array(again, np.int64)
    feats[:, CLASSES + 4] = np.array([line[-1:] in (b".", b"?", b"!", b":") for line in lines], np.int64)
    return feats + OFFSETS[:-1], size, np.array(counts)


class LineField:
    """A conditional random field with labels 0 bad, 1 good; weights of the line, the one before and the one after."""

    def __init__(self):
        self.w = np.zeros((3, SIZE))  # towards good
        self.turn = np.zeros((2, 2))
        self.bias = 0.0

    def _emissions(self, feats: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        own = self.w[0][feats].sum(axis=1) + self.bias
        before, after = self.w[1][feats].sum(axis=1), self.w[2][feats].sum(axis=1)
        own[1:] += np.where(first[1:], self.w[1][-1], before[:-1])
        own[:-1] += np.where(last[:-1], self.w[2][-1], after[1:])
        own[0] += self.w[1][-1]
        own[-1] += self.w[2][-1]
        return own

    def _marginals(self, emit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and P(previous label, label) summed over all neighbours.

        Texts step together, longest first, so step t touches only those with more than t lines.
        """
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        long = counts[order]
        live = np.searchsorted(-long, -np.arange(1, long[0] + 1), "right") if len(long) else []
        a = np.zeros((len(emit), 2))  # log forward, then marginals
        b = np.zeros((len(emit), 2))
        score = np.stack([np.zeros(len(emit)), emit], axis=1)
        for t, n in enumerate(live):
            at = first[:n] + t
            if t == 0:
                a[at] = score[at]
            else:
                prev = a[at - 1]
                a[at] = score[at] + np.logaddexp(prev[:, :1] + self.turn[0], prev[:, 1:] + self.turn[1])
        pairs = np.zeros((2, 2))
        for t in range(len(live) - 2, -1, -1):
            n = live[t + 1]
            at = first[:n] + t
            nxt = score[at + 1] + b[at + 1]
            b[at] = np.logaddexp(nxt[:, :1] + self.turn[:, 0], nxt[:, 1:] + self.turn[:, 1])
            joint = a[at][:, :, None] + self.turn + nxt[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return 1 / (1 + np.exp(np.clip((a[:, 0] + b[:, 0]) - (a[:, 1] + b[:, 1]), -500, 500))), pairs

    @staticmethod
    def _edges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(counts)
        first, last = np.zeros(end[-1], bool), np.zeros(end[-1], bool)
        first[end - counts], last[end - 1] = True, True
        return first, last

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> None:
        """Gradient ascent (Adam) on the mean log-likelihood of the lines' labels, classes weighted alike."""
        feats, _, counts = describe(texts)
        first, last = self._edges(counts)
        y = np.repeat(labels, counts).astype(float)
        n = len(y)
        pairs_of = np.zeros((2, 2))
        np.add.at(pairs_of, (labels, labels), counts - 1)
        m = [np.zeros_like(self.w), np.zeros((2, 2)), 0.0]
        v = [np.zeros_like(self.w), np.zeros((2, 2)), 0.0]
        before = np.where(first[:, None], SIZE - 1, np.roll(feats, 1, axis=0))
        after = np.where(last[:, None], SIZE - 1, np.roll(feats, -1, axis=0))
        for step in range(1, rounds + 1):
            p, pairs = self._marginals(self._emissions(feats, first, last), counts)
            d = y - p
            wide = np.repeat(d, feats.shape[1])
            gw = np.stack([np.bincount(f.ravel(), wide, SIZE) for f in (feats, before, after)])
            gw[1:, -1] /= feats.shape[1]
            grad = [gw / n - RIDGE * self.w, (pairs_of - pairs) / n - RIDGE * self.turn, d.sum() / n]
            for i, (name, g) in enumerate(zip(("w", "turn", "bias"), grad)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                setattr(self, name, getattr(self, name) + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8))

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) and length of every line, and lines per text."""
        feats, size, counts = describe(texts)
        return self._marginals(self._emissions(feats, *self._edges(counts)), counts)[0], size, counts

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            part, size = [], 0
            while at + len(part) < len(texts) and size < BLOCK:
                part.append((texts[at + len(part)] or "").encode("utf-8", "replace"))
                size += len(part[-1]) + 1
            p, length, counts = self.lines(part)
            weight = np.maximum(length, 1)
            start = np.cumsum(counts) - counts
            out[at : at + len(part)] = np.add.reduceat(p * weight, start) / np.add.reduceat(weight, start)
            at += len(part)
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, **options) -> LineField:
    """A field learned from labelled documents outside the held-out fold; without any, every score is one half."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = sample(known.where(~held_out(F.col("doc_id"), 5, 0)), "quality", most)  # at most 2 * most rows
    texts = docs.select("doc_id", F.substring("text", 1, CHARS).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")).collect()  # of a repeated id the least text
    rows.sort(key=lambda r: r.doc_id)
    field = LineField()
    if rows:
        field.fit([r.text.encode("utf-8", "replace") for r in rows], np.array([r.quality for r in rows]), **options)
    return field


def _scorer(shared):
    @F.pandas_udf(T.DoubleType())
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)) if len(texts) else [], dtype="float64")

    return udf


def score(docs: DataFrame, labels: DataFrame, field: LineField | None = None) -> Column:
    """Score (0 to 1) of docs.text, null texts as empty ones; the field (some kilobytes) is broadcast.

    Only the text is looked at: nulls elsewhere, repeated rows and other columns make no difference.
    """
    field = field or train(docs, labels)
    return _scorer(docs.sparkSession.sparkContext.broadcast(field))(F.col("text"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score(docs, labels).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= LEAST, 1).otherwise(0))
