"""Parts of the training-data operators that no other test holds: label model, span classifier, redaction, written shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.llm import hilbert, pii


def test_label_model_finds_the_labelers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.3
    right = [0.95, 0.8, 0.7, 0.9]  # how often a labeler that votes is right; each says nothing in a third of the cases
    votes = np.stack([np.where(rng.random(len(truth)) < 1 / 3, 1, np.where((rng.random(len(truth)) < r) == truth, 2, 0)) for r in right], axis=1)
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, given, prior = pii.reliabilities(patterns, counts.astype(float))
    assert prior == pytest.approx(0.3, abs=0.04)
    for j, r in enumerate(right):
        assert given[1, j] == pytest.approx([(1 - r) * 2 / 3, 1 / 3, r * 2 / 3], abs=0.05)
        assert given[0, j] == pytest.approx([r * 2 / 3, 1 / 3, (1 - r) * 2 / 3], abs=0.05)
    sure = np.abs(p[of.ravel()] - 0.5) > 0.4
    assert sure.mean() > 0.4 and ((p[of.ravel()] > 0.5) == truth)[sure].mean() > 0.93


def test_logistic_is_at_the_least_of_its_loss():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((500, 1)), rng.integers(0, 2, (500, 4))], axis=1).astype(float)
    target, weight = rng.random(500), rng.integers(1, 9, 500).astype(float)

    def loss(w):
        z = x @ w
        return (weight / weight.sum() * (np.logaddexp(0, z) - target * z)).sum() + 0.005 * (w * w).sum()

    w = pii.logistic(x, target, weight)
    assert all(loss(w) < loss(w + s * d) for d in np.eye(5) for s in (-1e-3, 1e-3))


def test_redaction(spark):
    rows = [(1, "mail a.b@c.org now, call +49 (30) 1234567."), (2, None), (3, ""), (4, "nothing here"), (4, "nothing here"), (5, "\U0001f600 10.0.0.1 " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "mail [EMAIL] now, call [PHONE].", 2: None, 3: "", 4: "nothing here", 5: "\U0001f600 [IP] " * 2000}
    assert all(not pii.base_spans(t) for t in got.values() if t)
    assert pii.redact(docs.limit(0)).count() == 0


def test_shards_follow_the_curve_and_are_written(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "w" * int(rng.integers(0, 5000)), f"s{i % 5}", "ab"[i % 2]) for i in range(400)] + [(7, None, None, None), (8, "x", "s1", "a"), (8, "x", "s1", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("slot", F.lit("mine"))
    placed = hilbert.place(docs, 6, carry=True)
    at = sorted((r.shard, r.slot, r.hilbert) for r in placed.collect())
    assert [h for _, _, h in at] == sorted(h for _, _, h in at)  # shards cut runs of the curve
    hilbert.write_shards(docs, f"{tmp_path}/out", 6)
    files = spark.read.parquet(f"{tmp_path}/out")
    held = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert sorted(held) == list(range(6)) and sum(held.values()) == len(rows) and max(held.values()) - min(held.values()) <= 1
