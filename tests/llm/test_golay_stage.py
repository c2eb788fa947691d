"""The near-dedup stage of the pipeline takes its candidates from Golay buckets of fingerprints too."""

import pandas as pd

from driftframe.llm import shingles, simhash


def test_candidates_meet_in_golay_buckets(spark, monkeypatch):
    """Texts that share no band: one long text, one copy of it with a word changed in its last sentence."""
    words = [f"w{i * 7919 % 1009}" for i in range(900)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"v{i}" for i in range(50)), "", None]
    prints = [simhash.simhash(t) for t in texts]
    assert bin(prints[0] ^ prints[1]).count("1") <= 2 < bin(prints[0] ^ prints[2]).count("1")
    monkeypatch.setattr(shingles, "links", lambda nodes, rows, scratch, links=shingles.links: links(nodes.selectExpr("node", "size", "slice(bands, 21, 100) AS bands"), rows, scratch))
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": [4, 2, 3, 5, 6], "text": texts}))
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [2, 3, 5]
