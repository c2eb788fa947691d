"""Overlaps of sets: counted where a set's lists meet, so that no exchange is keyed by pairs."""

import itertools
import random
import re

from driftframe.operators import expression


def test_set_overlaps(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.choice("abcdefghijklmnopqrst")) for _ in range(300)] + [(1, None), (2, None), (None, "a"), (77, "lone"), (1, "a"), (1, "a")]
    out = expression.set_overlaps(spark.createDataFrame(rows, "set_name long, gene string"))
    sets = {k: {g for s, g in rows if s == k} for k, _ in rows if k is not None}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if n := len((sets[a] & sets[b]) - {None}):
            want[a, b] = (n, round(n / (len(sets[a]) + len(sets[b]) - n), 9))
    assert {(r.one, r.two): (r.inter, round(r.jaccard, 9)) for r in out.collect()} == want
    assert not re.search(r"hashpartitioning\((?:one|set_name)#\w+, (?:two|set_name)#", out._jdf.queryExecution().executedPlan().toString())
