"""Exact neighbours keep every candidate where single precision or the squares of doubles run out of range."""

import numpy as np
import pytest

from driftframe.operators.nearest import Best

PLAIN = np.random.default_rng(0).normal(size=(120, 3))


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("v", [PLAIN, PLAIN * 1e200, np.where(np.arange(120)[:, None] % 3, PLAIN, PLAIN * 1e200), PLAIN * 1e-200, np.vstack([PLAIN * 10**-21.5, [[1.0] * 3, [-1.0] * 3]])], ids=["plain", "huge", "mixed", "tiny", "beside an outlier"])
def test_no_candidate_is_lost(v):
    n, k, rng = len(v), 5, np.random.default_rng(7)
    best = Best(np.arange(n), v, k)
    for part in np.array_split(rng.permutation(n), 4):
        best.meet(part, v[part])
    square = np.zeros((n, n))
    for c in range(v.shape[1]):
        square += (v[:, None, c] - v[None, :, c]) ** 2
    d = np.sqrt(square)
    got = best.found().groupby("id")["near"].agg(list)
    assert all(got[i] == [j for _, j in sorted((d[i, j], j) for j in range(n) if j != i)[:k]] for i in range(n))
