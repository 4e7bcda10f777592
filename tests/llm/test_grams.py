from __future__ import annotations

import numpy as np

from quarry.llm import toxicity


def test_no_two_keys_share_a_value():
    rng = np.random.default_rng(1)
    g = np.unique(rng.integers(0, 1 << 52, 300_000, dtype=np.uint64))
    r = rng.normal(size=len(g)).astype(np.float32)
    other = np.setdiff1d(rng.integers(0, 1 << 52, 300_000, dtype=np.uint64), g)
    for n in (len(g), 1, 0):
        table = toxicity.Grams(g[:n], r[:n])
        assert (table.of(g[:n])[0] == r[:n]).all() and not len(table.of(g[:n])[1])
        for x in (other, g[n:]):
            value, none = table.of(x)
            assert not value.any() and len(none) == len(x)
