from __future__ import annotations

import random

from quarry.operators import ranking


def test_many_small_sources_are_walked_in_batches(spark):
    rng = random.Random(7)
    rows = [(s, i, [rng.randrange(9) for _ in range(rng.randrange(7))] if rng.random() < 0.95 else None, f"{s}-{i}") for s in [None, *range(300)] for i in range(rng.randrange(1, 9))]
    want, kept = set(), {}
    for s, i, nums, name in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        mine = set(nums or ())
        kept.setdefault(s, [])
        near = len(mine) >= 3 and any(len(mine & k) >= max(3, 0.9 * len(mine)) for k in kept[s])
        if not near:
            kept[s].append(mine)
            want.add(name)
    out = ranking.suppress_near(spark.createDataFrame(rows, "source int, seq int, numbers array<int>, name string"), "numbers", "source", "seq", 3, 0.9)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.name for r in out.collect()} == want
