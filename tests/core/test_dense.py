from __future__ import annotations

from quarry.operators import search


def test_equal_scores_over_strips_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "STRIP", 7)
    rows = [(i, [float(i % 3), 1.0, 0.0 if i % 5 else float("nan")] if i % 11 else [0.0, 0.0, 0.0]) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.dense_topk(v.where("id % 4 = 0"), v, 6, block=50, drop_self=True).collect())
    unit = {i: [c / max(1e-300, sum(y * y for y in x) ** 0.5) for c in x] for i, x in rows}
    score = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b])), 9)
    want = []
    for q in range(0, 200, 4):
        fit = sorted((-s, c) for c in range(200) if c != q and (s := score(q, c)) == s)
        want += [(q, n, c) for n, (_, c) in enumerate(fit[:6], 1)]
    assert got == sorted(want)
