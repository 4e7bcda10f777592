from __future__ import annotations

import random

from quarry.llm import jaccard_join


def test_common_passage_needs_no_pairs(spark, monkeypatch):
    """Texts that share a line and nothing else come apart by their rarest shingles, before any are measured or dealt to blocks in twos."""
    rng, rows = random.Random(3), []
    line = [f"c{i}" for i in range(8)]
    for i in range(900):
        rows.append((i, " ".join(line + [f"w{rng.randrange(10**6)}" for _ in range(60)])))
    rows += [(900 + i, rows[i][1] + " end") for i in range(5)]
    seen, stored = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: seen.append(name) or stored(df, name))
    monkeypatch.setattr(jaccard_join, "LEAF", 32)
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 900 else i - 900 for i in range(905)}
    assert "join-met" not in seen
