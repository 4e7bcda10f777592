from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from quarry.llm import jaccard, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def least_ids(rows, similar=0.8):
    """The smallest id of the class of each row, by comparing all pairs."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similar * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return [ids.get(root(i)) for i in range(len(rows))]


def table(seed, n=60):
    """Texts with so many changed words that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 200))]
        rows.append((10 * i, " ".join(t)))
        for k in (1, 2, 3):
            u = list(t)
            for _ in range(max(1, len(t) * k // 60)):
                u[rng.randrange(len(u))] = f"x{rng.randrange(999)}"
            rows.append((10 * i + k, " ".join(u)))
    return rows


def test_stage_equals_brute_force(spark, monkeypatch):
    rows = table(1) + [(5000, None), (5001, " \n"), (None, "null here " * 20)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    want = sorted(str(d) for (d, _), c in zip(rows, least_ids(rows)) if d == c or c is None)
    for chunk in (jaccard.CHUNK, 2):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        out = P.drop_near_copies(spark, docs, "")
        assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == want
    assert P.drop_near_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize(("low", "least"), [(0.8, 0.96), (0.85, 0.98), (0.9, 1.0)])
def test_recall_by_similarity(spark, low, least):
    """The share of pairs that are found, of pairs whose similarity is in the band of 0.05 from ``low`` on."""
    rng, rows, pairs = random.Random(int(100 * low)), [], 0
    while pairs < 300:
        t = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 400))]
        u = list(t)
        for _ in range(rng.randrange(1, 12)):
            u[rng.randrange(len(u))] = f"x{rng.randrange(999)}"
        a, b = grams(" ".join(t)), grams(" ".join(u))
        if low <= len(a & b) / len(a | b) < low + 0.05:
            rows += [(2 * pairs, " ".join(t)), (2 * pairs + 1, " ".join(u))]
            pairs += 1
    found = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    share = sum(r.doc_id % 2 and r.component_id == r.doc_id - 1 for r in found) / pairs
    print("recall", low, share)
    assert share >= least and all(r.component_id // 2 == r.doc_id // 2 for r in found)


def test_rows_are_judged_by_their_own_class(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(150)) for _ in range(4))
    rows = [(1, a), (None, a + " more"), (None, b), (None, c), (None, c + " more"), (7, a + " end"), (7, d), (8, d + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.kept_rows(docs).collect()), key=str)
    # Of the class of a row 1 stays, of that of d the second row 7; all of a class without ids stay.
    assert got == sorted([rows[0], *rows[2:5], rows[6]], key=str)
