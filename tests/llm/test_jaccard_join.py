from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import jaccard_join as J
from quarry.llm.queries import op12_ngram_jaccard_join


def grams(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) > k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85, k=4):
    """(doc_id, n_shingles, component_id) by counting the shared shingles of all pairs that share one."""
    sets, parent, posts = [grams(t, k) for _, t in rows], list(range(len(rows))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, o in Counter(j for g in s for j in posts.get(g, ())).items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            posts.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def text_of(rng, n, words=5000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def table(seed):
    """Copies changed so much that similarities lie on both sides of the bound, chains, short texts, and texts round a common passage."""
    rng, rows = random.Random(seed), []
    passage = text_of(rng, 60)
    for i in range(60):
        t = text_of(rng, rng.choice([4, 6, 8, 9, 12, 20, 60, 200]))
        rows.append(t)
        for _ in range(rng.randrange(5)):
            u = list(rng.choice(rows[-4:]))
            for _ in range(rng.randrange(0, 1 + len(u) // 25 + 1)):
                at = rng.randrange(len(u))
                rng.choice([lambda: u.__setitem__(at, "x"), lambda: u.insert(at, f"y{rng.randrange(9)}"), lambda: u.pop(at) if len(u) > 1 else None])()
            rows.append(u)
    rows += [text_of(rng, rng.randrange(0, 8)) + passage + text_of(rng, rng.randrange(0, 8)) for _ in range(80)]
    rows += [text_of(rng, rng.randrange(5, 30)) + passage for _ in range(40)]
    base = text_of(rng, 150)
    for _ in range(120):
        u = list(base)
        for _ in range(rng.randrange(7)):
            u[rng.randrange(150)] = f"z{rng.randrange(999)}"
        rows.append(u)
    made = [" ".join(r) for r in rows] + [None, "", " \n\t", "a", "A", "a b", "A  b", "a b c", "a b c d", "one two three four five", rows[3] and " ".join(rows[3])]
    return [(7 * i if i % 40 else None, t) for i, t in enumerate(made)] + [(14, "repeated id of another text here"), (14, "repeated id of another text here")]


@pytest.mark.parametrize(("seed", "leaf", "hot", "memo"), [(1, None, None, None), (2, 4, 1, 1), (3, 12, None, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, leaf, hot, memo):
    if leaf:
        monkeypatch.setattr(J, "LEAF", leaf)
        monkeypatch.setattr(J, "LEAF_SIZE", 600 * leaf)
    if hot:
        monkeypatch.setattr(J, "SAMPLE", 2)
        monkeypatch.setattr(J, "HOT", hot)
    if memo:
        monkeypatch.setattr(J, "MEMO", memo)
    rows = table(seed)
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n int, node string").repartition(5)
    assert sorted((tuple(r) for r in J.classes(docs).collect()), key=str) == brute(rows)


def test_other_bounds(spark):
    rows = [r for r in table(4) if r[0] is not None][:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, k in ((70, 2), (100, 4)):
        assert sorted((tuple(r) for r in J.classes(docs, percent, k).collect()), key=str) == brute(rows, percent, k)
    assert J.classes(docs.limit(0)).count() == 0
    assert J.classes(spark.createDataFrame([(1, None), (2, "")], docs.schema)).count() == 2


def test_linked_sets_share_a_region():
    """Each pair at the bound shares a key, sets with many empty classes included."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        a = int(rng.integers(1, 80))
        b = int(rng.integers(-(-a * 85 // 100), a * 100 // 85 + 1))
        shared = -(-85 * (a + b) // 185)
        if shared > min(a, b):
            continue
        high = rng.integers(0, 2) * 20  # all in few classes, at times
        draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(high)
        both = draw(shared)
        x, y = (np.unique(np.concatenate([both, draw(n - shared)])) for n in (a, b))
        o = len(np.intersect1d(x, y))
        if 100 * o >= 85 * (len(x) + len(y) - o) and not np.array_equal(x, y):
            assert set(J.keys_of(x, 85)) & set(J.keys_of(y, 85)), (len(x), len(y), o)


def test_one_large_group(spark):
    """Four thousand near copies of one text, and as many texts that share only a passage with it."""
    rng = random.Random(9)
    base, rows = text_of(rng, 40), []
    for i in range(4000):
        u = list(base)
        u[rng.randrange(40)] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(u)))
    rows += [(10**6 + i, " ".join(base[:25] + text_of(rng, 15, 10**6))) for i in range(4000)]
    got = {r.doc_id: r.component_id for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10**6 + i] == 10**6 + i for i in range(4000))
    assert len(got) == 8000
    ends = [i for i in range(4000) if rows[i][1].split()[0] != base[0] or rows[i][1].split()[-1] != base[-1]]
    assert len({got[i] for i in ends}) == 1  # one word at an end leaves 36 of 38 shingles equal


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op12_ngram_jaccard_join(spark, sf).collect()), key=str) == brute(rows)
