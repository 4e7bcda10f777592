from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from quarry.llm import exact_dedup, graph, simhash


def brute_components(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, j) for j in range(501, 540)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components(600, edges)
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


DOCS = "doc_id long, text string, keep_id string, _text string"


def test_exact_cases(spark):
    rows = [
        (5, "a  b", "x", None), (3, "a\tb", None, "y"), (9, "a b", None, None), (4, None, None, None), (2, "", None, None),
        (None, "a b", None, None), (7, "z", None, None), (7, "z", None, None), (None, "n", None, None), (None, "n", None, None), (8, " " * 50000, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS).coalesce(3)
    got = exact_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    by = {(r.row.doc_id, r.row.text): r for r in got}
    assert by[5, "a  b"].keep_id == 3 and by[5, "a  b"].group_size == 3 and not by[5, "a  b"].kept
    assert by[3, "a\tb"].kept and by[None, "a b"].keep_id == 3
    assert by[4, None].keep_id == 2 and by[9, "a b"].kept
    assert sum(r.kept for r in got if r.row.doc_id == 7) == 1
    assert [r.keep_id for r in got if r.row.text == "n"] == [None, None] and sum(r.kept for r in got if r.row.text == "n") == 1
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert exact_dedup.classes(docs.limit(0)).count() == 0


def brute_print(text, k=3):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "Ab cD", "É a b C d", "x y z", "a b c d e f a b c", "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 12])
def test_linked_is_exact(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for b in range(9)] + [base]))
    rng.shuffle(values)
    key = np.sort(rng.integers(0, 3, len(values)))
    u, v = simhash.linked([key], values, radius)
    edges = []
    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if key[i] == key[j] and bin(int(values[i] ^ values[j])).count("1") <= radius:
                edges.append((i, j))
    got = list(zip(u, v))
    assert brute_components(len(values), got) == brute_components(len(values), edges)
    assert len(got) < len(values) and all(e in set(edges) or e[::-1] in set(edges) for e in got)


def test_simhash_classes(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 200))]
        for _ in range(4):
            texts.append(" ".join(t))
            if t:
                t = list(t)
                t[rng.randrange(len(t))] = "new"
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, "alone here"), (None, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    comp = brute_components(len(rows), edges)
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = sorted(((str(d), least.get(c)) for (d, _), c in zip(rows, comp)), key=str)
    assert sorted(((str(r.doc_id), r.component_id) for r in got), key=str) == want
    assert simhash.classes(docs.limit(0)).count() == 0


def test_crowded_keys_are_cut_exactly(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (60, 2))})
    monkeypatch.setattr(simhash, "CHUNK", 7)
    got = graph.connected_components(simhash.links(spark.createDataFrame([(v, v) for v in values], "node long, fp0 long"))).collect()
    edges = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 3]
    comp = brute_components(len(values), edges)
    label = {r.node: r.component for r in got}
    assert all((label.get(a, a) == label.get(b, b)) == (comp[i] == comp[j]) for i, a in enumerate(values) for j, b in enumerate(values))
