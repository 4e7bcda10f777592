from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import quality, toxicity
from quarry.llm.queries import op1_toxicity, op5_quality_classifier

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ri", "su", "ta", "vo", "xe") for c in ("n", "r", "s", "la", "de")]


def toxic_docs(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        t = [rng.choice(WORDS) for _ in range(rng.randrange(5, 150))]
        if bad:
            for _ in range(rng.randrange(2, 5)):
                t.insert(rng.randrange(len(t)), rng.choice(["grobble", "snurk", "pfuiteufel"]))
        docs.append((i, " ".join(t)))
        if rng.random() < 0.8:
            labels.append((i, int(bad), rng.randrange(2)))
    return docs, labels, {i for i, t in docs if "grobble" in t or "snurk" in t or "pfuiteufel" in t}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def brute_ratios(texts):
    """Log ratio of the last byte of any six bytes, by dictionaries over all orders; texts are (text, label)."""
    c = {0: Counter(), 1: Counter()}
    for t, y in texts:
        b = b"\0" * 5 + toxicity._bytes(t)
        for i in range(len(b) - 5):
            c[y][b[i : i + 6]] += 1
    levels = {6: c}
    for n in (5, 4, 3):
        levels[n] = {y: Counter(g[1:] for g in levels[n + 1][y]) for y in (0, 1)}
    D = toxicity.DISCOUNT
    two = Counter(g[1:] for g in {**levels[3][0], **levels[3][1]})
    one = Counter(g[1:] for g in two)
    total = sum(one.values())
    every, kinds = Counter(), Counter()
    for g, v in two.items():
        every[g[:1]] += v
        kinds[g[:1]] += 1
    cuts, sums, lefts = {}, {}, {}
    for n in (3, 4, 5, 6):
        for y in (0, 1):
            n1, n2, n3, n4 = (sum(v == k for v in levels[n][y].values()) for k in (1, 2, 3, 4))
            cut = [D] * 3
            if n1 and n2 and n3:
                u = n1 / (n1 + 2 * n2)
                cut = [min(max(d, 0.1), k - 0.02) for k, d in ((1, 1 - 2 * u * n2 / n1), (2, 2 - 3 * u * n3 / n2), (3, 3 - 4 * u * n4 / n3))]
            cuts[n, y], sums[n, y], lefts[n, y] = cut, Counter(), defaultdict(float)
            for g, v in levels[n][y].items():
                sums[n, y][g[:-1]] += v
                lefts[n, y][g[:-1]] += cut[min(v, 3) - 1]

    def p(y, g):
        n = len(g)
        if n == 2:
            return max(two[g] - D, 0) / every[g[:1]] + D * kinds[g[:1]] / every[g[:1]] * (one[g[1:]] + 0.5) / (total + 128) if two[g] else 1.0
        all_, v = sums[n, y][g[:-1]], levels[n][y][g]
        if not all_:
            return p(y, g[1:])
        return ((v - cuts[n, y][min(v, 3) - 1] if v else 0) + lefts[n, y].get(g[:-1], 0.0) * p(y, g[1:])) / all_

    return lambda g: math.log(p(1, g)) - math.log(p(0, g)), {g for y in (0, 1) for g in levels[6][y]}


def model_of(spark, texts):
    table, cut, _ = toxicity._level(toxicity.counts(spark.createDataFrame(texts, "text string, label int")), "counts")
    return toxicity.Slices(toxicity.ratios(table, cut))


def test_ratios_equal_dictionaries(spark):
    """Of seen six-grams, and of unseen ones, which back off class by class."""
    docs, labels, _ = toxic_docs(60, 1)
    label = {i: y for i, y, _ in labels}
    ratio, seen = brute_ratios([(t, label[i]) for i, t in docs if i in label] + [("", 0), ("é日", 1)])
    table = model_of(spark, [(t, label[i]) for i, t in docs if i in label] + [("", 0), ("é日", 1)])._whole
    rng = random.Random(1)
    unseen = {bytes(rng.choice(list(seen))[:k] + rng.choice(list(seen))[k:]) for k in range(6) for _ in range(300)} | {b"zzzzzz", b"\0\0\0\0\0q"}
    for grams in (sorted(seen), sorted(unseen - seen)):
        got = table.ratios(np.array([int.from_bytes(g, "big") for g in grams], np.uint64))
        assert np.abs(got - [ratio(g) for g in grams]).max() < 1e-5


def test_slices_give_the_same_scores(spark, monkeypatch):
    docs, labels, _ = toxic_docs(120, 5)
    frame = spark.createDataFrame([*docs, (None, None), (900, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    whole = {r.doc_id: r.score for r in toxicity.classify(frame, marks).collect()}
    monkeypatch.setattr(toxicity, "SLICE", 3000)
    sliced = {r.doc_id: r.score for r in toxicity.classify(frame, marks).collect()}
    assert whole.keys() == sliced.keys() and all(abs(whole[k] - sliced[k]) < 1e-4 for k in whole)
    assert sorted(map(str, toxicity.clean_rows(frame, marks).collect())) == sorted(str(r) for r in frame.collect() if whole[r.doc_id] < 0.5)


def test_toxicity_on_held_out_texts(spark):
    docs, labels, bad = toxic_docs(900, 2)
    rows = [(i, t, "x") for i, t in docs] + [(5000, None, "x"), (5001, "", "x"), (None, "kasus", "x"), (3, docs[3][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7777, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.classify(frame, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and held(r.doc_id))
    test = [r for r in got if r.held_out and r.doc_id < 5000]
    right = sum((r.doc_id in bad) == bool(r.predicted) for r in test)
    assert len(test) > 100 and right >= 0.97 * len(test)
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert not any(r.predicted for r in got if r.doc_id in (5000, 5001))
    kept = toxicity.clean_rows(frame, marks)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 5000 in ids and len(bad & set(ids)) <= 0.05 * len(bad) and len(ids) >= 0.97 * (900 - len(bad))


@pytest.mark.parametrize("marks", [[], [(0, 0)], [(1, 1), (2, 1)]])
def test_toxicity_without_both_classes(spark, marks):
    frame = spark.createDataFrame([(i, "some text") for i in range(5)], "doc_id long, text string")
    got = toxicity.classify(frame, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    assert toxicity.classify(frame.limit(0), spark.createDataFrame(marks, "doc_id long, toxic int")).count() == 0


def test_labels_of_fold_zero_teach_nothing(spark):
    docs, labels, _ = toxic_docs(200, 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda ls: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.classify(frame, spark.createDataFrame(ls, "doc_id long, toxic int, quality int")).collect())
    assert score(labels) == score([(i, 1 - y if held(i) else y, q) for i, y, q in labels])


def test_long_texts_are_read_to_the_end():
    g = toxicity.grams(b"snurk!")
    table = toxicity.Grams(g[-1:] | np.uint64(6 << 48), np.array([5.0]))
    base = "ab " * 1_500_000
    a, b = toxicity.features([base, base + "snurk!"], table, [None, None])
    assert b[0] > a[0] + 0.2


def junk_docs(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(WORDS) for _ in range(rng.randrange(30, 200))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            t = [f"{w.upper()}!!" for w in t] if kind == 0 else [w + "%%%" for w in t] if kind == 1 else [w for w in t[:20] for _ in range(8)]
        docs.append((i, " ".join(t)))
        if rng.random() < 0.8:
            labels.append((i, int(good), 0))
    return docs, labels


def test_quality_on_held_out_texts(spark):
    docs, labels = junk_docs(700, 4)
    good = {i for i, y, _ in labels if y}
    rows = [*docs, (5000, None), (5001, ""), (None, "x"), (3, docs[3][1]), (5002, "w " * 200_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    known = {i for i, _, _ in labels}
    test = [r for r in got if r.held_out and r.doc_id in known]
    assert len(test) > 80 and sum((r.doc_id in good) == bool(r.predicted) for r in test) >= 0.95 * len(test)
    assert quality.classify(frame.limit(0), marks).count() == 0


def test_quality_without_both_classes(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    got = quality.classify(frame, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 2 and len({r.score for r in got}) == 1


def test_chunks_cover_whole_texts():
    rng = random.Random(1)
    for n in (0, 1, 11, 512, 513, 960, 961, 5000):
        b = bytes(rng.randrange(97, 123) for _ in range(n))
        codes, again = quality.chunks(b.decode())
        whole = np.full((len(codes) - 1) * quality.STEP + quality.CHUNK, 256)
        for i, c in enumerate(codes):
            whole[i * quality.STEP : i * quality.STEP + quality.CHUNK] = c
        assert whole[:n].astype(np.uint8).tobytes() == b and (whole[n:] == 256).all() and codes.shape == again.shape


def random_network(seed):
    net = quality.Network(quality._start(np.random.default_rng(seed)))
    rng = np.random.default_rng(seed + 1)
    net.w = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.w.items()}
    return net


def slow_score(net, text):
    """The forward pass byte by byte, in double precision."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    b = list((text or "").encode())
    again = quality.recurring(np.array(b, np.uint8))
    vectors = []
    at = 0
    while not vectors or at + quality.CHUNK - quality.STEP < len(b):
        best = np.zeros(quality.FILTERS)
        for start in range(0, quality.CHUNK - quality.KERNEL + 1, quality.STRIDE):
            x = []
            for i in range(at + start, at + start + quality.KERNEL):
                x += [*(w["embed"][b[i] if i < len(b) else 256]), float(again[i]) if i < len(b) else 0.0]
            best = np.maximum(best, np.array(x) @ w["filters"] + w["shift"])
        vectors.append(best)
        at += quality.STEP
    pooled = np.concatenate([np.max(vectors, axis=0), np.mean(vectors, axis=0)])
    hidden = np.tanh(pooled @ w["dense"] + w["dense_shift"])
    return 1 / (1 + math.exp(-(hidden @ w["out"] + w["out_shift"][0])))


def test_forward_pass_equals_a_slow_one(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "é", "a" * 512, *("".join(rng.choice("abc é!") for _ in range(n)) for n in (5, 511, 900, 2500))]
    for group in (quality.GROUP, 2):
        monkeypatch.setattr(quality, "GROUP", group)
        net = random_network(7)
        assert np.abs(net.scores(texts) - [slow_score(net, t) for t in texts]).max() < 1e-5


def test_gradient_equals_differences():
    rng = random.Random(5)
    made = [quality.chunks("".join(rng.choice("abcde ") for _ in range(n))) for n in (40, 700, 1300)]
    codes, again = (np.concatenate(x) for x in zip(*made))
    sizes, y, weight = np.array([len(c) for c, _ in made]), np.array([1, 0, 1], np.float32), np.array([1.0, 2.0, 0.5])
    net = random_network(9)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        per_chunk, _ = net.convolve(codes, again)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pooled = np.concatenate([np.maximum.reduceat(per_chunk, starts), np.add.reduceat(per_chunk, starts) / sizes[:, None]], axis=1).astype(np.float64)
        p, _ = net.head(pooled)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y)

    g = quality.gradient(net, y, weight, codes, again, sizes)
    for name, v in net.w.items():
        for place in random.Random(1).sample(range(v.size), min(v.size, 12)):
            at = np.unravel_index(place, v.shape)
            kept, ends = v[at], []
            for e in (1e-6, -1e-6):
                v[at] = kept + e
                ends.append(loss())
            v[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-6 - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), (name, at)


def test_recurrence_by_brute_force():
    rng = random.Random(2)
    b = np.array([rng.randrange(97, 100) for _ in range(400)], np.uint8)
    want = [i >= 3 and any(i - lag >= 3 and (b[i - 3 : i + 1] == b[i - 3 - lag : i + 1 - lag]).all() for lag in range(1, quality.LAGS + 1)) for i in range(400)]
    assert quality.recurring(b).tolist() == want


def test_registered_queries(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for q in (op1_toxicity, op5_quality_classifier):
        got = q(spark, d)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == n
