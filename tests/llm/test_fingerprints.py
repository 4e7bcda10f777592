from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import weighted_minhash as W
from quarry.llm.queries import op7_weighted_fingerprints


def generalised_jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    find = W.Sampler(2048)
    for share in (0.2, 0.5, 0.8):
        a = [rng.choice(words) for _ in range(120)]
        b = [w if rng.random() < share else rng.choice(words) for w in a]
        fa, fb = find([" ".join(a), " ".join(b)])
        want = generalised_jaccard(" ".join(a), " ".join(b))
        assert abs((fa == fb).mean() - want) < 4 * (want * (1 - want) / 2048) ** 0.5


def test_weights_are_consistent():
    a = W.log_a(np.array([5], np.uint64).repeat(3), np.array([1.0, 2.0, 50.0]), 512)
    assert (a[1] <= a[0]).all() and (a[2] <= a[1]).all() and (a[1] == a[0]).any()


def test_forgetting_and_case(monkeypatch):
    texts = ["One two two", "three " * 9, "", " \n", "ONE two\ttwo", "é É"]
    want = W.Sampler()(texts)
    monkeypatch.setattr(W, "MEMO", 2)
    assert (W.Sampler()(texts) == want).all()
    assert not want[2].any() and not want[3].any() and (want[0] == want[4]).all()


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        f, g, h = (x.astype(">u2").tobytes().hex() for x in W.Sampler()([t, e, u]))
        yield d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, W.likeness(f, g), W.likeness(f, h)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_edits_of_small_tables(spark, n):
    rng = random.Random(n)
    rows = [(i * i, " ".join(rng.choice("ab é 日本 wörd xyz".split()) for _ in range(rng.randrange(30)))) for i in range(n)]
    if n == 40:
        rows += [(None, "null id"), (None, None), (7, None), (4, "twice"), (4, "twice"), (2**62, "x" * 30000), (-5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, W.with_edits(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_op7_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op7_weighted_fingerprints(spark, d)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_plain_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (None, "a  b", "z")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in W.fingerprints(docs).collect()}
    assert got[1] == got[None] and set(got[2]) == {"0"} and len(got[1]) == 4 * W.SAMPLES
