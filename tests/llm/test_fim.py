from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import fim

DOCS = "doc_id long, text string, row string, u string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(ident, text, unit, seed=7, fim_percent=100, spm_percent=50):
    h = sha(f"{seed}:{'' if ident is None else ident}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    text = text or ""
    found = re.findall(fim.GRAMMARS[unit].unit, text)
    n = len(found)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_percent else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(5)
    letters = list("ab \n\n\t<>P🙂é") + ["\u0085", "\r\n", "<P", "S>", " "]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(200)]
    return [None, "", "\n", "\n\n", "no line", "a\n", "a<P>b\nc", "<M>", "x\n" * 30000, "long " * 40000, "same\ntext\n", "same\ntext\n", *made]


@pytest.mark.parametrize("unit", list(fim.GRAMMARS))
def test_units_are_those_of_the_grammar(spark, unit):
    given = [t or "" for t in texts() if unit != "chars" or len(t or "") < 1000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", fim.units(F.col("t"), fim.GRAMMARS[unit]).alias("u")).collect()
    for r in rows:
        assert r.u == re.findall(fim.GRAMMARS[unit].unit, given[r.i])


@pytest.mark.parametrize(("unit", "rate", "spm"), [("lines", 100, 50), ("words", 60, 20), ("lines", 0, 50)])
def test_equals_brute_force_and_comes_back(spark, unit, rate, spm):
    rows = [(i if i % 50 else None, t, "r", None) for i, t in enumerate(texts())] + [(3, "again\nid", None, "u"), (-5, "below\nzero", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    made = fim.transform(docs, unit=unit, fim_percent=rate, spm_percent=spm)
    got = made.select("row.*", "n", "form", "prefix", "middle", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix, r.middle, r.output) == brute(r.doc_id, r.text, unit, 7, rate, spm)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == ({"plain", "psm", "spm"} if rate else {"plain"})


def test_digests(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts())], DOCS)
    got = fim.digests(docs)
    for r in got.collect():
        n, form, p, m, out = brute(r.doc_id, texts()[r.doc_id], "lines")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(texts()[r.doc_id] or "")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert fim.digests(docs.limit(0)).count() == 0
