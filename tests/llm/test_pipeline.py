from __future__ import annotations

import random

import public_tokenizers as vocab
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, copies, near copies and shared passages."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "po", "ru") for b in "abcdefghijklmnopqrstuvwxyz"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels, plan = [], [], {}
    passage = say(70)
    for i in range(400):
        kind = ("toxic" if i % 10 == 0 else "copy" if i % 10 == 1 and i > 100 else "near" if i % 10 == 2 and i > 100 else "passage" if i % 10 == 3 else "clean")
        t = f"{say(60)}\n{say(90)}"
        if kind == "toxic":
            t = f"{say(20)} grobble {say(5)} snurk pfui {say(30)} grobble"
        elif kind == "copy":
            t = plan[i - 57][1].replace(" ", "  ", 3)
        elif kind == "near":
            w = plan[i - 58][1].split(" ")
            w[10] = "changed"
            t = " ".join(w)
        elif kind == "passage":
            t = f"{say(40)}\n{passage}\n{say(40)}"
        plan[i] = (kind, t)
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(kind == "toxic")))
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), (None, "null id " + say(30), "en", "s", 5)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), plan, passage


def test_stages(spark, folder):
    d, plan, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d).cache()
        assert out.columns == columns, name
        kept.append({r.doc_id: r.text for r in out.collect()})
        docs = out
    toxic, copies, near, passages = kept
    kinds = lambda k: {i for i, (x, _) in plan.items() if x == k}
    assert not kinds("toxic") & toxic.keys() and {i for i in plan if i not in kinds("toxic")} <= toxic.keys()
    # Copies of a toxic document are toxic themselves; all others go one by one, and the first of each stays.
    assert not kinds("copy") & copies.keys() and kinds("clean") | kinds("near") | kinds("passage") <= copies.keys()
    assert not kinds("near") & near.keys() and kinds("clean") | kinds("passage") <= near.keys()
    with_passage = {i for i, t in passages.items() if t and passage in t}
    assert with_passage == {min(kinds("passage"))}
    assert all(passages[i] == plan[i][1] for i in kinds("clean"))
    for name, part in zip(("toxicity", "exact", "near", "substring"), kept):
        assert {1000, None} <= part.keys(), name


def test_run_packs_what_is_left(spark, folder):
    d, _, _ = folder
    rows = P.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
    tok = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
