from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import segment
from quarry.operators import chunks, lines, search

ELEMENTS = "file string, pos int, role string, text string, header boolean, caption string"


def sections_by_hand(elements):
    """Records of one file by the rules, without Spark."""
    head = lambda r, t: r == "Title" or (r == "Text" and len(t) <= 60 and len(t.split()) <= 8 and t[-1] not in ".。:：;；,，")
    out, held, size = [], [], 0
    for n, (role, text) in enumerate(elements):
        if role == "Table" and text.strip():
            caption = ""
            for r, t in reversed(elements[max(0, n - 2) : n]):
                if r == "Table":
                    break
                if sum(c.isalpha() for c in t or "") >= 3:
                    caption = t.strip()[:240]
                    break
            out.append(("table", f"{caption}\n\n{text.strip()}" if caption else text.strip()))
    parts = []
    for role, text in elements:
        t = (text or "").strip()
        if role == "Table" or not t:
            continue
        if head(role, t) and size >= chunks.SECTION:
            parts.append(held)
            held, size = [], 0
        held, size = held + [t], size + len(t)
    for p in parts + [held]:
        out += [("text", c.strip()) for c in lines.recursive_split("\n\n".join(p), 1200, 0) if len(c.strip()) > chunks.SHORTEST]
    return out


def test_chunk_records_equal_the_rules(spark):
    rng = random.Random(5)
    some = [("Title", "Income Taxes"), ("Text", "Net sales"), ("Text", "It ends."), ("Text", "a\tb c d e f g h i"), ("NarrativeText", "Sales rose by 4 %. " * 20), ("NarrativeText", "x" * 1500), ("NarrativeText", " \n"), ("Table", "| a |\n|---|\n| 1 |"), ("Table", " "), (None, "no role " * 9), ("Title", None), ("Text", "Umsätze\n")]
    files = {f"f{i}": [rng.choice(some) for _ in range(rng.randrange(1, 40))] for i in range(40)}
    rows = [(f, i, r, t, True, "clash") for f, es in files.items() for i, (r, t) in enumerate(es)]
    rows.append((None, 0, "Title", "A file without a name, all the same", False, ""))
    rng.shuffle(rows)
    got: dict = {}
    for r in chunks.chunk_records(spark.createDataFrame(rows, ELEMENTS).repartition(5)).collect():
        got.setdefault(r.file, []).append((r.chunk_index, r.chunk_type, r.text))
    want = {f: [(i, *c) for i, c in enumerate(sections_by_hand([(r, (t or "") if r == "Table" else t) for r, t in es]))] for f, es in files.items()}
    want[None] = [(0, "text", "A file without a name, all the same")]
    assert {f: sorted(x) for f, x in got.items()} == {f: x for f, x in want.items() if x}


def test_summaries_of_large_tables_without_caption(spark):
    table = "\n".join(["| a |", "|---|"] + [f"| {i} |" for i in range(chunks.SUMMARY_ROWS)])
    rows = [("f", 0, "Table", table, None, None), ("f", 1, "Table", "| a |\n|---|\n| 1 |", None, None), ("f", 2, "Text", "Known sales", None, None), ("f", 3, "Table", table, None, None)]
    told = spark.createDataFrame([("f", i, f"Summary {i}") for i in range(4)], "file string, pos int, summary string")
    got = [r.text.split("\n")[0] for r in chunks.chunk_records(spark.createDataFrame(rows, ELEMENTS), summaries=told).orderBy("chunk_index").collect()]
    assert got == ["Summary 0", "| a |", "Known sales"]
    assert chunks.chunk_records(spark.createDataFrame([], ELEMENTS)).collect() == []


def test_one_file_with_very_many_elements(spark):
    n = 60_000
    made = spark.range(n).select(F.lit(7).alias("file"), F.col("id").alias("pos"), F.when(F.col("id") % 5 == 0, "Title").otherwise("NarrativeText").alias("role"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 30).alias("text"))
    got = chunks.chunk_records(made.repartition(7), split=lambda t: [t])
    assert got.agg(F.count("*"), F.countDistinct("chunk_index"), F.max("chunk_index")).first()[:] == (n // 5, n // 5, n // 5 - 1)
    first = lambda t: F.regexp_extract(t, r"^w(\d+)", 1).cast("int")
    assert got.where(first(F.col("text")) != F.col("chunk_index") * 5).count() == 0


@pytest.mark.parametrize(
    ("heading", "want"),
    [
        ("Three  Months Ended March 31, 2026 Compared with Three Months Ended March 31, 2025", "Three Months Ended March 31, 2026 vs March 31, 2025"),
        ("Six Months Ended May 1, 2026 Compared With Nine Months Ended May 1, 2025", "Six Months Ended May 1, 2026 Compared With Nine Months Ended May 1, 2025"),
        ("Fiscal Year 2026\nCompared with Fiscal Year 2025", "Fiscal Year 2026 vs 2025"), (" Other  things ", "Other things"), (None, None), ("", ""),
    ],
)
def test_period_label(spark, heading, want):
    assert spark.createDataFrame([(heading,)], "h string").select(chunks.period_label(F.col("h"))).first()[0] == want


def test_unquantified_sections_join_the_one_before(spark):
    s = lambda *xs: [(h, t) for h, t in xs]
    cases = [
        (s(("T", "| 1,234 |"), ("A", "A rose."), ("B", "B fell.")), s(("T", "| 1,234 |\nA rose.\nB fell."))), (s(("T", "no"), ("A", "A rose.")), s(("T", "no"), ("A", "A rose."))),
        (s(("T", "5 %"), ("A", "A rose 4%.")), s(("T", "5 %"), ("A", "A rose 4%."))), (s((None, "A rose.")), s((None, "A rose."))), ([], []),
        (s(("T", "$5" + "x" * 7999), ("A", "A rose.")), s(("T", "$5" + "x" * 7999), ("A", "A rose."))),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s array<struct<heading string, text string>>")
    got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", chunks.merge_unquantified(F.col("s")).alias("m")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_lattice_equals_all_paths():
    rng = random.Random(3)
    for _ in range(200):
        words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 9) for _ in range(5)}
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 9)))
        total, best = sum(words.values()), -math.inf
        for cuts in itertools.product((0, 1), repeat=len(run) - 1):
            at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(run)]
            parts = [run[a:b] for a, b in zip(at, at[1:])]
            if all(p in words or len(p) == 1 for p in parts):
                best = max(best, sum(math.log(words[p] / total) if p in words else -math.log(total) - 1e-9 for p in parts))
        got = segment.Lattice(words).path(run)
        assert "".join(got) == run and all(p in words or len(p) == 1 for p in got)
        assert sum(math.log(words[p] / total) if p in words else -math.log(total) - 1e-9 for p in got) == pytest.approx(best)
    known = segment.Lattice({"營收": 5, "成長": 5, "營收成長": 2, "收成": 50})
    assert known.cut("營收成長率高漲") == ["營收成長", "率高", "高漲"]
    assert known.cut("") == [] and known.cut("率") == ["率"]


def test_words_of_any_language(spark):
    dictionary = spark.createDataFrame([("輝達", 3), ("營收", 4), (None, 2), ("", 3), ("少", 0)], "word string, n long")
    texts = ["NVDA輝達營收 grew 3%", "Größe, café niño", "", None, "甲", "輝達" * 50_000, "!?"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    cut = segment.segmenter(dictionary)
    got = {r.i: r.w for r in df.select("i", cut(F.col("text")).alias("w")).collect()}
    assert got == {0: ["nvda", "輝達", "營收", "grew", "3"], 1: ["größe", "café", "niño"], 2: [], 3: [], 4: ["甲"], 5: ["輝達"] * 50_000, 6: []}
    pairs = {r.i: r.w for r in df.where("i < 5").select("i", segment.bigrams(F.col("text")).alias("w")).collect()}
    assert pairs[0] == ["nvda", "輝達", "達營", "營收", "grew", "3"] and pairs[4] == ["甲"] and pairs[3] == []
    with pytest.raises(ValueError):
        segment.segmenter(spark.createDataFrame([("長" * (segment.LONGEST + 1), 1)], "word string, n long"))
    docs = spark.createDataFrame([(1, "營收成長"), (2, "輝達虧損"), (3, "天氣很好"), (4, "café ouvert")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "輝達營運"), (2, "CAFÉ")], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in search.bm25_topk(asked, docs, 3, words=cut).orderBy("query_id").collect()] == [(1, 2), (2, 4)]
