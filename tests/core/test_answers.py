from __future__ import annotations

import time
import re
from pyspark.sql import functions as F

from quarry.functions import spans
from quarry.operators import answers


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def test_spans(spark):
    df = spark.createDataFrame([("a1b22",), ("",), (None,), ("7",), ("no",)], "t string")
    got = df.select(spans.placed(F.col("t"), r"(\d)(\d)?", 2).alias("m"), spans.tail(F.col("t"), r"\d+").alias("rest"), spans.rewritten(F.col("t"), r"\d+", 0, lambda m: F.concat(F.lit("<"), m["g0"], F.lit(">"))).alias("w")).collect()
    assert [[(m.start, m.stop, m.before, m.g1, m.g2) for m in r.m] for r in got] == [[(1, 2, "a", "1", ""), (3, 5, "b", "2", "2")], [], [], [(0, 1, "", "7", "")], []]
    assert [r.rest for r in got] == ["", "", "", "", "no"] and [r.w for r in got] == ["a<1>b<22>", "", "", "<7>", "no"]


def test_segments_go_to_the_citations_that_close_them(spark):
    text = "[a.txt, chunk #9] one【a.txt, chunk #1】【b.html, chunk #2】 two [a.txt, chunk #3] none\n---\n📚 list【a.txt, chunk #4】"
    got = rows(answers.cited_segments(spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "answer_id int, answer string")), "answer_id", "segment", "said", "source", "chunk")
    assert got == [(1, 1, " one", "a.txt", 1), (1, 1, " one", "b.html", 2), (1, 2, " two ", "a.txt", 3)]


def test_rounding_is_held_against_own_citations(spark):
    chunks = spark.createDataFrame([(1, "f.txt", 0, "Growth 18.30% Margin 68.31% Debt 118.30 B"), (1, "k.html", 5, "increased 18% or so")], "answer_id int, source string, chunk int, text string")
    cases = [
        ("about 18%【f.txt, chunk #0】", [("18.30", "%", "18")]), ("about 18% [k.html, chunk #5]", []), ("18.3%, about 18%【f.txt, chunk #0】", []),
        ("18%【f.txt, chunk #0】【k.html, chunk #5】", []), ("about 18%", []), ("118%【f.txt, chunk #0】", []), ("118 billion【f.txt, chunk #0】", [("118.30", "billion", "118")]), ("18% and 68.3%【f.txt, chunk #0】", [("18.30", "%", "18"), ("68.31", "%", "68.3")]),
    ]
    for text, want in cases:
        got = answers.rounding_losses(spark.createDataFrame([(1, text)], "answer_id int, answer string"), chunks)
        assert rows(got, "source_value", "unit", "wrote") == want, text


def test_references(spark):
    allowed = spark.createDataFrame([(1, 1, "x.txt", 4), (1, 2, "y.txt", 6)], "answer_id int, place int, source string, chunk int")
    said = [(1, "a [Reference 2, chunk #6] b【reference 1，chunk 4】[Reference 1, chunk #5][Reference 9, chunk #4] c"), (2, "[Reference 1, chunk #1]"), (3, "none"), (4, None)]
    got = rows(answers.repaired_references(spark.createDataFrame(said, "answer_id int, answer string"), allowed), "answer_id", "answer", "fixed", "skipped")
    assert got == [(1, "a [y.txt, chunk #6] b【x.txt, chunk #4】[Reference 1, chunk #5][Reference 9, chunk #4] c", 2, 2), (2, "[Reference 1, chunk #1]", 0, 0), (3, "none", 0, 0), (4, "", 0, 0)]


def test_dual_sourcing(spark):
    web, filing = "市值 $4.75 trillion [web: a]", "reported $4342.02 billion【A.txt, chunk #0】"
    cases = [(f"{web}。{filing}", (True, True)), (f"截至 2026‑09‑01 {web}。{filing}", (False, True)), (f"{web}。FY2025 {filing}", (True, False)), (f"Sep 1, 2026 {web}。FY2025 {filing}", None), (web, None), (f"{web}。reported $4750.1 billion【A.txt, chunk #0】", None), (f"{web}。$4,342 【A.txt, chunk #0】", None), (f"{web}。$40 billion【A.txt, chunk #0】", None)]
    for text, want in cases:
        got = [(r.web_undated, r.filing_undated) for r in answers.undated_dual_sourcing(spark.createDataFrame([(1, text)], "answer_id int, answer string")).collect()]
        assert got == ([want] if want else []), text


def test_amounts_of_a_hot_answer_meet_by_steps(spark):
    """100,000 amounts a side within two percent, and one that differs: without a pair of all of them."""
    near = spark.range(100_000).select(F.lit(1).alias("answer_id"), F.explode(F.array(F.lit("web"), F.lit("filing"))).alias("side"), (1000 + F.col("id") % 19).cast("double").alias("amount"))
    assert answers.comparable(near).count() == 0
    more = near.union(spark.createDataFrame([(1, "web", 1040.0), (2, "web", 9.99), (2, "filing", 10.0), (2, "filing", 99.9), (3, "web", 1.0), (3, "filing", 10.1)], near.schema))
    assert rows(answers.comparable(more), "answer_id") == [(1,), (2,)]


def test_numbers_at_the_precision_of_the_answer(spark):
    wanted = spark.createDataFrame([(1, "74.1"), (1, "74.2"), (1, "18.3"), (1, "7"), (2, "5"), (3, "5")], "answer_id int, literal string")
    sources = spark.createDataFrame([(1, 74.144995, False, 10), (1, 0.183, True, 10), (1, 6.5, False, 10), (2, 9.0, False, 999)], "answer_id int, value double, share boolean, size int")
    assert rows(answers.unsupported_numbers(wanted, sources, 100), "answer_id", "literal") == [(1, "7"), (1, "74.2")]


def test_matches_of_a_text_are_looked_for_once(spark):
    from quarry.functions import amounts, spans

    text = "".join(f"then $ {i} billion " + "x" * 60 for i in range(3_000))
    rows = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string")
    started = time.monotonic()
    got = {r.id: r for r in rows.select("id", amounts.stated(F.col("text")).alias("s"), spans.placed(F.col("text"), r"\$ (\d+)", 1).alias("p")).collect()}
    assert time.monotonic() - started < 30  # a search for each match takes minutes
    assert [m.start for m in got[1].p] == [m.start() for m in re.finditer(r"\$ \d+", text)]
    assert [(m.at, m.g1) for m in got[1].p][::1000] == [(0, "0"), (1000, "1000"), (2000, "2000")]
    assert [x.millions for x in got[1].s] == [i * 1000.0 for i in range(3_000)]
    assert got[2].p == got[2].s == got[3].p == got[3].s == []


def test_a_segment_is_named_by_its_first_citation_even_without_its_chunk(spark):
    answer = spark.createDataFrame([(1, "It was 3.1 million【a.txt, chunk #1】【b.txt, chunk #2】 and 9 million【c.txt, chunk #3】")], "answer_id int, answer string")
    chunks = spark.createDataFrame([(1, "b.txt", 2, "3.14 million"), (1, "b.txt", 2, None)], "answer_id int, source string, chunk int, text string")
    assert [tuple(r) for r in answers.rounding_losses(answer, chunks).collect()] == [(1, "3.14", "million", "3.1", "a.txt", 1)]
