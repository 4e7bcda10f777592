from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from quarry.functions import amounts, positional


def one(spark, column, text, **more):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_written_double(spark):
    cases = {
        "$5 million dollars": "0.05 億美元（$5 million）", "5 millionaires": "5 millionaires", None: "", "$3.2B and $45M, $2T": "32 億美元（$3.2 billion） and 0.45 億美元（$45 million）, 20,000 億美元（$2 trillion）",
        "$119,796 百萬元": "1,197.96 億美元（$119,796 百萬）", "300 million users": "3 億（300 million） users", "15 億美元": "15 億美元", "1.5 billion 歐元": "15 億（1.5 billion） 歐元", "US$ 2 bn": "20 億美元（US$2 bn）",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "answer_id int, text string")
    got = {r.answer_id: r.text for r in amounts.double_written(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_own_conversions(spark):
    cases = {
        "約 15 億美元": ("約 15 億美元", 0), "$1.5 billion（約 15 億美元）及 2 億美元": ("$1.5 billion及 2 億美元", 1), "15 億美元（$1.5 billion） rose": ("$1.5 billion rose", 1), "$54.5 億（$54.5 billion）": ("$54.5 billion", 1),
        "716,924 百萬美元（即 716.924 億美元）又 3 billion (30 億) 。": ("716,924 百萬美元又 3 billion 。", 2), "20 億（$2 billion（20 億））": ("$2 billion", 2), "20 億（其中 3 billion）": ("20 億（其中 3 billion）", 0), None: ("", 0),
    }
    got = {r.answer_id: (r.text, r.removed) for r in amounts.without_own(spark.createDataFrame(list(enumerate(cases)), "answer_id int, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_repair_needs_evidence(spark):
    cases = [
        ("84.75 億美元", "at $84.75 billion", "847.5 億美元（$84.75 billion）", 1), ("84.75 億", "$84.75 billion", "84.75 億", 0), ("84.75 億美元", "$8.475 billion and $84.75 billion", "84.75 億美元", 0), ("84.75 億美元", "$8,475 million; $84.75B", "84.75 億美元", 0),
        ("10 億使用者", "$10 billion", "10 億使用者", 0), ("$3 億（其中）", "$3B", "30 億美元（$3 billion）（其中）", 1), ("84.75 億美元 or $84.75 billion", "none", "847.5 億美元 or 847.5 億美元（$84.75 billion）", 1), ("5 億元", "$5 billion", "5 億元", 0), (None, None, "", 0),
    ]
    answers = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "answer_id int, text string")
    contexts = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "answer_id int, text string")
    got = {r.answer_id: (r.text, r.repaired) for r in amounts.finalised(answers, contexts).collect()}
    assert [got[i] for i in range(len(cases))] == [(c[2], c[3]) for c in cases]


def test_values(spark):
    assert set(one(spark, amounts.money_values(F.col("t")), "15 億美元, $3億, 10 億使用者, 2億元")) == {Decimal(15), Decimal(3)}
    assert one(spark, amounts.spelt(F.lit(1234.5)), "") == ["1234.5", "1,234.5"] and one(spark, amounts.spelt(F.lit(3)), "") == ["3"]
    assert [tuple(x) for x in one(spark, amounts.stated(F.col("t")), "1,602.1 億美元（$160.21 billion）, then $5 million")] == [(0, 160210.0), (35, 5.0)]
    assert one(spark, amounts.wrong_twice(F.col("t")), "1,602.1 億美元（$160.21 billion） 847.5 億美元（$847.5 billion）")[0].said.startswith("847.5")


def test_dates_that_markers_point_to(spark):
    cases = {
        "At close: August 31 at 4:00": (2025, 8, 31), "AT CLOSE 4:00 PM EDT 07/28/26": (2026, 7, 28), "Pre-Market: 9:06 AM [...] | Jul 8, 2026 |": None, "Updated on 2026-07-02. Published Jun 3, 2026": (2026, 6, 3),
        "Next earnings Nov 17, 2026": None, "as of Nov 17, 2026": None, "Real Time quote Jul 1, 2026": (2026, 7, 1), "posted " + "x" * 60 + " 2026-01-01": None, "as of 2026-02-30": None, None: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, t string").select("id", positional.published_in(F.col("t"), F.lit("2026-08-01").cast("date")).alias("day"))
    got = {r.id: r.day for r in rows.collect()}
    assert [got[i] for i in range(len(cases))] == [d and datetime.date(*d) for d in cases.values()]


def test_answers_are_read_once(spark):
    """Three readings, each with four searches a group, took 0.8 ms a row."""
    answers = spark.createDataFrame([(1, "84.75 億美元")], "answer_id int, text string")
    contexts = spark.createDataFrame([(1, "$84.75 billion")], "answer_id int, text string")
    plan = amounts.finalised(answers, contexts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # answers and contexts, one time each


def test_long_numbers_stay_as_they_are(spark):
    """Numbers beyond a decimal's digits are neither dropped with the text before them nor an error."""
    cases = {"then 12345678901234567890123 million, and more": "then 12345678901234567890123 million, and more", "1234567890123456789012 億美元": "1234567890123456789012 億美元", "so 123456789012345678901234 億美元 and $5 million": "so 123456789012345678901234 億美元 and 0.05 億美元（$5 million）"}
    answers = spark.createDataFrame(list(enumerate(cases)), "answer_id int, text string")
    contexts = spark.createDataFrame([(i, "$5 billion") for i in range(3)], "answer_id int, text string")
    got = {r.answer_id: (r.text, r.repaired) for r in amounts.finalised(answers, contexts).collect()}
    assert [got[i] for i in range(3)] == [(t, 0) for t in cases.values()]


def test_evidence_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(amounts, "LISTED", 2, raising=False)
    many = " and ".join(f"${i} billion" for i in range(2, 12))
    cases = [
        ("84.75 億美元", [many, "$84.75 billion"], "847.5 億美元（$84.75 billion）", 1), ("84.75 億美元", ["$84.75 billion", many, "$8,475 million"], "84.75 億美元", 0), ("30 億美元, 5 億美元, 110 億美元", [many], "30 億美元, 50 億美元（$5 billion）, 110 億美元", 1),
        ("84.75 億美元 or $84.75 billion", [many], "847.5 億美元 or 847.5 億美元（$84.75 billion）", 1), ("84.75 億美元 or $84.75 billion", [many, "$8.475 billion"], "84.75 億美元 or 847.5 億美元（$84.75 billion）", 0), ("84.75 億美元", [], "84.75 億美元", 0),
    ]
    answers = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(None, "$5 million")], "answer_id int, text string")
    contexts = spark.createDataFrame([(i, t) for i, c in enumerate(cases) for t in c[1]] + [(None, "$5 billion")], "answer_id int, text string")
    got = {r.answer_id: (r.text, r.repaired) for r in amounts.finalised(answers, contexts).collect()}
    assert [got[i] for i in range(len(cases))] == [(c[2], c[3]) for c in cases] and got[None] == ("0.05 億美元（$5 million）", 0)


def test_texts_that_hold_the_marks(spark):
    """Matches are found by marks in the text; a text with marks of its own gives the same."""
    from quarry.functions import spans

    texts = ["a 5 億\x01 6 億", "\x02\x017 億\x02", "\x01", "8 億", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", spans.matches(F.col("t"), r"(\d) (億)", 2).alias("m"), spans.tail(F.col("t"), r"(\d) (億)").alias("rest")).collect()
    found = {r.id: ([(m.at, m.before, m.g0, m.g1, m.g2) for m in r.m], r.rest) for r in got}
    assert found == {0: ([(0, "a ", "5 億", "5", "億"), (1, "\x01 ", "6 億", "6", "億")], ""), 1: ([(0, "\x02\x01", "7 億", "7", "億")], "\x02"), 2: ([], "\x01"), 3: ([(0, "", "8 億", "8", "億")], ""), 4: ([], "")}
