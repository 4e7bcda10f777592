from __future__ import annotations

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import freshness
from quarry.sources import runs

D = datetime.date


def test_newest_before_equals_a_search(spark):
    rng = random.Random(2)
    day = lambda: D(2024, 1, 1) + datetime.timedelta(days=rng.randrange(40))
    rows = [(rng.choice("abc"), day()) for _ in range(30)] + [(None, D(2024, 1, 2)), ("a", None)]
    asked = [(i, rng.choice(["a", "b", "c", "d"]), day()) for i in range(200)] + [(200, None, D(2024, 2, 1)), (201, "a", None), (202, "a", D(2023, 1, 1)), (202, "a", D(2023, 1, 1))]
    got = freshness.newest_before(spark.createDataFrame(asked, "i int, ticker string, as_of date"), spark.createDataFrame(rows, "ticker string, date date"))
    want = [(i, t, a, max((d for e, d in rows if e == t and t and d and a and d <= a), default=None)) for i, t, a in asked]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hot_ticker_has_few_rows_in_its_window(spark):
    rows = spark.range(300_000).select(F.lit("hot").alias("ticker"), F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 1000).cast("int")).alias("date"))
    asked = spark.range(300_000).select("id", F.lit("hot").alias("ticker"), F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 1500).cast("int")).alias("as_of"))
    got = freshness.newest_before(asked, rows).agg(F.count("*"), F.count_if(F.col("newest") == F.least("as_of", F.lit(D(2022, 9, 26))))).first()
    assert tuple(got) == (300_000, 300_000)


def test_gaps(spark):
    used = spark.createDataFrame([(1, "A", "news", D(2026, 8, 15)), (1, "A", "news", D(2026, 8, 15)), (2, "B", "news", D(2026, 8, 15)), (3, "A", "10-K", D(2026, 8, 15)), (4, "C", "news", D(2026, 8, 15))], "todo_id int, ticker string, doc_type string, as_of date")
    news = spark.createDataFrame([("A", D(2026, 8, 1)), ("A", D(2026, 7, 1)), ("B", D(2026, 8, 15))], "ticker string, date date")
    assert [tuple(r) for r in freshness.news_gaps(used, news).collect()] == [(1, "A", "2026-08-01", "2026-08-15", "news", "")]
    todos = spark.createDataFrame([(1, "days", ["B", "A"], "web", 0, D(2026, 8, 15)), (2, "none", [], "both", None, D(2026, 8, 15)), (3, "intraday", None, "web", 2, D(2026, 8, 15)), (4, None, None, None, 0, None)], "todo_id int, need string, tickers array<string>, route string, web_notes int, as_of date")
    chunks = spark.createDataFrame([(1, D(2026, 6, 30)), (1, D(2026, 3, 31)), (1, None)], "todo_id int, date date")
    assert sorted(tuple(r) for r in freshness.realtime_gaps(todos, chunks).collect()) == [(1, "A", "2026-06-30", "2026-08-15", "realtime", "days"), (3, "", "", "2026-08-15", "realtime", "intraday")]
    assert sorted(tuple(r) for r in freshness.web_route_gaps(todos, chunks).collect()) == [(1, "", "2026-06-30", "2026-08-15", "realtime", "days"), (2, "", "", "2026-08-15", "realtime", "days")]


META = {"module": "m", "model": None, "web": True, "mode": "live"}
RECORD = "id string, answer string, error string, extra int"


def test_a_run_that_stops_between_two_commits(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/run"
    work = spark.createDataFrame([(f"q{i}",) for i in range(6)] + [(None,)], "id string")
    left = lambda **kw: sorted(r.id or "" for r in runs.pending(work, runs.finished(spark, path, {**META, **kw})).collect())
    rows = lambda *xs: spark.createDataFrame(list(xs), RECORD)
    assert len(left()) == 7
    runs.commit(rows(("q0", "yes", None, 1), ("q1", "", None, 1), ("q2", "no", "timed out", 1), (None, "lost", None, 1)), path, META)
    assert left() == ["", "q1", "q2", "q3", "q4", "q5"]
    made = spark.createDataFrame
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # stops after the records, before the commit
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        runs.commit(made([("q3", "half", None, 2)], RECORD), path, META)
    assert left() == ["", "q1", "q2", "q3", "q4", "q5"]
    runs.commit(rows(("q1", "now", "", 3), ("q3", "whole", None, 3), ("q0", None, "later", 3)), path, META)
    assert left() == ["", "q2", "q4", "q5"]
    runs.commit(rows(("q1", "newer", None, 4)), path, META)
    runs.commit(rows(), path, META)
    done = {r.id: (r.answer, r.extra) for r in runs.finished(spark, path, META).collect()}
    assert done == {"q0": ("yes", 1), "q1": ("newer", 4), "q3": ("whole", 3)}
    assert len(left(web=False)) == 7 and len(left(web="true")) == 7 and len(left(model="x")) == 7
    assert left(other=None) == left()
    assert len(runs.finished(spark, path, {"module": "m", "web": False}, keys=["module"]).collect()) == 3


def test_cover_fields_keeps_what_was_selected(spark):
    row = "query_id int, ticker string, source string, chunk_index int, content string, score double, content2 string"
    sel = spark.createDataFrame([(1, "A", "A_Fundamentals", 1, "Balance", 0.9, None), (1, "B", "B_Fundamentals", 0, "gross MARGIN", 0.8, None)], row)
    ranked = spark.createDataFrame([(1, "A", "A_Fundamentals", 1, "Gross Margin", 0.9, None), (1, "A", "A_News", 0, "Gross Margin", 0.7, None), (1, "A", "A_Fundamentals", 2, "Gross Margin", 0.5, None), (1, "A", "A_Fundamentals", 3, "Gross Margin", 0.5, None)], row)
    want = spark.createDataFrame([(1, t, ["Gross Margin"]) for t in "ABCD"] + [(2, "C", None), (1, None, None)], "query_id int, ticker string, fields array<string>")
    kept = spark.createDataFrame([("C", "TTM", "C_Fundamentals", 0, "GROSS margin", 0.2), ("C", "FY", "C_Fundamentals", 1, "gross margin", 0.9), ("D", "TTM", "D_Fundamentals", 0, None, 1.0)], "ticker string, period_basis string, source string, chunk_index int, content string, score double")
    got = sorted((r.query_id, r.ticker, r.chunk_index, r.level) for r in freshness.cover_fields(ranked, sel, want, kept).collect())
    assert got == [(1, "A", 1, 0), (1, "A", 2, 1), (1, "B", 0, 0), (1, "C", 0, 2)]


def test_stored_rows_are_not_multiplied_by_the_questions(spark):
    keys = spark.range(20_000).select(F.col("id").alias("query_id"))
    row = ["query_id", F.lit("A").alias("ticker"), F.lit("A_News").alias("source"), F.lit(0).alias("chunk_index"), F.lit("x").alias("content"), F.lit(0.1).alias("score")]
    fields = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("Margin"))).otherwise(F.array(F.lit("margin"), F.lit("growth")))
    want = keys.select("query_id", F.lit("A").alias("ticker"), fields.alias("fields"))
    kept = spark.range(20_000).select(F.lit("A").alias("ticker"), F.lit("TTM").alias("period_basis"), F.format_string("Fundamentals_%05d", "id").alias("source"), F.lit(0).alias("chunk_index"), F.when(F.col("id") % 2 == 0, "MARGIN").otherwise("Growth").alias("content"), (F.col("id") % 1000).cast("double").alias("score"))
    out = freshness.cover_fields(keys.select(*row).limit(0), keys.select(*row).limit(0), want, kept)
    started = time.monotonic()
    got = {(r.even, r.source, r.level): r["count"] for r in out.groupBy((F.col("query_id") % 2 == 0).alias("even"), "source", "level").count().collect()}
    assert got == {(True, "Fundamentals_00998", 2): 10_000, (False, "Fundamentals_00999", 2): 10_000}
    assert time.monotonic() - started < 40  # 400 million pairs take minutes
