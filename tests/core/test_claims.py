from __future__ import annotations

from quarry.operators import validators


def test_claims_are_not_multiplied(spark):
    row = "answer_id int, metric string, entity string, scope string, period_key string, kind string, unit string, basis string, value double, quote string"
    cell = lambda i, *vs: [(i, "m", "", "", "2024", "change", "USD_M", "reported", v, q) for v, q in vs]
    rows = cell(1, (1.0, "a"), (2.0, "b"), (2.0, "b")) + cell(2, (1.0, "a"), (2.0, "a")) + cell(3, (1.0, "a"), (2.0, "b"), (3.0, "c")) + cell(4, (1.0, "a"), (None, None), (3.0, "b")) + cell(5, (1.0, "a"), (1.00001, "b"), (3.0, None))
    out = validators.conflicting_claims(spark.createDataFrame(rows, row))
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.answer_id, r.low, r.high) for r in out.collect()) == [(1, 1.0, 2.0), (4, 1.0, 3.0), (5, 1.0, 3.0)]


def test_citations_meet_what_is_allowed_in_one_aggregation(spark):
    row = "answer_id int, source string, chunk int"
    cited = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, None, 1), (None, "a", 1)], row)
    allowed = spark.createDataFrame([(1, "a", 1), (1, "c", 3), (2, None, 1), (None, "a", 1), (3, "a", 1)], row)
    out = validators.check_citations(cited, allowed)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, 1, 1), (2, 1, 0), (None, 1, 0)], key=str)
