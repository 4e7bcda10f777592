from __future__ import annotations

import datetime
import itertools
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import overlay
from quarry.operators.predicates import clause, compile_clauses
from quarry.streaming import incremental

ROW = "id int, ticker array<string>, fiscal_year string, report_label_year string, filing_type string, values string"


@pytest.mark.parametrize(
    ("query", "decision", "want"),
    [
        ("Apple in 2024", '{"filters": [{"field": "ticker", "value": "MSFT"}, {"field": "fiscal_year", "value": 2024, "polarity": "exclude"}]}', [("ticker", ["MSFT"], True), ("fiscal_year", ["2024"], False)]),
        ("Apple and Nvidia", '{"filters": [{"field": "ticker", "value": "MSFT"}]}', [("ticker", ["AAPL", "NVDA"], True)]), ("fiscal 202403", "nonsense", [("report_period_code", ["202403"], True)]),
        ("fiscal", '{"filters": [3, null, "x", {"field": "other", "value": "a"}, {"field": "ticker", "value": null}, {"field": "ticker", "value": ""}]}', []),
        ("fiscal", '[1, 2]', []), ("fiscal", '{"filters": 5}', []), ("fiscal", None, []), (None, '{"filters": [{"field": "ticker", "value": "MSFT"}]}', []), ("", "", []),
    ],
)
def test_filters(spark, query, decision, want):
    r = spark.createDataFrame([(query, decision)], "q string, d string").select(overlay.filters(F.col("q"), F.col("d"))).first()[0]
    assert [tuple(x) for x in r] == want


def test_admits_is_compile_clauses(spark):
    rows = [(1, ["A"], "2024", None, "10-K", "x"), (2, ["A", "B"], "2023", "2024", None, None), (3, [], None, None, "10-Q", ""), (4, None, None, "2023", None, None)]
    df = spark.createDataFrame(rows, ROW)
    made = [clause("ticker", "A"), clause("ticker", ["B", "C"], include=False), clause("fiscal_year", "2024"), clause("fiscal_year", "2023", include=False), clause("filing_type", ["10-K", "10-Q"]), clause("period_basis", "TTM"), clause("period_basis", "TTM", include=False)]
    sets = [list(c) for n in (0, 1, 2) for c in itertools.combinations(made, n)]
    given = spark.createDataFrame([(i, [(c.field, list(c.values), c.include) for c in s]) for i, s in enumerate(sets)], f"i int, filters {overlay.FILTERS}")
    got = {(r.i, r.id) for r in given.join(df).where(overlay.admits(F.col("filters"), df.schema)).collect()}
    assert got == {(i, r.id) for i, s in enumerate(sets) for r in df.where(compile_clauses(df.schema, s)).collect()}


@pytest.mark.parametrize("keep", [None, 3600, 0.5])
def test_first_seen_over_restarts(spark, tmp_path, keep):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))

    def step(*keys):
        spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, n int").parquet(source)
        life = None if keep is None else datetime.timedelta(seconds=keep)
        q = incremental.first_seen(stream, "k", life).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        q = (q.trigger(availableNow=True) if keep is None else q.trigger(processingTime="1 second")).start()
        try:
            if keep is None:
                assert q.awaitTermination(100)
            else:
                for _ in range(300):
                    time.sleep(0.2)
                    if q.exception() or any(p["numInputRows"] for p in q.recentProgress):
                        break
                assert not q.exception() and any(p["numInputRows"] for p in q.recentProgress)
        finally:
            q.stop()
        return sorted(r.k or "" for r in spark.read.parquet(out).collect())

    assert step("a", "b", "a", None) == ["", "a", "b"]
    time.sleep(1.0)
    forgets = keep == 0.5
    assert step("b", "c", "c") == sorted(["", "a", "b", "c"] + ["b"] * forgets)
