from __future__ import annotations

from quarry.plans import agent


def test_waves_move_a_plan_once(spark):
    rows = [("a", 0, None), ("a", 1, 0), ("a", 2, 1), ("a", 3, 9), ("a", 4, 2), ("a", 5, 4), ("a", 6, 5), ("b", 1, 2), ("b", 2, None), ("c", 0, 1), ("c", 1, 0)]
    out = agent.wave_numbers(spark.createDataFrame(rows, "query_id string, id long, depends_on int"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.id): r.wave for r in out.collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 2, ("a", 3): None, ("a", 4): 3, ("a", 5): 4, ("a", 6): 5, ("b", 1): 1, ("b", 2): 0, ("c", 0): None, ("c", 1): None}
