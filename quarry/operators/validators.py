"""Deterministic checks of answers: conflicts between claims, stale periods, untraceable numbers, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["metric", "entity", "scope", "period_key", "kind", "unit", "basis"]


def conflicting_claims(claims: DataFrame, key: str = "answer_id", tolerance: float = 0.02) -> DataFrame:
    """Cells with two values that exclude each other.

    A cell is a change or growth with a known metric and period. It conflicts if it has two different quotes, at most two different values more than
    ``tolerance`` apart, and is not a split of 100 percent.
    """
    known = claims.where((F.col("metric") != "") & (F.col("period_key") != "unknown") & F.col("kind").isin("change", "growth_pct"))
    # A row a different value first: two distinct counts in one aggregation would move each claim three times.
    values = known.groupBy(key, *CELL, F.bround("value", 4).alias("_v")).agg(
        F.min("quote").alias("first"), F.max("quote").alias("last"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"),
    )
    cells = values.groupBy(key, *CELL).agg(
        (F.min("first") < F.max("last")).alias("quoted"), F.count("_v").alias("values"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
    )
    split = (F.col("unit") == "percent") & (F.abs(F.col("total") - 100) <= 1)
    apart = (F.col("high") > 0) & (F.try_divide(F.col("high") - F.col("low"), F.col("high")) > tolerance)
    return cells.where(F.col("quoted") & (F.col("n") >= 2) & ~split & (F.col("values") <= 2) & apart).select(key, *CELL, "low", "high")


def segment_conflicts(claims: DataFrame, key: str = "answer_id") -> DataFrame:
    """Metrics whose reported total change is below the largest segment's and fits no sum of segments.

    A segment's change is the first stated, else the difference of exactly two levels.
    """
    usd = claims.where((F.col("unit") == "USD_M") & (F.col("metric") != ""))
    seg = usd.where((F.col("scope") == "segment") & (F.col("entity") != "")).groupBy(key, "metric", "entity").agg(
        F.min_by(F.when(F.col("kind") == "change", F.col("value")), F.when(F.col("kind") == "change", F.col("seq"))).alias("stated"),
        F.count_if(F.col("kind") == "level").alias("levels"), F.max(F.when(F.col("kind") == "level", F.col("value"))).alias("top"), F.min(F.when(F.col("kind") == "level", F.col("value"))).alias("bottom"),
    )
    changes = seg.withColumn("change", F.coalesce("stated", F.when(F.col("levels") == 2, F.col("top") - F.col("bottom")))).where("change is not null")
    sums = changes.groupBy(key, "metric").agg(F.count("*").alias("segments"), F.sum("change").alias("segment_sum"), F.max("change").alias("largest"), F.min("change").alias("least"))
    whole = usd.where("scope = 'consolidated' AND kind = 'change'").join(sums.where("segments >= 2"), [key, "metric"])
    fits = F.abs(F.col("value") - F.col("segment_sum")) / F.greatest(F.abs(F.col("segment_sum")), F.lit(1e-9)) <= 0.02
    judged = whole.groupBy(key, "metric", "segment_sum", "largest", "least").agg(F.bool_or(fits).alias("fits"), F.min("value").alias("reported"))
    return judged.where("NOT fits AND least > 0 AND reported < largest * 0.98").select(key, "metric", "reported", "largest", "segment_sum")


def authority_conflicts(claims: DataFrame, key: str = "answer_id", weak: str = "news", tolerance: float = 0.02) -> DataFrame:
    """For each value that only ``weak`` sources have, the first value of an authoritative one in the same cell that differs by more than ``tolerance``."""
    cell = ["metric", "entity", "scope", "period_key", "unit"]
    a, b = claims.where(F.col("src") == weak), claims.where(F.col("src") == "authority")
    pairs = a.select(key, *cell, F.col("seq").alias("weak_seq"), F.col("value").alias("weak_value")).join(b.select(key, *cell, F.col("seq").alias("seq"), "value"), [key, *cell])
    off = pairs.where(F.abs(F.col("weak_value") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1e-9)) > tolerance)
    w = Window.partitionBy(key, "weak_seq").orderBy("seq")
    return off.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "weak_seq", "weak_value", "seq", "value")


def stale_periods(chunks: DataFrame, key: str, entity: str = "ticker", rank: str = "fiscal_rank") -> DataFrame:
    """Entities of which the newest cited filing is older than the newest available one."""
    best = chunks.groupBy(key, entity).agg(F.max(rank).alias("available"), F.max(F.when(F.col("cited"), F.col(rank))).alias("used"))
    return best.where("used IS NOT NULL AND used < available")


def check_citations(cited: DataFrame, allowed: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, invented, valid): citations outside and inside the allowed chunks."""
    on = [key, "source", "chunk"]
    both = cited.select(*on, F.lit(True).alias("_cited"), F.lit(False).alias("_ok")).unionByName(allowed.select(*on, F.lit(False).alias("_cited"), F.lit(True).alias("_ok")))
    known = F.col(key).isNotNull() & F.col("source").isNotNull() & F.col("chunk").isNotNull()  # a citation with a null is none of the allowed
    marked = both.groupBy(*on).agg(F.bool_or("_cited").alias("_cited"), (F.bool_or("_ok") & known).alias("_ok")).where("_cited")
    return marked.groupBy(key).agg(F.count_if(~F.col("_ok")).alias("invented"), F.count_if("_ok").alias("valid"))


def accept_revision(before: DataFrame, after: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """(key, accept): no counter has become worse."""
    b, a = before.alias("b"), after.alias("a")
    worse = F.greatest(*[F.coalesce(F.col(f"a.{c}"), F.lit(0)) - F.coalesce(F.col(f"b.{c}"), F.lit(0)) for c in counters], F.lit(0)) > 0
    return b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).select(F.col(f"b.{key}").alias(key), (~worse).alias("accept"))
