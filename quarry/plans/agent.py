"""Planning and execution of sub-questions over frames: waves, budgets, re-planning, synthesis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.sources.storage import checkpoint_folder

#: Limits of a run: sub-questions of a plan, waves of execution.
MAX_TODOS, MAX_WAVES = 7, 8


def todos(plan: DataFrame) -> DataFrame:
    """The first ``MAX_TODOS`` items of each plan, pending; what depends on an item that was cut does not depend on anything."""
    cut = plan.where(F.col("id") < MAX_TODOS)
    return cut.withColumn("depends_on", F.when(F.col("depends_on") < MAX_TODOS, F.col("depends_on"))).withColumn("status", F.lit("pending"))


def wave_numbers(plan: DataFrame) -> DataFrame:
    """Todos with the ``wave`` in which they can run: 0 without a dependency, else one after it.

    A plan has at most ``MAX_TODOS`` items with different ids, so it is one row while ``MAX_TODOS - 1`` steps settle them: plans move once, whatever the number of steps.
    """
    columns = plan.columns
    whole = plan.groupBy("query_id").agg(F.collect_list(F.struct(*columns)).alias("_t"))
    rows = F.col("_t")
    before = lambda x, m: F.get(F.filter(m, lambda y: y["id"] == x["depends_on"]), F.lit(0))["wave"]
    wave = lambda x, m: F.when(x["depends_on"].isNull(), F.lit(0)).otherwise(before(x, m) + 1)
    step = lambda m: F.transform(rows, lambda x: F.struct(x["id"].alias("id"), wave(x, m).alias("wave")))
    start = F.transform(rows, lambda x: F.struct(x["id"].alias("id"), F.when(x["depends_on"].isNull(), F.lit(0)).alias("wave")))
    settled = whole.withColumn("_m", F.aggregate(F.sequence(F.lit(2), F.lit(MAX_TODOS - 1)), start, lambda m, _: step(m)))
    each = settled.select("_m", F.explode("_t").alias("_x"))
    return each.select(*[F.col(f"_x.`{c}`").alias(c) for c in columns], wave(F.col("_x"), F.col("_m")).alias("wave"))


def run_waves(plan: DataFrame, execute: Callable[[DataFrame, DataFrame | None], DataFrame], waves: int = MAX_WAVES) -> DataFrame:
    """Rows of ``execute(ready, found so far)`` of all waves. A wave's rows are checkpointed, so the plan of a late wave does not hold the earlier ones."""
    checkpoint_folder(plan.sparkSession)
    numbered = wave_numbers(plan).checkpoint()
    last = numbered.agg(F.max("wave")).first()[0]
    found = None
    for w in range(min(waves, (last if last is not None else -1) + 1)):
        made = execute(numbered.where(F.col("wave") == w), found).checkpoint()
        found = made if found is None else found.unionByName(made)
    return found


def parent_entities(found: DataFrame, entity: str = "ticker") -> DataFrame:
    """(query_id, id, entity): the entity most rows of a todo have; of equals the one seen first."""
    counts = found.where(F.col(entity).isNotNull()).groupBy("query_id", "id", entity).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return counts.groupBy("query_id", "id").agg(F.max_by(entity, F.struct("n", -F.col("first"))).alias("entity"))


def contributions(found: DataFrame) -> DataFrame:
    """For each todo its rows, those no earlier todo of the query had, and those cited."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("id")
    marked = found.withColumn("new", F.row_number().over(first) == 1)
    return marked.groupBy("query_id", "id").agg(F.count("*").alias("picked"), F.count_if("new").alias("new"), F.count_if(F.col("new") & F.col("cited")).alias("new_cited"))


def synthesise(found: DataFrame) -> DataFrame:
    """Rows for the answer to each query: in turns over its todos, as many as its facets allow."""
    facets = found.groupBy("query_id").agg(F.count_distinct("id").alias("facets"))
    turn = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "doc_id"))
    dealt = found.withColumn("turn", turn).withColumn("seat", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "id")))
    return dealt.join(facets, "query_id").where(F.col("seat") <= ranking.writer_budget(F.col("facets"))).drop("facets")
