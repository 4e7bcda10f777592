"""Lenient JSON and plans of sub-questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTES = ("kb", "web", "both")


def lenient(text: Column) -> Column:
    """The text as VARIANT: without a code fence, else its first [...] or {...}; null if nothing parses."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```(?:json)?\s*|\s*```$", ""))
    return F.coalesce(*[F.try_parse_json(c) for c in (s, F.nullif(F.regexp_extract(s, r"(?s)(\[.*\])", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit("")))])


def truthy(text: Column) -> Column:
    """A said yes; anything else is no, null included."""
    # Fixed values.
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y", "夠", "足夠", "充足"), F.lit(False))


def plan_items(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, id, task, route, depends_on, deps_declared) of plans written as JSON arrays.

    A string is a task on route kb; an object has its own route, ``both`` if it is none of the known ones. Whether
    a dependency was declared is told by the key being there, null included. Other items are dropped; ids are positions among what stays.
    """
    items = rows.select(key, F.posexplode(F.from_json(F.to_json(lenient(F.col(raw))), "array<string>")).alias("pos", "item"))
    obj = F.col("item").startswith("{")
    body = F.when(obj, F.col("item"))
    keys = F.json_object_keys(body)
    route = F.lower(F.trim(F.coalesce(F.get_json_object(body, "$.route"), F.lit(""))))
    is_text = ~obj & ~F.col("item").startswith("[") & ~F.col("item").rlike(r"^(-?[0-9.]+([eE][-+]?[0-9]+)?|true|false|null)$")
    parsed = items.select(
        key, "pos", F.trim(F.coalesce(F.when(obj, F.get_json_object(body, "$.task")), F.when(is_text, F.col("item")), F.lit(""))).alias("task"),
        F.when(~obj, F.lit("kb")).when(route.isin(*ROUTES), route).otherwise(F.lit("both")).alias("route"),
        F.when(obj, F.get_json_object(body, "$.depends_on")).try_cast("int").alias("depends_on"),
        F.coalesce(obj & F.array_contains(keys, "depends_on"), F.lit(False)).alias("deps_declared"),
    ).where("task <> ''")
    return parsed.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).drop("pos")


def prune_dependencies(plan: DataFrame) -> DataFrame:
    """Dependencies only on earlier items; others become null and are marked ``pruned``. So no cycle is left."""
    bad = F.col("depends_on").isNotNull() & ~F.coalesce((F.col("depends_on") >= 0) & (F.col("depends_on") < F.col("id")), F.lit(False))
    return plan.withColumn("pruned", bad).withColumn("depends_on", F.when(~bad, F.col("depends_on")))


def unresolved(task: Column, mentioned: Column, back_reference: str) -> Column:
    """A placeholder like #1, or a back reference where nobody is named."""
    return task.rlike(r"#\d+") | (task.rlike(back_reference) & (F.size(mentioned) == 0))


def fill(task: Column, entity: Column, mentioned: Column, back_reference: str) -> Column:
    """The task with its placeholder or back reference replaced by the entity, which else goes before a task that names nobody."""
    return (
        F.when(task.rlike(r"#\d+"), F.regexp_replace(task, r"#\d+", entity))
        .when(task.rlike(back_reference), F.regexp_replace(task, F.lit(back_reference), entity))
        .when(F.size(mentioned) == 0, F.concat_ws(" ", entity, task)).otherwise(task)
    )


def effective_route(route: Column, live: Column, web: Column) -> Column:
    """The web only where the run is live and the web is on."""
    return F.when(live & web, route).otherwise(F.lit("kb"))


def escalated(route: Column, sufficient: Column, fixable: Column) -> Column:
    """From kb to web where evidence is short and no rewrite can help."""
    return F.when((route == "kb") & ~sufficient & ~fixable, F.lit("web")).otherwise(route)


def request_key(query: Column, most: Column, depth: Column, domains: Column) -> Column:
    """Canonical JSON of a web request, its domains sorted."""
    return F.to_json(F.struct(F.array_sort(domains).alias("include_domains"), most.alias("max_results"), query.alias("query"), depth.alias("search_depth")))
