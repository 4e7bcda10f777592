"""Runs that can be stopped and resumed: records in commits, each named by the settings it was made with."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "batch string, number long, meta map<string,string>"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def commit(rows: DataFrame, path: str, meta: dict) -> str:
    """Adds records to the run; returns the name of the commit.

    The records are written first and named by one row of a second table last. Whoever stops in between leaves
    records that no reader sees; they cost space only. An empty frame makes a commit without records.
    """
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/records/batch={batch}")
    before = _read(spark, f"{path}/commits", COMMITS)
    number = 0 if before is None else (before.agg(F.max("number")).first()[0] or 0) + 1
    named = {k: None if v is None else json.dumps(v, sort_keys=True) for k, v in meta.items()}
    spark.createDataFrame([(batch, number, named)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return batch


def committed(spark: SparkSession, path: str, meta: dict, keys: list[str] | None = None) -> DataFrame | None:
    """The records of all commits whose settings ``keys`` (all of ``meta``) are those of ``meta``; null where there is none.

    An absent setting and a null one are the same; true and "true" are not. ``number`` rises with the commits.
    """
    commits = _read(spark, f"{path}/commits", COMMITS)
    if commits is None:
        return None
    for k in keys if keys is not None else meta:
        wanted = meta.get(k)
        commits = commits.where(F.col("meta")[k].eqNullSafe(F.lit(None if wanted is None else json.dumps(wanted, sort_keys=True))))
    if commits.isEmpty():
        return None
    records = _read(spark, f"{path}/records")
    return None if records is None else records.join(commits.select("batch", "number"), "batch")


def finished(spark: SparkSession, path: str, meta: dict, keys: list[str] | None = None, key: str = "id") -> DataFrame | None:
    """One record of each id that has an answer and no error, that of the newest commit; null as in ``committed``. Records without an id count for nothing."""
    rows = committed(spark, path, meta, keys)
    if rows is None:
        return None
    good = rows.where(F.col(key).isNotNull() & (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("error", F.lit("")) == ""))
    names = [c for c in good.columns if c not in ("batch", "number", key)]
    best = good.groupBy(key).agg(F.max(F.struct("number", "batch", *names)).alias("_r"))
    return best.select(key, *(F.col(f"_r.`{c}`").alias(c) for c in names))


def pending(work: DataFrame, done: DataFrame | None, key: str = "id") -> DataFrame:
    """What of ``work`` is still to be done; work without an id always is."""
    return work if done is None else work.join(done.select(key).distinct(), key, "left_anti")
