"""Reading the tables of a folder, and views over them in the terms of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ranking import fiscal_rank


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; filters and columns reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the table is there and has a row: one row is looked for, none are counted."""
    from pyspark.errors import AnalysisException

    try:
        return not table(spark, folder, name).limit(1).isEmpty()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as filings: a customer is an issuer, urgent and high orders are annual reports."""
    o = table(spark, folder, "orders")
    annual = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    year = F.year("o_orderdate").cast("string")
    period = F.when(annual, F.lit("FY")).otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    code = F.when(annual, year).otherwise(F.date_format("o_orderdate", "yyyyMM"))
    return o.select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("source"),
        F.when(annual, F.lit("10-K")).otherwise(F.lit("10-Q")).alias("kind"), year.alias("fiscal_year"), period.alias("fiscal_period"), code.alias("period_code"),
        fiscal_rank(year, period).alias("fiscal_rank"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("filed"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, v, label) of the embeddings."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels as chunk metadata; labels cover a part, so there are real nulls."""
    d, l = table(spark, folder, "documents"), table(spark, folder, "labels")  # noqa: E741
    meta = l.select("doc_id", F.col("quality").cast("string").alias("fiscal_year"), F.col("toxic").cast("string").alias("report_label_year"))
    return d.select("doc_id", F.col("lang").alias("ticker"), F.col("source").alias("filing_type")).join(meta, "doc_id", "left")
