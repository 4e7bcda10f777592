"""Grounding and positional functions bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import positional
from quarry.operators import grounding
from quarry.plans.text_queries import literal as frame
from quarry.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""WITH l AS (SELECT item_id AS literal_id, text AS literal FROM benchmark) SELECT literal_id, doc_id FROM l JOIN documents ON contains(lower(text), lower(literal))""")
def literal_sources(spark, d):
    literals = table(spark, d, "benchmark").select(F.col("item_id").alias("literal_id"), F.col("text").alias("literal"))
    return grounding.locate(literals, table(spark, d, "documents").select("doc_id", "text"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_partkey AS source, l_linenumber AS chunk FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS source, l_linenumber AS chunk FROM lineitem WHERE l_linestatus = 'O' OR l_linenumber % 2 = 0)
    SELECT id, source, chunk, (id, source) IN (SELECT id, source FROM g) AS source_there FROM r WHERE (id, source, chunk) NOT IN (SELECT id, source, chunk FROM g)""")
def required_chunks(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("chunk"), "l_returnflag", "l_linestatus")
    return grounding.required_chunks(i.where("l_returnflag = 'R'").select("id", "source", "chunk"), i.where("l_linestatus = 'O' OR chunk % 2 = 0").select("id", "source", "chunk"))


_CHUNKS = [(1, "Margin was 12.5% in the quarter", "9M@2026-03", "10-Q"), (1, "also 12.5% here", "9M@2026-03", "news"), (1, "growth 7.1%", "3M@2026-03", "10-Q"), (1, "growth 7.1%", "6M@2025-12", "10-K"), (2, "112.5% is another", "3M@2026-03", "10-Q")]
_CLAIMS = [(1, 1, "12.5%", "unknown"), (1, 2, "7.1%", "kept"), (2, 1, "12.5%", "kept"), (3, 1, "1%", "kept")]


@query("SELECT * FROM (VALUES (1, 1, '9M@2026-03', '10-Q|news'), (1, 2, 'kept', '10-K|10-Q'), (2, 1, 'kept', ''), (3, 1, 'kept', '')) v(answer_id, seq, period, types)")
def grounded_claims(spark, d):
    chunks = frame(spark, _CHUNKS, "answer_id int, text string, chunk_period string, kind string")
    claims = frame(spark, _CLAIMS, "answer_id int, seq int, literal string, period string")
    types = grounding.source_types(claims, chunks)
    return grounding.grounded_periods(claims, chunks).join(types, ["answer_id", "seq"]).select("answer_id", "seq", "period", F.array_join("types", "|").alias("types"))


@query("SELECT * FROM (VALUES (1, '12.5|7.0', '2026-07-28'), (2, '', '2026-01-02'), (3, '', NULL), (4, '', NULL), (5, '-1000.0', '2026-01-02')) v(id, percents, day)")
def positional_matches(spark, d):
    rows = [(1, "Margin rose to 12.5% while margin of others was 7% " + "x" * 80 + " 99%. Updated: July 28, 2026"), (2, "At close: December 31 | Published 1/2/26"), (3, None), (4, "Updated | July 1, 2026"), (5, "margin -1,000 %. posted 2026-01-02. as of 2027-01-01")]
    t = frame(spark, rows, "id int, body string").withColumn("as_of", F.lit("2026-08-01").cast("date"))
    p = positional.anchored_percents(F.col("body"), F.lit("margin"))
    return t.select("id", F.array_join(p.cast("array<string>"), "|").alias("percents"), positional.published_in(F.col("body"), F.col("as_of")).cast("string").alias("day"))
