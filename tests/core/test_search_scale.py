from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans import retrieve


def corpus(spark, n=400):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 9), lambda i: F.concat(F.lit("w"), ((F.col("doc_id") * 7 + i * i) % 23).cast("string"))), " ")
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", words.alias("text"), F.lit("en").alias("ticker"), (F.col("doc_id") % 3).cast("string").alias("source"), F.lit("10-K").alias("filing_type"), F.lit("1").alias("item_id"), F.col("doc_id").alias("fiscal_rank"))


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w2 w5"), (2, "w3"), (3, "none"), (4, None)], "query_id long, text string")


def test_scores_are_summed_where_the_document_lies(spark):
    for find in (search.bm25_topk, search.counts_topk):
        plan = find(asked(spark), corpus(spark).select("doc_id", "text"), 5)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#", plan)


def test_large_batches_of_queries_give_the_same(spark, monkeypatch):
    docs = corpus(spark).select("doc_id", "text")
    for find in (search.bm25_topk, search.counts_topk):
        want = sorted(tuple(r) for r in find(asked(spark), docs, 5).collect())
        with monkeypatch.context() as m:
            m.setattr(search, "BROADCAST_ROWS", 1)
            assert sorted(tuple(r) for r in find(asked(spark), docs, 5).collect()) == want
        assert {r[0] for r in want} == {1, 2}
    assert find(asked(spark), docs.limit(0), 5).collect() == search.bm25_topk(asked(spark), docs.limit(0), 5).collect() == []


def test_candidates_of_a_plan_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scorer(query, text):
        calls.add(1)
        return float(len(text) % 7)

    wanted = spark.createDataFrame([(1, "en"), (1, "fr"), (2, "en"), (2, "fr")], "query_id long, ticker string")
    got = retrieve.retrieve(asked(spark), corpus(spark), retrieve.Config(fused=10), scorer=scorer, wanted=wanted).collect()
    assert {r.query_id for r in got} == {1, 2} and calls.value == 20
