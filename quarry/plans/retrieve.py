"""The whole retrieval plan for a batch of queries: no loop over queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import ranking, search
from quarry.operators.predicates import Clause, cascade, compile_clauses
from quarry.sources.storage import checkpoint_folder


@dataclass(frozen=True)
class Config:
    """Numbers of the plan: rows a lane gives, rows after fusion, the fusion constant, candidates of each variant, seats, sources a section may fill, rows of an answer."""

    lane: int = 60
    fused: int = 30
    rrf_k: int = 60
    variant_cap: int = 8
    rerank: int = 50
    keep_sources: int = 2
    prefer: str = "rank"
    top_k: int = 5
    clauses: Sequence[Clause] = field(default_factory=tuple)


def retrieve(queries: DataFrame, corpus: DataFrame, cfg: Config = Config(), scorer=search.overlap_score, wanted: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ranked evidence for ``queries(query_id, text)`` from ``corpus(doc_id, text, ticker, source, item_id, fiscal_rank, ...)``.

    Both lanes search under the same predicate; lists are fused by reciprocal rank; candidates are scored again, collapsed by section and cut to
    ``top_k``, and entities of ``wanted(query_id, ticker)`` that lack a row get their best one, so an answer may have more rows. Metadata joins after the lanes, on candidates alone.
    The candidates and their scores are checkpointed, so that the lanes run once, however often collapsing and cover read them.
    """
    admitted = cascade(corpus, list(cfg.clauses)).drop("tier") if cfg.clauses else corpus
    lanes = [search.bm25_topk(queries, admitted.select("doc_id", "text"), cfg.lane)]
    if vectors:
        asked, stored = vectors
        stored = stored.join(admitted.select(F.col("doc_id").alias("id")), "id", "left_semi")
        lanes.append(search.dense_topk(asked, stored, cfg.lane))
    else:
        lanes.append(search.counts_topk(queries, admitted, cfg.lane))
    checkpoint_folder(corpus.sparkSession)
    pool = search.fuse(lanes, cfg.rrf_k, cfg.fused).select("query_id", "doc_id").checkpoint()
    pairs = pool.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(admitted, "doc_id")
    scored = pairs.withColumn("score", F.round(scorer(F.col("query"), F.col("text")), 9)).drop("query", "text").checkpoint()
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    collapsed = ranking.collapse(ranked, ["ticker", "filing_type", "item_id"], "source", cfg.keep_sources, cfg.prefer)
    seated = collapsed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    top = seated.where(F.col("place") <= cfg.top_k).drop("place")
    if wanted is not None:
        top = ranking.cover(collapsed.select(*top.columns), top, wanted, "ticker")
    return top


def evidence_text(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, prompt): the rows of each query in order, numbered and with their source, as one text."""
    line = F.struct("rank", F.col("source"), "doc_id", "text")
    put = lambda x, i: F.concat(F.lit("[Reference "), (i + 1).cast("string"), F.lit(": "), x["source"].cast("string"), F.lit(", chunk #"), x["doc_id"].cast("string"), F.lit("]\n"), x["text"])
    joined = rows.select("query_id", "rank", "doc_id", "source").join(corpus.select("doc_id", "text"), "doc_id")
    return joined.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("rows")).select("query_id", F.array_join(F.transform("rows", put), "\n\n").alias("prompt"))


def admitted(corpus: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """Rows that all clauses admit; plain comparisons reach the scan."""
    return corpus.where(compile_clauses(corpus.schema, clauses, scan=True))
