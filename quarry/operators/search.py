"""Top-k search over vectors and postings, and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
#: Queries of a block that are multiplied at once.
STRIP = 256
#: Different (query, term) of a batch up to which its side of a join is broadcast.
BROADCAST_ROWS = 1 << 18


def importable(spark) -> None:
    """Lets Python workers of this session import the package."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def top(rows: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each key with their 1-based ``rank``; Spark keeps k rows per key and task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    n = max(1, -(-vectors.count() // size))
    rows = F.struct("id", F.col("v").cast("array<double>").alias("v"))
    return vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("block").agg(F.collect_list(rows).alias("rows"))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, block: int = 2048, drop_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` corpus vectors with the highest cosine for each query.

    ``queries(id, v)`` and ``corpus(id, v)`` are cut into blocks of about ``block`` vectors. Each pair of blocks is
    one matrix product that keeps k rows a query, so what is shuffled grows with queries times corpus blocks, not with the pairs of vectors.
    """
    importable(corpus.sparkSession)
    pairs = _blocks(queries, block).select(F.col("rows").alias("q")).crossJoin(_blocks(corpus, block).select(F.col("rows").alias("c")))

    def unit(rows) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(rows.field("v").flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), -1)
        return rows.field("id").to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (qi, q), (ci, c) = (unit(b.column(j)[i].values) for j in (0, 1))
                for at in range(0, len(qi), STRIP):
                    some = qi[at : at + STRIP]
                    raw = q[at : at + STRIP] @ c.T
                    s = np.where(np.isfinite(raw), np.round(raw, 9), -np.inf)
                    if drop_self:
                        s[some[:, None] == ci[None, :]] = -np.inf
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
                    row, col = np.nonzero((s >= least) & np.isfinite(s))  # the k best of each query and all that tie with the last of them
                    order = np.lexsort((ci[col], -s[row, col], row))
                    row, col = row[order], col[order]
                    first = np.searchsorted(row, np.arange(len(some)))
                    keep = np.arange(len(row)) - first[row] < k
                    row, col = row[keep], col[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(some[row]), pa.array(ci[col]), pa.array(raw[row, col])], names=["query_id", "doc_id", "score"])

    found = pairs.repartition(corpus.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "query_id long, doc_id long, score double")
    return top(found.withColumn("score", F.round("score", 9)), k)


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, term, tf); ``words`` makes the terms, as ``segment.segmenter`` does for texts without spaces."""
    every = docs.select(F.col(id_col).alias("doc_id"), F.explode(words(F.col(text_col))).alias("term"))
    return every.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _asked(queries: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """(query_id, term, qf) of ``queries(query_id, text)``."""
    return postings(queries, "query_id", words=words).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qf"))


def _few(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts frames with as many rows as ``rows`` if these are at most ``BROADCAST_ROWS``; Spark's own estimate knows only the size of the files."""
    return F.broadcast if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x


def _held(docs: DataFrame, terms: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, dl, term, tf) of the ``terms`` that ``docs(doc_id, text)`` have.

    Texts are dealt by their id before they are split, so that counts, scores and the best rows of a task need no
    further shuffle: what moves grows with the texts, not with their words or with the questions that share one.
    """
    every = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    held = every.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term", "left_semi")
    return held.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top-k by dot product of ``queries(query_id, term, w)`` and ``corpus(doc_id, term, w)``: an equi-join on the term and a sum."""
    few = _few(queries)
    pairs = corpus.select("doc_id", "term", F.col("w").alias("cw")).join(few(queries.select("query_id", "term", F.col("w").alias("qw"))), "term")
    return top(pairs.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("cw")).alias("score")), k)


def counts_topk(queries: DataFrame, docs: DataFrame, k: int, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """``sparse_topk`` of the counts of the words of ``queries(query_id, text)`` and ``docs(doc_id, text)``, ids unique; of the documents only words that are asked for are counted."""
    asked = _asked(queries, words)
    held = _held(docs, _few(asked)(asked.select("term").distinct()), words)
    return sparse_topk(asked.select("query_id", "term", F.col("qf").cast("double").alias("w")), held.select("doc_id", "term", F.col("tf").cast("double").alias("w")), k)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """Okapi BM25 of ``queries(query_id, text)`` on ``docs(doc_id, text)``, ids unique; only scores above 0.

    Texts are split twice: for the statistics of all terms, where a null term stands for a document and carries its length, and for
    the counts of terms that are asked for. Scores are rounded, so that ties do not hang on the order of summation. A term
    in more than half of the documents has a negative idf; it gets ``floor`` times the mean idf instead.
    """
    w = F.coalesce(words(F.col("text")), F.array().cast("array<string>"))
    every = docs.select(w.alias("w")).select(F.size("w").alias("dl"), F.explode(F.array_append(F.array_distinct("w"), F.lit(None))).alias("term"))
    counted = every.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("all_dl"))
    asked = _asked(queries, words)
    few = _few(asked)
    # One aggregation serves the totals, the mean and the terms: filters on its results, not on the term, leave it one.
    total = F.broadcast(counted.where("all_dl IS NOT NULL").select(F.col("df").alias("n"), (F.col("all_dl") / F.col("df")).alias("mean_dl")))  # one row
    raw = counted.where("all_dl IS NULL").crossJoin(total).select(F.coalesce("term", F.lit("")).alias("term"), "mean_dl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
    idf = F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw"))
    weighed = raw.join(few(asked), "term").crossJoin(mean).select("term", "query_id", "mean_dl", (F.col("qf") * idf).alias("weight"))
    held = _held(docs, few(asked.select("term").distinct()), words)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl"))
    hit = held.join(few(weighed), "term")
    score = F.sum(F.col("weight") * F.col("tf") * (k1 + 1) / norm)
    return top(hit.groupBy("query_id", "doc_id").agg(F.round(score, 6).alias("score")).where("score > 0"), k)


def fuse(lists: Sequence[DataFrame], k: int, limit: int) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, doc_id, rank): the sum of 1 / (k + rank), ranks from 1; one grouped sum however many lists."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "doc_id", "rank"))
    return top(every.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")), limit)


def merge_variants(lists: Sequence[DataFrame], cap: int) -> DataFrame:
    """All of the first list and the ``cap`` best of each other; of a document met twice the place in the earlier list."""
    every = lists[0].select("query_id", "doc_id", "rank", F.lit(0).alias("list_no"))
    for i, x in enumerate(lists[1:], 1):
        every = every.unionByName(x.where(F.col("rank") <= cap).select("query_id", "doc_id", "rank", F.lit(i).alias("list_no")))
    best = every.groupBy("query_id", "doc_id").agg(F.min(F.struct("list_no", "rank")).alias("at"))
    return best.select("query_id", "doc_id", "at.list_no", "at.rank")


def rerank(pairs: DataFrame, scorer) -> DataFrame:
    """``pairs(query_id, variant, query, doc_id, text)`` scored by ``scorer(query, text)``, a Column or Arrow UDF; the best over variants."""
    scored = pairs.withColumn("score", scorer(F.col("query"), F.col("text")))
    best = scored.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the query's words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q)), F.lit(0.0))
