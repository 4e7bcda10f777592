"""Search, fusion, predicates and ranking bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import metrics, ranking, search
from quarry.operators.predicates import cascade, clause, compile_clauses, qualified, tiers
from quarry.sources.tables import chunks, filings, table, vectors

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)"
_DENSE = f"""
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, q.label AS ql, c.label AS cl, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS raw
          FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM s),
    dense AS (SELECT query_id, doc_id, ql, cl, round(raw, 6) AS score, rank FROM r WHERE rank <= 10)"""


def _dense(spark, d, k=10):
    v = vectors(spark, d)
    return search.dense_topk(v.where("id % 20 = 0").select("id", "v"), v.select("id", "v"), k, drop_self=True)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(spark, d):
    return _dense(spark, d).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS rank
    FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.label IN (1, 3, 5)) SELECT * FROM s WHERE rank <= 5""")
def dense_topk_filtered(spark, d):
    v = vectors(spark, d)
    fits = compile_clauses(v.schema, [clause("label", [1, 3, 5])])
    return search.dense_topk(v.where("id % 20 = 0").select("id", "v"), v.where(fits).select("id", "v"), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {_DENSE},
    rel AS (SELECT q.vec_id AS query_id, count(*) AS n_rel FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND q.label = c.label GROUP BY 1),
    h AS (SELECT query_id, ql % 2 AS category, rank, (ql = cl)::INT AS hit, sum((ql = cl)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM dense),
    m AS (SELECT query_id, category, sum(hit)::DOUBLE / coalesce(any_value(n_rel), 0) AS recall, sum(hit)::DOUBLE / count(*) AS precision,
          coalesce(sum(hit * upto::DOUBLE / rank) / least(10, any_value(n_rel)), 0) AS ap, coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0) AS rr
          FROM h LEFT JOIN rel USING (query_id) GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM m)
    SELECT coalesce(category::VARCHAR, 'overall') AS category, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(f1), 4) AS f1,
      round(avg(ap), 4) AS ap, round(avg(rr), 4) AS mrr, count(*) AS n FROM f GROUP BY GROUPING SETS ((category), ())""")
def ir_metrics(spark, d):
    v = vectors(spark, d)
    found = _dense(spark, d)
    label = v.select(F.col("id").alias("doc_id"), F.col("label").alias("doc_label"))
    asked = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    marked = found.join(asked, "query_id").join(label, "doc_id").withColumn("hit", (F.col("query_label") == F.col("doc_label")).cast("int"))
    sizes = label.groupBy("doc_label").agg(F.count("*").alias("n"))
    relevant = asked.join(sizes, F.col("query_label") == F.col("doc_label")).select("query_id", (F.col("n") - 1).alias("n_rel"))
    per_query = metrics.ranked_metrics(marked.select("query_id", "rank", "hit"), relevant, 10)
    return metrics.by_category(per_query.join(asked.select("query_id", (F.col("query_label") % 2).cast("string").alias("category")), "query_id"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_TF = f"""
    t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    q AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL)"""
_BM25 = f"""{_TF},
    dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
    st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) AS total),
    ir AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, st GROUP BY term),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ir) ELSE raw END AS idf FROM ir),
    sc AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS raw
           FROM qf JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL HAVING raw > 0),
    bm25 AS (SELECT query_id, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20)"""


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d, k=20):
    return search.bm25_topk(_asked(spark, d), table(spark, d, "documents").select("doc_id", "text"), k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark, d):
    return _bm25(spark, d)


_SPARSE = f"""{_TF}, sd AS (SELECT query_id, doc_id, sum(qf * tf)::DOUBLE AS score FROM qf JOIN tf USING (term) GROUP BY ALL),
    sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sd QUALIFY rank <= 20)"""


def _sparse(spark, d):
    return search.counts_topk(_asked(spark, d), table(spark, d, "documents"), 20)


@query(f"WITH {_SPARSE} SELECT query_id, doc_id, score, rank FROM sparse")
def sparse_topk(spark, d):
    return _sparse(spark, d)


_LANES = f"WITH {_BM25}, sd AS (SELECT query_id, doc_id, sum(qf * tf)::DOUBLE AS score FROM qf JOIN tf USING (term) GROUP BY ALL), sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sd QUALIFY rank <= 20)"


@query(f"""{_LANES}, u AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM sparse),
    f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS raw FROM u GROUP BY ALL)
    SELECT query_id, doc_id, round(raw, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_hybrid(spark, d):
    lanes = [_bm25(spark, d), _sparse(spark, d)]
    every = lanes[0].select("query_id", "doc_id", "rank").unionByName(lanes[1].select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return search.top(fused, 10)


@query(f"""{_LANES}, u AS (SELECT query_id, doc_id, rank, 0 AS list_no FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1 FROM sparse WHERE rank <= 8)
    SELECT query_id, doc_id, list_no, rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list_no, rank) = 1""")
def variant_merge(spark, d):
    return search.merge_variants([_bm25(spark, d), _sparse(spark, d)], 8)


@query(f"""WITH qt AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS qw FROM benchmark), dt AS (SELECT doc_id, {_TOKENS} AS dw FROM documents),
    {_BM25}, p AS (SELECT query_id, doc_id, len(list_intersect(qw, dw)) / len(qw)::DOUBLE AS score FROM bm25 JOIN qt USING (query_id) JOIN dt USING (doc_id))
    SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p""")
def rerank_pool(spark, d):
    pool = _bm25(spark, d).select("query_id", "doc_id")
    pairs = pool.join(_asked(spark, d).withColumnRenamed("text", "query"), "query_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return search.rerank(pairs, search.overlap_score).withColumn("score", F.round("score", 9))


_CHUNKS = "c AS (SELECT doc_id, lang AS ticker, source AS filing_type, quality::VARCHAR AS fiscal_year, toxic::VARCHAR AS report_label_year FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {_CHUNKS} SELECT doc_id,
    ticker IN ('en', 'fr') AS in_list, coalesce(fiscal_year = '1' OR report_label_year = '1', false) AS year_strict,
    coalesce(fiscal_year = '1', false) OR fiscal_year IS NULL OR coalesce(report_label_year = '1', false) AS year_soft,
    coalesce(fiscal_year = '1', false) OR fiscal_year IS NULL AS year_relaxed,
    NOT (coalesce(fiscal_year = '1', false) OR coalesce(report_label_year = '1', false)) AS year_out,
    coalesce(report_label_year = '0', false) OR report_label_year IS NULL AS label_soft FROM c""")
def filter_truth_table(spark, d):
    c = chunks(spark, d)
    of = lambda *cs, **kw: compile_clauses(c.schema, cs, **kw)
    year = clause("fiscal_year", "1")
    return c.select(
        "doc_id", of(clause("ticker", ["en", "fr"])).alias("in_list"), of(year).alias("year_strict"), of(year, strict=False).alias("year_soft"),
        of(year, relaxed=["fiscal_year"]).alias("year_relaxed"), of(clause("fiscal_year", "1", include=False)).alias("year_out"),
        of(clause("report_label_year", "0"), strict=False).alias("label_soft"),
    )


@query(f"""WITH {_CHUNKS}, t AS (SELECT doc_id, filing_type, CASE WHEN ticker = 'de' AND coalesce(fiscal_year = '0' OR report_label_year = '0', false) THEN 1 WHEN ticker = 'de' THEN 2
      WHEN coalesce(ticker = 'de', true) AND (fiscal_year IS NULL OR fiscal_year = '0' OR coalesce(report_label_year = '0', false)) THEN 3 ELSE 4 END AS tier FROM c)
    SELECT doc_id, filing_type, tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY filing_type)""")
def tier_cascade(spark, d):
    return cascade(chunks(spark, d), [clause("ticker", "de"), clause("fiscal_year", "0")], "filing_type").select("doc_id", "filing_type", "tier")


@query(f"""WITH {_CHUNKS} SELECT filing_type, bool_or(fiscal_year IS NULL OR fiscal_year = '0') AS qualified FROM c WHERE ticker = 'es' GROUP BY 1""")
def tier_qualified(spark, d):
    return qualified(chunks(spark, d).where("ticker = 'es'"), "filing_type", ["0"])


@query(f"""WITH {_CHUNKS} SELECT CASE WHEN ticker = 'de' AND coalesce(fiscal_year = '0' OR report_label_year = '0', false) THEN 1 WHEN ticker = 'de' THEN 2
      WHEN false THEN 3 ELSE 4 END AS tier, count(*) AS n FROM c GROUP BY 1""")
def tier_sizes(spark, d):
    c = chunks(spark, d)
    return c.groupBy(tiers(c, [clause("ticker", "de"), clause("fiscal_year", "0")]).alias("tier")).agg(F.count("*").alias("n"))


# --- ranked lists -------------------------------------------------------------------

_FILINGS = """f AS (SELECT o_custkey AS ticker, o_orderkey AS source, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '10-K' ELSE '10-Q' END AS kind, year(o_orderdate) AS y,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 5 ELSE quarter(o_orderdate) END AS ord, o_totalprice AS score, o_orderdate AS filed,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y%m') END AS period_code FROM orders)"""


def _ranked_lines(spark, d):
    """Order lines as ranked chunks: a query per customer, one section per return flag, a source per order."""
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = i.join(o, i.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("query_id"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("item_id"), F.col("l_orderkey").alias("source"),
        F.col("l_linenumber").alias("chunk"), F.col("o_orderdate").alias("fiscal_rank"), F.col("l_extendedprice").alias("score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk")
    return lines.withColumn("rank", F.row_number().over(w))


_LINES = """l AS (SELECT o_custkey AS query_id, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS item_id, l_orderkey AS source, l_linenumber AS chunk, o_orderdate AS fr,
    row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _collapse_sql(order: str) -> str:
    return f"""WITH {_LINES}, s AS (SELECT query_id, item_id, source, min(rank) AS mr, max(fr) AS nf FROM l WHERE item_id IS NOT NULL GROUP BY ALL),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY {order}) <= 2)
    SELECT query_id, item_id, source, chunk, rank FROM l WHERE item_id IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.query_id = l.query_id AND k.item_id = l.item_id AND k.source = l.source)"""


@query(_collapse_sql("mr, source"))
def collapse_rank(spark, d):
    return ranking.collapse(_ranked_lines(spark, d), ["item_id"], "source", 2).select("query_id", "item_id", "source", "chunk", "rank")


@query(_collapse_sql("nf DESC NULLS LAST, mr, source"))
def collapse_newest(spark, d):
    return ranking.collapse(_ranked_lines(spark, d), ["item_id"], "source", 2, prefer="newest").select("query_id", "item_id", "source", "chunk", "rank")


@query(f"""WITH {_LINES}, s AS (SELECT query_id, source, min(rank) AS first FROM l GROUP BY ALL)
    SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM s""")
def sources_in_order(spark, d):
    return ranking.first_places(_ranked_lines(spark, d), ["query_id", "source"], "rank")


@query()
def near_dup_numbers(spark, d):
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    sets = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.pmod("l_partkey", F.lit(12)))).alias("numbers"))
    rows = o.join(sets, o.o_orderkey == sets.l_orderkey).select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("seq"), "numbers")
    return ranking.suppress_near(rows, "numbers", "source", "seq", 3, 0.9)


_COVER = f"""{_FILINGS}, q AS (SELECT ticker % 50 AS query_id, ticker, source, score FROM f), sel AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) <= 10),
    want AS (SELECT query_id, ticker FROM q WHERE ticker % 7 = 1 GROUP BY ALL), many AS (SELECT query_id FROM want GROUP BY 1 HAVING count(*) > 1),
    miss AS (SELECT * FROM want WHERE query_id IN (SELECT query_id FROM many) AND (query_id, ticker) NOT IN (SELECT query_id, ticker FROM sel)),
    best AS (SELECT q.* FROM q JOIN miss USING (query_id, ticker) QUALIFY row_number() OVER (PARTITION BY q.query_id, q.ticker ORDER BY score DESC, source) = 1)"""


@query(f"WITH {_COVER} SELECT query_id, ticker, source, score FROM sel UNION ALL SELECT query_id, ticker, source, score FROM best")
def coverage_fill(spark, d):
    ranked = filings(spark, d).select(F.pmod("ticker", F.lit(50)).alias("query_id"), "ticker", "source", "score")
    selected = search.top(ranked, 10, tie="source").drop("rank")
    wanted = ranked.where("ticker % 7 = 1").select("query_id", "ticker")
    return ranking.cover(ranked, selected, wanted, "ticker", tie="source")


@query("""SELECT event_id, event_type, value, turn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 40""")
def fair_select(spark, d):
    return ranking.fair_select(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", 40, "value", "event_id")


@query("""WITH p AS (SELECT user_id, event_type, max(value) AS score FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id, event_type, max(value) AS score FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
    u AS (SELECT *, 0 AS side FROM p UNION ALL SELECT *, 1 FROM n) SELECT user_id, event_type, score, side FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, side) = 1""")
def merge_keep_best(spark, d):
    e = table(spark, d, "events")
    side = lambda n: e.where(F.pmod("event_id", F.lit(2)) == n).groupBy("user_id", "event_type").agg(F.max("value").alias("score")).withColumn("side", F.lit(n))
    return ranking.merge_best(side(0), side(1), ["user_id", "event_type"])


@query(f"WITH {_FILINGS} SELECT ticker, source, kind, y::VARCHAR AS fiscal_year, row_number() OVER (PARTITION BY ticker ORDER BY y DESC, ord DESC, source) - 1 AS nth FROM f")
def period_ladder(spark, d):
    return ranking.ladder(filings(spark, d)).select("ticker", "source", "kind", "fiscal_year", "nth")


_PICKS = "SELECT c_custkey AS request, c_custkey AS ticker, CASE c_custkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 1997 END AS year, c_custkey % 5 - 1 AS nth FROM customer"


def _picks(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    kind = F.when(k % 3 == 0, F.lit("10-K")).when(k % 3 == 1, F.lit("10-Q"))
    return c.select(k.alias("request"), k.alias("ticker"), kind.alias("kind"), F.when(k % 4 == 0, F.lit(1997)).alias("year"), (k % 5 - 1).alias("nth"))


@query(f"""WITH {_FILINGS}, w AS ({_PICKS}), m AS (SELECT request, source, nth, row_number() OVER (PARTITION BY request ORDER BY y DESC, ord DESC, source) - 1 AS n
    FROM w JOIN f ON w.ticker = f.ticker AND (w.kind IS NULL OR w.kind = f.kind) AND (w.year IS NULL OR w.year = f.y)), h AS (SELECT request, source FROM m WHERE n = nth)
    SELECT request, ticker, kind, year, nth, source FROM w LEFT JOIN h USING (request)""")
def ladder_nth(spark, d):
    return ranking.ladder_pick(_picks(spark, d), filings(spark, d))


@query(f"WITH {_FILINGS} SELECT ticker, max(period_code) AS latest FROM f WHERE kind = '10-Q' AND length(period_code) >= 6 GROUP BY 1")
def latest_quarter(spark, d):
    return filings(spark, d).where("kind = '10-Q' AND length(period_code) >= 6").groupBy("ticker").agg(F.max("period_code").alias("latest"))


@query(f"WITH {_FILINGS} SELECT ticker, kind, arg_max(source, (y, ord, -source)) AS source, count(*) AS n FROM f GROUP BY ALL")
def kb_coverage(spark, d):
    return filings(spark, d).groupBy("ticker", "kind").agg(F.max_by("source", F.struct("fiscal_rank", -F.col("source"))).alias("source"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority) AS last FROM orders)
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate = last THEN 'latest' ELSE 'stale' END AS state FROM m""")
def keep_latest(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    last, stale = ranking.keep_latest(rows, ["o_custkey", "o_orderpriority"], "o_orderdate")
    both = last.withColumn("state", F.lit("latest")).unionByName(stale.withColumn("state", F.lit("stale")))
    return both.select("o_orderkey", "o_custkey", "state")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def chat_history_tail(spark, d):
    return ranking.tail(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 6)


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def budget_cap(spark, d):
    return ranking.capped(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 3)


@query(f"""WITH {_FILINGS}, p AS (SELECT ticker, source, kind, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, source) AS rank FROM f), h AS (SELECT * FROM p WHERE kind = '10-K' AND rank <= 3)
    SELECT ticker, source, rank FROM h UNION ALL SELECT ticker, source, rank FROM p WHERE rank <= 2 AND ticker NOT IN (SELECT ticker FROM h)""")
def chosen_or_top(spark, d):
    f = filings(spark, d)
    pool = search.top(f.select("ticker", "source", "kind", "score"), 1 << 30, "ticker", "score", "source")
    return ranking.chosen_or_top(pool, pool.where("kind = '10-K' AND rank <= 3").select("ticker", "source"), "ticker", "source", "rank", 2).select("ticker", "source", "rank")
