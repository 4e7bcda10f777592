"""Whole plans bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans import agent, retrieve
from quarry.plans.retrieval_queries import _LANES, _TOKENS
from quarry.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _corpus(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", F.col("lang").alias("ticker"), F.col("source"), F.lit("10-K").alias("filing_type"), (F.col("doc_id") % 5).cast("string").alias("item_id"), F.struct(F.col("n_chars").alias("year"), F.col("doc_id").alias("ord")).alias("fiscal_rank"))


_PLAN = f"""{_LANES.replace('rank <= 20', 'rank <= 60')}, u AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM sparse),
    f AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS s FROM u GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 30),
    p AS (SELECT query_id, d.doc_id, lang AS ticker, source, d.doc_id % 5 AS item, round(len(list_intersect(list_distinct({_TOKENS.replace('text', 'b.text')}), {_TOKENS.replace('text', 'd.text')})) / len(list_distinct({_TOKENS.replace('text', 'b.text')}))::DOUBLE, 9) AS score
          FROM f JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p),
    g AS (SELECT query_id, ticker, item, source, min(rank) AS mr FROM r GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY query_id, ticker, item ORDER BY mr, source) <= 2),
    c AS (SELECT r.* FROM r JOIN g USING (query_id, ticker, item, source)),
    tt AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5),
    want AS (SELECT DISTINCT query_id, v.ticker FROM c, (VALUES ('en'), ('fr')) AS v(ticker)),
    miss AS (SELECT * FROM want WHERE (query_id, ticker) NOT IN (SELECT query_id, ticker FROM tt)),
    bb AS (SELECT c.* FROM c JOIN miss USING (query_id, ticker) QUALIFY row_number() OVER (PARTITION BY c.query_id, c.ticker ORDER BY score DESC, doc_id) = 1)"""


@query(f"{_PLAN} SELECT query_id, doc_id, ticker, source, score, rank FROM tt UNION ALL SELECT query_id, doc_id, ticker, source, score, rank FROM bb")
def retrieve_plan(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    wanted = asked.select("query_id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("ticker"))
    return retrieve.retrieve(asked, _corpus(spark, d), wanted=wanted).select("query_id", "doc_id", "ticker", "source", "score", "rank")


def _plan(spark, d):
    """Lines of an order as todos; a line depends on the one before where its part number is even."""
    i = table(spark, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = i.select(F.col("l_orderkey").alias("query_id"), n.alias("id"), "l_partkey")
    return agent.todos(rows.withColumn("depends_on", F.when((F.col("id") > 0) & (F.col("l_partkey") % 2 == 0), F.col("id") - 1)))


@query("""WITH RECURSIVE n AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS id, l_partkey FROM lineitem),
    t AS (SELECT query_id, id, CASE WHEN id > 0 AND l_partkey % 2 = 0 THEN id - 1 END AS depends_on FROM n WHERE id < 7),
    w AS (SELECT query_id, id, depends_on, 0 AS wave FROM t WHERE depends_on IS NULL UNION ALL SELECT t.query_id, t.id, t.depends_on, w.wave + 1 FROM t JOIN w ON t.query_id = w.query_id AND t.depends_on = w.id)
    SELECT query_id, id, depends_on, wave FROM w""")
def todo_waves(spark, d):
    return agent.wave_numbers(_plan(spark, d)).select("query_id", "id", "depends_on", "wave")


_FOUND = """f AS (SELECT user_id AS query_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS id, event_id % 100 AS doc_id, max(value) AS score, bool_or(value > 50) AS cited FROM events GROUP BY ALL)"""


def _found(spark, d):
    e = table(spark, d, "events")
    ident = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return e.groupBy(F.col("user_id").alias("query_id"), ident.alias("id"), (F.col("event_id") % 100).alias("doc_id")).agg(F.max("value").alias("score"), F.bool_or(F.col("value") > 50).alias("cited"))


@query(f"""WITH {_FOUND}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY id) = 1 AS new FROM f)
    SELECT query_id, id, count(*) AS picked, count(*) FILTER (new) AS new, count(*) FILTER (new AND cited) AS new_cited FROM m GROUP BY ALL""")
def todo_contributions(spark, d):
    return agent.contributions(_found(spark, d))


@query(f"""WITH {_FOUND}, n AS (SELECT query_id, count(DISTINCT id) AS facets FROM f GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, doc_id) AS turn FROM f),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, id) AS seat FROM t) SELECT query_id, id, doc_id, score, turn, seat FROM s JOIN n USING (query_id) WHERE seat <= least(5 + 2 * (facets - 1), 16)""")
def synthesis_rows(spark, d):
    return agent.synthesise(_found(spark, d)).select("query_id", "id", "doc_id", "score", "turn", "seat")


@query("""WITH o AS (SELECT o_orderpriority AS mode, avg(o_totalprice) AS m, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1), b AS (SELECT m FROM o WHERE mode = '1-URGENT')
    SELECT mode, round(o.m, 4) AS mean, low, high, round(100 * (o.m / b.m - 1), 4) AS delta_pct FROM o, b""")
def latency_by_mode(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("mode")).agg(F.avg("o_totalprice").alias("m"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    base = F.broadcast(o.where("mode = '1-URGENT'").select(F.col("m").alias("base")))  # one row
    return o.crossJoin(base).select("mode", F.round("m", 4).alias("mean"), "low", "high", F.round(100 * (F.col("m") / F.col("base") - 1), 4).alias("delta_pct"))
