"""Gaps of freshness and the cover of asked fields on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import freshness, overlay
from quarry.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""WITH o AS (SELECT o_orderkey AS todo_id, o_custkey::VARCHAR AS ticker, CAST(o_orderdate AS DATE) AS day FROM orders),
    c AS (SELECT l_orderkey AS todo_id, max(CAST(l_shipdate AS DATE)) AS top FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
    n AS (SELECT DISTINCT ticker, day FROM o WHERE todo_id % 4 = 0),
    u AS (SELECT o.todo_id, o.ticker, o.day AS as_of, max(n.day) AS cutoff FROM o JOIN n ON n.ticker = o.ticker AND n.day <= o.day WHERE todo_id % 3 = 0 GROUP BY ALL)
    SELECT todo_id, ticker, cutoff::VARCHAR AS cutoff, as_of::VARCHAR AS as_of, 'news' AS doc_type, '' AS need FROM u WHERE cutoff < as_of
    UNION ALL SELECT todo_id, CASE WHEN todo_id % 6 = 0 THEN '' ELSE least(ticker, 'X') END, coalesce(top::VARCHAR, ''), day::VARCHAR, 'realtime', CASE todo_id % 5 WHEN 0 THEN 'intraday' ELSE 'days' END FROM o LEFT JOIN c USING (todo_id) WHERE todo_id % 5 < 2
    UNION ALL SELECT todo_id, '', coalesce(top::VARCHAR, ''), day::VARCHAR, 'realtime', 'days' FROM o LEFT JOIN c USING (todo_id) WHERE todo_id % 7 < 2 AND todo_id % 2 = 0""")
def freshness_gaps(spark, d):
    k, ticker = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    o = table(spark, d, "orders").select(
        k.alias("todo_id"), ticker.alias("ticker"), F.col("o_orderdate").alias("date"), F.to_date("o_orderdate").alias("as_of"),
        F.when(k % 5 == 0, "intraday").when(k % 5 == 1, "days").otherwise("none").alias("need"), F.when(k % 6 != 0, F.array(F.lit("X"), ticker)).alias("tickers"),
        F.when(k % 7 == 0, "web").when(k % 7 == 1, "both").otherwise("kb").alias("route"), F.when(k % 2 == 1, 1).alias("web_notes"), F.when(k % 3 == 0, "news").otherwise("10-K").alias("doc_type"),
    )
    chunks = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("todo_id"), F.col("l_shipdate").alias("date"))
    gaps = freshness.news_gaps(o, o.where("todo_id % 4 = 0").select("ticker", "date"))
    return gaps.unionByName(freshness.realtime_gaps(o, chunks)).unionByName(freshness.web_route_gaps(o, chunks))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS query_id, left(o_orderpriority, 1) AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN 'News_' ELSE 'Fundamentals_' END || o_orderkey AS source,
        o_totalprice AS score, o_orderkey % 4 AS f FROM orders),
    w AS (SELECT DISTINCT query_id, t.ticker, query_id % 3 AS m FROM o, (VALUES ('1'), ('2'), ('3')) t(ticker)),
    s AS (SELECT * FROM o WHERE k % 5 = 0), p AS (SELECT * FROM o WHERE k % 5 IN (1, 2)),
    fit AS (SELECT o.*, w.query_id AS asker FROM o JOIN w ON w.ticker = o.ticker AND k % 3 <> 0 AND (m = 0 OR (m = 1 AND f = 1) OR (m = 2 AND f IN (1, 2)))),
    a AS (SELECT query_id, ticker FROM w ANTI JOIN (SELECT * FROM fit WHERE asker = query_id AND k % 5 = 0) x USING (query_id, ticker)),
    one AS (SELECT fit.* FROM fit JOIN a ON a.query_id = asker AND a.ticker = fit.ticker WHERE asker = fit.query_id AND k % 5 IN (1, 2) QUALIFY row_number() OVER (PARTITION BY asker, fit.ticker ORDER BY score DESC, source) = 1),
    two AS (SELECT fit.* FROM fit JOIN (SELECT * FROM a ANTI JOIN (SELECT asker AS query_id, ticker FROM one) y USING (query_id, ticker)) b ON b.query_id = asker AND b.ticker = fit.ticker
        WHERE asker % 3 <> 0 AND k % 11 = 0 QUALIFY row_number() OVER (PARTITION BY asker, fit.ticker ORDER BY score DESC, source) = 1)
    SELECT query_id, ticker, source, 0 AS level FROM s UNION ALL SELECT asker, ticker, source, 1 FROM one
    UNION ALL SELECT asker, ticker, source, 2 FROM two WHERE NOT (k % 5 = 0 AND asker = query_id)""")
def field_cover(spark, d):
    k = F.col("o_orderkey")
    content = F.when(k % 4 == 1, "GROSS margin 3 %").when(k % 4 == 2, "Revenue Growth : 4 %").otherwise("Balance sheet")
    o = table(spark, d, "orders").select(
        k, F.col("o_custkey").alias("query_id"), F.left("o_orderpriority", F.lit(1)).alias("ticker"), F.concat(F.when(k % 3 == 0, "News_").otherwise("Fundamentals_"), k.cast("string")).alias("source"),
        F.lit(0).alias("chunk_index"), content.alias("content"), F.col("o_totalprice").alias("score"), F.when(k % 11 == 0, "TTM").alias("period_basis"),
    )
    m = F.col("query_id") % 3
    fields = F.when(m == 1, F.array(F.lit("Gross Margin"))).when(m == 2, F.array(F.lit("Gross Margin"), F.lit("revenue growth")))
    wanted = o.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, "123"))).alias("ticker"), fields.alias("fields"))
    out = freshness.cover_fields(o.where("o_orderkey % 5 IN (1, 2)"), o.where("o_orderkey % 5 = 0"), wanted, o)
    return out.select("query_id", "ticker", "source", "level")


@query("""WITH o AS (SELECT o_orderkey AS query_id, o_orderkey % 6 AS t, o_orderkey % 5 AS m, year(o_orderdate)::VARCHAR AS y FROM orders),
    g AS (SELECT *, m IN (0, 1, 3) AS gated, t IN (1, 2, 4) AS good FROM o),
    f AS (SELECT query_id, 'fiscal_year' AS field, y AS vals, t <> 2 AS include FROM g WHERE gated AND good
        UNION ALL SELECT query_id, 'ticker', 'MSFT', true FROM g WHERE gated AND t = 4
        UNION ALL SELECT query_id, 'ticker', CASE WHEN query_id % 2 = 0 THEN 'AAPL' ELSE 'NVDA' END, true FROM g WHERE m IN (0, 2) AND NOT (gated AND t = 4)
        UNION ALL SELECT query_id, 'report_period_code', y || '03', true FROM g WHERE m = 4 AND y >= '2000'
        UNION ALL SELECT query_id, 'period_basis', 'TTM', true FROM g WHERE m = 1)
    SELECT query_id, field, vals AS "values", include FROM f""")
def filter_overlay(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    company = F.when(k % 2 == 0, "Apple").otherwise("NVIDIA")
    m, t = k % 5, k % 6
    asked = (
        F.when(m == 0, F.concat(F.lit("What did "), company, F.lit(" sell in fiscal "), y)).when(m == 1, F.concat(F.lit("TTM margin of the annual report "), y))
        .when(m == 2, F.concat(F.lit("How is "), company, F.lit(" doing"))).when(m == 3, F.lit("全年的成長")).otherwise(F.concat(F.lit("Sales of "), y, F.lit("03")))
    )
    one = lambda field, value, more="": F.concat(F.lit(f'{{"field": "{field}", "value": "'), value, F.lit(f'"{more}}}'))
    whole = lambda *parts: F.concat(F.lit('{"filters": ['), F.concat_ws(", ", *parts), F.lit("]}"))
    said = (
        F.when(t == 0, F.lit("no idea")).when(t == 1, F.concat(F.lit("```json\n"), whole(one("fiscal_year", y)), F.lit("\n```"))).when(t == 2, whole(one("fiscal_year", y, ', "polarity": "exclude"')))
        .when(t == 3, whole(one("color", F.lit("red")), one("ticker", F.lit("")), F.lit("7"))).when(t == 4, whole(one("fiscal_year", y, ', "polarity": "maybe"'), one("ticker", F.lit("MSFT"))))
        .otherwise(F.concat(F.lit("Here: "), whole(one("fiscal_year", y))))
    )
    found = table(spark, d, "orders").select(k.alias("query_id"), F.explode(overlay.filters(asked, said)).alias("f"))
    return found.select("query_id", "f.field", F.array_join("f.values", "|").alias("values"), "f.include")
