"""Text, url, period and number functions over whole driver tables: what they read is written from a row's values, so SQL tells the result from the values alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numbers, periods, text, web
from quarry.operators import grounding, ranking
from quarry.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _cut(n, values):
    """The value at place n of a list."""
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def _dated(spark, d):
    """Orders with their day, thirty years on."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 360)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


_DAY = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS DATE)"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 6 THEN strftime({_DAY}, '%Y-%m-%d') END AS day FROM orders")
def published_date(spark, d):
    o, turn, at = _dated(spark, d), F.col("id") % 7, lambda p: F.date_format("day", p)
    published = F.when(turn == 0, at("EEE, dd MMM yyyy '10:00:00 GMT'")).when(turn == 1, F.concat(F.lit("on "), at("yyyy-MM-dd'T'01:02:03")))
    url = F.when(turn == 2, F.concat(F.lit("https://a.com/"), at("yyyy/M/d"), F.lit("/x"))).when(turn < 2, "https://a.com/2001/01/01/").otherwise("https://a.com/x")
    content = F.when(turn == 3, F.concat(F.lit("Volume 7 | At close: "), at("MMMM d, yyyy"), F.lit(" 4 PM"))).when(turn == 4, F.concat(F.lit("Ex-date 1/2/2034 # Last updated "), at("MM/dd/yy"), F.lit(" | 1/3/2034")))
    content = F.when(turn == 5, F.concat(F.lit("Published on "), at("yyyy-MM-dd"), F.lit(" next report as of 2040-01-01"))).when(turn == 6, F.concat(F.lit("Rated "), at("yyyy-MM-dd"))).otherwise(content)
    return o.select("id", web.result_date(published, url, content, F.lit("2035-01-01").cast("date")).cast("string").alias("day"))


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN strftime(date_trunc('month', {_DAY}), '%Y-%m-%d') ELSE strftime({_DAY}, '%Y-%m-%d') END AS day FROM orders")
def url_date(spark, d):
    o, turn, at = _dated(spark, d), F.col("id") % 4, lambda p: F.date_format("day", p)
    part = F.when(turn == 0, at("yyyy/MM/dd")).when(turn == 1, at("MM-dd-yyyy")).when(turn == 2, at("yyyyMMdd")).otherwise(at("yyyy/MM"))
    return o.select("id", web.url_date(F.concat(F.lit("https://a.com/news/"), part, F.lit("/story"))).cast("string").alias("day"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 OR coalesce(trim(url), '') = '' THEN 'title::page ' || page_id || '::' ELSE 'url::' || lower(trim(url)) END AS key FROM pages""")
def news_keys(spark, d):
    p = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit(" "), F.upper("url"), F.lit("  ")))
    return p.select("page_id", web.news_key(url, F.concat(F.lit(" Page "), F.col("page_id").cast("string")), F.lit(None).cast("string")).alias("key"))


@query("SELECT page_id, page_id % 3 = 0 AS is_option FROM pages WHERE url IS NOT NULL")
def option_pages(spark, d):
    p = table(spark, d, "pages").where("url is not null")
    symbol = F.concat(F.lit("/quote/TSLA260116"), F.when(F.col("page_id") % 2 == 0, "C").otherwise("P"), F.lpad((F.col("page_id") * 1000).cast("string"), 8, "0"))
    return p.select("page_id", web.is_option_page(F.concat(F.lit("https://a.com"), F.when(F.col("page_id") % 3 == 0, symbol).otherwise("/q"))).alias("is_option"))


@query("""SELECT o_orderkey AS id, ['AAPL', 'MSFT|NVDA', 'GOOGL', '', 'TSLA'][o_orderkey % 5 + 1] AS mentioned, nullif(['AAPL', 'MSFT', 'GOOGL', '', 'TSLA'][o_orderkey % 5 + 1], '') AS first,
    nullif(['AAPL', '', 'GOOGL', '', 'TSLA'][o_orderkey % 5 + 1], '') AS sole FROM orders""")
def company_aliases(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    said = F.concat(F.lit("Order "), F.col("id").cast("string"), F.lit(" of "), _cut(F.col("id") % 5, ["APPLE stores", "輝達與微軟", "Alphabet (google)", "metadata", "特斯拉 and Tesla"]))
    found = text.mentioned(said)
    return o.select("id", F.array_join(found, "|").alias("mentioned"), text.first_mentioned(said).alias("first"), text.sole(found).alias("sole"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'TTM' END AS basis, CASE WHEN o_orderkey % 3 = 0 THEN strftime({_DAY}, '%Y%m') END AS code FROM orders")
def query_signals(spark, d):
    o = _dated(spark, d)
    asked = F.concat(_cut(F.col("id") % 4, ["trailing twelve months", "近 12 個月", "LTM margin", "last year"]), F.lit(" of "), F.date_format("day", "yyyyMM"), F.when(F.col("id") % 3 == 0, "").otherwise("7"))
    return o.select("id", text.asks_trailing_year(asked).alias("basis"), text.period_code(asked).alias("code"))


@query("""SELECT l_orderkey AS id, string_agg(DISTINCT 'part_' || l_partkey || '.txt#' || l_linenumber, '|' ORDER BY 'part_' || l_partkey || '.txt#' || l_linenumber) AS cited FROM lineitem GROUP BY l_orderkey""")
def citation_sets(spark, d):
    mark = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "【Reference 3: part_").otherwise("【part_"), F.col("l_partkey").cast("string"), F.lit(".txt, chunk #"), F.col("l_linenumber").cast("string"), F.lit("】"))
    said = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list(F.concat(mark, F.lit(" so "), mark)), " and ").alias("body"))
    cited = F.transform(text.citations(F.col("body")), lambda c: F.concat(c["source"], F.lit("#"), c["chunk"].cast("string")))
    return said.select("id", F.array_join(F.array_sort(cited), "|").alias("cited"))


@query(f"""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime({_DAY}, '%Y%m%d') WHEN 1 THEN strftime({_DAY}, '%Y%m') WHEN 2 THEN strftime({_DAY}, '%Y') ELSE '' END AS stamp,
    CASE o_orderkey % 4 WHEN 0 THEN strftime({_DAY}, '%Y-%m-%d') WHEN 1 THEN strftime(last_day({_DAY}), '%Y-%m-%d') WHEN 2 THEN strftime({_DAY}, '%Y') || '-12-31' END AS newest, o_orderkey % 4 = 0 AS dated,
    ['fundamentals', '10-Q', '10-K', 'other'][o_orderkey % 4 + 1] AS kind FROM orders""")
def source_stamps(spark, d):
    o, turn = _dated(spark, d), F.col("id") % 4
    source = F.when(turn == 0, F.concat(F.lit("MSFT_Fundamentals_"), F.date_format("day", "yyyyMMdd"), F.lit(".txt"))).when(turn == 1, F.concat(F.lit("AAPL_10Q_"), F.date_format("day", "yyyyMM"))).when(turn == 2, F.concat(F.lit("NVDA_10K_"), F.date_format("day", "yyyy"))).otherwise("notes")
    kind = text.source_type(source)
    return o.select("id", periods.stamp(source).alias("stamp"), periods.newest_date(source).cast("string").alias("newest"), periods.is_dated(source).alias("dated"), kind.alias("kind"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN date_diff('day', {_DAY}, DATE '2026-06-12') END AS age, ['intraday', 'days', 'none'][o_orderkey % 3 + 1] AS need FROM orders)
    SELECT id, CASE WHEN need = 'none' THEN NULL WHEN age IS NULL THEN -1 WHEN age > CASE need WHEN 'days' THEN 7 ELSE 1 END THEN age END AS stale FROM o""")
def staleness(spark, d):
    o = _dated(spark, d)
    newest = F.when(F.col("id") % 5 > 0, F.col("day"))
    return o.select("id", periods.staleness(_cut(F.col("id") % 3, ["intraday", "days", "none"]), newest, F.lit("2026-06-12").cast("date")).alias("stale"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_DAY} AS day, CASE WHEN o_orderkey % 15 IN (3, 6, 9, 12) THEN o_orderkey % 15 END AS m, CASE WHEN o_orderkey % 4 > 0 THEN strftime({_DAY}, '%Y-%m') END AS e FROM orders)
    SELECT id, CAST(m AS INTEGER) AS months, e AS ends, coalesce(m || 'M@' || e, CASE WHEN id % 2 = 0 THEN '2026Q3' END, 'unknown') AS key, CASE WHEN id % 5 < 4 THEN [3, 6, 9, 12][id % 5 + 1] || '/' || strftime(day, '%Y-%m') END AS tag FROM o""")
def period_parts(spark, d):
    o = _dated(spark, d)
    m = periods.months(F.concat(F.lit(" "), (F.col("id") % 15).cast("string")))
    e = periods.month_end(F.when(F.col("id") % 4 > 0, F.date_format("day", "yyyy-MM")).otherwise("2026-13"))
    body = F.concat(F.lit("x ["), _cut(F.col("id") % 5, ["Three", "six", "NINE", "Twelve", "Two"]), F.lit(" Months Ended "), F.date_format("day", "MMMM d, yyyy"), F.lit(" vs before] y"))
    tag = periods.chunk_period(body)
    return o.select("id", m.alias("months"), e.alias("ends"), periods.period_key(m, e, F.when(F.col("id") % 2 == 0, "2026Q3").otherwise("")).alias("key"), F.concat(tag["months"].cast("string"), F.lit("/"), tag["end"]).alias("tag"))


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % 6 < 5 AND o_orderkey % 7 > 0 THEN year({_DAY}) * 10 + o_orderkey % 6 + 1 END AS k FROM orders)
    SELECT o_custkey, arg_max(id, (k, id)) FILTER (k IS NOT NULL) AS newest, count(k) AS known FROM o GROUP BY o_custkey""")
def fiscal_order(spark, d):
    o = _dated(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")
    year = F.when(F.col("id") % 7 > 0, F.year("day").cast("string")).otherwise("n/a")
    ranked = o.withColumn("r", ranking.fiscal_rank(year, _cut(F.col("id") % 6, ["Q1", "q2", "Q3", "q4", "FY", "H1"])))
    return ranked.groupBy("o_custkey").agg(F.max(F.when(F.col("r").isNotNull(), F.struct("r", "id")))["id"].alias("newest"), F.count("r").alias("known"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
    SELECT id, CASE id % 4 WHEN 0 THEN CAST(p AS VARCHAR) WHEN 1 THEN CAST(CAST(p * 1000 AS DECIMAL(18,2)) AS VARCHAR) WHEN 2 THEN '' ELSE CAST(p AS VARCHAR) || '|' || '2.50' END AS millions FROM o""")
def money(spark, d):
    o, turn, p = _dated(spark, d), F.col("id") % 4, F.format_number("price", 2)
    said = F.when(turn == 0, F.concat(F.lit("sold for US$"), p, F.lit(" million"))).when(turn == 1, F.concat(F.lit("$ "), p, F.lit("bn in all"))).when(turn == 2, F.concat(F.lit("a bare $"), p)).otherwise(F.concat(F.lit("from $"), p, F.lit("M to $2.5 mn")))
    return o.select("id", F.array_join(F.transform(numbers.money_in_millions(said), lambda x: F.bround(x.cast("decimal(18,4)"), 2).cast("decimal(18,2)").cast("string")), "|").alias("millions"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS t, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) SELECT id, CASE WHEN t = 3 THEN CAST(p AS VARCHAR) ELSE '' END AS unseen FROM o""")
def number_trace(spark, d):
    o, turn = _dated(spark, d), F.col("id") % 4
    plain = F.col("price").cast("string")
    answer = F.concat(F.lit("It was "), F.when(turn == 0, F.format_number("price", 2)).otherwise(plain), F.lit(" and 12.34%."))
    evidence = F.when(turn == 0, plain).when(turn == 1, F.format_number("price", 2)).when(turn == 2, F.concat(plain, F.lit("1"))).otherwise(F.concat(F.lit("about "), (F.col("price") + 1).cast("string")))
    return o.select("id", F.array_join(numbers.untraceable(answer, evidence), "|").alias("unseen"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM orders), m AS (SELECT id, c // 1000 AS k FROM o)
    SELECT id, CASE id % 4 WHEN 0 THEN '$' || (k // 100) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || 'M' WHEN 1 THEN '$' || (k // 100) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || 'B' WHEN 2 THEN '$' || (k % 1000) || '.00' ELSE 'N/A' END AS money,
        CASE WHEN id % 4 = 3 THEN 'N/A' ELSE (k % 1000) || '.00%' END AS pct FROM m WHERE k >= 100""")
def money_format(spark, d):
    o = _dated(spark, d).withColumn("k", F.expr("cast(price * 100 as long) div 1000")).where("k >= 100")
    turn = F.col("id") % 4
    x = F.when(turn == 0, F.col("k") * 10_000.0).when(turn == 1, F.col("k") * 10_000_000.0).when(turn == 2, (F.col("k") % 1000).cast("double"))
    pct = F.when(turn < 3, (F.col("k") % 1000).cast("double"))
    return o.select("id", numbers.short_money(x).alias("money"), numbers.percent(pct, already=True).alias("pct"))


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '[AAPL 10-Q period ' || strftime({_DAY}, '%Y%m') || '] ' WHEN 1 THEN '[AAPL FY' || year({_DAY}) || ' FY] ' WHEN 2 THEN '' ELSE '[AAPL 10-Q FY' || year({_DAY}) || '] ' END AS header FROM orders")
def headers(spark, d):
    o, turn, none = _dated(spark, d), F.col("id") % 4, F.lit(None).cast("string")
    code, year = F.when(turn == 0, F.date_format("day", "yyyyMM")), F.when(turn != 2, F.date_format("day", "yyyy"))
    return o.select("id", text.header(F.when(turn != 2, "AAPL").otherwise(none), F.when(turn % 4 != 1, F.when(turn != 2, "10-Q")), code, year, F.when(turn < 2, "FY")).alias("header"))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS hash, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(to_hex((CAST('0x' || h[17:18] AS INTEGER) & 63) | 128)) || h[19:20] || '-' || h[21:32] AS uid
    FROM (SELECT doc_id, text, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc_' || doc_id || '_c' || doc_id % 7)) AS h FROM documents)""")
def ids(spark, d):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_c"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), text.uuid5(name).alias("uid"))


@query("""WITH l AS (SELECT l_orderkey AS answer_id, l_linenumber AS seq, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS v FROM lineitem GROUP BY ALL)
    SELECT answer_id, seq, CASE WHEN seq % 4 = 1 THEN '9M@2026-03' ELSE 'kept' END AS period, CASE seq % 4 WHEN 1 THEN '10-Q' WHEN 2 THEN '10-K|news' ELSE '' END AS types FROM l""")
def grounded_claims(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("seq")).agg(F.max("l_extendedprice").cast("decimal(18,2)").alias("v"))
    turn, literal = F.col("seq") % 4, F.concat(F.lit("7"), F.col("seq").cast("string"), F.lit("."), F.col("v").cast("string"))
    chunk = lambda kind, period, said: F.struct(said.alias("text"), F.lit(period).cast("string").alias("chunk_period"), F.lit(kind).alias("kind"))
    one, two = F.concat(F.lit("it was "), literal, F.lit(" then")), F.concat(F.lit("it was 9"), literal)
    found = F.when(turn == 1, F.array(chunk("10-Q", "9M@2026-03", one))).when(turn == 2, F.array(chunk("10-K", "6M@2026-03", one), chunk("news", "3M@2026-03", one))).otherwise(F.array(chunk("10-K", "6M@2026-03", two)))
    chunks = i.select("answer_id", F.explode(found).alias("c")).select("answer_id", "c.*")
    claims = i.select("answer_id", "seq", literal.alias("literal"), F.lit("kept").alias("period"))
    types = grounding.source_types(claims, chunks)
    return grounding.grounded_periods(claims, chunks).join(types, ["answer_id", "seq"]).select("answer_id", "seq", "period", F.array_join("types", "|").alias("types"))
