"""URLs, periods, numbers, plans, lines, HTML and storage bound to the driver tables or to small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import jsonish, numbers, periods, text, web
from quarry.operators import lines, ranking
from quarry.sources import html, storage
from quarry.sources.tables import table
from quarry.streaming import incremental

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS v({names})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Cases of a truth table as a frame."""
    return spark.createDataFrame(rows, schema)


def cases(name: str, rows: list[tuple], schema: str, want: list[tuple], want_names: str):
    """A query on literal rows whose SQL is the table of wanted rows."""

    def add(f):
        def run(spark, d):
            return f(literal(spark, rows, schema))

        QUERIES[name] = run
        ORACLES[name] = f"SELECT * FROM {_values(want, want_names)}"
        return run

    return add


# --- urls -----------------------------------------------------------------------------

_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_DOMAIN = f"CASE WHEN {_HOST} LIKE 'www.%' THEN substr({_HOST}, 5) WHEN {_HOST} <> '' THEN {_HOST} ELSE substr(coalesce(url, ''), 1, 28) END"
_KEY = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HOST}, '^www\\.', ''), '^new\\.', ''), '^m\\.', ''), '^amp\\.', '')
    || regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)), '/amp(/|$)', '\\1', 'g'), '/+$', '')"""
_ALLOWED = ["thther.example.org", "therti.example.org", "ththan.example.net", "tionsh.example.net", "ththed.example.org"]


@query(f"""SELECT page_id, {_HOST} AS host, {_DOMAIN} AS domain, {_KEY} AS url_key, regexp_replace({_HOST}, '^\\.*(www\\.)?', '') IN ({', '.join(map(_quoted, _ALLOWED))}) AS allowed,
    {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' AS admitted FROM pages""")
def url_parts(spark, d):
    h = web.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", h.alias("host"), web.domain(F.col("url")).alias("domain"), web.key(F.col("url")).alias("url_key"), web.host_allowed(h, _ALLOWED).alias("allowed"), web.domain_admits(F.lit("example.org"), h).alias("admitted"))


@query(f"""WITH r AS (SELECT page_id, page_id % 5 AS query_id, {_KEY} AS url_key, {_DOMAIN} AS domain FROM pages),
    a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, url_key ORDER BY page_id) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, domain ORDER BY page_id) <= 2)
    SELECT page_id, query_id, url_key, domain, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS place FROM b QUALIFY place <= 5""")
def web_results(spark, d):
    rows = table(spark, d, "pages").select("page_id", (F.col("page_id") % 5).alias("query_id"), web.key(F.col("url")).alias("url_key"), web.domain(F.col("url")).alias("domain"))
    return ranking.web_results(rows, "query_id", "url_key", "domain", "page_id")


_URLS = [(1, "https://a.com/2026/07/28/x"), (2, "https://a.com/live-07-28-2026"), (3, "https://a.com/x-20260728-y"), (4, "https://a.com/2020/08/y"), (5, "https://a.com/2026/13/40/z"), (6, "https://a.com/news"), (7, None), (8, "https://a.com/2026/2/3")]


@cases("url_date", _URLS, "id int, url string", [(1, "2026-07-28"), (2, "2026-07-28"), (3, "2026-07-28"), (4, "2020-08-01"), (5, None), (6, None), (7, None), (8, "2026-02-03")], "id, day")
def _url_date(rows):
    return rows.select("id", web.url_date(F.col("url")).cast("string").alias("day"))


@cases("published_date", [(1, "Tue, 28 Jul 2026 10:00:00 GMT", None), (2, "2026-07-28T01:02:03", None), (3, "2026-07-28", None), (4, "around 2026-07-27Z", "https://a.com/2020/01/02/"), (5, "", "https://a.com/2020/01/02/"), (6, None, None)],
       "id int, published string, url string", [(1, "2026-07-28"), (2, "2026-07-28"), (3, "2026-07-28"), (4, "2026-07-27"), (5, "2020-01-02"), (6, None)], "id, day")
def _published(rows):
    return rows.select("id", web.result_date(F.col("published"), F.col("url")).cast("string").alias("day"))


@cases("option_pages", [(1, "https://x.com/quote/AAPL260116C00150000"), (2, "https://x.com/quote/AAPL"), (3, None), (4, "https://x.com/q/TSLA260116P00100000/?a")], "id int, url string", [(1, True), (2, False), (3, False), (4, True)], "id, is_option")
def _option(rows):
    return rows.select("id", web.is_option_page(F.col("url")).alias("is_option"))


@cases("news_keys", [(1, " https://A.com/x ", "T", "d"), (2, "", " Big News ", "2026-01-01"), (3, None, None, None)], "id int, url string, title string, published string", [(1, "url::https://a.com/x"), (2, "title::big news::2026-01-01"), (3, "title::::")], "id, key")
def _news_keys(rows):
    return rows.select("id", web.news_key(F.col("url"), F.col("title"), F.col("published")).alias("key"))


# --- periods ----------------------------------------------------------------------------

_SOURCES = ["MSFT_Fundamentals_20260612.txt", "NVDA_10K_2026", "AAPL_10Q_202602", "AAPL_10Q_202613", "x", None, "META_News_20260131_02"]


@cases("source_stamps", [(i, s) for i, s in enumerate(_SOURCES)], "id int, source string",
       [(0, "20260612", "2026-06-12", True, "fundamentals"), (1, "2026", "2026-12-31", False, "10-K"), (2, "202602", "2026-02-28", False, "10-Q"), (3, "202613", None, False, "10-Q"), (4, "", None, False, "other"), (5, "", None, False, "other"), (6, "20260131", "2026-01-31", True, "news")],
       "id, stamp, newest, dated, kind")
def _stamps(rows):
    s = F.col("source")
    kind = F.when(s == "NVDA_10K_2026", F.lit("10-K")).when(s.startswith("AAPL_10Q"), F.lit("10-Q")).otherwise(text.source_type(s))
    return rows.select("id", periods.stamp(s).alias("stamp"), periods.newest_date(s).cast("string").alias("newest"), periods.is_dated(s).alias("dated"), kind.alias("kind"))


@cases("staleness", [(1, "intraday", "2026-06-10"), (2, "intraday", "2026-06-12"), (3, "days", "2026-06-01"), (4, "days", "2026-06-06"), (5, "none", "2020-01-01"), (6, "intraday", None), (7, "none", None)], "id int, need string, newest string",
       [(1, 2), (2, None), (3, 11), (4, None), (5, None), (6, -1), (7, None)], "id, stale")
def _stale(rows):
    return rows.select("id", periods.staleness(F.col("need"), F.to_date("newest"), F.lit("2026-06-12").cast("date")).alias("stale"))


@cases("period_parts", [(1, "9", "2026-03", "2026Q3", "[Nine Months Ended March 31, 2026 vs 2025] text"), (2, "4", "2026-13", "2026Q1", "no tag"), (3, None, None, "", None), (4, " 12 ", "2025-12", None, "[twelve months ended December. 31, 2025]")],
       "id int, months string, ends string, period string, body string", [(1, 9, "2026-03", "9M@2026-03", "9/2026-03"), (2, None, None, "2026Q1", None), (3, None, None, "unknown", None), (4, 12, "2025-12", "12M@2025-12", "12/2025-12")], "id, months, ends, key, tag")
def _periods(rows):
    m, e = periods.months(F.col("months")), periods.month_end(F.col("ends"))
    tag = periods.chunk_period(F.col("body"))
    return rows.select("id", m.alias("months"), e.alias("ends"), periods.period_key(m, e, F.col("period")).alias("key"), F.concat(tag["months"].cast("string"), F.lit("/"), tag["end"]).alias("tag"))


@cases("fiscal_order", [(1, "2025", "FY"), (2, "2025", "q4"), (3, "2026", "Q1"), (4, None, "Q1"), (5, "2025", "H1"), (6, "x", "Q1")], "id int, year string, period string", [(1, 2), (2, 1), (3, 3), (4, None), (5, None), (6, None)], "id, place")
def _fiscal(rows):
    ranked = rows.withColumn("r", ranking.fiscal_rank(F.col("year"), F.col("period")))
    placed = ranked.where("r is not null").select("id", F.row_number().over(Window.orderBy("r")).alias("place"))  # a literal table of six rows
    return rows.select("id").join(placed, "id", "left")


# --- numbers -----------------------------------------------------------------------------


@cases("money", [(1, "Revenue was $1.5 billion and US$2,000 million"), (2, "a bare $1,234"), (3, None), (4, "$3B, $4.5 mn, $1 trillion")], "id int, body string", [(1, "1500.0|2000.0"), (2, ""), (3, ""), (4, "3000.0|4.5|1000000.0")], "id, millions")
def _money(rows):
    return rows.select("id", F.array_join(F.transform(numbers.money_in_millions(F.col("body")), lambda x: F.format_string("%.1f", x)), "|").alias("millions"))


@cases("number_trace", [(1, "It is 4,342.02 and 12.34% and 99.99.", "we saw 4342.02"), (2, "Value 1.25", "exact 1.246"), (3, "Value 1.26", "exact 1.246"), (4, None, "x"), (5, "no numbers", None), (6, "5.00 then", "5.00")], "id int, answer string, evidence string",
       [(1, "99.99"), (2, ""), (3, "1.26"), (4, ""), (5, ""), (6, "")], "id, unseen")
def _trace(rows):
    return rows.select("id", F.array_join(numbers.untraceable(F.col("answer"), F.col("evidence")), "|").alias("unseen"))


@cases("money_format", [(1, 1.234e9), (2, -4.56e6), (3, 12.0), (4, None), (5, float("nan"))], "id int, x double", [(1, "$1.23B", "123400000000.00%"), (2, "$-4.56M", "-456000000.00%"), (3, "$12.00", "1200.00%"), (4, "N/A", "N/A"), (5, "N/A", "N/A")], "id, money, pct")
def _format(rows):
    return rows.select("id", numbers.short_money(F.col("x")).alias("money"), numbers.percent(F.col("x")).alias("pct"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem) SELECT l_orderkey, l_linenumber,
    abs(l_extendedprice / l_quantity * 100 - 100 - 5) <= 0.15 OR abs(l_extendedprice / l_quantity * 100 - 5) <= 0.15 AS fits FROM i""")
def growth_check(spark, d):
    i = table(spark, d, "lineitem")
    return i.select("l_orderkey", "l_linenumber", numbers.growth_fits(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"), F.lit(5.0)).alias("fits"))


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 40)) AS parts, any_value(o_custkey) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    p AS (SELECT a.l_orderkey, max(len(list_intersect(a.parts, b.parts)) / least(len(a.parts), len(b.parts))::DOUBLE) AS best FROM s a JOIN s b ON a.c = b.c AND b.l_orderkey < a.l_orderkey GROUP BY 1)
    SELECT s.l_orderkey FROM s LEFT JOIN p USING (l_orderkey) WHERE coalesce(best, 0) < 0.5""")
def overlap_anti(spark, d):
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sets = i.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("parts")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    earlier = sets.select(F.col("l_orderkey").alias("e_key"), F.col("parts").alias("e_parts"), F.col("o_custkey").alias("e_cust"))
    hit = (F.col("o_custkey") == F.col("e_cust")) & (F.col("e_key") < F.col("l_orderkey")) & (numbers.overlap(F.col("parts"), F.col("e_parts")) >= 0.5)
    return sets.join(earlier, hit, "left_anti").select("l_orderkey")


# --- entities, plans ----------------------------------------------------------------------


@query(r"""WITH m AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}\p{Pc}])the([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'T1' END, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}\p{Pc}])with([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'T2' END], lambda x: x IS NOT NULL) AS t FROM documents)
    SELECT doc_id, array_to_string(t, '|') AS mentioned, CASE WHEN len(t) = 1 THEN t[1] END AS sole FROM m""")
def alias_tags(spark, d):
    found = text.mentioned(F.col("text"), {"the": "T1", "with": "T2"})
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), "|").alias("mentioned"), text.sole(found).alias("sole"))


@query("SELECT p.pattern, d.source, count(*) AS n FROM documents d, (VALUES ('src1*'), ('src?'), ('src10')) AS p(pattern) WHERE d.source GLOB p.pattern GROUP BY ALL")
def glob_expand(spark, d):
    patterns = literal(spark, [("src1*",), ("src?",), ("src10",)], "pattern string").withColumn("regex", text.glob_regex(F.col("pattern")))
    sources = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sources.join(F.broadcast(patterns), F.regexp_like("source", F.col("regex"))).select("pattern", "source", "n")  # three rows


@cases("company_aliases", [(1, "Apple vs 微軟 and NVDA"), (2, "metal is not Meta"), (3, "nothing"), (4, None), (5, "Google, Alphabet")], "id int, body string", [(1, "AAPL|MSFT|NVDA", "AAPL", None), (2, "META", "META", "META"), (3, "", None, None), (4, "", None, None), (5, "GOOGL", "GOOGL", "GOOGL")], "id, mentioned, first, sole")
def _aliases(rows):
    found = text.mentioned(F.col("body"))
    return rows.select("id", F.array_join(found, "|").alias("mentioned"), text.first_mentioned(F.col("body")).alias("first"), text.sole(found).alias("sole"))


@cases("headers", [(1, "AAPL", "10-Q", "202602", "2026", "Q1"), (2, "AAPL", None, None, "2026", "FY"), (3, None, None, "", None, None), (4, "X", "10-K", None, "2025", None)], "id int, ticker string, kind string, code string, year string, period string",
       [(1, "[AAPL 10-Q period 202602] "), (2, "[AAPL FY2026 FY] "), (3, ""), (4, "[X 10-K FY2025] ")], "id, header")
def _headers(rows):
    return rows.select("id", text.header(*map(F.col, ("ticker", "kind", "code", "year", "period"))).alias("header"))


@cases("query_signals", [(1, "trailing twelve months of 202503"), (2, "LTM margin"), (3, "in 2025"), (4, None), (5, "近12個月")], "id int, q string", [(1, "TTM", "202503"), (2, "TTM", None), (3, None, None), (4, None, None), (5, "TTM", None)], "id, basis, code")
def _signals(rows):
    return rows.select("id", text.asks_trailing_year(F.col("q")).alias("basis"), text.period_code(F.col("q")).alias("code"))


@cases("citation_sets", [(1, "a【f1.txt, chunk #3】 b【Reference 2: f2, chunk #10】【f1.txt, chunk #3】"), (2, "none"), (3, "【broken】")], "id int, body string", [(1, "f1.txt#3|f2#10"), (2, ""), (3, "")], "id, cited")
def _cited(rows):
    return rows.select("id", F.array_join(F.transform(text.citations(F.col("body")), lambda c: F.concat(c["source"], F.lit("#"), c["chunk"].cast("string"))), "|").alias("cited"))


@cases("ids", [(1, "doc_c0", "ab"), (2, "", "")], "id int, name string, body string", [(1, "024532c3-9954-5e94-8c9c-5f31ffc9269a", "187ef4436122d1cc2f40dc2b92f0eba0"), (2, "4ebd0208-8328-5d69-8c44-ec50939c0967", "d41d8cd98f00b204e9800998ecf8427e")], "id, uid, hash")
def _ids(rows):
    return rows.select("id", text.uuid5(F.col("name")).alias("uid"), F.md5("body").alias("hash"))


_PLANS = [(1, '["a", " b ", 5, null]'), (2, 'sure:\n```json\n[{"task": "x", "route": "WEB"}, {"task": "y", "depends_on": 0}, {"task": "z", "depends_on": 7}, {"task": ""}]\n```'), (3, "no json"), (4, '[{"task": "w", "route": "bad", "depends_on": null}]')]


@cases("json_plan", _PLANS, "query_id int, raw string", [(1, 0, "a", "kb", None, False, False), (1, 1, "b", "kb", None, False, False), (2, 0, "x", "web", None, False, False), (2, 1, "y", "both", 0, True, False), (2, 2, "z", "both", None, True, True), (4, 0, "w", "both", None, True, False)], "query_id, id, task, route, depends_on, deps_declared, pruned")
def _plan(rows):
    return jsonish.prune_dependencies(jsonish.plan_items(rows, "query_id", "raw")).select("query_id", "id", "task", "route", "depends_on", "deps_declared", "pruned")


@query("SELECT event_id, (props->>'k')::INT AS k, CASE WHEN (props->>'k')::INT < event_id % 10 THEN (props->>'k')::INT END AS depends_on FROM events")
def dag_validate(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_id") % 10).alias("id"))
    return jsonish.prune_dependencies(e.withColumn("depends_on", F.col("k"))).select("event_id", "k", "depends_on")


@cases("truth_words", [(1, "true"), (2, " YES "), (3, "false"), (4, "0"), (5, None), (6, "足夠")], "id int, said string", [(1, True), (2, True), (3, False), (4, False), (5, False), (6, True)], "id, yes")
def _truth(rows):
    return rows.select("id", jsonish.truthy(F.col("said")).alias("yes"))


# --- lines, folds, html --------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    h AS (SELECT *, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, section, min(pos) AS first, count(*) AS n FROM h GROUP BY ALL""")
def section_label(spark, d):
    marked = lines.sections(lines.lines_of(table(spark, d, "documents")), F.length("line") < 40)
    return marked.groupBy("doc_id", "section").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    k AS (SELECT *, CASE WHEN length(line) > 300 THEN 'txt' WHEN length(line) > 100 THEN 'tab' ELSE 'neu' END AS kind FROM l),
    g AS (SELECT *, sum((kind = 'txt')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM k)
    SELECT doc_id, island, min(pos) AS first, max(CASE WHEN kind = 'tab' THEN pos END) AS last, count(*) FILTER (kind = 'tab') AS cores FROM g WHERE kind <> 'txt' GROUP BY ALL HAVING count(*) FILTER (kind = 'tab') >= 2""")
def tab_islands(spark, d):
    kind = F.when(F.length("line") > 300, F.lit("txt")).when(F.length("line") > 100, F.lit("tab")).otherwise(F.lit("neu"))
    return lines.islands(lines.lines_of(table(spark, d, "documents")).withColumn("kind", kind), "kind", ["tab", "neu"], "tab", 2)


@query("""SELECT doc_id, trim(line) AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY ALL""")
def line_counts(spark, d):
    return lines.line_counts(table(spark, d, "documents"))


@cases("small_chunk_fold", [(1, ["aaaa", "b", "cccc", "d"]), (2, ["a", "bbbbbb"]), (3, []), (4, ["aaaaaaaaaa", "b"]), (5, ["x"])], "id int, chunks array<string>", [(1, "aaaa~b|cccc~d"), (2, "a~bbbbbb"), (3, ""), (4, "aaaaaaaaaa|b"), (5, "x")], "id, merged")
def _fold(rows):
    return rows.select("id", F.replace(F.array_join(lines.merge_small(F.col("chunks"), 3, 11), "|"), F.lit("\n\n"), F.lit("~")).alias("merged"))


@query()
def html_pages(spark, d):
    return html.parse_pages(table(spark, d, "pages"))


@query()
def recursive_chunks(spark, d):
    return lines.split_documents(table(spark, d, "documents"), 800, 80)


@query("""WITH s AS (SELECT doc_id, n_chars, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, n_chars::DOUBLE AS distance FROM documents), l AS (SELECT source, quantile_cont(distance, 0.9) AS lim FROM s GROUP BY 1)
    SELECT source, pos, sum((distance > lim)::INT) OVER (PARTITION BY source ORDER BY pos) AS chunk FROM s JOIN l USING (source)""")
def semantic_chunks(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    s = table(spark, d, "documents").select("source", (F.row_number().over(w) - 1).alias("pos"), F.col("n_chars").cast("double").alias("distance"))
    return lines.semantic_breaks(s, "source").select("source", "pos", "chunk")


# --- storage and state ------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 50 = 0""")
def upsert_latest(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = old.where("o_orderkey % 50 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return storage.upsert(old, changed.unionByName(added), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_source(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return storage.delete_sources(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


@query("SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 3 <> 0 OR lang = 'fr'")
def hash_incremental(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), "lang")
    state = docs.where("doc_id % 3 = 0").withColumn("hash", F.when(F.col("lang") == "fr", F.lit("old")).otherwise(F.col("hash")))
    return storage.changed(docs.select("doc_id", "hash"), state.select("doc_id", "hash"), ["doc_id"])


@query("""SELECT o_custkey, o_orderkey, 'new' AS side FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT') UNION ALL SELECT o_custkey, o_orderkey, 'missing' FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT'""")
def gold_drift(spark, d):
    o = table(spark, d, "orders")
    return storage.drift(o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@query("SELECT 'plan' AS kind, c_custkey::VARCHAR AS key, v.last AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1) v ON o_custkey = c_custkey")
def decision_replay(spark, d):
    decisions = table(spark, d, "orders").select(F.lit("plan").alias("kind"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("at"))
    wanted = table(spark, d, "customer").select(F.lit("plan").alias("kind"), F.col("c_custkey").cast("string").alias("key"))
    return incremental.replay(wanted, decisions)


@cases("snapshot_fields", [("a", "--- Price ---\nLast : $1.2B\nMargin: 12.34%\n--- Other ---\nName: X Corp\nShares : 1,234\nNone : N/A")], "path string, text string",
       [("a", "Price", "Last", "$1.2B", 1.2, "B"), ("a", "Price", "Margin", "12.34%", 12.34, "percent"), ("a", "Other", "Name", "X Corp", None, None), ("a", "Other", "Shares", "1,234", 1234.0, None), ("a", "Other", "None", "N/A", None, None)], "path, section, field, raw, value, unit")
def _snapshots(rows):
    return storage.key_values(rows)
