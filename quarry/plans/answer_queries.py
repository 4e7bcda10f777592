"""Checks of answers bound to the driver tables: answers are put together from rows, so the SQL can tell the result from the numbers alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import amounts
from quarry.operators import answers, comparisons
from quarry.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _joined(rows, key, order, part):
    """One answer a key: the parts in their order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["p"]), "").alias("answer"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("answer_id"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


@query("""WITH o AS (SELECT o_custkey AS answer_id, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders),
    w AS (SELECT * FROM o WHERE o_orderkey % 2 = 1 AND price > 0), k AS (SELECT * FROM o WHERE o_orderkey % 2 = 0 AND price > 0),
    p AS (SELECT DISTINCT w.answer_id FROM w JOIN k USING (answer_id) WHERE greatest(w.price, k.price)::DOUBLE / least(w.price, k.price)::DOUBLE <= 10 AND abs(w.price - k.price)::DOUBLE / greatest(w.price, k.price)::DOUBLE > 0.02),
    f AS (SELECT answer_id, NOT bool_or(o_orderkey % 2 = 1 AND o_orderkey % 9 = 0) AS web_undated, NOT bool_or(o_orderkey % 2 = 0 AND o_orderkey % 5 = 0) AS filing_undated FROM o GROUP BY answer_id)
    SELECT answer_id, web_undated, filing_undated FROM f JOIN p USING (answer_id) WHERE web_undated OR filing_undated""")
def undated_dual_sourcing(spark, d):
    o = _orders(spark, d)
    web = F.concat(F.lit("Worth $"), F.format_number("price", 2), F.lit(" million"), F.when(F.col("o_orderkey") % 9 == 0, F.lit(" on 2026‑09‑01")).otherwise(""), F.lit(" [web: page]. \n"))
    filing = F.concat(F.lit("Reported at "), F.format_number("price", 2), F.lit(" 百萬美元"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(" in FY2025")).otherwise(""), F.lit("【report.html, chunk #"), F.col("o_orderkey").cast("string"), F.lit("】。"))
    return answers.undated_dual_sourcing(_joined(o, "answer_id", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, web).otherwise(filing)))


@query("""WITH o AS (SELECT o_custkey AS answer_id, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM orders),
    r AS (SELECT *, CASE o_orderkey % 4 WHEN 1 THEN 10 WHEN 2 THEN 100 END AS s FROM o WHERE o_orderkey % 4 IN (1, 2)),
    q AS (SELECT *, c // s + CASE WHEN 2 * (c % s) > s OR (2 * (c % s) = s AND (c // s) % 2 = 1) THEN 1 ELSE 0 END AS v FROM r WHERE c % s <> 0)
    SELECT answer_id, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS source_value, 'million' AS unit,
        CASE WHEN s = 100 THEN CAST(v AS VARCHAR) WHEN v % 10 = 0 THEN CAST(v // 10 AS VARCHAR) ELSE (v // 10) || '.' || (v % 10) END AS wrote, 'order_' || o_orderkey || '.txt' AS source, 7 AS chunk FROM q""")
def rounding_losses(spark, d):
    o = _orders(spark, d).withColumn("source", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".txt")))
    chunks = o.select("answer_id", "source", F.lit(7).alias("chunk"), F.concat(F.lit("Value of the order: "), F.col("price").cast("string"), F.lit(" million")).alias("text"))
    turn = F.col("o_orderkey") % 4
    full, one, none = (F.col("price").cast("string"), F.regexp_replace(F.bround("price", 1).cast("decimal(18,1)").cast("string"), r"\.0$", ""), F.bround("price", 0).cast("decimal(18,0)").cast("string"))
    wrote = F.when(turn == 1, one).when(turn == 2, none).when(turn == 3, F.concat(full, F.lit(" million, or about "), none)).otherwise(full)
    said = F.concat(F.lit("It was "), wrote, F.lit(" million【"), F.col("source"), F.lit(", chunk #7】, and "))
    return answers.rounding_losses(_joined(o, "answer_id", "o_orderkey", said), chunks)


@query("""WITH l AS (SELECT l_orderkey AS answer_id, l_linenumber AS n, min(l_partkey) AS p, l_linenumber % 3 <> 0 AND min(l_quantity) < 45 AS good FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT answer_id, string_agg('Line ' || n || CASE WHEN good THEN '【part_' || p || '.html, chunk #' || n * 10 || '】' ELSE '【Reference ' || (n + CASE WHEN n % 3 = 0 THEN 100 ELSE 0 END) || ', chunk #' || (n * 10 + CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END) || '】' END || ' ends. ', '' ORDER BY n) || 'Last.' AS answer,
        count(*) FILTER (good) AS fixed, count(*) FILTER (NOT good) AS skipped FROM l GROUP BY answer_id""")
def repaired_references(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("int").alias("n")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    allowed = i.select("answer_id", F.col("n").alias("place"), (F.col("n") * 10).alias("chunk"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit(".html")).alias("source"))
    third = F.col("n") % 3 == 0
    place = F.col("n") + F.when(third, 100).otherwise(0)
    chunk = F.col("n") * 10 + F.when(third | (F.col("l_quantity") < 45), 0).otherwise(1)
    part = F.concat(F.lit("Line "), F.col("n").cast("string"), F.lit("【Reference "), place.cast("string"), F.lit(", chunk #"), chunk.cast("string"), F.lit("】 ends. "))
    made = _joined(i, "answer_id", "n", part).select("answer_id", F.concat("answer", F.lit("Last.")).alias("answer"))
    return answers.repaired_references(made, allowed)


@query("""WITH o AS (SELECT o_custkey AS answer_id, o_orderkey, o_orderkey % 3 AS d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM orders),
    z AS (SELECT answer_id FROM o GROUP BY answer_id HAVING count(*) <= 12),
    u AS (SELECT *, CAST(10 ** (5 - d) AS BIGINT) AS s FROM o),
    r AS (SELECT answer_id, o_orderkey, d, c // s + CASE WHEN 2 * (c % s) > s OR (2 * (c % s) = s AND (c // s) % 2 = 1) THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS v FROM u),
    g AS (SELECT o.answer_id, p.d, c // s + CASE WHEN 2 * (c % s) > s OR (2 * (c % s) = s AND (c // s) % 2 = 1) THEN 1 ELSE 0 END AS v FROM o, (VALUES (0, 100000), (1, 10000), (2, 1000)) p(d, s))
    SELECT answer_id, CASE d WHEN 0 THEN CAST(v AS VARCHAR) ELSE (v // CAST(10 ** d AS BIGINT)) || '.' || lpad(CAST(v % CAST(10 ** d AS BIGINT) AS VARCHAR), CAST(d AS INTEGER), '0') END AS literal
    FROM r WHERE answer_id IN (SELECT answer_id FROM z) AND (answer_id, d, v) NOT IN (SELECT answer_id, d, v FROM g)""")
def unsupported_numbers(spark, d):
    o = _orders(spark, d).withColumn("percent", (F.col("price") / 1000).cast("decimal(18,5)"))
    more = F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(0)
    at = [(F.bround("percent", p).cast(f"decimal(18,{p})") + (more * F.lit(10.0**-p)).cast("decimal(18,2)")).cast(f"decimal(18,{p})").cast("string") for p in range(3)]
    wanted = o.select("answer_id", F.when(F.col("o_orderkey") % 3 == 0, at[0]).when(F.col("o_orderkey") % 3 == 1, at[1]).otherwise(at[2]).alias("literal"))
    share = F.col("o_orderkey") % 2 == 0
    sources = o.select("answer_id", F.when(share, (F.col("percent") / 100).cast("decimal(18,7)")).otherwise(F.col("percent")).alias("value"), share.alias("share"), F.lit(1000).alias("size"))
    return answers.unsupported_numbers(wanted, sources, 12_000)


#: Words that name a benchmark item in the query below: its first three.
_NAMED = r"^(\S+ \S+ \S+)"


@query(r"""WITH n AS (SELECT regexp_extract(lower(text), '^(\S+ \S+ \S+)', 1) AS name, min(item_id) AS item FROM benchmark GROUP BY name HAVING name <> ''),
    h AS (SELECT doc_id, item, regexp_extract(lower(text), '(?s)^(.*?(?:^|[^\p{L}\p{N}_]))' || regexp_escape(name) || '(?:$|[^\p{L}\p{N}_])', 1) AS before, strpos(lower(text), name) AS p FROM documents, n WHERE contains(lower(text), name)
        AND regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])' || regexp_escape(name) || '(?:$|[^\p{L}\p{N}_])'))
    SELECT doc_id, CAST(item AS VARCHAR) AS entity, CAST(min(length(before)) AS INTEGER) AS first FROM h GROUP BY doc_id, item""")
def first_mentions(spark, d):
    named = table(spark, d, "benchmark").select(F.regexp_extract(F.lower("text"), _NAMED, 1).alias("name"), "item_id").where("name <> ''")
    names = {r["name"]: str(r["item"]) for r in named.groupBy("name").agg(F.min("item_id").alias("item")).limit(comparisons.MAX_NAMES + 1).collect()}
    hits = comparisons.mentions(table(spark, d, "documents"), "doc_id", "text", names).select("doc_id", F.explode("hits").alias("h"))
    return hits.groupBy("doc_id", F.col("h.entity").alias("entity")).agg(F.min("h.start").alias("first"))


@query("""WITH l AS (SELECT l_orderkey AS answer_id, l_linenumber AS n, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber),
    w AS (SELECT answer_id, max(v) FILTER (n = 1) AS a, max(v) FILTER (n = 2) AS b, max(v) FILTER (n = 3) AS c FROM l GROUP BY answer_id),
    t AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS whole, CASE WHEN a >= greatest(b, c) THEN 'NVDA' WHEN b >= c THEN 'META' ELSE 'GOOGL' END AS high, CASE answer_id % 4 WHEN 0 THEN 'NVDA' WHEN 1 THEN 'META' WHEN 2 THEN 'GOOGL' END AS claimed FROM w)
    SELECT answer_id, CASE WHEN claimed IS NULL OR NOT whole THEN 'N/A' WHEN claimed = high THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN claimed IS NULL THEN 'no_claim' WHEN NOT whole THEN 'unfounded' ELSE '' END AS reason, claimed,
        CASE WHEN claimed IS NOT NULL AND whole THEN high END AS truth, concat_ws('|', CASE WHEN a IS NULL THEN 'NVDA' END, CASE WHEN b IS NULL THEN 'META' END, CASE WHEN c IS NULL THEN 'GOOGL' END) AS missing FROM t""")
def comparison_claims(spark, d):
    i = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("place")).agg(F.max("l_extendedprice").cast("decimal(18,2)").alias("v"))
    ticker = F.when(F.col("place") == 1, "NVDA").when(F.col("place") == 2, "META").otherwise("GOOGL")
    contexts = i.select("answer_id", "place", F.concat(F.lit("["), ticker, F.lit("] Size (now): $"), (F.col("v") / 1000).cast("decimal(18,5)").cast("string"), F.lit("B Other: 9")).alias("text"))
    lists, turn = "在輝達、Meta 與 Alphabet（GOOGL）中，", F.col("answer_id") % 4
    said = F.when(turn == 0, "以 NVIDIA 的規模最大").when(turn == 1, "很明顯 Meta 這一年領先於其他的 Alphabet").when(turn == 2, "規模最大的，據資料顯示，正是谷歌").otherwise("沒有資料")
    answers_ = i.select("answer_id").distinct().select("answer_id", F.concat(F.lit(lists), said, F.lit("。📚 NVIDIA 最高")).alias("answer"), F.array(*map(F.lit, ("NVDA", "META", "GOOGL"))).alias("companies"), F.lit("Size (now)").alias("field"), F.lit(True).alias("largest"))
    return comparisons.judged(answers_, contexts).withColumn("missing", F.array_join("missing", "|"))


@query("""WITH o AS (SELECT o_orderkey AS answer_id, o_orderkey % 5 AS turn, (o_orderkey % 900 + 100) || '.' || (o_orderkey % 9 + 1) AS n, format('{:,}', (o_orderkey % 900 + 100) * 10 + o_orderkey % 9 + 1) AS ten FROM orders)
    SELECT answer_id, 'It is ' || CASE WHEN turn IN (0, 1, 3) THEN ten || ' 億美元（$' || n || ' billion）' ELSE n || ' 億美元' END || ' in all.' AS text, CASE WHEN turn = 3 THEN 1 ELSE 0 END AS removed, CASE WHEN turn = 1 THEN 1 ELSE 0 END AS repaired FROM o""")
def unit_conversion(spark, d):
    n = F.concat((F.col("o_orderkey") % 900 + 100).cast("string"), F.lit("."), (F.col("o_orderkey") % 9 + 1).cast("string"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderkey") % 5).alias("turn"), n.alias("n"))
    said = F.when(F.col("turn") == 0, F.concat(F.lit("$"), "n", F.lit("B"))).when(F.col("turn") == 3, F.concat(F.lit("$"), "n", F.lit(" billion（約 "), "n", F.lit(" 億美元）"))).otherwise(F.concat("n", F.lit(" 億美元")))
    tenth = (F.col("n").cast("decimal(10,1)") / 10).cast("decimal(10,2)").cast("string")
    source = F.when(F.col("turn") == 1, F.concat(F.lit("sales of $"), "n", F.lit(" billion"))).when(F.col("turn") == 2, F.concat(F.lit("sales of $"), tenth, F.lit(" billion, not $"), "n", F.lit(" billion"))).otherwise("none")
    return amounts.finalised(o.select("answer_id", F.concat(F.lit("It is "), said, F.lit(" in all.")).alias("text")), o.select("answer_id", source.alias("text")))


@query("""WITH o AS (SELECT o_orderkey AS answer_id, o_orderkey % 4 AS turn, CAST(o_orderkey % 900 + 100 AS BIGINT) AS n FROM orders), s AS (SELECT *, 'Sales were ' || n * 10 || ' 億美元（$' || n || ' billion），' AS a FROM o)
    SELECT answer_id, CASE turn WHEN 0 THEN '' WHEN 1 THEN n * 10 || ' 億美元（$' || n * 10 || ' billion' ELSE '' END AS wrong,
        CASE turn WHEN 0 THEN '11:' || n * 1000 WHEN 1 THEN '11:' || n * 1000 || '|' || (11 + length(n * 10 || ' 億美元（')) || ':' || n * 10000
            WHEN 2 THEN '11:' || n * 1000 || '|' || (length(a) + 60) || ':' || n * 1000 ELSE '11:' || n * 1000 || '|' || (length(a) + 5) || ':' || n * 1100 END AS amounts FROM s""")
def stated_amounts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderkey") % 4).alias("turn"), (F.col("o_orderkey") % 900 + 100).alias("n"))
    first = F.concat(F.lit("Sales were "), (F.col("n") * 10).cast("string"), F.lit(" 億美元（$"), F.when(F.col("turn") == 1, F.col("n") * 10).otherwise(F.col("n")).cast("string"), F.lit(" billion），"))
    far = F.concat(F.lit("x" * 59 + " "), (F.col("n") * 10).cast("string"), F.lit(" 億美元"))
    more = F.when(F.col("turn") == 2, far).when(F.col("turn") == 3, F.concat(F.lit("then "), (F.col("n") * 11).cast("string"), F.lit(" 億美元"))).otherwise("")
    text = F.concat(first, more)
    wrong = F.array_join(F.transform(amounts.wrong_twice(text), lambda x: x["said"]), "|")
    places = F.array_join(F.transform(amounts.stated(text), lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["millions"].cast("long").cast("string"))), "|")
    return o.select("answer_id", wrong.alias("wrong"), places.alias("amounts"))
