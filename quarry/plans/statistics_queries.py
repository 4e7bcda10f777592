"""Distributions, votes, agreement, conflicts and staleness bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import metrics, validators
from quarry.plans.retrieval_queries import _FILINGS, _LINES, _ranked_lines
from quarry.sources.tables import filings, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PCT = ", ".join(f"list_sort(list(n_chars))[(round_even({p} / 100.0 * (count(*) - 1), 0))::INT + 1] AS p{p}" for p in (50, 90, 95, 99))


@query(f"SELECT lang, {_PCT} FROM documents GROUP BY 1")
def nearest_rank_percentiles(spark, d):
    return metrics.exact_percentiles(table(spark, d, "documents"), "n_chars", ["lang"], [50, 90, 95, 99])


@query("""SELECT coalesce(lang, 'ALL') AS lang, count(n_chars) AS n, round(avg(n_chars), 2) AS mean, max(n_chars) AS max,
    count(*) FILTER (n_chars > 1200) AS over_1200, round(100 * avg((n_chars > 1200)::INT), 2) AS pct_over_1200, count(*) FILTER (n_chars > 2048) AS over_2048, round(100 * avg((n_chars > 2048)::INT), 2) AS pct_over_2048
    FROM documents GROUP BY GROUPING SETS ((lang), ())""")
def length_profile(spark, d):
    return metrics.length_profile(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", "lang", [1200, 2048])


@query("""WITH r AS (SELECT l_orderkey AS answer_id, l_linenumber AS weight, l_returnflag = 'R' AS hit, l_linenumber = 1 AS critical, l_linenumber = 7 AND l_linestatus = 'F' AS fatal FROM lineitem),
    s AS (SELECT answer_id, sum(weight * hit::INT) / sum(weight)::DOUBLE AS share, bool_or(critical AND NOT hit) AS missed_critical, bool_or(fatal AND hit) AS fatal FROM r GROUP BY 1)
    SELECT answer_id, round(CASE WHEN fatal THEN 0 WHEN missed_critical THEN least(share, 0.5) ELSE share END, 6) AS score, missed_critical, fatal FROM s""")
def weighted_score(spark, d):
    i = table(spark, d, "lineitem")
    rows = i.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("weight"), (F.col("l_returnflag") == "R").alias("hit"), (F.col("l_linenumber") == 1).alias("critical"), ((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "F")).alias("fatal"))
    return metrics.weighted_correctness(rows, ["answer_id"])


@query("SELECT user_id, event_type AS item, count(*) FILTER (value > 50) * 2 > 5 AS hit FROM events GROUP BY ALL")
def majority_vote(spark, d):
    votes = table(spark, d, "events").select("user_id", F.col("event_type").alias("item"), (F.col("value") > 50).alias("hit"))
    return metrics.majority(votes, ["user_id"], 5)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def first_seen_mode(spark, d):
    return metrics.first_mode(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1""")
def pearson_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"), F.count("*").alias("n"))


_RUNS = "WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, list(event_type ORDER BY event_id) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1), r AS (SELECT * FROM a JOIN b USING (user_id))"


@query(f"""{_RUNS} SELECT round(avg((list_sort(list_distinct(a)) = list_sort(list_distinct(b)))::INT), 6) AS same_set, round(avg((a = b)::INT), 6) AS same_order,
    round(avg(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a || b))::DOUBLE), 6) AS mean_jaccard FROM r""")
def run_stability(spark, d):
    e = table(spark, d, "events")
    run = lambda n, c: e.where(F.pmod("event_id", F.lit(2)) == n).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias(c))
    return metrics.run_agreement(run(0, "a").join(run(1, "b"), "user_id"))


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL)
    SELECT user_id, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS across, round(avg(s), 6) AS within, count(*) AS runs FROM m GROUP BY 1""")
def two_level_spread(spark, d):
    return metrics.two_level_spread(table(spark, d, "events"), "event_type", "user_id", "value")


@query("SELECT o_custkey, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::INT] AS upper_median, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def upper_median(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(metrics.upper_median(F.collect_list("o_totalprice")).alias("upper_median"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"""WITH {_LINES}, t AS (SELECT * FROM l WHERE rank <= 10), b AS (SELECT query_id, arg_min(source, rank) AS best FROM t GROUP BY 1),
    s AS (SELECT query_id, item_id, count(DISTINCT source) AS density FROM t GROUP BY ALL), x AS (SELECT query_id, max(density) AS density FROM s GROUP BY 1)
    SELECT query_id, count(DISTINCT source) AS sources, count(*) FILTER (source <> best) AS crowding, any_value(density) AS density FROM t JOIN b USING (query_id) JOIN x USING (query_id) GROUP BY 1""")
def crowding_seats(spark, d):
    return metrics.seats(_ranked_lines(spark, d), "query_id", "source", "rank", 10)


@query(f"""WITH {_FILINGS}, t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score DESC, source) <= 5)
    SELECT ticker, count(DISTINCT period_code) AS periods, count(DISTINCT CASE WHEN kind = '10-K' THEN period_code END) AS annual, list_sort(list(DISTINCT period_code)) AS codes FROM t GROUP BY 1""")
def trend_periods(spark, d):
    top = filings(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("score"), "source"))).where("rank <= 5")
    return top.groupBy("ticker").agg(F.count_distinct("period_code").alias("periods"), F.count_distinct(F.when(F.col("kind") == "10-K", F.col("period_code"))).alias("annual"), F.array_sort(F.collect_set("period_code")).alias("codes"))


def _claims(spark, d):
    """Order lines as claims: an answer per order, its cell by flag and status."""
    i = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, F.lit("level")).when(F.col("l_linenumber") % 2 == 0, F.lit("growth_pct")).otherwise(F.lit("change"))
    return i.select(
        F.col("l_orderkey").alias("answer_id"), (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("seq"), F.col("l_returnflag").alias("metric"), F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string"))).alias("entity"),
        F.when(F.col("l_linestatus") == "O", F.lit("consolidated")).otherwise(F.lit("segment")).alias("scope"), F.when(F.col("l_partkey") % 10 == 0, F.lit("unknown")).otherwise(F.year("l_shipdate").cast("string")).alias("period_key"),
        kind.alias("kind"), F.lit("USD_M").alias("unit"), F.lit("reported").alias("basis"), F.col("l_quantity").cast("double").alias("value"), F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("quote"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit("news")).otherwise(F.lit("authority")).alias("src"),
    )


_CLAIMS = """c AS (SELECT l_orderkey AS answer_id, l_linenumber::BIGINT * 10000000 + l_partkey AS seq, l_returnflag AS metric, CASE WHEN l_linestatus = 'O' THEN '' ELSE 's' || (l_suppkey % 3) END AS entity,
    CASE WHEN l_linestatus = 'O' THEN 'consolidated' ELSE 'segment' END AS scope, CASE WHEN l_partkey % 10 = 0 THEN 'unknown' ELSE year(l_shipdate)::VARCHAR END AS period_key,
    CASE WHEN l_linenumber % 3 = 0 THEN 'level' WHEN l_linenumber % 2 = 0 THEN 'growth_pct' ELSE 'change' END AS kind, 'USD_M' AS unit, 'reported' AS basis, l_quantity::DOUBLE AS value, 'q' || l_partkey AS quote,
    CASE WHEN l_suppkey % 4 = 0 THEN 'news' ELSE 'authority' END AS src FROM lineitem)"""


@query(f"""WITH {_CLAIMS} SELECT answer_id, metric, entity, scope, period_key, kind, unit, basis, min(value) AS low, max(value) AS high FROM c
    WHERE metric <> '' AND period_key <> 'unknown' AND kind IN ('change', 'growth_pct') GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
    HAVING count(DISTINCT quote) >= 2 AND count(*) >= 2 AND count(DISTINCT round(value, 4)) <= 2 AND max(value) > 0 AND (max(value) - min(value)) / max(value) > 0.02""")
def claim_conflicts(spark, d):
    return validators.conflicting_claims(_claims(spark, d))


@query(f"""WITH {_CLAIMS}, g AS (SELECT answer_id, metric, entity, arg_min(CASE WHEN kind = 'change' THEN value END, CASE WHEN kind = 'change' THEN seq END) AS stated, count(*) FILTER (kind = 'level') AS levels,
      max(value) FILTER (kind = 'level') AS top, min(value) FILTER (kind = 'level') AS bottom FROM c WHERE scope = 'segment' GROUP BY ALL),
    s AS (SELECT answer_id, metric, count(*) AS n, sum(coalesce(stated, top - bottom)) AS segment_sum, max(coalesce(stated, top - bottom)) AS largest, min(coalesce(stated, top - bottom)) AS least FROM g WHERE stated IS NOT NULL OR levels = 2 GROUP BY ALL HAVING n >= 2),
    j AS (SELECT answer_id, metric, segment_sum, largest, least, bool_or(abs(value - segment_sum) / greatest(abs(segment_sum), 1e-9) <= 0.02) AS fits, min(value) AS reported FROM c JOIN s USING (answer_id, metric) WHERE scope = 'consolidated' AND kind = 'change' GROUP BY ALL)
    SELECT answer_id, metric, reported, largest, segment_sum FROM j WHERE NOT fits AND least > 0 AND reported < largest * 0.98""")
def segment_conflicts(spark, d):
    return validators.segment_conflicts(_claims(spark, d))


@query(f"""WITH {_CLAIMS}, p AS (SELECT a.answer_id, a.seq AS weak_seq, a.value AS weak_value, b.seq, b.value FROM c a JOIN c b USING (answer_id, metric, entity, scope, period_key, unit) WHERE a.src = 'news' AND b.src = 'authority'
    AND abs(a.value - b.value) / greatest(abs(b.value), 1e-9) > 0.02) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY answer_id, weak_seq ORDER BY seq) = 1""")
def authority_conflicts(spark, d):
    return validators.authority_conflicts(_claims(spark, d))


@query(f"""WITH {_FILINGS}, s AS (SELECT ticker, max(y * 10 + ord) AS available, max(CASE WHEN score < 100000 THEN y * 10 + ord END) AS used FROM f GROUP BY 1)
    SELECT ticker, available // 10 AS available_year, used // 10 AS used_year FROM s WHERE used < available""")
def stale_period(spark, d):
    chunks = filings(spark, d).withColumn("cited", F.col("score") < 100000).withColumn("query_id", F.lit(1))
    found = validators.stale_periods(chunks, "query_id")
    return found.select("ticker", F.col("available.year").alias("available_year"), F.col("used.year").alias("used_year"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS answer_id, l_partkey AS source, l_linenumber AS chunk FROM lineitem),
    a AS (SELECT DISTINCT l_orderkey AS answer_id, l_partkey AS source, l_linenumber AS chunk, 1 AS k FROM lineitem WHERE l_returnflag <> 'N')
    SELECT answer_id, count(*) - count(a.k) AS invented, count(a.k) AS valid FROM c LEFT JOIN a USING (answer_id, source, chunk) GROUP BY 1""")
def citation_check(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("chunk"), "l_returnflag")
    return validators.check_citations(i.drop("l_returnflag"), i.where("l_returnflag <> 'N'"))


@query("""WITH k AS (SELECT l_orderkey AS answer_id, count(*) FILTER (l_linestatus = 'F') AS b1, count(*) FILTER (l_linestatus = 'O') AS a1, count(*) FILTER (l_returnflag = 'R') AS b2, count(*) FILTER (l_returnflag = 'A') AS a2 FROM lineitem GROUP BY 1)
    SELECT answer_id, a1 <= b1 AND a2 <= b2 AS accept FROM k""")
def accept_revision(spark, d):
    i = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "answer_id")
    side = lambda one, two: i.groupBy("answer_id").agg(F.count_if(one).alias("numbers"), F.count_if(two).alias("periods"))
    before, after = side(F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"), side(F.col("l_linestatus") == "O", F.col("l_returnflag") == "A")
    return validators.accept_revision(before, after, "answer_id", ["numbers", "periods"])


@query("""SELECT coalesce(l_returnflag, 'overall') AS category, count(*) AS n, round(avg(l_discount), 4) AS mean, round(avg((l_discount >= 0.05)::INT), 4) AS pass_rate, count(*) FILTER (l_linestatus = 'F') AS fatal FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def grouping_overall(spark, d):
    i = table(spark, d, "lineitem")
    out = i.rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"), F.round(F.avg((F.col("l_discount") >= 0.05).cast("int")), 4).alias("pass_rate"), F.count_if(F.col("l_linestatus") == "F").alias("fatal"))
    return out.select(F.coalesce("l_returnflag", F.lit("overall")).alias("category"), "n", "mean", "pass_rate", "fatal")


@query("""SELECT o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'F') AS found, count(*) FILTER (o_orderstatus = 'O') AS lost, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS na,
    round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0)::DOUBLE, 6) AS rate FROM orders GROUP BY 1""")
def funnel_tally(spark, d):
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    found, counted = F.count_if(s == "F"), F.count_if(s.isin("F", "O"))
    return o.groupBy(F.col("o_orderpriority").alias("category")).agg(found.alias("found"), F.count_if(s == "O").alias("lost"), F.count_if(~s.isin("F", "O")).alias("na"), F.round(F.try_divide(found.cast("double"), counted), 6).alias("rate"))


@query("""SELECT doc_id, text_md5 FROM (SELECT doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def seen_key_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return rows.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_md5")


@query("""WITH n AS (SELECT event_id, ts, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
    SELECT user_id, event_id, seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY seq), 4) AS running FROM n""")
def running_counters(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("seq", F.row_number().over(w))
    return e.select("user_id", "event_id", "seq", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("""WITH b AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, value FROM events) SELECT event_type, w AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY ALL""")
def hourly_windows(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "n", "total")
