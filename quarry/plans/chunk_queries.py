"""Chunk records and words of any language on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import segment
from quarry.functions.text import item_id
from quarry.operators import chunks, search
from quarry.plans.retrieval_queries import _BM25, _TOKENS
from quarry.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _elements(spark, d):
    """Orders as files, their lines as elements; role and text follow from the part."""
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("p"))
    turn, p = F.col("p") % 5, F.col("p").cast("string")
    role = F.when(turn == 0, "Table").when(turn == 1, "Title").when(turn == 2, "Text").otherwise("NarrativeText")
    note = F.concat(F.lit("Note "), p, F.when(F.col("p") % 2 == 0, ".").otherwise(""))
    text = F.when(turn == 0, F.concat(F.lit("| part | n |\n|---|---|\n| "), p, F.lit(" | 5 |"))).when(turn == 1, F.concat(F.lit("Part "), p)).when(turn == 2, note)
    return i.select("file", "pos", role.alias("role"), text.otherwise(F.repeat(F.concat(F.lit("word "), p, F.lit(".")), 40)).alias("text"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS file, l_linenumber AS pos, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    e AS (SELECT file, pos, p % 5 AS r, CASE p % 5 WHEN 0 THEN '| part | n |' || chr(10) || '|---|---|' || chr(10) || '| ' || p || ' | 5 |' WHEN 1 THEN 'Part ' || p
        WHEN 2 THEN 'Note ' || p || CASE WHEN p % 2 = 0 THEN '.' ELSE '' END ELSE repeat('word ' || p || '.', 40) END AS text, r = 1 OR (r = 2 AND p % 2 = 1) AS header FROM l),
    v AS (SELECT *, lag(r) OVER w AS before, lag(text) OVER w AS said FROM e WINDOW w AS (PARTITION BY file ORDER BY pos)),
    t AS (SELECT file, pos, CASE WHEN before <> 0 THEN left(said, 240) || chr(10) || chr(10) ELSE '' END || text AS text FROM v WHERE r = 0),
    x AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) AS i, text, header FROM e WHERE r <> 0),
    s AS (SELECT file, i, text, length(text) AS size, 0 AS section FROM x WHERE i = 1 UNION ALL
        SELECT x.file, x.i, x.text, CASE WHEN x.header AND s.size >= 350 THEN 0 ELSE s.size END + length(x.text), s.section + (x.header AND s.size >= 350)::INT FROM s JOIN x ON x.file = s.file AND x.i = s.i + 1),
    g AS (SELECT file, section, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM s GROUP BY ALL),
    u AS (SELECT file, 'table' AS chunk_type, pos, text FROM t UNION ALL SELECT file, 'text', section, text FROM g WHERE length(text) > 20)
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY chunk_type, pos) - 1 AS chunk_index, chunk_type, text FROM u""")
def chunk_records(spark, d):
    return chunks.chunk_records(_elements(spark, d), split=lambda text: [text])


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'Part I, Item 2' ELSE 'Item 7.' END AS item FROM orders),
    b AS (SELECT *, CASE k % 4 WHEN 0 THEN 'Fiscal Year ' || y || ' vs ' || (y - 1) WHEN 1 THEN 'Nine Months Ended March 31, ' || y || ' vs March 31, ' || (y - 1) WHEN 2 THEN 'Six Months Ended May 1, ' || y || ' Compared with Nine Months Ended May 1, ' || (y - 1) END AS period,
        CASE k % 5 WHEN 0 THEN 'Sales grew.' WHEN 1 THEN 'Sales grew 5 %.' WHEN 2 THEN 'Growth is slow.' WHEN 3 THEN 'Costs FELL to $ 12' ELSE repeat('Sales rose. ', 120) END AS body FROM o)
    SELECT c AS source, CASE WHEN item = 'Item 7.' THEN 'Item_7' ELSE 'Part_I_Item_2' END AS item, row_number() OVER (PARTITION BY c, item ORDER BY k) - 1 AS item_chunk_index,
        coalesce('[' || period || '] ', '') || CASE WHEN k % 7 = 0 THEN '' ELSE '[section: S' || k || '] ' END || body AS text, k % 5 = 0 AS orphan FROM b""")
def item_records(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    heading = (
        F.when(k % 4 == 0, F.format_string("Fiscal  Year %d Compared With Fiscal Year %d", y, y - 1))
        .when(k % 4 == 1, F.format_string(" Nine Months\nEnded March 31, %d Compared with Nine Months Ended March 31, %d", y, y - 1))
        .when(k % 4 == 2, F.format_string("Six Months Ended May 1, %d Compared with Nine Months Ended May 1, %d", y, y - 1))
    )
    body = F.when(k % 5 == 0, "Sales grew.").when(k % 5 == 1, "Sales grew 5 %.").when(k % 5 == 2, "Growth is slow.").when(k % 5 == 3, "Costs FELL to $ 12").otherwise("Sales rose. " * 120)
    section = F.when(k % 7 != 0, F.concat(F.lit("S"), k.cast("string")))
    item = item_id(F.when(k % 3 == 0, "Part I, Item 2").otherwise("Item 7."))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), item.alias("item"), k, chunks.period_label(heading).alias("period"), section.alias("section"), body.alias("body"))
    text = F.concat(chunks.period_prefix(F.col("period"), F.col("section")), F.col("body"))
    return chunks.numbered(o, ["source", "item"], ["o_orderkey"]).select("source", "item", "item_chunk_index", text.alias("text"), chunks.orphan_explainer(F.col("body")).alias("orphan"))


@query(f"WITH {_BM25.replace(_TOKENS, _TOKENS.replace('[a-z0-9]+', '[' + chr(92) + 'pL' + chr(92) + 'pM' + chr(92) + 'pN]+'))} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_any_language(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_topk(asked, table(spark, d, "documents").select("doc_id", "text"), 20, words=segment.bigrams)


# What a status and a priority are called in the texts.
STATUS = {"F": "已完成", "O": "處理中", "P": "部分出貨"}
PRIORITY = {"1": "緊急訂單", "2": "優先處理", "3": "一般訂單", "4": "未指定", "5": "低優先"}


def _case(names: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _named(names: dict[str, str], of):
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[of]


@query(f"""WITH o AS (SELECT o_orderkey AS doc_id, {_case(PRIORITY, "left(o_orderpriority, 1)")} AS p, {_case(STATUS, "o_orderstatus")} AS s FROM orders),
    w AS (SELECT doc_id, unnest([CASE WHEN doc_id % 2 = 0 THEN 'größe' ELSE 'order' END, CAST(doc_id AS VARCHAR), p, s] || CASE doc_id % 3 WHEN 0 THEN ['甲乙', '乙丙'] WHEN 1 THEN ['丁'] ELSE [] END) AS term FROM o)
    SELECT doc_id, term, count(*) AS tf FROM w WHERE term IS NOT NULL GROUP BY ALL""")
def words_without_spaces(spark, d):
    """Dictionary of the names with their counts in the table, and parts of them that are words too."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), _named(PRIORITY, F.left("o_orderpriority", F.lit(1))).alias("p"), _named(STATUS, F.col("o_orderstatus")).alias("s"))
    names = o.select(F.explode(F.array("p", "s")).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    parts = names.select(F.explode(F.array(F.left("word", F.lit(2)), F.substring("word", 2, 2))).alias("word"), F.lit(1).cast("long").alias("n")).distinct()
    known = names.unionByName(parts.join(names, "word", "left_anti"))
    tail = F.when(F.col("doc_id") % 3 == 0, "甲乙丙").when(F.col("doc_id") % 3 == 1, "丁").otherwise("")
    head = F.when(F.col("doc_id") % 2 == 0, "GRÖßE ").otherwise("Order-")
    text = F.concat(head, F.col("doc_id").cast("string"), F.coalesce("p", F.lit("")), F.coalesce("s", F.lit("")), tail)
    return search.postings(o.select("doc_id", text.alias("text")), words=segment.segmenter(known))
