"""How far the evidence behind an answer reaches: gaps as rows, and ratio questions that lack a row with the asked field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Needs that only current data meets, and routes that promise a look at the web.
CURRENT, WEB = ("intraday", "days"), ("web", "both")


def newest_before(asked: DataFrame, rows: DataFrame, entity: str = "ticker", at: str = "as_of", date: str = "date", name: str = "newest") -> DataFrame:
    """``asked`` with the newest ``date`` of ``rows`` of the same entity that is not after ``at``, null where there is none.

    Both sides are first reduced to different days of an entity, so an entity with any number of rows or questions has as
    many rows in its window as it has days. Null entities and dates meet nothing; repeated questions stay.
    """
    days = rows.select(F.col(entity).alias("_e"), F.col(date).cast("date").alias("_d")).where("_e IS NOT NULL AND _d IS NOT NULL").distinct()
    needs = asked.select(F.col(entity).alias("_e"), F.col(at).cast("date").alias("_d")).where("_e IS NOT NULL AND _d IS NOT NULL").distinct()
    line = days.withColumn("_k", F.lit(0)).unionByName(needs.withColumn("_k", F.lit(1)))
    w = Window.partitionBy("_e").orderBy("_d", "_k")
    known = line.withColumn("_n", F.last(F.when(F.col("_k") == 0, F.col("_d")), ignorenulls=True).over(w)).where("_k = 1").select("_e", "_d", F.col("_n").alias(name))
    return asked.join(known, (F.col(entity) == F.col("_e")) & (F.col(at).cast("date") == F.col("_d")), "left").drop("_e", "_d")


def _gap(key: str, ticker: Column, cutoff: Column, kind: str, need: Column) -> list[Column]:
    text = lambda c: F.coalesce(c.cast("date").cast("string"), F.lit(""))
    return [F.col(key), F.coalesce(ticker, F.lit("")).alias("ticker"), text(cutoff).alias("cutoff"), text(F.col("as_of")).alias("as_of"), F.lit(kind).alias("doc_type"), need.alias("need")]


def news_gaps(used: DataFrame, news: DataFrame, key: str = "todo_id") -> DataFrame:
    """A gap for each ticker whose news a todo used, ``used(key, ticker, doc_type, as_of)``, if the newest of ``news(ticker, date)`` is older than ``as_of``."""
    asked = used.where("doc_type = 'news'").select(key, F.col("ticker").cast("string").alias("ticker"), F.col("as_of").cast("date").alias("as_of")).distinct()
    found = newest_before(asked, news.select(F.col("ticker").cast("string").alias("ticker"), "date"))
    return found.where("newest < as_of").select(*_gap(key, F.col("ticker"), F.col("newest"), "news", F.lit("")))


def _reach(todos: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    return todos.join(chunks.groupBy(key).agg(F.max(F.col("date").cast("date")).alias("_ceiling")), key, "left")


def realtime_gaps(todos: DataFrame, chunks: DataFrame, key: str = "todo_id") -> DataFrame:
    """A gap for each of ``todos(key, need, tickers, as_of)`` that needs current data; its cutoff is the newest date of its ``chunks(key, date)``."""
    return _reach(todos.where(F.col("need").isin(*CURRENT)), chunks, key).select(*_gap(key, F.array_min("tickers"), F.col("_ceiling"), "realtime", F.col("need")))


def web_route_gaps(todos: DataFrame, chunks: DataFrame, key: str = "todo_id") -> DataFrame:
    """A gap for each of ``todos(key, route, web_notes, as_of)`` that was to look at the web and has no note from it."""
    unmet = todos.where(F.col("route").isin(*WEB) & (F.coalesce("web_notes", F.lit(0)) == 0))
    return _reach(unmet, chunks, key).select(*_gap(key, F.lit(""), F.col("_ceiling"), "realtime", F.lit("days")))


def has_field(text: Column, fields: Column) -> Column:
    """The text names one of the fields, in any case; without fields every text does."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.coalesce(F.size(fields), F.lit(0)) <= 0, F.lit(True)).otherwise(F.exists(fields, lambda f: t.contains(F.lower(f))))


def cover_fields(ranked: DataFrame, selected: DataFrame, wanted: DataFrame, stored: DataFrame, key: str = "query_id") -> DataFrame:
    """``selected`` and, for each wanted ticker without a fundamentals row that has an asked field, the best such row, with its ``level``.

    ``ranked``, ``selected`` (key, ticker, source, chunk_index, content, score); ``wanted(key, ticker, fields)``, where a missing array asks for any
    fundamentals; ``stored(ticker, period_basis, source, chunk_index, content, score)``. Level 0 is what was selected, 1 comes from
    ``ranked``, 2 from the trailing-year rows of ``stored``, looked up only for what level 1 left open and only if fields are asked for. Ties go to the smaller source
    and chunk. Nothing is taken twice and nothing selected is lost.

    What level 2 finds hangs on the ticker and the fields alone, so rows are held against the different (ticker, field), and the best of each
    meets the questions: neither the stored rows nor their texts are multiplied by the number of keys that ask for them.
    """
    place = ["source", "chunk_index"]
    columns = [key, "ticker", *place, "content", "score"]
    want = wanted.where("ticker IS NOT NULL").select(key, "ticker", "fields").distinct()

    def fitting(rows: DataFrame, on: list[str], asked: DataFrame) -> DataFrame:
        return rows.where(F.col("source").contains("Fundamentals")).join(asked, on).where(has_field(F.col("content"), F.col("fields")))

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        first = F.min_by(F.struct(*place, "content", "score"), F.struct((-F.col("score")).alias("s"), *place))
        return rows.groupBy(*by).agg(first.alias("_b")).select(*by, "_b.*")

    both = [key, "ticker"]
    open_ = want.join(fitting(selected.select(*columns), both, want).select(*both).distinct(), both, "left_anti")
    fresh = ranked.select(*columns).join(selected.select(key, *place).distinct(), [key, *place], "left_anti")
    one = best(fitting(fresh, both, open_), both)
    still = open_.join(one.select(*both), both, "left_anti").where("size(fields) > 0")
    kept = stored.where("period_basis = 'TTM'").select("ticker", *place, "content", "score")
    asks = still.select(key, "ticker", F.explode("fields").alias("_field"))
    needs = asks.select("ticker", F.array("_field").alias("fields")).distinct()
    held = best(fitting(kept, ["ticker"], needs), ["ticker", "fields"]).withColumn("_field", F.col("fields")[0])
    two = best(asks.join(held, ["ticker", "_field"]), both).join(selected.select(key, *place).distinct(), [key, *place], "left_anti")
    out = selected.select(*columns, F.lit(0).alias("level"))
    for level, rows in ((1, one), (2, two)):
        out = out.unionByName(rows.select(*columns, F.lit(level).alias("level")))
    return out
