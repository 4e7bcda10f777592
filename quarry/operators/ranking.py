"""Operators on ranked lists: collapsing, coverage, merging, fair selection, period ladders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of fiscal periods within a year.
PERIOD_ORDER = {"Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "FY": 5}


def fiscal_rank(year: Column, period: Column) -> Column:
    """struct(year, ord), which sorts by time; null unless both are known."""
    order = F.create_map(*[F.lit(x) for kv in PERIOD_ORDER.items() for x in kv])
    ordinal = F.try_element_at(order, F.upper(period))
    number = year.try_cast("int")
    return F.when(number.isNotNull() & ordinal.isNotNull(), F.struct(number.alias("year"), ordinal.alias("ord")))


def stamp_key(stamp: Column) -> Column:
    """Digits of a stamp, padded to eight with zeros."""
    return F.rpad(F.regexp_replace(stamp, "[^0-9]", ""), 8, "0")


def collapse(rows: DataFrame, group: list[str], source: str, keep: int, prefer: str = "rank", rank: str = "rank", newest: str = "fiscal_rank", key: str = "query_id") -> DataFrame:
    """Keeps the rows of at most ``keep`` different sources in each group of a query.

    Sources stand in order of their best rank, or with ``prefer="newest"`` of the largest ``newest``, unknown ones last. Rows
    with a null in the group all pass. Sources are ranked once, as a small table, and rows join it.
    """
    grouped = F.lit(True)
    for g in group:
        grouped = grouped & F.col(g).isNotNull()
    members = rows.where(grouped)
    order = [F.desc_nulls_last("_new"), "_rank", source] if prefer == "newest" else ["_rank", source]
    sources = members.groupBy(key, *group, source).agg(F.min(rank).alias("_rank"), F.max(newest).alias("_new"))
    chosen = sources.withColumn("_place", F.row_number().over(Window.partitionBy(key, *group).orderBy(*order))).where(F.col("_place") <= keep)
    kept = members.join(chosen.select(key, *group, source), [key, *group, source], "left_semi")
    return kept.unionByName(rows.where(~grouped).select(*kept.columns))


def suppress_near(rows: DataFrame, numbers: str, source: str, order: str, min_shared: int = 5, min_cover: float = 0.9) -> DataFrame:
    """Drops rows whose numbers are mostly within those of an earlier kept row of the same source.

    Whether a row stays depends on the rows that stayed, so a source's rows are walked in order; a
    source is one filing, whose number of rows is bounded. A task walks its sources one after the other in Arrow batches, which
    costs nothing a source, and holds the kept numbers of one.
    """
    columns = rows.columns
    at, own = columns.index(numbers), columns.index(source)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for b in batches:
            stay = []
            for who, nums in zip(b.column(own).to_pylist(), b.column(at).to_pylist()):
                if kept is None or who != now:
                    now, kept = who, []
                mine = frozenset(nums or ())
                near = len(mine) >= min_shared and any((n := len(mine & k)) >= min_shared and n >= min_cover * len(mine) for k in kept)
                stay.append(not near)
                if not near and len(mine) >= min_shared:  # smaller ones are near to nothing
                    kept.append(mine)
            yield b.filter(pa.array(stay, pa.bool_()))

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, source).sortWithinPartitions(source, order).mapInArrow(walk, rows.schema)


def cover(ranked: DataFrame, selected: DataFrame, wanted: DataFrame, entity: str, score: str = "score", key: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """``selected`` and, for each wanted entity it lacks, the best ranked row; queries that want fewer than two stay as they are."""
    many = wanted.groupBy(key).agg(F.countDistinct(entity).alias("_n")).where("_n > 1").select(key)
    missing = wanted.distinct().join(many, key, "left_semi").join(selected, [key, entity], "left_anti")
    w = Window.partitionBy(key, entity).orderBy(F.desc(score), tie)
    best = ranked.join(missing, [key, entity], "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return selected.unionByName(best.select(*selected.columns))


def merge_best(pool: DataFrame, new: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Union by key with the higher score; the pool's row wins a tie."""
    both = pool.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "_seq")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_seq")


def fair_select(rows: DataFrame, bucket: str, k: int, score: str, tie: str) -> DataFrame:
    """``k`` rows in turns over the buckets: the best of each, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc(score), tie))
    return rows.withColumn("turn", turn).where(F.col("turn") <= k).orderBy("turn", bucket).limit(k)


def writer_budget(n: Column, base: int = 5, step: int = 2, most: int = 16) -> Column:
    """Evidence rows for an answer of ``n`` facets."""
    return F.least(F.lit(base) + step * (n - 1), F.lit(most))


def first_places(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Different values of ``by`` at their first place, renumbered from 1."""
    first = rows.groupBy(*by).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*by[:-1]).orderBy("_first") if len(by) > 1 else Window.orderBy("_first")
    return first.withColumn("place", F.row_number().over(w)).drop("_first")


def ladder(filings: DataFrame, entity: str = "ticker", rank: str = "fiscal_rank", tie: str = "source") -> DataFrame:
    """Filings of each entity numbered from 0, newest first; those without a period are left out."""
    w = Window.partitionBy(entity).orderBy(F.desc(rank), tie)
    return filings.where(F.col(rank).isNotNull()).withColumn("nth", F.row_number().over(w) - 1)


def ladder_pick(wanted: DataFrame, filings: DataFrame, entity: str = "ticker", rank: str = "fiscal_rank", tie: str = "source") -> DataFrame:
    """For each row of ``wanted(request, ticker, kind?, year?, nth)`` the nth newest filing of that kind and year, or nulls: never another one."""
    fits = (F.col("w.kind").isNull() | (F.col("f.kind") == F.col("w.kind"))) & (F.col("w.year").isNull() | (F.col(f"f.{rank}.year") == F.col("w.year")))
    met = wanted.alias("w").join(filings.where(F.col(rank).isNotNull()).alias("f"), (F.col(f"f.{entity}") == F.col(f"w.{entity}")) & fits)
    n = F.row_number().over(Window.partitionBy("w.request").orderBy(F.desc(f"f.{rank}"), F.col(f"f.{tie}"))) - 1
    hit = met.select(F.col("w.request").alias("request"), F.col("w.nth").alias("_want"), F.col(f"f.{tie}").alias(tie), n.alias("_n")).where("_n = _want").select("request", tie)
    return wanted.join(hit, "request", "left")


def keep_latest(rows: DataFrame, keys: list[str], stamp: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the largest stamp of their keys, and the stale ones."""
    last = rows.groupBy(*keys).agg(F.max(stamp).alias("_last"))
    marked = rows.join(last, keys)
    return marked.where(F.col(stamp) == F.col("_last")).drop("_last"), marked.where(F.col(stamp) < F.col("_last")).drop("_last")


def tail(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def capped(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key: a budget."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def web_results(rows: DataFrame, query: str, url_key: str, domain: str, order: str, per_domain: int = 2, most: int = 5) -> DataFrame:
    """The first ``most`` results of a query with at most ``per_domain`` of a domain and one of a url.

    Filters on a single result come before. Duplicates are told by kept urls, so each step numbers what the step before has left.
    """
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(query, url_key).orderBy(order))).where("_n = 1").drop("_n")
    two = one.withColumn("_n", F.row_number().over(Window.partitionBy(query, domain).orderBy(order))).where(F.col("_n") <= per_domain).drop("_n")
    return two.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(order))).where(F.col("place") <= most)


def chosen_or_top(pool: DataFrame, relevant: DataFrame, key: str, ident: str, rank: str, k: int) -> DataFrame:
    """Rows of the pool that were judged relevant; of queries without any, the ``k`` best."""
    hits = pool.join(relevant, [key, ident], "left_semi")
    rest = pool.join(hits.select(key).distinct(), key, "left_anti").where(F.col(rank) <= k)
    return hits.unionByName(rest)
