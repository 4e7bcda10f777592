"""Measures of ranked lists, distributions, agreement and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(rows: DataFrame, relevant: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """recall, precision, f1, ap and rr at ``k`` of ``rows(key, rank, hit)`` for each query.

    Precision divides by the rows there are, average precision by the smaller of k and all relevant ones
    (``relevant(key, n_rel)``); what has nothing relevant scores 0.
    """
    top = rows.where(F.col("rank") <= k).withColumn("upto", F.sum("hit").over(Window.partitionBy(key).orderBy("rank")))
    hits = F.sum("hit")
    per = top.groupBy(key).agg(
        hits.alias("hits"), F.count("*").alias("size"), F.sum(F.col("hit") * F.col("upto") / F.col("rank")).alias("gain"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    joined = per.join(relevant, key, "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), "n_rel"), F.lit(0.0))
    precision = F.col("hits") / F.col("size")
    f1 = F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0))
    return (
        joined.withColumn("recall", recall).withColumn("precision", precision).withColumn("f1", f1)
        .withColumn("ap", F.coalesce(F.try_divide("gain", F.least(F.lit(k), "n_rel")), F.lit(0.0)))
        .withColumn("rr", F.coalesce(F.try_divide(F.lit(1.0), "first"), F.lit(0.0)))
        .select(key, "recall", "precision", "f1", "ap", "rr")
    )


def by_category(rows: DataFrame) -> DataFrame:
    """Means of ``ranked_metrics`` per category and over all, from one pass with two groupings."""
    means = [F.round(F.avg(c), 4).alias(n) for c, n in (("recall", "recall"), ("precision", "precision"), ("f1", "f1"), ("ap", "ap"), ("rr", "mrr"))]
    return rows.rollup("category").agg(*means, F.count("*").alias("n")).withColumn("category", F.coalesce("category", F.lit("overall")))


def nearest_rank(sorted_values: Column, percent: float) -> Column:
    """The value at index round(p / 100 (n - 1)), halves to even, of a sorted array."""
    at = F.bround(F.lit(percent / 100) * (F.size(sorted_values) - 1), 0).cast("int")
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, at + 1))


def exact_percentiles(rows: DataFrame, value: str, by: list[str], percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles of each group, without gathering a group: rows are numbered and the wanted places looked up.

    Places are found on distinct values with their running counts, so a group is as long as its values are different.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("_hi", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("_n") - 1), 0)
    picks = [F.min(F.when(F.col("_hi") > at(p), F.col(value))).alias(f"p{p}") for p in percents]
    return placed.groupBy(*by).agg(*picks)


def length_profile(rows: DataFrame, value: str, by: str, over: list[int]) -> DataFrame:
    """Count, mean, maximum and the count and share above each limit, per group and over all."""
    limits = []
    for x in over:
        limits += [F.count_if(F.col(value) > x).alias(f"over_{x}"), F.round(100 * F.avg((F.col(value) > x).cast("double")), 2).alias(f"pct_over_{x}")]
    out = rows.rollup(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.max(value).alias("max"), *limits)
    return out.withColumn(by, F.coalesce(by, F.lit("ALL")))


def weighted_correctness(rows: DataFrame, key: list[str]) -> DataFrame:
    """Score of ``rows(key, weight, hit, critical, fatal)``: the weighted share, at most one half with a critical miss, 0 with a fatal hit."""
    share = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("hit").cast("int")), F.sum("weight")), F.lit(0.0))
    missed, fatal = F.bool_or(F.col("critical") & ~F.col("hit")), F.bool_or(F.col("fatal") & F.col("hit"))
    score = F.when(fatal, F.lit(0.0)).when(missed, F.least(share, F.lit(0.5))).otherwise(share)
    return rows.groupBy(*key).agg(F.round(score, 6).alias("score"), missed.alias("missed_critical"), fatal.alias("fatal"))


def majority(votes: DataFrame, key: list[str], n_votes: int) -> DataFrame:
    """Items hit by a strict majority of ``n_votes`` ballots of ``votes(key, item, hit)``."""
    return votes.groupBy(*key, "item").agg(F.count_if("hit").alias("n")).select(*key, "item", (F.col("n") * 2 > n_votes).alias("hit"))


def first_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value), F.max("_n").alias("n"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of pairs without a null; null below two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count_if(both) >= 2, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def known_mean(x: Column) -> Column:
    """Mean over what is neither null nor NaN."""
    return F.avg(F.when(~F.isnan(x), x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def run_agreement(rows: DataFrame) -> DataFrame:
    """Of ``rows(a array, b array)``: the shares with equal sets and equal order, and the mean Jaccard similarity."""
    same_set = (F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b"))).cast("double")
    return rows.agg(F.round(F.avg(same_set), 6).alias("same_set"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("same_order"), F.round(F.avg(jaccard(F.col("a"), F.col("b"))), 6).alias("mean_jaccard"))


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted array."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def seats(rows: DataFrame, key: str, source: str, rank: str, k: int) -> DataFrame:
    """Of the top ``k`` rows: the sources, the seats not of the best row's source, and the largest number of sources in one section."""
    top = rows.where(F.col(rank) <= k)
    first = top.groupBy(key).agg(F.min_by(source, rank).alias("_best"))
    sections = top.groupBy(key, "item_id").agg(F.count_distinct(source).alias("_density"))
    dense = sections.groupBy(key).agg(F.max("_density").alias("density"))
    seated = top.join(first, key).groupBy(key).agg(F.count_distinct(source).alias("sources"), F.count_if(F.col(source) != F.col("_best")).alias("crowding"))
    return seated.join(dense, key)


def two_level_spread(rows: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """Mean of run means and the population deviation within runs and across them, per key."""
    per_run = rows.groupBy(key, run).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return per_run.groupBy(key).agg(F.round(F.avg("_m"), 6).alias("mean"), F.round(F.stddev_pop("_m"), 6).alias("across"), F.round(F.avg("_s"), 6).alias("within"), F.count("*").alias("runs"))
