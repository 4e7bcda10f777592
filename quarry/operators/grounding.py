"""Tying literals and claims to evidence by containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals that are held against all texts at once; they are broadcast, so their number is checked.
MAX_LITERALS = 100_000


def number_bounded(text: Column, literal: Column, lower_text: Column | None = None, lower_literal: Column | None = None) -> Column:
    """The literal is in the text; a number only where no digit, comma or point touches it. Texts in lower case may be given where they are at hand."""
    quoted = F.regexp_replace(literal, r"([\\.^$|()\[\]{}+*?])", r"\\$1")
    number = literal.rlike(r"^[0-9][0-9,.]*%?$")
    held = F.contains(F.lower(text) if lower_text is None else lower_text, F.lower(literal) if lower_literal is None else lower_literal)
    return F.when(number, F.regexp_like(text, F.concat(F.lit(r"(?<![0-9.,])"), quoted, F.lit(r"(?![0-9])")))).otherwise(held)


def locate(literals: DataFrame, chunks: DataFrame, entity: str | None = None) -> DataFrame:
    """(literal_id, doc_id) of all chunks that have the literal; with ``entity`` only those of the same one.

    Containment has no key to join on, so the literals, checked to be few, are broadcast and each chunk is read once.
    """
    few = literals.limit(MAX_LITERALS + 1).cache()
    if few.count() > MAX_LITERALS:
        raise ValueError(f"more than {MAX_LITERALS} literals")
    few = few.withColumn("_literal", F.lower("literal"))
    on = number_bounded(F.col("text"), F.col("literal"), F.col("_text"), F.col("_literal"))
    if entity:
        on = (F.col(entity) == F.col(f"_{entity}")) & on
        few = few.withColumnRenamed(entity, f"_{entity}")
    return chunks.withColumn("_text", F.lower("text")).join(F.broadcast(few), on).select("literal_id", "doc_id")


def grounded_periods(claims: DataFrame, chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """``claims(key, seq, literal, period)`` with the period of the chunks of their answer that have the literal, where that is exactly one."""
    tagged = chunks.where(F.col("chunk_period").isNotNull()).select(key, "text", "chunk_period")
    met = claims.join(tagged, key).where(number_bounded(F.col("text"), F.col("literal")))
    found = met.groupBy(key, "seq").agg(F.count_distinct("chunk_period").alias("_n"), F.min("chunk_period").alias("_p")).where("_n = 1")
    return claims.join(found, [key, "seq"], "left").withColumn("period", F.coalesce("_p", "period")).drop("_n", "_p")


def source_types(claims: DataFrame, chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, seq, types): sorted kinds of the evidence that has the claim's literal; empty if none has."""
    met = claims.join(chunks.select(key, "text", "kind"), key).where(number_bounded(F.col("text"), F.col("literal")))
    found = met.groupBy(key, "seq").agg(F.array_sort(F.collect_set("kind")).alias("types"))
    return claims.select(key, "seq").join(found, [key, "seq"], "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def required_chunks(required: DataFrame, got: DataFrame, key: str = "id") -> DataFrame:
    """Required (key, source, chunk) that were not retrieved, and whether at least their source was."""
    missing = required.join(got, [key, "source", "chunk"], "left_anti")
    sources = got.select(key, "source").distinct().withColumn("_s", F.lit(True))
    return missing.join(sources, [key, "source"], "left").select(key, "source", "chunk", F.coalesce("_s", F.lit(False)).alias("source_there"))
