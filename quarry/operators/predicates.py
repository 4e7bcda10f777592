"""Metadata predicates: clauses compiled to Columns, and the cascade that relaxes them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR, LABEL_YEAR = "fiscal_year", "report_label_year"
PERIOD_FIELDS = (YEAR, "fiscal_period", "report_period_code")


@dataclass(frozen=True)
class Clause:
    """``field`` is (or, excluded, is not) one of ``values``."""

    field: str
    values: tuple
    include: bool = True
    routed_latest: bool = False


def clause(field: str, value, include: bool = True, routed_latest: bool = False) -> Clause:
    """A clause from a scalar or a list."""
    return Clause(field, tuple(value) if isinstance(value, (list, tuple, set)) else (value,), include, routed_latest)


def _is_array(schema: T.StructType, field: str) -> bool:
    return field in schema.names and isinstance(schema[field].dataType, T.ArrayType)


def is_empty(schema: T.StructType, field: str) -> Column:
    """The field is missing, null or an empty array."""
    if field not in schema.names:
        return F.lit(True)
    return F.col(field).isNull() | (F.size(field) == 0) if _is_array(schema, field) else F.col(field).isNull()


def _matches(schema: T.StructType, field: str, values: Sequence) -> Column:
    if field not in schema.names:
        return F.lit(False)
    if _is_array(schema, field):
        return F.coalesce(F.arrays_overlap(F.col(field), F.array(*map(F.lit, values))), F.lit(False))
    return F.col(field).isin(*values)


def compile_clauses(schema: T.StructType, clauses: Iterable[Clause], strict: bool = True, relaxed: Iterable[str] = (), scan: bool = False) -> Column:
    """One boolean Column, never null; or with ``scan``, for a filter, one that may be null for false, whose plain comparisons reach the Parquet scan.

    Included, strict: the value must match. Soft, or strict with the field in ``relaxed``: an empty field passes too.
    Excluded: matching rows go, empty fields stay. A fiscal year also matches by the label year,
    but not where the clause is strict and relaxed.
    """
    relaxed, parts = set(relaxed), []
    for c in clauses:
        hit = _matches(schema, c.field, c.values)
        by_label = hit | _matches(schema, LABEL_YEAR, c.values) if c.field == YEAR else hit
        if not c.include:
            parts.append(~F.coalesce(by_label, F.lit(False)))
        elif not strict:
            parts.append(by_label | is_empty(schema, c.field))
        elif c.field in relaxed:
            parts.append(hit | is_empty(schema, c.field))
        else:
            parts.append(by_label)
    every = reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    return every if scan else F.coalesce(every, F.lit(False))


def without_periods(clauses: Iterable[Clause]) -> list[Clause]:
    """The included clauses that a search without any year or period keeps."""
    return [c for c in clauses if c.include and c.field in ("ticker", "mentioned_tickers", "filing_type", "doc_type")]


def qualified(rows: DataFrame, key: str, years: Sequence[str]) -> DataFrame:
    """(key, qualified): whether any row of the key has a wanted year or none at all; all are, if no year is wanted."""
    fits = F.lit(True) if not years else is_empty(rows.schema, YEAR) | F.col(YEAR).isin(*years)
    return rows.groupBy(key).agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("qualified"))


def tiers(rows: DataFrame, clauses: Sequence[Clause]) -> Column:
    """The first tier of the cascade that admits a row: 1 strict, 2 without periods, 3 soft, 4 anything.

    With a period code among the clauses the strict tier asks only for ticker, code and doc type.
    """
    first = [c for c in clauses if c.field in ("ticker", "report_period_code", "doc_type")] if any(c.field == "report_period_code" and c.include for c in clauses) else list(clauses)
    s = rows.schema
    admitted = (compile_clauses(s, first), compile_clauses(s, without_periods(clauses)), compile_clauses(s, clauses, strict=False))
    return F.when(admitted[0], 1).when(admitted[1], 2).when(admitted[2], 3).otherwise(4)


def cascade(rows: DataFrame, clauses: Sequence[Clause], key: str | None = None) -> DataFrame:
    """Rows of the strictest tier that has any, for each ``key`` or over all; one scan instead of one search a tier."""
    marked = rows.withColumn("tier", tiers(rows, clauses))
    if key is None:
        least = marked.agg(F.min("tier").alias("least"))
        return marked.join(F.broadcast(least), F.col("tier") == F.col("least")).drop("least")  # one row
    least = marked.groupBy(key).agg(F.min("tier").alias("tier"))
    return marked.join(least, [key, "tier"])


def missed_periods(rows: DataFrame, key: str, years: Sequence[str]) -> DataFrame:
    """(key, note): asked and found years, where none of the asked was found."""
    found = F.array_sort(F.collect_set(YEAR), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    asked = ", ".join(sorted(years, reverse=True))
    seen = rows.groupBy(key).agg(found.alias("found"))
    return seen.where(~F.arrays_overlap("found", F.array(*map(F.lit, years)))).select(key, F.concat(F.lit(f"asked {asked}; found "), F.array_join("found", ", ")).alias("note"))


def best_tier_per(rows: DataFrame, key: str, tier: Column) -> DataFrame:
    """Rows whose tier is the least of their key, by a window where the key's rows are few."""
    w = Window.partitionBy(key)
    return rows.withColumn("_tier", tier).withColumn("_least", F.min("_tier").over(w)).where("_tier = _least").drop("_tier", "_least")
