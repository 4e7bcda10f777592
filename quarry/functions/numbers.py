"""Numbers in text: extraction, formatting, scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a unit word is worth in millions.
SCALE = {"trillion": 1e6, "billion": 1e3, "bn": 1e3, "b": 1e3, "million": 1.0, "mn": 1.0, "m": 1.0}


def long_numbers(text: Column) -> Column:
    """Different numbers of four or more characters, commas and points included."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,.]{2,}[0-9]"), 0)
    return F.array_distinct(found)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def two_decimals(text: Column) -> Column:
    """Different numbers with two decimals, not followed by a percent sign or another digit."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\d.,])(\d[\d,]*\.\d{2})(?![\d%])(?!\s*%)"), 1)
    return F.array_sort(F.array_distinct(found))


def untraceable(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence has neither as written, nor without commas, nor rounded to two places."""
    hay = F.coalesce(evidence, F.lit(""))
    flat = F.replace(hay, F.lit(","), F.lit(""))
    plain = lambda n: F.replace(n, F.lit(","), F.lit(""))
    rounded = F.transform(F.regexp_extract_all(hay, F.lit(r"\d[\d,]*\.\d+"), 0), lambda n: F.bround(plain(n).try_cast("decimal(38,8)"), 2))
    return F.filter(two_decimals(answer), lambda n: ~(F.contains(hay, n) | F.contains(flat, plain(n)) | F.array_contains(rounded, F.bround(plain(n).try_cast("decimal(38,8)"), 2))))


def money_in_millions(text: Column) -> Column:
    """Dollar amounts with a unit word, in millions; bare amounts are left out."""
    pattern = r"(?i)(?:US)?\$\s?(\d[\d,]*(?:\.\d+)?)\s*(trillion|billion|million|bn|mn|b|m)\b"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    scale = F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv])
    value = lambda m: F.replace(F.regexp_extract(m, pattern, 1), F.lit(","), F.lit("")).try_cast("double") * F.try_element_at(scale, F.lower(F.regexp_extract(m, pattern, 2)))
    return F.filter(F.transform(found, value), lambda v: v.isNotNull())


def short_money(x: Column, prefix: str = "$") -> Column:
    """``$1.23B``, ``$4.56M`` or the plain number; ``N/A`` for null and NaN."""
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("N/A"))
        .when(F.abs(x) >= 1e9, F.format_string(f"{prefix}%.2fB", x / 1e9)).when(F.abs(x) >= 1e6, F.format_string(f"{prefix}%.2fM", x / 1e6))
        .otherwise(F.format_string(f"{prefix}%.2f", x))
    )


def percent(x: Column, already: bool = False) -> Column:
    """A share as ``12.34%``; ``N/A`` for null and NaN."""
    return F.when(x.isNull() | F.isnan(x), F.lit("N/A")).otherwise(F.format_string("%.2f%%", x if already else x * 100))


def plain_number(x: Column, places: int = 4) -> Column:
    """Grouped by thousands, closing zeros dropped."""
    return F.regexp_replace(F.format_number(x, places), r"\.?0+$", "")


def growth_fits(a: Column, b: Column, pct: Column, tol: float = 0.15) -> Column:
    """The percent is the change from a to b, or b as a share of a."""
    change, share = F.try_divide(b, a) * 100 - 100, F.try_divide(b, a) * 100
    return F.coalesce((F.abs(change - pct) <= tol) | (F.abs(share - pct) <= tol), F.lit(False))


def rounded_forms(x: Column, places: int) -> Column:
    """The number at ``places`` to 0 decimals, halves to even."""
    return F.array(*[F.bround(x.cast("decimal(38,10)"), p).cast("string") if p == 0 else F.bround(x.cast("decimal(38,10)"), p).cast(f"decimal(38,{p})").cast("string") for p in range(places, -1, -1)])
