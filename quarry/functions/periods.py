"""Stamps, fiscal periods and staleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which evidence is stale for a need; none for the others.
STALE_DAYS = {"intraday": 1, "days": 7}
WEB_STALE_DAYS = {"intraday": 7, "days": 180}
_SOURCE = r"^([A-Z.]+)_([A-Za-z0-9]+)_(\d{4}|\d{6}|\d{8})(?:\D.*)?$"


def stamp(source: Column) -> Column:
    """Digits (4, 6 or 8) of ``TICKER_KIND_STAMP``, else empty."""
    return F.regexp_extract(F.coalesce(source, F.lit("")), _SOURCE, 3)


def source_parts(source: Column) -> Column:
    """struct(ticker, kind, stamp) or null."""
    at = lambda i: F.regexp_extract(source, _SOURCE, i)
    return F.when(source.rlike(_SOURCE), F.struct(at(1).alias("ticker"), at(2).alias("kind"), at(3).alias("stamp")))


def newest_date(source: Column) -> Column:
    """The last day a source may be of: the year's, the month's, or the day."""
    s = stamp(source)
    return (
        F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd"))
        .when(F.length(s) == 6, F.last_day(F.try_to_date(F.concat(s, F.lit("01")), "yyyyMMdd")))
        .when(F.length(s) == 4, F.try_to_date(F.concat(s, F.lit("1231")), "yyyyMMdd"))
    )


def is_dated(source: Column) -> Column:
    """Only a full date proves how new a source is."""
    return F.length(stamp(source)) == 8


def limit_of(need: Column, days: dict[str, int] = STALE_DAYS) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), need)


def staleness(need: Column, newest: Column, as_of: Column) -> Column:
    """Days of age beyond the need's limit, -1 without any dated evidence, null where new enough or no limit holds."""
    limit, age = limit_of(need), F.date_diff(as_of, newest)
    return F.when(limit.isNull(), F.lit(None).cast("int")).when(newest.isNull(), F.lit(-1)).when(age > limit, age)


def display(s: Column) -> Column:
    """An eight-digit stamp as an ISO date, others as they are."""
    return F.when(s.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise(s)


def months(v: Column) -> Column:
    """3, 6, 9 or 12; else null."""
    n = F.trim(v.cast("string")).try_cast("int")
    return F.when(n.isin(3, 6, 9, 12), n)


def month_end(v: Column) -> Column:
    """``yyyy-mm`` or null."""
    t = F.trim(F.coalesce(v, F.lit("")))
    return F.when(t.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), t)


def period_key(n: Column, end: Column, period: Column) -> Column:
    """``9M@2026-03`` where both are known, else the period's own name, else ``unknown``."""
    both = F.concat(n.cast("string"), F.lit("M@"), end)
    return F.coalesce(both, F.nullif(period, F.lit("")), F.lit("unknown"))


def chunk_period(text: Column) -> Column:
    """struct(months, end) of a tag like ``[Nine Months Ended March 31, 2026]``, or null."""
    # Fixed pattern and names.
    tag = r"(?i)\[(Three|Six|Nine|Twelve)\s+Months\s+Ended\s+([A-Z][a-z]+)\.?\s+\d{1,2},\s*(\d{4})[^\]]*\]"
    numbers = F.create_map(*[F.lit(x) for x in ("three", 3, "six", 6, "nine", 9, "twelve", 12)])
    names = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    month = F.array_position(F.array(*map(F.lit, names)), F.lower(F.regexp_extract(text, tag, 2)))
    n = F.try_element_at(numbers, F.lower(F.regexp_extract(text, tag, 1)))
    return F.when(n.isNotNull() & (month > 0), F.struct(n.alias("months"), F.concat(F.regexp_extract(text, tag, 3), F.lit("-"), F.lpad(month.cast("string"), 2, "0")).alias("end")))


def fiscal_label(year: Column, period: Column) -> Column:
    return F.concat(F.lit("FY"), year.cast("string"), F.lit(" "), period)
