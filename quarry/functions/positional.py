"""What depends on where in a text something stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import spans

PERCENT = r"(-?\d[\d,]*(?:\.\d+)?)\s*%"
#: Words after which a date says when a page was published, how far behind them it may stand, and what ends their reach.
MARKER = r"(?i)\b(?:at\s+close|after\s+hours|pre[- ]?market|real\s?time|as\s+of|published(?:\s+on)?|last\s+updated|updated(?:\s+on)?|posted(?:\s+on)?)\b"
REACH, END = 48, r"[|\[\]#]"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Kinds of dates by preference: pattern, and the groups of year, month and day.
DATES = (
    (rf"(?i)\b({'|'.join(MONTHS)})[a-z]*\.?\s+(\d{{1,2}})(?:\s*,?\s*(20\d{{2}}))?\b", "g3", "g1", "g2"),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{2}|20\d{2})\b", "g3", "g1", "g2"),
    (r"\b(20\d{2})-(\d{2})-(\d{2})\b", "g1", "g2", "g3"),
)


def anchored_percents(text: Column, anchor: Column, window: int = 60) -> Column:
    """Percentages that begin within ``window`` characters of a mention of the anchor, in order. Without an anchor none."""
    spots = spans.placed(text, F.concat(F.lit(r"(?i)\Q"), F.nullif(anchor, F.lit("")), F.lit(r"\E")))
    near = F.filter(spans.placed(text, PERCENT, 1), lambda p: F.exists(spots, lambda s: F.abs(s["start"] - p["start"]) <= window))
    return F.when(F.coalesce(anchor, F.lit("")) == "", F.array().cast("array<double>")).otherwise(F.transform(near, lambda p: F.replace(p["g1"], F.lit(","), F.lit("")).cast("double")))


def _date(x: Column, kind: int, as_of: Column) -> Column:
    """struct<kind, start, stop, day> of a match; a date without a year is the last such day not after ``as_of``."""
    _, y, m, d = DATES[kind]
    months = F.create_map(*[v for i, name in enumerate(MONTHS) for v in (F.lit(name), F.lit(i + 1))])
    month = x[m].try_cast("int") if kind else F.try_element_at(months, F.lower(F.substring(x[m], 1, 3)))
    year = F.when(F.length(x[y]) == 2, F.concat(F.lit("20"), x[y])).otherwise(x[y]).try_cast("int")
    on = lambda of: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", of, month, x[d].try_cast("int")), F.lit("yyyy-MM-dd")).cast("date")
    this = on(F.year(as_of))
    day = F.when(year.isNotNull(), on(year)).otherwise(F.when(this > as_of, on(F.year(as_of) - 1)).otherwise(this))
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), day.alias("day"))


def _dates(text: Column, as_of: Column) -> Column:
    """All dates in the text."""
    kinds = [F.transform(spans.placed(text, DATES[k][0], 3), _reader(k, as_of)) for k in range(len(DATES))]
    return F.filter(F.concat(*kinds), lambda x: x["day"].isNotNull())


def _reader(kind: int, as_of: Column):
    return lambda x: _date(x, kind, as_of)


def published_in(text: Column, as_of: Column) -> Column:
    """The latest date not after ``as_of`` that a marker points to, or null.

    All dates of the text are candidates. A marker points to the one of the most preferred kind, then the first, that lies whole behind it, within its
    reach and before a table cell, bracket or heading begins; one that is in the future points nowhere.
    """
    dates = _dates(text, as_of)

    def pointed(m: Column) -> Column:
        reach = F.length(F.split(F.substring(text, m["stop"] + 1, F.lit(REACH)), END, 2)[0])
        return F.array_min(F.filter(dates, lambda x: (x["start"] >= m["stop"]) & (x["stop"] <= m["stop"] + reach)))["day"]

    found = F.transform(spans.placed(text, MARKER), pointed)
    return F.array_max(F.filter(found, lambda day: day <= as_of))
