"""URLs: hosts, keys for dedupe, allow lists and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.positional import published_in

#: Host prefixes that stand for the same site, taken off once each in this order.
PREFIXES = ("www.", "new.", "m.", "amp.")
#: Fixed pattern: an option symbol in a path.
OPTION = r"/[A-Z]{1,6}[0-9]{6}[CP][0-9]{6,8}([/?]|$)"


def host(url: Column) -> Column:
    """Lower-case network location; empty without a scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def domain(url: Column) -> Column:
    """The host without ``www.``; else the start of the url."""
    h = host(url)
    return F.when(h.startswith("www."), F.substring(h, 5, 1 << 20)).when(h != "", h).otherwise(F.substring(F.coalesce(url, F.lit("")), 1, 28))


def key(url: Column) -> Column:
    """Host without known prefixes and lower-case path without ``/amp`` parts and closing slashes: one page, however it is written."""
    h = host(url)
    for p in PREFIXES:
        h = F.when(h.startswith(p), F.substring(h, len(p) + 1, 1 << 20)).otherwise(h)
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1))
    return F.concat(h, F.regexp_replace(F.regexp_replace(path, "/amp(?=/|$)", ""), "/+$", ""))


def host_allowed(h: Column, allowed: list[str]) -> Column:
    """The host, or the host without ``www.``, is listed; other subdomains are not."""
    return F.regexp_replace(F.lower(F.trim(h)), r"^\.*(www\.)?", "").isin([x.lower() for x in allowed])


def domain_admits(entry: Column, h: Column) -> Column:
    """The host is the entry or below it."""
    e, x = (F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^\.+", "") for c in (entry, h))
    return (e != "") & (x != "") & ((x == e) | x.endswith(F.concat(F.lit("."), e)))


def is_option_page(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(OPTION)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def url_date(url: Column) -> Column:
    """The date that a url carries, by the first of four forms that gives a valid one."""
    part = lambda pattern, group: F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, group), F.lit(""))
    # Fixed patterns.
    slashed, month_first = r"[/-](20\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:[/-]|$)", r"[/-](\d{1,2})-(\d{1,2})-(20\d{2})(?:[/-]|$)"
    together, month_only = r"[/-](20\d{2})(\d{2})(\d{2})(?:[/-]|$)", r"/(20\d{2})[/-](\d{1,2})(?:[/-]|$)"
    return F.coalesce(
        _date(part(slashed, 1), part(slashed, 2), part(slashed, 3)), _date(part(month_first, 3), part(month_first, 1), part(month_first, 2)),
        _date(part(together, 1), part(together, 2), part(together, 3)), _date(part(month_only, 1), part(month_only, 2), F.lit("1")),
    )


def result_date(published: Column, url: Column, content: Column | None = None, as_of: Column | None = None) -> Column:
    """The date a result was published: as it says in one of four formats or with an ISO date inside, else its url's, else, where the content is given, the one its markers point to."""
    raw = F.trim(F.coalesce(published, F.lit("")))
    rfc = F.regexp_extract(raw, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4}) \d{2}:\d{2}:\d{2}( [A-Z]{3})?$", 1)
    iso = F.regexp_extract(raw, r"(20\d{2}-\d{2}-\d{2})", 1)
    known = [F.try_to_date(F.nullif(rfc, F.lit("")), "dd MMM yyyy"), F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), url_date(url)]
    return F.coalesce(*known, *([] if content is None else [published_in(content, as_of)]))


def news_key(url: Column, title: Column, published: Column) -> Column:
    """``url::`` and the url, or ``title::`` and title and date."""
    t = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t(url) != "", F.concat(F.lit("url::"), t(url))).otherwise(F.concat(F.lit("title::"), t(title), F.lit("::"), t(published)))
