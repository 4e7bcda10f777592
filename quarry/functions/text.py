"""Text: entities, sources, headers, citations and Markdown tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by which an issuer is mentioned, and its ticker.
ALIASES = {
    "apple": "AAPL", "aapl": "AAPL", "蘋果": "AAPL", "microsoft": "MSFT", "msft": "MSFT", "微軟": "MSFT",
    "nvidia": "NVDA", "nvda": "NVDA", "輝達": "NVDA", "amazon": "AMZN", "amzn": "AMZN", "亞馬遜": "AMZN",
    "google": "GOOGL", "alphabet": "GOOGL", "googl": "GOOGL", "谷歌": "GOOGL", "meta": "META", "臉書": "META",
    "tesla": "TSLA", "tsla": "TSLA", "特斯拉": "TSLA",
}
_HAN = re.compile("[一-鿿]")


def mentioned(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Different tickers whose names the text has, in the order of the names.

    Han names match anywhere, others as whole words of letters, digits and underscores of any script.
    """
    lower, hits = F.lower(text), []
    for name, ticker in aliases.items():
        found = text.contains(name) if _HAN.search(name) else lower.rlike(rf"(?U)\b{re.escape(name)}\b")
        hits.append(F.when(found, F.lit(ticker)))
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def first_mentioned(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The first of ``mentioned`` or null."""
    return F.get(mentioned(text, aliases), F.lit(0))


def sole(tickers: Column) -> Column:
    """The only element of an array, or null."""
    one = F.array_distinct(tickers)
    return F.when(F.size(one) == 1, F.get(one, F.lit(0)))


def tags(text: Column, owner: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Mentioned tickers and the owner, sorted."""
    return F.array_sort(F.filter(F.array_union(mentioned(text, aliases), F.array(owner)), lambda x: x.isNotNull()))


def asks_trailing_year(text: Column) -> Column:
    """``TTM`` if the last twelve months are asked for."""
    # Fixed pattern.
    said = r"(?iU)\bttm\b|\bltm\b|(?:最近|近|過去|滾動|過往)\s*(?:十二|12)\s*個?\s*月|trailing\s*(?:twelve|12)\s*months?|last\s*twelve\s*months?"
    return F.when(F.coalesce(text, F.lit("")).rlike(said), F.lit("TTM"))


def period_code(text: Column) -> Column:
    """The first year and month like 202503, or null."""
    return F.nullif(F.regexp_extract(text, r"(?U)\b(20\d{2}(?:0[1-9]|1[0-2]))\b", 1), F.lit(""))


def source_type(source: Column) -> Column:
    """The kind of document that a file name says."""
    s = F.upper(source)
    return (
        F.when(s.contains("_NEWS_"), F.lit("news")).when(s.contains("_10K_") | s.contains("10-K"), F.lit("10-K")).when(s.contains("_10Q_") | s.contains("10-Q"), F.lit("10-Q"))
        .when(s.contains("FUNDAMENTALS"), F.lit("fundamentals")).when(s.contains("INCOMESTATEMENT"), F.lit("income_statement")).otherwise(F.lit("other"))
    )


def header(ticker: Column, filing_type: Column, code: Column, year: Column, period: Column) -> Column:
    """``[TICKER TYPE period CODE] `` or with the fiscal year; empty if nothing is known."""
    blank = lambda c: F.nullif(c, F.lit(""))
    when = F.coalesce(F.concat(F.lit("period "), blank(code)), F.concat_ws(" ", F.concat(F.lit("FY"), blank(year)), F.when(blank(year).isNotNull(), blank(period))))
    body = F.concat_ws(" ", blank(ticker), blank(filing_type), blank(when))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("["), body, F.lit("] ")))


def item_id(name: Column) -> Column:
    """An item's name without commas and full stops, blanks as underscores."""
    return F.regexp_replace(F.regexp_replace(name, "[,.]", ""), r"\s+", "_")


def clean(text: Column) -> Column:
    """Tags and the common entities gone, blanks squeezed, ends trimmed."""
    t = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def glob_regex(pattern: Column) -> Column:
    """A regular expression for a glob of ``*`` and ``?``; everything else is literal."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def citations(text: Column) -> Column:
    """Different (source, chunk) of marks like ``【file, chunk #3】``, a leading ``Reference N:`` dropped."""
    marks = F.regexp_extract_all(text, F.lit(r"【([^【】]*?,\s*chunk\s*#\d+)】"), 1)
    one = lambda m: F.struct(F.trim(F.regexp_replace(F.regexp_extract(m, r"^(.*),\s*chunk\s*#\d+$", 1), r"^Reference\s+\d+:\s*", "")).alias("source"), F.regexp_extract(m, r"#(\d+)$", 1).cast("int").alias("chunk"))
    return F.array_distinct(F.transform(marks, one))


def refuses(answer: Column, markers: list[str], most: int = 150) -> Column:
    """A marker of refusal in an answer whose body without citations is short."""
    body = F.trim(F.regexp_replace(answer, "【[^】]*】", ""))
    return answer.rlike("|".join(map(re.escape, markers))) & (F.length(body) < most)


def table_rows(markdown: Column) -> Column:
    """Data rows of a Markdown table."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).startswith("|"))
    return F.greatest(F.size(lines) - 2, F.lit(0))


def compact_table(markdown: Column) -> Column:
    """A Markdown table without separator rows and empty cells."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: ~x.rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"))
    cells = lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.array_join(cells(x), " | ")), lambda x: x != ""), "\n")


def caption_like(text: Column) -> Column:
    """At least three characters and three letters."""
    return (F.length(F.trim(text)) >= 3) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3)


def heading_like(line: Column) -> Column:
    """A short standalone title: 4 to 60 characters, at most six words, capitalised, no digits, no full stop."""
    t = F.trim(line)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.length(t).between(4, 60) & (words <= 6) & t.rlike(r"^\p{Lu}") & ~t.rlike(r"[0-9]") & ~t.rlike(r"[.:;,]$")


def prose_like(line: Column) -> Column:
    """At least eight words, or the punctuation of a sentence."""
    return (F.size(F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")) >= 8) | line.rlike(r"[.;:!?](\s|$)")


def english(text: Column) -> Column:
    """No character above U+2000."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[\x{2001}-\x{10FFFF}]")


def language(text: Column) -> Column:
    """``zh`` if Han characters are more than 15 % of the Latin letters."""
    han, latin = (F.length(F.regexp_replace(text, f"[^{x}]", "")) for x in ("一-鿿", "A-Za-z"))
    return F.when(han > 0.15 * latin, F.lit("zh")).otherwise(F.lit("en"))


def query_terms(query: Column) -> Column:
    """Latin words of more than one character and pairs of neighbouring Han characters."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) > 1)
    runs = F.filter(F.regexp_extract_all(query, F.lit("[一-鿿]+"), 0), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.array_union(words, pairs))


def best_window(text: Column, terms: Column, n: int) -> Column:
    """0-based start of the window of ``n`` characters, in steps of a quarter, with most terms; the first of the best."""
    low = F.lower(text)
    last = F.greatest(F.length(low) - n, F.lit(0))
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(max(1, n // 4))), last))
    scored = F.transform(starts, lambda s: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.substring(low, s + 1, F.lit(n)), F.lower(t)))).alias("hits"), (-s).alias("at")))
    return -F.array_max(scored)["at"]


def snippet(text: Column, terms: Column, n: int) -> Column:
    """The window with most terms, with ellipses where it is cut."""
    at = best_window(text, terms, n)
    cut = F.substring(text, at + 1, F.lit(n))
    return F.concat(F.when(at > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(at + n < F.length(text), F.lit("…")).otherwise(F.lit("")))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID of version 5 (SHA-1), by default in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
