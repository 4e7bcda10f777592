"""Matches of a pattern with what stands between them, as Column expressions: Spark has no positions of matches, but the pieces of a split have lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, put: Callable[[Column], Column]) -> Column:
    """``put(value)`` with the value worked out once a row: inside a lambda an expression is worked out again for each element."""
    return F.get(F.transform(F.array(value), put), F.lit(0))


#: Marks put around what is found: behind a match, and between the parts of one.
END, PART = "\x01", "\x02"


def cut(text: Column, pattern: str | Column, groups: int = 0) -> Column:
    """struct<found, rest>: ``matches`` and ``tail`` by one search.

    A search is dear and a split by one character is cheap, so the matches are marked and the marked text is split. A text that holds a mark itself is
    searched once for what stands between the matches and once for each group.
    """
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    fields = lambda i, before, group: F.struct(i.alias("at"), before.alias("before"), *[group(k).alias(f"g{k}") for k in range(groups + 1)])

    def marked(body: Column) -> Column:
        pieces = F.split(F.regexp_replace(body, regex, F.lit("".join(f"{PART}${k}" for k in range(groups + 1)) + END)), END, -1)
        parts = lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: F.split(x, PART, -1))
        found = lambda p: F.transform(parts(p), lambda x, i: fields(i, F.get(x, F.lit(0)), lambda k: F.get(x, F.lit(k + 1))))
        return bound(pieces, lambda p: F.struct(found(p).alias("found"), F.element_at(p, -1).alias("rest")))

    def searched(body: Column) -> Column:
        every = [F.regexp_extract_all(body, regex, F.lit(k)).alias(f"g{k}") for k in range(groups + 1)]
        found = lambda s: F.transform(s["g0"], lambda x, i: fields(i, F.get(s["before"], i), lambda k: F.get(s[f"g{k}"], i)))
        return bound(F.struct(F.split(body, regex, -1).alias("before"), *every), lambda s: F.struct(found(s).alias("found"), F.element_at(s["before"], -1).alias("rest")))

    holds = lambda body: F.contains(body, F.lit(END)) | F.contains(body, F.lit(PART))
    return bound(F.coalesce(text, F.lit("")), lambda body: F.when(holds(body), searched(body)).otherwise(marked(body)))


def matches(text: Column, pattern: str | Column, groups: int = 0) -> Column:
    """array<struct<at, before, g0, g1, ..>>: each match with its number, the text between it and the match before, and its groups.

    A group that takes no part is empty. ``tail`` is what follows the last match. A null text has no matches.
    """
    return cut(text, pattern, groups)["found"]


def tail(text: Column, pattern: str) -> Column:
    """What follows the last match; the whole text if there is none."""
    return cut(text, pattern)["rest"]


def placed(text: Column, pattern: str | Column, groups: int = 0) -> Column:
    """``matches`` with ``start`` and ``stop``, in characters from 0."""

    def put(found: Column, ends: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            stop = F.get(ends, i)
            return m.withField("start", stop - F.length(m["g0"])).withField("stop", stop)

        return F.transform(found, one)

    step = lambda a, m: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(m["before"]) + F.length(m["g0"]))
    ends = lambda found: F.aggregate(found, F.array().cast("array<int>"), step)
    return bound(matches(text, pattern, groups), lambda found: bound(ends(found), lambda e: put(found, e)))


def rewritten(text: Column, pattern: str, groups: int, put) -> Column:
    """The text with each match replaced by ``put(match)``, a Column."""
    parts = lambda c: F.transform(c["found"], lambda m: F.concat(m["before"], put(m)))
    return bound(cut(text, pattern, groups), lambda c: F.concat(F.array_join(parts(c), ""), c["rest"]))
