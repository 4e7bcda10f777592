"""Fill-in-middle: texts cut at unit boundaries into prefix, middle and suffix.

A unit grammar says which characters a unit may end with and which the next one may begin
with. It is translated to a zero-width boundary, a lookbehind for the one class and a
lookahead for the other, and Spark's ``split`` at that boundary gives the units with no
character lost: joined again they are the text. An empty text would be one empty piece;
it has no units and is handled apart.

Everything is a projection of one row in the JVM: no shuffle, no Python, nothing kept.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY = r"\s\S"
_SPACE = r"\x20\x09-\x0D"


class Grammar(NamedTuple):
    """Character classes, as inside brackets: what a unit ends with, and what the next one begins with."""

    ends: str
    begins: str
    #: The units as one pattern, for those who match instead of splitting.
    unit: str


#: ``chars`` is the boundary between any two code points, which Spark writes as the empty pattern.
GRAMMARS = {
    "lines": Grammar(r"\n", _ANY, r"[^\n]*\n|[^\n]+"),
    "words": Grammar(_SPACE, "^" + _SPACE, rf"[^{_SPACE}]+[{_SPACE}]*|[{_SPACE}]+"),
    "chars": Grammar("", "", r"[\s\S]"),
}

SENTINELS = ("<P>", "<S>", "<M>")


def boundary(grammar: Grammar) -> str:
    """The zero-width pattern at which units meet."""
    return rf"(?<=[{grammar.ends}])(?=[{grammar.begins}])" if grammar.ends else ""


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text, in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _drawn(seed: int, ident: Column) -> list[Column]:
    """Four numbers of 32 bits from SHA-256 of ``seed:id``."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = "lines", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
              sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``n``, ``form``, ``prefix``, ``middle``, ``suffix``, ``output``.

    The id and ``seed`` alone draw both cuts and the form: ``psm`` is prefix, suffix, middle behind their sentinels, ``spm`` suffix,
    prefix, middle; ``plain`` is the text as it is, without parts. An empty or null text, one that contains a sentinel and one that the
    rate leaves out are plain. A null id draws as an empty one; rows that repeat an id are cut by the same draws. A text without
    a boundary is one unit. Texts of any length are cut whole; an empty table gives no rows; other columns, whatever their names and
    nulls, are carried in ``row``.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ident, text = F.col("row")[id_col], F.coalesce(F.col("row")[text_col], F.lit(""))
    read = given.select("row", text.alias("text"), F.array(*_drawn(seed, ident)).alias("h"))
    cut = read.select("*", units(F.col("text"), GRAMMARS[unit]).alias("u"))
    n = F.size("u").cast("long")
    a, b = F.col("h")[0] % (n + 1), F.col("h")[1] % (n + 1)
    marked = F.lit(False)
    for s in sentinels:
        marked |= F.contains(F.col("text"), F.lit(s))
    plain = (F.col("text") == "") | marked | (F.col("h")[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    placed = cut.select("row", "text", "u", n.alias("n"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi"), form.alias("form"))
    kept = F.col("form") != "plain"
    part = lambda first, size: F.when(kept, F.array_join(F.slice("u", first, size), ""))
    parts = placed.select(
        "row", "n", "form", F.when(~kept, F.col("text")).alias("text"), part(F.lit(1), F.col("lo")).alias("prefix"),
        part(F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("middle"), part(F.col("hi") + 1, F.size("u") - F.col("hi")).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in sentinels)
    psm = F.concat(p, F.col("prefix"), s, F.col("suffix"), m, F.col("middle"))
    spm = F.concat(s, F.col("suffix"), p, F.col("prefix"), m, F.col("middle"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from an output and its form alone: parts are what lies between the sentinels."""
    found = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    return F.when(form == "psm", F.concat(found[1], found[3], found[2])).when(form == "spm", F.concat(found[2], found[3], found[1])).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of ``transform``."""
    sentinels = options.get("sentinels", SENTINELS)
    made = transform(docs, id_col=id_col, text_col=text_col, **options)
    back = restored(F.col("output"), F.col("form"), sentinels)
    return made.select(
        F.col("row")[id_col].alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
