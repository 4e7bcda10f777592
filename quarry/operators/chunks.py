"""Chunk records of filings: elements of a file in, numbered chunks with their context out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import table_rows
from quarry.operators import lines
from quarry.operators.search import importable

# Fixed values of the chunk format: verbs of change, ways to write a magnitude, headings of compared periods.
CHANGES = r"(?i)\b(increased|decreased|grew|declined|rose|fell)\b"
MAGNITUDE = r"\d+(?:\.\d+)?\s*%|\$\s*[\d,]+|\b\d{1,3},\d{3}\b"
SPANS = "Three|Six|Nine|Twelve"
#: Smallest section that a header closes, shortest chunk, longest orphan and longest merged section, in characters; rows from which a table needs a summary.
SECTION, SHORTEST, ORPHAN, MERGED, SUMMARY_ROWS = 350, 20, 1200, 8000, 4


def strip(text: Column) -> Column:
    """Without blanks of any kind at the ends; null gives the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def section_header(role: Column, text: Column) -> Column:
    """A title, or a generic text of at most 60 characters and eight words that doesn't end like a sentence or a list."""
    t = strip(text)
    short = (F.length(t) <= 60) & (F.size(F.split(t, r"\s+")) <= 8) & ~t.rlike("[.。:：;；,，]$")
    return F.coalesce((t != "") & ((role == "Title") | ((role == "Text") & short)), F.lit(False))


def has_magnitude(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(MAGNITUDE)


def orphan_explainer(text: Column) -> Column:
    """A short text that says something changed but not by how much."""
    t = strip(text)
    return (F.length(t) <= ORPHAN) & t.rlike(CHANGES) & ~has_magnitude(t)


def period_label(heading: Column) -> Column:
    """A heading that compares two periods with ``vs`` and without the repeated span; any other with blanks squeezed."""
    h = F.trim(F.regexp_replace(heading, r"\s+", " "))
    months = F.regexp_replace(h, rf"^(({SPANS}) Months Ended .+?) Compared [Ww]ith \2 Months Ended (.+)$", "$1 vs $3")
    return F.regexp_replace(months, r"^(Fiscal Year \d{4}) Compared [Ww]ith Fiscal Year (\d{4}).*$", "$1 vs $2")


def period_prefix(period: Column, heading: Column) -> Column:
    """``[period] [section: heading] ``, each part only where it is known."""
    part = lambda before, c: F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit("] ")), F.lit(""))
    return F.concat(part("[", period), part("[section: ", heading))


def merge_unquantified(sections: Column) -> Column:
    """Array of (heading, text) where an orphan explainer joins the section before, if that one has a magnitude and the two stay within ``MERGED``."""
    last = lambda a: F.get(a, F.size(a) - 1)

    def step(a, x):
        before = last(a)
        back = (F.size(a) > 0) & orphan_explainer(x["text"]) & has_magnitude(before["text"]) & (F.length(before["text"]) + F.length(x["text"]) <= MERGED)
        joined = F.struct(before["heading"].alias("heading"), F.concat(before["text"], F.lit("\n"), x["text"]).alias("text"))
        return F.when(back, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.array_append(a, x))

    return F.aggregate(sections, F.slice(sections, 1, 0), step)


def numbered(records: DataFrame, by: list[str], order: list[str], name: str = "item_chunk_index") -> DataFrame:
    """Records with an index from 0 that runs on over all sections of an item, so that neighbours are at plus and minus one."""
    return records.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def sized(text: str) -> list[str]:
    """Pieces of at most 1,200 characters."""
    return lines.recursive_split(text, 1200, 0)


def chunk_records(elements: DataFrame, key: str = "file", split: Callable[[str], list[str]] = sized, summaries: DataFrame | None = None) -> DataFrame:
    """(key, chunk_index, chunk_type, text) of ``elements(key, pos, role, text)``.

    Tables come first, each under its caption or, if it has none and ``SUMMARY_ROWS`` rows or more, under its text in
    ``summaries(key, pos, summary)``. The other elements follow in sections: a header starts a new one once the
    present one has ``SECTION`` characters. ``split`` cuts each section, and pieces of ``SHORTEST`` characters or fewer go.

    Elements are dealt by file and sorted, and a map over Arrow batches makes the sections; it holds one of them and a batch at a
    time, and starts nothing anew for a file; positions are unique in a file. Null and blank texts give no record, equal
    elements one each, an empty table none. Columns besides the four are not read, whatever their names.
    """
    importable(elements.sparkSession)
    e = elements.select(F.col(key).alias("_key"), F.col("pos").cast("long").alias("pos"), F.coalesce("role", F.lit("")).alias("role"), strip(F.col("text")).alias("text"))
    told = lines.captions(e, "_key").where("text <> ''")
    if summaries is not None:
        s = summaries.select(F.col(key).alias("_key"), F.col("pos").cast("long").alias("pos"), "summary")
        large = (F.trim(F.coalesce("caption", F.lit(""))) == "") & (table_rows(F.col("text")) >= SUMMARY_ROWS)
        told = told.join(s, ["_key", "pos"], "left").withColumn("caption", F.when(large, F.col("summary")).otherwise(F.col("caption")))
    caption = F.trim(F.coalesce("caption", F.lit("")))
    tables = told.select("_key", F.lit(0).alias("part"), "pos", F.lit(False).alias("header"), F.when(caption == "", F.col("text")).otherwise(F.concat(caption, F.lit("\n\n"), F.col("text"))).alias("text"))
    plain = e.where(~F.col("role").eqNullSafe("Table") & (F.col("text") != ""))
    texts = plain.select("_key", F.lit(1).alias("part"), "pos", section_header(F.col("role"), F.col("text")).alias("header"), "text")
    least, shortest = SECTION, SHORTEST

    kind = to_arrow_type(e.schema["_key"].dataType)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, index, held, size, out = None, False, 0, [], 0, []

        def told(what: str, text: str) -> None:
            nonlocal index
            out.append((key, index, what, text))
            index += 1

        def flush() -> None:
            nonlocal held, size
            for piece in split("\n\n".join(held)) if held else ():
                if len(piece.strip()) > shortest:
                    told("text", piece.strip())
            held, size = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out
            cells, out = list(zip(*out)) or [()] * 4, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (kind, pa.int32(), pa.string(), pa.string()))], names=["key", "chunk_index", "chunk_type", "text"])

        for b in batches:
            for file, part, _, header, text in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or file != key:
                    flush()
                    key, begun, index = file, True, 0
                if part == 0:
                    told("table", text)
                    continue
                if header and size >= least:
                    flush()
                held.append(text)
                size += len(text)
            yield batch()
        flush()
        yield batch()

    order = ["_key", "part", "pos", "text"]
    rows = tables.unionByName(texts).repartition(int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").sortWithinPartitions(*order)
    return rows.mapInArrow(made, f"`{key}` {e.schema['_key'].dataType.simpleString()}, chunk_index int, chunk_type string, text string")
