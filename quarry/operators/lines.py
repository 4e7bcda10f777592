"""Structure of text: lines, sections, islands, folds and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import heading_like, prose_like


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line), positions from 0."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))


def sections(lines: DataFrame, is_heading: Column, key: str = "doc_id") -> DataFrame:
    """Lines with ``section`` (0 before the first heading) and the ``heading`` that carries on to them."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("_head", F.coalesce(is_heading, F.lit(False)))
    return marked.withColumn("section", F.sum(F.col("_head").cast("int")).over(w)).withColumn("heading", F.last(F.when(F.col("_head"), F.trim("line")), ignorenulls=True).over(w)).drop("_head")


def subheadings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections at heading-like lines that are followed by prose; blank lines between do not matter."""
    later = Window.partitionBy(key).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.trim("line") != "", F.col("line")), ignorenulls=True).over(later)
    ahead = lines.withColumn("_next", following)
    return sections(ahead, heading_like(F.col("line")) & prose_like(F.col("_next")), key).drop("_next")


def islands(lines: DataFrame, kind: str, inside: list[str], core: str, least: int, key: str = "doc_id") -> DataFrame:
    """Runs of lines whose kind is in ``inside``, cut after their last ``core`` line, with at least ``least`` core lines: (key, island, first, last, cores)."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("_in", F.col(kind).isin(*inside)).withColumn("island", F.sum((~F.col("_in")).cast("int")).over(w)).where("_in")
    runs = marked.groupBy(key, "island").agg(F.min("pos").alias("first"), F.max(F.when(F.col(kind) == core, F.col("pos"))).alias("last"), F.count_if(F.col(kind) == core).alias("cores"))
    return runs.where(F.col("cores") >= least).select(key, "island", "first", "last", "cores")


def line_kind(line: Column, known: Column) -> Column:
    """``neu`` for a blank line, ``tab`` if it is numbers only or all its long numbers are known, else ``txt``."""
    numbers = F.regexp_extract_all(line, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+"), 0)
    numeric = line.rlike(r"^[\s$%()0-9.,\-—]+$")
    return F.when(F.trim(line) == "", F.lit("neu")).when(numeric | ((F.size(numbers) > 0) & (F.size(F.array_except(numbers, known)) == 0)), F.lit("tab")).otherwise(F.lit("txt"))


def merge_small(chunks: Column, least: int, most: int) -> Column:
    """Array of texts where those below ``least`` characters join the one before, if the two stay within ``most``; a short first one joins the next."""
    start = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    swap = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))

    def step(a, x):
        joined = F.concat_ws("\n\n", last(a), x)
        back = (F.size(a) > 0) & ((F.length(x) < least) | ((F.size(a) == 1) & (F.length(F.get(a, F.lit(0))) < least))) & (F.length(F.get(a, F.size(a) - 1)) + F.length(x) + 2 <= most)
        return F.when(back, swap(a, joined)).otherwise(F.array_append(a, x))

    return F.aggregate(chunks, start, step)


def size_sections(elements: Column, least: int) -> Column:
    """Section number of each element of array<struct<text, header>>: a header starts a new one once ``least`` characters have come."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        new = x["header"] & (a["size"] >= least)
        n = a["n"] + new.cast("int")
        size = F.when(new, F.length(x["text"])).otherwise(a["size"] + F.length(x["text"]))
        return F.struct(n.alias("n"), size.alias("size"), F.array_append(a["out"], n).alias("out"))

    return F.aggregate(elements, zero, step, lambda a: a["out"])


def captions(elements: DataFrame, key: str = "id", most: int = 240) -> DataFrame:
    """For each table the nearest of the two elements before it, not past another table, that has three letters: its caption."""
    w = Window.partitionBy(key).orderBy("pos")
    good = lambda n: F.when(F.lag("role", n).over(w) != "Table", F.when(F.length(F.regexp_replace(F.lag("text", n).over(w), r"[^\p{L}]", "")) >= 3, F.lag("text", n).over(w)))
    second = F.when(F.lag("role", 1).over(w) != "Table", good(2))
    return elements.withColumn("caption", F.substring(F.coalesce(good(1), second), 1, most)).where("role = 'Table'")


def table_context(elements: DataFrame, key: str = "id", rows: int = 8, most: int = 900) -> DataFrame:
    """For each table the texts of up to ``rows`` elements before it since the last table, their last ``most`` characters."""
    w = Window.partitionBy(key).orderBy("pos")
    island = elements.withColumn("_t", F.coalesce(F.sum((F.col("role") == "Table").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy(key, "_t").orderBy("pos").rowsBetween(-rows, -1)
    texts = F.filter(F.collect_list("text").over(before), lambda t: F.trim(t) != "")
    return island.withColumn("context", F.right(F.array_join(texts, "\n"), F.lit(most))).where("role = 'Table'").drop("_t")


def semantic_breaks(sentences: DataFrame, key: str = "doc_id", distance: str = "distance", percent: float = 0.9) -> DataFrame:
    """Sentences with a ``chunk`` number that rises where the distance to the sentence before is above the key's percentile."""
    limits = sentences.groupBy(key).agg(F.percentile(distance, F.lit(percent)).alias("_limit"))
    w = Window.partitionBy(key).orderBy("pos")
    return sentences.join(limits, key).withColumn("chunk", F.sum(F.coalesce((F.col(distance) > F.col("_limit")).cast("int"), F.lit(0))).over(w)).drop("_limit")


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, each beginning with up to ``overlap`` characters of the piece before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep, rest = separators[0], separators[1:]
    parts = list(text) if sep == "" else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    now: list[str] = []
    length = 0
    for p in parts:
        if len(p) > size and rest:
            if now:
                out.append("".join(now))
                now, length = [], 0
            out += recursive_split(p, size, overlap, rest)
            continue
        if length + len(p) > size and now:
            out.append("".join(now))
            while now and (length > overlap or length + len(p) > size):
                length -= len(now.pop(0))
        now.append(p)
        length += len(p)
    if now:
        out.append("".join(now))
    return [o for o in (x.strip() for x in out) if o]


def split_documents(docs: DataFrame, size: int = 1200, overlap: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk) by ``recursive_split``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["chunks"] = [recursive_split(t or "", size, overlap) for t in b["text"]]
            yield b[["key", "chunks"]]

    made = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(cut, "key long, chunks array<string>")
    return made.select(F.col("key").alias(key), F.posexplode("chunks").alias("chunk_index", "chunk"))


def line_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, n): how often each different trimmed line stands in a document."""
    return lines_of(docs, key, text).withColumn("line", F.trim("line")).where("line <> ''").groupBy(key, "line").agg(F.count("*").alias("n"))
