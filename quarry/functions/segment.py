"""Words of texts in any language, those written without spaces included."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import importable

HAN = "一-鿿"
PIECE = rf"[{HAN}]+|[\p{{L}}\p{{M}}\p{{N}}&&[^{HAN}]]+"
#: Entries and characters an entry that a dictionary may have; it is held by every worker.
ENTRIES, LONGEST = 500_000, 32


def pieces(text: Column) -> Column:
    """Lower-case runs of Han characters and words of all other letters, marks and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PIECE), 0)


def bigrams(text: Column) -> Column:
    """``pieces`` where a Han run gives its pairs of neighbours, a single character itself."""
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(pieces(text), lambda p: F.when(p.rlike(f"^[{HAN}]{{2,}}$"), pairs(p)).otherwise(F.array(p))))


class Lattice:
    """Best path of a run through the words of a dictionary.

    A word weighs the logarithm of its share of all counts, a character that no word covers that of one count. Of
    equal paths the one with the longer first word wins. Neighbouring uncovered characters come out as pairs.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        total = math.log(max(1, sum(counts.values())))
        self.weights: dict[str, float | None] = {w[:i]: None for w in counts for i in range(1, len(w))}
        self.weights.update((w, math.log(n) - total) for w, n in counts.items())
        self.uncovered = -total - 1e-9

    def path(self, run: str) -> list[str]:
        """The parts of the best path: words and uncovered characters."""
        n = len(run)
        best, end = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], end[i] = self.uncovered + best[i + 1], i + 1
            for j in range(i + 1, n + 1):
                if run[i:j] not in self.weights:
                    break
                w = self.weights[run[i:j]]
                if w is not None and w + best[j] >= best[i]:
                    best[i], end[i] = w + best[j], j
        out, i = [], 0
        while i < n:
            out.append(run[i : end[i]])
            i = end[i]
        return out

    def cut(self, run: str) -> list[str]:
        """Words of the best path, uncovered characters as pairs of neighbours or, with none beside them, alone."""
        out: list[str] = []
        for covered, parts in itertools.groupby(self.path(run), lambda p: self.weights.get(p) is not None):
            held = list(parts)
            out += held if covered or len(held) == 1 else [a + b for a, b in itertools.pairwise(held)]
        return out


def segmenter(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A function from text to the array of its words, for texts with and without spaces.

    ``dictionary(word, n)`` has at most ``ENTRIES`` different words of at most ``LONGEST`` characters (an error
    beyond, as every worker holds it); counts of equal words are added, null words and counts below one ignored. Texts without Han characters
    never leave the JVM; the pieces of the others go to Python in Arrow batches, in time linear in their length.
    """
    spark = dictionary.sparkSession
    importable(spark)
    known = dictionary.where("word <> '' AND n >= 1").groupBy(F.lower("word").alias("word")).agg(F.sum("n").cast("long").alias("n"))
    rows = known.limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES or any(len(r.word) > LONGEST for r in rows):
        raise ValueError(f"a dictionary has at most {ENTRIES} words of at most {LONGEST} characters")
    counts = spark.sparkContext.broadcast({r.word: r.n for r in rows})
    ready: list[Lattice] = []

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(Lattice(counts.value))
        han = re.compile(f"[{HAN}]")
        return texts.map(lambda ps: None if ps is None else [w for p in ps for w in (ready[0].cut(p) if han.match(p) else (p,))])

    def words(text: Column) -> Column:
        every = pieces(text)
        return F.coalesce(cut(F.when(text.rlike(f"[{HAN}]"), every)), every)

    return words
