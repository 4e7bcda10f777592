"""Answers that say which of several companies is first: who is meant, and whether the evidence agrees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import ALIASES
from quarry.operators.search import importable

#: Names that are searched for at once; the automaton is built in each worker.
MAX_NAMES = 1_000_000
#: Fixed patterns: words of a comparison, those of them with the winner in front, and what may stand between the members of a list.
SUPERLATIVE = "最高|最大|最多|居首|領先|排名第一|勝過|超越|優於|高於"
TRANSITIVE = "領先|勝過|超越|優於|高於"
BETWEEN = r"^[\s、,，/／|與和及或者的是為以\(\)（）\[\]【】0-9.,%$＄億美元十二個月TTM\-—─~～]*$"
_HAN = re.compile("[一-鿿]")


def lowered(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _automaton(names: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name, entity in names.items():
        found.add_word(name, (len(name), entity, _HAN.search(name) is None))
    if names:
        found.make_automaton()
    return found


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _positions(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    low, out = lowered(text), []
    for last, (size, entity, bounded) in automaton.iter(low):
        start, stop = last + 1 - size, last + 1
        if not bounded or not ((start and _word(low[start - 1])) or (stop < len(low) and _word(low[stop]))):
            out.append((start, stop, entity))
    return sorted(out)


def mentions(texts: DataFrame, key: str, text: str, names: dict[str, str] = ALIASES) -> DataFrame:
    """(key, hits): array<struct<start, stop, entity>> of all mentions of ``names`` (lower case to entity), by place.

    One pass over a text, whatever the number of names; names may contain each other. Han names match anywhere, others where
    no letter, digit or underscore touches them. A null text has no hits.
    """
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    importable(texts.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("entity", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names)
        for b in batches:
            hits = [[dict(zip(("start", "stop", "entity"), h)) for h in _positions(automaton, x)] if (x := t.as_py()) and names else [] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, kind)], names=[key, "hits"])

    given = texts.select(key, text)
    return given.mapInArrow(run, f"{key} {given.schema[key].dataType.simpleString()}, hits array<struct<start: int, stop: int, entity: string>>")


def _answer(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "📚", 2)[0]


def winner(text: Column, hits: Column, companies: Column) -> Column:
    """The company that the answer puts first, or null: the mention nearest to the first word of comparison.

    Members of a list, that is mentions of different companies with nothing but separators or figures between them, are no claim. Before a
    verb such as *leads* the nearest mention in front of it counts, where there is one. Of equally near ones the first by name.
    """
    body = _answer(text)
    anchor = F.length(F.split(body, SUPERLATIVE, 2)[0])
    own = F.filter(hits, lambda h: F.array_contains(companies, h["entity"]))

    def listed(a: Column, b: Column) -> Column:
        between = F.substring(body, a["stop"] + 1, F.greatest(b["start"] - a["stop"], F.lit(0)))
        return F.coalesce((a["entity"] != b["entity"]) & between.rlike(BETWEEN), F.lit(False))

    free = F.filter(own, lambda h, i: ~listed(F.get(own, i - 1), h) & ~listed(h, F.get(own, i + 1)))
    near = F.array_min(F.transform(free, lambda h: F.struct(F.abs(h["start"] - anchor).alias("far"), h["entity"].alias("entity"))))
    front = F.array_min(F.transform(F.filter(free, lambda h: h["start"] < anchor), lambda h: F.struct((anchor - h["start"]).alias("far"), h["entity"].alias("entity"))))
    verb = F.substring(body, anchor + 1, F.lit(4)).rlike(f"^(?:{TRANSITIVE})")
    return F.when(body.rlike(SUPERLATIVE), F.when(verb, F.coalesce(front["entity"], near["entity"])).otherwise(near["entity"]))


def stated_value(text: Column, field: Column) -> Column:
    """``Field: $1.2B`` as a number, billions as millions; null if the field has none."""
    pattern = F.concat(F.lit(r"\Q"), field, F.lit(r"\E\s*:\s*\$?(-?[\d.]+)\s*([BM%]?)"))
    number = F.regexp_extract_all(text, pattern, 1)
    unit = F.get(F.regexp_extract_all(text, pattern, 2), F.lit(0))
    return F.get(number, F.lit(0)).try_cast("double") * F.when(unit == "B", 1000.0).otherwise(1.0)


def judged(answers: DataFrame, contexts: DataFrame, key: str = "answer_id", names: dict[str, str] = ALIASES) -> DataFrame:
    """(key, verdict, reason, claimed, truth, missing) of ``answers(key, answer, companies, field, largest)``.

    ``contexts(key, place, text)`` begin with ``[TICKER]``; the first of a company that states the field counts, and of equal values the one
    that comes first. Without a claim, or with one that can't be told, or where a company has no value, the verdict is N/A.
    """
    said = answers.join(mentions(answers.select(key, _answer(F.col("answer")).alias("_body")), key, "_body", names), key)
    claims = said.select(key, "companies", "largest", winner(F.col("answer"), F.col("hits"), F.col("companies")).alias("claimed"), _answer(F.col("answer")).rlike(SUPERLATIVE).alias("compares"))
    ticker = F.regexp_extract("text", r"^\[([A-Z]{1,6})\]", 1)
    stated = contexts.join(answers.select(key, "companies", "field"), key).where(F.array_contains("companies", ticker)).select(key, ticker.alias("company"), "place", stated_value(F.col("text"), F.col("field")).alias("value"))
    values = stated.where("value is not null").groupBy(key, "company").agg(F.min(F.struct("place", "value")).alias("x"))
    order = values.groupBy(key).agg(
        F.collect_set("company").alias("have"), F.min(F.struct(-F.col("x.value"), "x.place", "company")).alias("high"), F.min(F.struct(F.col("x.value"), "x.place", "company")).alias("low"),
    )
    both = claims.join(order, key, "left").withColumn("missing", F.array_except("companies", F.coalesce("have", F.array().cast("array<string>"))))
    sure = F.col("claimed").isNotNull() & (F.size("missing") == 0)
    truth = F.when(sure, F.when(F.col("largest"), F.col("high.company")).otherwise(F.col("low.company")))
    reason = F.when(F.col("claimed").isNull(), F.when(F.col("compares"), "ambiguous_claim").otherwise("no_claim")).when(F.size("missing") > 0, "unfounded").otherwise("")
    return both.select(key, F.when(~sure, "N/A").when(truth == F.col("claimed"), "PASS").otherwise("FAIL").alias("verdict"), reason.alias("reason"), "claimed", truth.alias("truth"), "missing")
