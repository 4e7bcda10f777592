"""Checks and repairs of answers by what stands next to what: citations, rounding, amounts of two kinds of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import spans

#: Fixed patterns: a citation of a chunk, the block that is added to an answer, a reference by its number alone, marks of web and filing citations.
CITED = r"[【\[]\s*([A-Za-z0-9_.\-]+?\.(?:txt|html))\s*,\s*chunk\s*#(\d+)\s*[】\]]"
ADDED = r"\n-{3,}\n(?=\s*(?:📚|⚠))"
REFERENCE = r"(?i)([\[【])\s*reference\s*(\d+)\s*[,，]\s*chunk\s*#?\s*(\d+)\s*([\]】])"
WEB, FILING = r"(?i)[\[【]\s*web\s*[:：]", r"(?i)[\[【][^\]】]*chunk\s*#\s*\d+[^\[【]*?[\]】]"
#: Fixed patterns: a number with a decimal point and its unit, and how a unit may be spelt.
MEASURED = r"(?i)(?<![\d.])(\d+\.\d+)\s*(%|billion|million|bn|\bB\b|\bM\b)"
SPELT = {"%": r"\s*%", "billion": r"\s*(?:billion|bn|B\b)", "million": r"\s*(?:million|M\b)"}
#: Decimals up to which roundings are looked for.
PLACES = 8
#: Fixed patterns: a calendar date, a fiscal period, the ends of sentences, an amount of dollars.
DATED = r"(?i)\b20\d{2}\s*[-/年]\s*(?:0?[1-9]|1[0-2])\s*[-/月]|\b(?:0?[1-9]|1[0-2])\s*/\s*(?:0?[1-9]|[12]\d|3[01])\s*/\s*\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+20\d{2}\b"
FISCAL = r"(?i)FY\s*20\d{2}|20\d{2}\s*(?:財政年度|財年|會計年度)|第\s*[1-4一二三四]\s*季|_10[KQ]_\d{4,6}|_\d{8}\b|Q[1-4]\s*(?:FY)?\s*20\d{2}|20\d{2}\s*Q[1-4]"
SENTENCE = r"[。！？!?；;\n]+"
AMOUNT = r"(?i)(?:US)?\$\s*([\d,]+(?:\.\d+)?)\s*(trillion|billion|million|兆|億)|([\d,]+(?:\.\d+)?)\s*(兆美元|億美元|百萬美元)"
MILLIONS = {"trillion": 1e6, "兆": 1e6, "兆美元": 1e6, "billion": 1e3, "億": 100.0, "億美元": 100.0, "million": 1.0, "百萬美元": 1.0}
#: Dashes that look like a hyphen.
DASHES = "‐‑‒–—―－−"
#: Steps by which amounts are gathered before they are joined; a step is less than two percent wide.
STEPS = 120


def body(text: Column) -> Column:
    """The answer without the block of sources or warnings that is added to it."""
    return F.split(F.coalesce(text, F.lit("")), ADDED, 2)[0]


def cited_segments(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """(key, segment, said, source, chunk): each stretch of text goes to the citations that close it, several in a row included.

    Text behind the last citation and citations before any text have no row.
    """
    rows = answers.select(key, F.explode(spans.matches(body(F.col(text)), CITED, 2)).alias("m"))
    new = F.when(F.trim(F.regexp_replace("m.before", r"\s+", " ")) != "", 1).otherwise(0)
    numbered = rows.select(key, F.sum(new).over(Window.partitionBy(key).orderBy("m.at")).alias("segment"), new.alias("new"), "m").where("segment > 0")
    said = F.first(F.when(F.col("new") == 1, F.col("m.before")), ignorenulls=True).over(Window.partitionBy(key, "segment").orderBy("m.at"))
    return numbered.select(key, "segment", "m.at", said.alias("said"), F.col("m.g1").alias("source"), F.col("m.g2").cast("int").alias("chunk"))


def _unit(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.isin("bn", "b"), "billion").when(low == "m", "million").otherwise(low)


def _plain(number: Column) -> Column:
    """A number without closing zeros behind its point."""
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)


def appears(text: Column, number: Column, unit: Column) -> Column:
    """The number, not as part of a longer one, with its unit in any spelling."""
    spelt = F.lit(SPELT["%"])
    for k, p in SPELT.items():
        spelt = F.when(unit == k, F.lit(p)).otherwise(spelt)
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![\d.])"), F.replace(_plain(number), F.lit("."), F.lit(r"\.")), F.lit(r"0*(?!\d)"), spelt))


def rounding_losses(answers: DataFrame, chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, source_value, unit, wrote, source, chunk): numbers of a cited chunk that the segment gives only rounded.

    ``answers(key, answer)``, ``chunks(key, source, chunk, text)``. A segment is held against the chunks it cites alone. A number that it
    also gives in full, and a rounding that the cited text has itself, are no losses; of several roundings the finest counts, and each
    loss once an answer.
    """
    segments = cited_segments(answers, key)
    there = chunks.select(key, "source", "chunk", F.struct("text").alias("_there"))
    met = segments.join(there, [key, "source", "chunk"], "left")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_there").isNotNull(), F.struct("at", "_there.text")))), lambda x: x["text"]), "\n")
    named = F.min(F.struct("at", "source", "chunk"))  # of all citations, those without a chunk included
    held = met.groupBy(key, "segment").agg(F.min("said").alias("said"), texts.alias("cited"), named.alias("named"), F.count("_there").alias("_n")).where("_n > 0")
    found = held.select("*", F.explode(F.array_distinct(F.transform(spans.matches(F.col("cited"), MEASURED, 2), lambda m: F.struct(m["g1"].alias("value"), _unit(m["g2"]).alias("unit"))))).alias("n"))
    lost = found.where(~appears(F.col("said"), F.col("n.value"), F.col("n.unit")))
    exact = F.col("n.value").cast(f"decimal(38,{PLACES + 1})")
    forms = [F.when(F.length(F.regexp_extract("n.value", r"\.(\d+)", 1)) > p, _plain(F.bround(exact, p).cast(f"decimal(38,{p})").cast("string"))) for p in range(PLACES - 1, -1, -1)]
    rounded = F.filter(F.array(*forms), lambda v: v.isNotNull() & (v != _plain(F.col("n.value"))) & appears(F.col("said"), v, F.col("n.unit")) & ~appears(F.col("cited"), v, F.col("n.unit")))
    wrote = lost.select(key, F.col("n.value").alias("source_value"), F.col("n.unit").alias("unit"), F.get(rounded, F.lit(0)).alias("wrote"), "named", "segment").where("wrote is not null")
    once = wrote.groupBy(key, "source_value", "unit", "wrote").agg(F.min(F.struct("segment", "named")).alias("x"))
    return once.select(key, "source_value", "unit", "wrote", "x.named.source", "x.named.chunk")


def repaired_references(answers: DataFrame, allowed: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, answer, fixed, skipped): references by number get the name of the source that stands at that place.

    ``allowed(key, place, source, chunk)``, places from 1. A reference is repaired only where the chunk it names is the one at its place;
    others stay as they are and count as skipped. Of several chunks at a place the first by number counts. A key without allowed chunks keeps its answer.
    """
    rows = answers.select(key, spans.cut(F.col("answer"), REFERENCE, 4).alias("c")).select(key, F.col("c.found").alias("m"), "c.rest")
    each = rows.select(key, "rest", F.explode_outer("m").alias("m")).select(key, "rest", "m", F.col("m.g2").try_cast("int").alias("place"), F.col("m.g3").try_cast("int").alias("chunk"))
    first = allowed.groupBy(key, "place").agg(F.min(F.struct("chunk", "source")).alias("x")).select(key, "place", "x.chunk", F.col("x.source").alias("_source"))
    at = each.join(first, [key, "place", "chunk"], "left")
    new = F.coalesce(F.concat("m.g1", "_source", F.lit(", chunk #"), F.col("chunk").cast("string"), F.col("m.g4")), F.col("m.g0"))
    part = F.struct(F.col("m.at").alias("at"), F.concat("m.before", new).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), part))), lambda x: x["part"]), "")
    done = at.groupBy(key).agg(whole.alias("parts"), F.first("rest").alias("rest"), F.count("_source").alias("fixed"), F.count(F.when(F.col("m").isNotNull() & F.col("_source").isNull(), 1)).alias("skipped"))
    known = allowed.select(key).distinct().withColumn("_known", F.lit(1))
    return done.join(known, key, "left").select(key, F.concat("parts", "rest").alias("answer"), "fixed", F.when(F.col("_known") == 1, F.col("skipped")).otherwise(0).alias("skipped"))


def comparable(amounts: DataFrame, key: str = "answer_id", ratio: float = 10.0, apart: float = 0.02) -> DataFrame:
    """Keys of ``amounts(key, side, amount)`` with a ``web`` and a ``filing`` amount of one size but different value.

    That is, the larger is at most ``ratio`` times the smaller and they differ by more than ``apart`` of it. Amounts of a key are first gathered
    to steps of less than two percent with their extremes, so that a key has some hundred rows for each decade, however many
    amounts; equal and neighbouring decades are then joined. Of two steps only the farthest and the nearest amounts need be compared.
    """
    step = F.floor(F.log10("amount") * STEPS)
    kept = amounts.where("amount > 0 and side in ('web', 'filing')").groupBy(key, "side", step.alias("step")).agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
    kept = kept.withColumn("decade", F.floor(F.col("step") / STEPS))
    web = kept.where("side = 'web'").select(key, F.explode(F.array(*[F.col("decade") + i for i in (-1, 0, 1)])).alias("decade"), F.col("low").alias("a"), F.col("high").alias("b"))
    filing = kept.where("side = 'filing'").select(key, "decade", F.col("low").alias("c"), F.col("high").alias("d"))
    differ = lambda x, y: (F.greatest(x, y) / F.least(x, y) <= ratio) & (F.abs(F.col(x) - F.col(y)) / F.greatest(x, y) > apart)
    return web.join(filing, [key, "decade"]).where(differ("a", "d") | differ("b", "c")).select(key).distinct()


def sentences(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """(key, said, side): sentences that cite the web or a filing; one that cites both has a row for each."""
    clean = F.translate(body(F.col(text)), DASHES, "-" * len(DASHES))
    said = answers.select(key, F.explode(F.split(clean, SENTENCE, -1)).alias("said"))
    sides = F.array_compact(F.array(F.when(F.col("said").rlike(WEB), "web"), F.when(F.col("said").rlike(FILING), "filing")))
    return said.select(key, "said", F.explode(sides).alias("side"))


def millions(text: Column) -> Column:
    """Dollar amounts with a unit in millions; bare ones are left out."""
    scale = F.create_map(*[F.lit(x) for kv in MILLIONS.items() for x in kv])
    number = lambda m: F.replace(F.concat(m["g1"], m["g3"]), F.lit(","), F.lit("")).try_cast("double")
    found = F.transform(spans.matches(text, AMOUNT, 4), lambda m: number(m) * F.try_element_at(scale, F.lower(F.concat(m["g2"], m["g4"]))))
    return F.filter(found, lambda v: v.isNotNull())


def undated_dual_sourcing(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, web_undated, filing_undated) of answers that give two values of one size from web and filing and leave the time of one of them open.

    A web sentence needs a calendar date, a filing sentence that or a fiscal period; one dated sentence a side is enough.
    """
    cited = sentences(answers, key)
    amounts = cited.select(key, "side", F.explode(millions(F.col("said"))).alias("amount"))
    dated = F.col("said").rlike(DATED)
    when = F.bool_or(F.when(F.col("side") == "web", dated)).alias("web"), F.bool_or(F.when(F.col("side") == "filing", dated | F.col("said").rlike(FISCAL))).alias("filing")
    sides = cited.groupBy(key).agg(*when)
    return sides.join(comparable(amounts, key), key).where("not web or not filing").select(key, (~F.col("web")).alias("web_undated"), (~F.col("filing")).alias("filing_undated"))


def unsupported_numbers(wanted: DataFrame, sources: DataFrame, largest: int, key: str = "answer_id") -> DataFrame:
    """(key, literal) of ``wanted`` percentages that no number of their sources gives at the precision of the literal.

    ``sources(key, value, share, size)``: a value is a percentage or, where ``share``, a part of one. Sources are rounded, halves to even, to the precisions
    that their key asks for, and joined on value and precision. Keys whose sources have more than ``largest`` bytes together are
    left out: in a large text any number is found. So are keys without sources.
    """
    asked = wanted.select(key, "literal", F.length(F.regexp_extract("literal", r"\.(\d+)", 1)).alias("places"), F.col("literal").try_cast("decimal(38,10)").alias("value"))
    sizes = sources.groupBy(key).agg(F.sum("size").alias("size")).where(F.col("size") <= largest).select(key)
    used = asked.select(key, "places").distinct()
    percent = F.when(F.col("share"), F.col("value") * 100).otherwise(F.col("value")).cast("decimal(38,14)")
    at = F.lit(None).cast("decimal(38,10)")
    for p in range(11):
        at = F.when(F.col("places") == p, F.bround("percent", p).cast("decimal(38,10)")).otherwise(at)
    given = sources.select(key, percent.alias("percent")).join(used, key).select(key, "places", at.alias("value")).distinct()
    return asked.join(sizes, key).join(given, [key, "places", "value"], "left_anti").select(key, "literal")
