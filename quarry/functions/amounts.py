"""Amounts of money as tokens: a text is cut at its amounts once, and rules look at a token, its neighbours and what stands between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import spans
from quarry.functions.numbers import plain_number

#: Unit words in hundreds of millions (億), what they are in millions, letters after a dollar amount, words that follow a unit.
HUNDREDS = {"billion": 10.0, "bn": 10.0, "十億": 10.0, "trillion": 10_000.0, "兆": 10_000.0, "million": 0.01, "mn": 0.01, "百萬": 0.01}
LETTERS = {"B": "billion", "M": "million", "T": "trillion"}
YI = "億"
DOLLARS = ["美元", "美金", "dollar", "dollars", "usd"]
FOLLOWING = "美元|美金|dollars?|USD|歐元|元|圓"
ABOUT = "約|約為|即|亦即|等於|≈|=|~"
#: Sign, number, unit, and the word behind it with its space. The first look tells most places from those where one can begin.
TOKEN = rf"(?i)(?=[$U\d])((?:US)?\$\s?)?(\d[\d,]*(?:\.\d+)?)\s*({'|'.join(sorted(HUNDREDS, key=len, reverse=True))}|{YI})(?![A-Za-z])(\s*(?:{FOLLOWING}))?"
#: Where an amount of 億 may stand without its source right behind it in brackets.
MAYBE_OPEN = rf"(?i){YI}(?![A-Za-z])(?:\s*(?:{FOLLOWING}))?+(?![（(](?-i:(?:US)?\$?)[0-9])"
#: An amount of a sentence, and one written twice, the second time in brackets.
STATED = r"([\d,]+(?:\.\d+)?)\s*(億美元|百萬美元)|\$\s*([\d,]+(?:\.\d+)?)\s*(billion|十億|million|百萬)"
STATED_MILLIONS = {"億美元": 100.0, "百萬美元": 1.0, "billion": 1000.0, "十億": 1000.0, "million": 1.0, "百萬": 1.0}
TWICE = r"([\d,]+(?:\.\d+)?)\s*億美元\s*[（(]\s*\$?\s*([\d,]+(?:\.\d+)?)\s*(billion|million|百萬|十億|兆)"
TWICE_MILLIONS = {"billion": 1000.0, "十億": 1000.0, "million": 1.0, "百萬": 1.0, "兆": 1_000_000.0}
#: Characters within which two spellings of one amount stand, and the share by which they may differ.
NEAR, SHARE = 40, 0.02
#: Values of an answer's evidence in a row.
LISTED = 1_000


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(30,8)")


def _map(values: dict[str, float], kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))])


def _word(token: Column) -> Column:
    return F.lower(F.trim(token["g4"]))


def _is_yi(token: Column) -> Column:
    return token["g3"] == YI


def is_money(token: Column) -> Column:
    """An amount of hundreds of millions of a currency; a count of things, or an amount in 元, is none."""
    return _is_yi(token) & ~_word(token).isin("元", "圓") & ((token["g1"] != "") | _word(token).isin("美元", "歐元"))


def money_values(text: Column) -> Column:
    """Different values of the amounts of money in hundreds of millions."""
    return F.array_distinct(F.transform(F.filter(spans.matches(text, TOKEN, 4), is_money), lambda t: number(t["g2"])))


def grouped(x: Column) -> Column:
    """Grouped by thousands, up to four decimals, no closing zeros."""
    return plain_number(x.cast("decimal(34,8)"))


def spelt(x: Column) -> Column:
    """How a number may be written: plain, and grouped by thousands."""
    plain = F.regexp_replace(x.cast("decimal(34,10)").cast("string"), r"\.?0+$", "")
    whole = F.format_number(F.split(plain, r"\.")[0].cast("decimal(34,0)"), 0)
    return F.array_distinct(F.array(plain, F.concat(whole, F.coalesce(F.concat(F.lit("."), F.get(F.split(plain, r"\."), F.lit(1))), F.lit("")))))


def stated(text: Column) -> Column:
    """array<struct<start, millions>>: amounts of a sentence by place; a second spelling of one, at most ``NEAR`` characters on, is left out."""
    units = _map(STATED_MILLIONS, "double")
    found = F.transform(spans.placed(text, STATED, 4), lambda m: F.struct(m["start"].alias("start"), (number(F.concat(m["g1"], m["g3"])).cast("double") * F.try_element_at(units, F.concat(m["g2"], m["g4"]))).alias("millions")))
    none = F.array().cast("array<struct<start: int, millions: double>>")

    def fold(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        same = (x["start"] - last["start"] <= NEAR) & (F.abs(x["millions"] - last["millions"]) <= F.greatest(last["millions"] * SHARE, F.lit(0.5)))
        return F.when(F.coalesce(same, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.filter(found, lambda x: x["millions"].isNotNull()), none, fold)


def wrong_twice(text: Column) -> Column:
    """array<struct<start, said, millions, other>>: amounts written twice whose spellings differ by more than two percent and half a million."""
    units = _map(TWICE_MILLIONS, "double")
    each = lambda m: F.struct(m["start"].alias("start"), F.trim(m["g0"]).alias("said"), (number(m["g1"]).cast("double") * 100).alias("millions"), (number(m["g2"]).cast("double") * F.try_element_at(units, m["g3"])).alias("other"))
    return F.filter(F.transform(spans.placed(text, TWICE, 3), each), lambda x: F.abs(x["other"] - x["millions"]) > F.greatest(x["millions"] * SHARE, F.lit(0.5)))


def _cut(text: Column, needed: Column, put: Callable[[Column, Column], Column]) -> Column:
    """``put(tokens, rest)`` of a text, null where it isn't needed: a look at a text is cheap, cutting it is not."""
    return F.when(needed, spans.bound(spans.cut(text, TOKEN, 4), lambda c: put(c["found"], c["rest"])))


def _unbracketed(rows: DataFrame, drops_first: bool, about: str) -> DataFrame:
    """One amount of two that stand as ``a（b）`` taken out with the brackets: b where a has a unit word and b is of 億, or a where it is the other way round."""

    def taken(found: Column, rest: Column) -> Column:
        def pair(one: Column, i: Column) -> Column:
            two, follows = F.get(found, i + 1), F.coalesce(F.get(found, i + 2)["before"], rest)
            kinds = ~_is_yi(one) & _is_yi(two) & _word(two).isin("", "美元", "美金") if not drops_first else _is_yi(one) & ~_is_yi(two) & (_word(two) == "") & _word(one).isin("", "美元", "美金")
            apart = two["before"].rlike(rf"^\s*[（(]\s*(?:{about})?\s*$") & follows.rlike(r"^\s*[)）]")
            return F.coalesce(kinds, F.lit(False)) & F.coalesce(apart, F.lit(False))

        def without(pairs: Column) -> Column:
            closed = lambda piece, i: F.when(F.coalesce(F.get(pairs, i - 2), F.lit(False)), F.regexp_replace(piece, r"^\s*[)）]", "")).otherwise(piece)
            second = lambda i: F.coalesce(F.get(pairs, i - 1), F.lit(False))

            def put(t: Column, i: Column) -> Column:
                if drops_first:
                    return F.when(second(i), t["g0"]).otherwise(F.concat(closed(t["before"], i), F.when(F.get(pairs, i), "").otherwise(t["g0"])))
                return F.when(second(i), "").otherwise(F.concat(closed(t["before"], i), t["g0"]))

            text = F.concat(F.array_join(F.transform(found, put), ""), closed(rest, F.size(found)))
            return F.when(F.array_contains(pairs, True), F.struct(text.alias("text"), F.size(F.filter(pairs, lambda p: p)).alias("removed")))

        return spans.bound(F.transform(found, pair), without)

    text = F.col("text")
    needed = F.contains(text, F.lit(YI)) & text.rlike(rf"(?i)[（(]\s*(?:{about})?\s*(?:(?:US)?\$\s?)?\d")
    new = rows.withColumn("_new", _cut(text, needed, taken))
    return new.withColumns({"text": F.coalesce("_new.text", text), "removed": F.col("removed") + F.coalesce("_new.removed", F.lit(0))}).drop("_new")


def without_own(rows: DataFrame) -> DataFrame:
    """``rows(.., text)`` without conversions to 億 that stand in one pair of brackets with the amount they convert; ``removed`` counts them. Others stay."""
    begun = rows.withColumns({"text": F.coalesce("text", F.lit("")), "removed": F.lit(0)})
    return _unbracketed(_unbracketed(begun, False, ABOUT), True, "")


def double_written(rows: DataFrame) -> DataFrame:
    """``rows(.., text)`` with each amount that has a unit word as hundreds of millions, with what the source says in brackets. Not to be applied twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spelt_out = text
    for letter, unit in LETTERS.items():
        spelt_out = F.regexp_replace(spelt_out, rf"((?:US)?\$\s?\d[\d,]*(?:\.\d+)?)\s*{letter}(?![A-Za-z])", f"$1 {unit}")
    short = text.rlike(rf"\$\s?\d[\d,]*(?:\.\d+)?\s*[{''.join(LETTERS)}](?![A-Za-z])")
    worth = _map(HUNDREDS, "decimal(12,2)")

    def put(t: Column) -> Column:
        dollars = (t["g1"] != "") | _word(t).isin(DOLLARS)
        sign = F.when(t["g1"] != "", F.trim(t["g1"])).when(dollars, "$").otherwise("")
        after = F.when(_word(t).isin("歐元", "圓"), t["g4"]).otherwise("")
        both = F.concat(grouped(number(t["g2"]) * F.try_element_at(worth, F.lower(t["g3"]))), F.lit(f" {YI}"), F.when(dollars, "美元").otherwise(""), F.lit("（"), sign, t["g2"], F.lit(" "), t["g3"], F.lit("）"), after)
        return F.concat(t["before"], F.when(_is_yi(t), t["g0"]).otherwise(F.coalesce(both, t["g0"])))

    needed = F.col("text").rlike(rf"(?i)[\d,]\s*(?:{'|'.join(HUNDREDS)})(?![A-Za-z])")
    anew = _cut(F.col("text"), needed, lambda found, rest: F.concat(F.array_join(F.transform(found, put), ""), rest))
    return rows.withColumn("text", F.when(short, spelt_out).otherwise(text)).withColumn("text", F.coalesce(anew, "text"))


def evidence(contexts: DataFrame, key: str) -> DataFrame:
    """(key, value, unit) of the dollar amounts of ``contexts(key, text)`` in billions (``B``) or millions (``M``), where written plainly or grouped by thousands."""
    found = contexts.select(key, F.explode(spans.matches(F.col("text"), r"\$\s?(\d[\d,]*(?:\.\d+)?)\s*(billion|B\b|million|M\b)", 2)).alias("m"))
    written = found.where(F.col("m.g1").rlike(r"^(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d*[1-9])?$"))
    return written.select(key, number(F.col("m.g1")).alias("value"), F.translate(F.substring("m.g2", 1, 1), "bm", "BM").alias("unit")).distinct()


def _listed(contexts: DataFrame, key: str) -> DataFrame:
    """(key, billions, millions): the values of ``evidence``, at most ``LISTED`` in a row; a key with more has more rows."""
    among = F.row_number().over(Window.partitionBy(key).orderBy("value", "unit")) - 1
    of = lambda unit: F.collect_list(F.when(F.col("unit") == unit, F.col("value")))
    found = evidence(contexts, key).where(F.col("value").isNotNull()).withColumn("_part", F.floor(among / LISTED))
    return found.groupBy(key, "_part").agg(of("B").alias("_billions"), of("M").alias("_millions")).drop("_part")


def repaired(rows: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """``rows(key, text, known, ..)`` with amounts of 億 that are a tenth of what is meant corrected where that is certain; ``repaired`` counts them.

    ``known`` are values in 億 that were calculated, not copied. An amount of N 億 stays if it has its source in brackets, or if the
    evidence has it as N / 10 billion or 100 N million. Else it is 10 N if the evidence has N billion, which is then given in brackets, or if 10 N is known.
    A text is held against each row of its evidence, and what that says of its amounts is put together.
    """
    right, tenth, other = 1, 2, 3
    among = lambda values, x: F.coalesce(F.array_contains(values, x.try_cast("decimal(30,8)")), F.lit(False))

    def verdicts(found: Column, rest: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            behind = F.substring(F.coalesce(F.concat(F.get(found, i + 1)["before"], F.get(found, i + 1)["g0"]), rest), 1, 8)
            open_ = is_money(t) & ~behind.rlike(r"^[\s\x{3000}]*[（(][\s\x{3000}]*(?:US)?\$?[\s\x{3000}]*[0-9]")
            said = lambda n: F.when(among("_billions", n / 10) | among("_millions", n * 100), right).when(among("_billions", n), tenth).when(among("known", n * 10), other)
            return F.coalesce(F.when(open_, spans.bound(number(t["g2"]), said)), F.lit(0))

        return F.transform(found, one)

    asks = F.col("text").rlike(MAYBE_OPEN) & (F.col("_billions").isNotNull() | (F.size("known") > 0))
    met = rows.withColumn("_row", F.monotonically_increasing_id()).join(_listed(contexts, key), key, "left")
    told = met.withColumn("_said", _cut(F.col("text"), asks, verdicts)).drop("known", "_billions", "_millions")
    kept = [F.first(c).alias(c) for c in told.columns if c not in (key, "_row", "_said")]
    one = told.groupBy(key, "_row").agg(*kept, F.collect_list("_said").alias("_said")).drop("_row")

    def mended(found: Column, rest: Column) -> Column:
        def put(t: Column, i: Column) -> Column:
            said, n = F.transform("_said", lambda s: F.get(s, i)), number(t["g2"])
            new = F.concat(grouped(n * 10), F.lit(f" {YI}"), F.when(F.trim(t["g4"]) != "", F.trim(t["g4"])).otherwise("美元"))
            fits = lambda s: F.when(F.array_contains(s, tenth), F.concat(new, F.lit("（$"), t["g2"], F.lit(" billion）"))).when(F.array_contains(s, other), new)
            return spans.bound(said, lambda s: F.when(~F.array_contains(s, right), fits(s)))

        text = lambda new: F.concat(F.array_join(F.transform(found, lambda t, i: F.concat(t["before"], F.coalesce(F.get(new, i), t["g0"]))), ""), rest)
        return spans.bound(F.transform(found, put), lambda new: F.struct(text(new).alias("text"), F.size(F.filter(new, lambda x: x.isNotNull())).cast("long").alias("repaired")))

    new = one.withColumn("_new", _cut(F.col("text"), F.exists("_said", lambda s: F.exists(s, lambda x: x >= tenth)), mended))
    return new.withColumns({"text": F.coalesce("_new.text", "text"), "repaired": F.coalesce("_new.repaired", F.lit(0).cast("long"))}).drop("_said", "_new")


def finalised(answers: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, text, removed, repaired) of ``answers(key, text)``, a key once, and the texts they were made from, ``contexts(key, text)``.

    Own conversions are taken out, every amount is written double, and what is left of 億 is held against the evidence and against the values
    that the second step has calculated. A null text is empty. Answers are dealt by key before they are read, so that the work is spread
    and the evidence meets them where they lie.
    """
    clean = without_own(answers.select(key, "text").repartition(key)).withColumn("_was", F.col("text"))
    done = double_written(clean)
    calculated = (F.col("text") != F.col("_was")) & F.col("text").rlike(MAYBE_OPEN)
    known = F.when(calculated, F.array_except(money_values(F.col("text")), money_values(F.col("_was")))).otherwise(F.array().cast("array<decimal(30,8)>"))
    return repaired(done.withColumn("known", known).drop("_was"), contexts, key).select(key, "text", "removed", "repaired")
