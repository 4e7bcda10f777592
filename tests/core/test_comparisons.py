from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarry.functions.text import ALIASES
from quarry.operators import comparisons as C


def slow(text, names):
    low, out = C.lowered(text), []
    for name, entity in names.items():
        if re.search("[一-鿿]", name):
            out += [(m.start(), m.start() + len(name), entity) for m in re.finditer(f"(?={re.escape(name)})", low)]
        else:
            out += [(m.start(), m.end(), entity) for m in re.finditer(rf"\b{re.escape(name)}\b", low)]
    return sorted(out)


def test_mentions_equal_a_slow_search(spark):
    rng = random.Random(8)
    names = {**ALIASES, "meta platforms": "META", "met": "MET", "蘋果公司": "AAPL", "果公": "X", "a b": "AB"}
    bits = [*names, "metadata", "Apple", "NVIDIA", " ", "、", "é", "_", "İ", "1", "果", "a b a b"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "，"]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    got = C.mentions(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", names).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(h) for h in r.hits] == slow(texts[r.id] or "", names)
    many = {f"name{i}x": str(i) for i in range(20_000)}
    assert C.mentions(spark.createDataFrame([(1, "name7x name19999x name3")], "id int, t string"), "id", "t", many).first().hits[1].entity == "19999"
    assert C.mentions(spark.createDataFrame([(1, "x")], "id int, t string"), "id", "t", {}).first().hits == []


CONTEXTS = [(1, 0, "[NVDA] === Growth === Revenue Growth (YoY): 85.20% "), (1, 1, "[META] Revenue Growth (YoY): 33.10%"), (1, 2, "[GOOGL] Revenue Growth (YoY): 21.80%"), (1, 3, "[NVDA] Revenue Growth (YoY): 1%")]


def verdict(spark, answer, companies=("NVDA", "META", "GOOGL"), largest=True, contexts=CONTEXTS):
    said = spark.createDataFrame([(1, answer, list(companies), "Revenue Growth (YoY)", largest)], "answer_id int, answer string, companies array<string>, field string, largest boolean")
    r = C.judged(said, spark.createDataFrame(contexts, "answer_id int, place int, text string")).first()
    return r.verdict, r.reason, r.claimed, r.truth, sorted(r.missing)


def test_claims(spark):
    assert verdict(spark, "成長最高的是 NVIDIA。")[:4] == ("PASS", "", "NVDA", "NVDA")
    assert verdict(spark, "Meta 的成長最高。")[:4] == ("FAIL", "", "META", "NVDA")
    assert verdict(spark, "成長最高的是 NVIDIA。", largest=False)[:4] == ("FAIL", "", "NVDA", "GOOGL")
    assert verdict(spark, "NVIDIA 的成長率明顯領先於 Meta 與 Alphabet")[2] == "NVDA"
    assert verdict(spark, "據此 NVIDIA 這一年是 Meta、Alphabet 兩家中成長最大的")[2] == "NVDA"
    assert verdict(spark, "Meta、Alphabet 最高")[1:3] == ("ambiguous_claim", None)
    assert verdict(spark, "無法判斷。📚 NVIDIA 最高")[1] == "no_claim" and verdict(spark, None)[1] == "no_claim"
    assert verdict(spark, "最高的是 NVIDIA", contexts=CONTEXTS[:2]) == ("N/A", "unfounded", "NVDA", None, ["GOOGL"])
    assert verdict(spark, "最高的是 Tesla")[1] == "ambiguous_claim"


def test_values(spark):
    rows = spark.createDataFrame([("Cap: $2.5B",), ("Cap : -3.5 M",), ("Cap: 7%",), ("Other: 1",), ("Cap: 1.2.3",)], "t string")
    assert [r.v for r in rows.select(C.stated_value(F.col("t"), F.lit("Cap")).alias("v")).collect()] == [2500.0, -3.5, 7.0, None, None]
