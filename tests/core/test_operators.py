from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import lines, ranking, search
from quarry.operators.predicates import cascade, clause, compile_clauses, without_periods
from quarry.plans import agent, retrieve
from quarry.sources import html, storage
from quarry.streaming import incremental

VALUES = "doc_id int, kind string, tags array<string>, fiscal_year string, report_label_year string"
ROWS = [(1, "a", ["x"], "2025", "2024"), (2, "b", [], "2024", "2025"), (3, None, None, None, None), (4, "a", ["y", "x"], "2023", "2023")]


@pytest.mark.parametrize(
    ("c", "kw", "want"),
    [
        (clause("kind", "a"), {}, {1, 4}), (clause("kind", ["a", "b"]), {}, {1, 2, 4}), (clause("kind", "a"), {"strict": False}, {1, 3, 4}),
        (clause("kind", "a"), {"relaxed": ["kind"]}, {1, 3, 4}), (clause("kind", "a", include=False), {}, {2, 3}), (clause("kind", "a", include=False), {"strict": False}, {2, 3}),
        (clause("tags", "x"), {}, {1, 4}), (clause("tags", "x"), {"strict": False}, {1, 2, 3, 4}), (clause("tags", ["y"], include=False), {}, {1, 2, 3}),
        (clause("fiscal_year", "2025"), {}, {1, 2}), (clause("fiscal_year", "2025"), {"strict": False}, {1, 2, 3}), (clause("fiscal_year", "2025"), {"relaxed": ["fiscal_year"]}, {1, 3}),
        (clause("fiscal_year", "2025", include=False), {}, {3, 4}), (clause("absent", "v"), {}, set()), (clause("absent", "v"), {"strict": False}, {1, 2, 3, 4}), (clause("absent", "v", include=False), {}, {1, 2, 3, 4}),
    ],
)
def test_clause_truth_table(spark, c, kw, want):
    df = spark.createDataFrame(ROWS, VALUES)
    assert {r.doc_id for r in df.where(compile_clauses(df.schema, [c], **kw)).collect()} == want


def test_cascade_takes_the_strictest_tier(spark):
    df = spark.createDataFrame([(1, "A", "2024", None), (2, "A", "2023", None), (3, "B", "2025", None)], "doc_id int, ticker string, fiscal_year string, report_label_year string")
    year = lambda y: [clause("ticker", "A"), clause("fiscal_year", y)]
    assert {r.doc_id for r in cascade(df, year("2024")).collect()} == {1}
    assert {r.doc_id for r in cascade(df, year("2020")).collect()} == {1, 2}
    assert {(r.doc_id, r.tier) for r in cascade(df, [clause("ticker", "C")]).collect()} == {(1, 4), (2, 4), (3, 4)}
    assert without_periods(year("2020")) == [clause("ticker", "A")]


def test_pushdown_reaches_the_scan(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = o.where(compile_clauses(o.schema, [clause("o_orderstatus", ["F", "O"])], scan=True)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus, [F,O])" in plan
    assert "o_totalprice" not in plan


def test_dense_search_does_not_depend_on_blocks(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    runs = [sorted(map(tuple, search.dense_topk(v.where("id % 20 = 0"), v, 7, block=b).collect())) for b in (3, 17, 4096)]
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_collapse_cases(spark):
    rows = [(1, "s", "a", 1, 10), (1, "s", "b", 2, 30), (1, "s", "a", 3, 10), (1, "s", "c", 4, None), (1, None, "d", 5, 1), (1, "t", "a", 6, 10)]
    df = spark.createDataFrame(rows, "query_id int, item_id string, source string, rank int, fiscal_rank int")
    ranks = lambda **kw: {r["rank"] for r in ranking.collapse(df, ["item_id"], "source", **kw).collect()}
    assert ranks(keep=1) == {1, 3, 5, 6} and ranks(keep=2) == {1, 2, 3, 5, 6} and ranks(keep=0) == {5}
    assert ranks(keep=1, prefer="newest") == {2, 5, 6} and ranks(keep=3, prefer="newest") == {1, 2, 3, 4, 5, 6}


def test_suppress_near_keeps_by_kept_rows(spark):
    n = lambda *xs: [str(x) for x in xs]
    rows = [(1, "s", n(*range(10))), (2, "s", n(*range(5))), (3, "s", n(*range(20))), (4, "s", n(1, 2)), (5, "t", n(*range(5)))]
    out = ranking.suppress_near(spark.createDataFrame(rows, "seq int, source string, nums array<string>"), "nums", "source", "seq")
    assert {r.seq for r in out.collect()} == {1, 3, 4, 5}


def test_fair_select_is_round_robin(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randrange(5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, bucket string, score int")
    for k in (0, 1, 7, 60):
        queues = {b: sorted((r for r in rows if r[1] == b), key=lambda r: (-r[2], r[0])) for b in "abc"}
        want = [q[i][0] for i in range(50) for _, q in sorted(queues.items()) if i < len(q)][:k]
        assert [r.id for r in ranking.fair_select(df, "bucket", k, "score", "id").collect()] == want


def test_cover_needs_two_wanted(spark):
    ranked = spark.createDataFrame([(1, i, t, float(-i)) for i, t in enumerate("AAABBC")], "query_id int, doc_id int, ticker string, score double")
    top = ranked.where("doc_id < 2")
    want = lambda *ts: spark.createDataFrame([(1, t) for t in ts], "query_id int, ticker string")
    got = lambda *ts: {r.doc_id for r in ranking.cover(ranked, top, want(*ts), "ticker").collect()}
    assert got("B") == {0, 1} and got("A", "B") == {0, 1, 3} and got("B", "C", "X") == {0, 1, 3, 5}


def test_ladder_pick_never_substitutes(spark):
    f = spark.createDataFrame([("A", "f1", "10-K", 2024, 5), ("A", "f2", "10-Q", 2025, 1), ("A", "f3", "10-Q", 2024, 3)], "ticker string, source string, kind string, y int, o int")
    f = f.withColumn("fiscal_rank", F.struct(F.col("y").alias("year"), F.col("o").alias("ord")))
    asks = [(1, "A", None, None, 0), (2, "A", "10-Q", None, 1), (3, "A", "10-Q", 2024, 0), (4, "A", None, None, 5), (5, "A", None, None, -1), (6, "Z", None, None, 0), (7, "A", "10-K", 2025, 0)]
    got = {r.request: r.source for r in ranking.ladder_pick(spark.createDataFrame(asks, "request int, ticker string, kind string, year int, nth int"), f).collect()}
    assert got == {1: "f2", 2: "f3", 3: "f3", 4: None, 5: None, 6: None, 7: None}


PAGE = """<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><h1>Head &amp; shoulders</h1><p>One  two</p><div style="display: none">hidden</div>
<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr><tr><td></td></tr></table><p>After<br>break</p><script>no()</script></body></html>"""


def test_html():
    assert html.text_of(PAGE).split("\n")[:2] == ["Head & shoulders", "One two"]
    assert "menu" not in html.text_of(PAGE) and "hidden" not in html.text_of(PAGE) and "no()" not in html.text_of(PAGE)
    assert html.table_markdown(PAGE) == "| a | b/c |\n| --- | --- |\n| 1 |  |"
    assert html.table_markdown("<p>x</p>") is None and html.text_of(None) == "" and html.text_of("<p>open <b>tags") == "open tags"
    long = "word " * 60
    assert html.article_of(f"<article><p>{long}</p></article>") == long.strip() and html.article_of("<p>short</p>") is None
    roles = [r for r, _ in html._read(PAGE).elements]
    assert roles[0] == "Title" and "Table" in roles and "NarrativeText" in roles


def test_recursive_split_covers_everything():
    rng = random.Random(3)
    for _ in range(50):
        t = " ".join("w" * rng.randrange(1, 12) for _ in range(rng.randrange(200))).replace("ww ", "ww. ", 5).replace("www ", "\n\n", 3)
        parts = lines.recursive_split(t, 60, 10)
        assert all(len(p) <= 60 for p in parts) and set(t.split()) <= set(" ".join(parts).split())
    assert lines.recursive_split("", 10, 2) == [] and all(len(p) <= 10 for p in lines.recursive_split("x" * 95, 10, 3))


def test_captions_and_context(spark):
    e = [("Title", "Revenue"), ("Text", "12"), ("Table", "t1"), ("Table", "t2"), ("Text", "note one"), ("Text", "note two"), ("Table", "t3")]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(e)], "id int, pos int, role string, text string")
    assert {r.pos: r.caption for r in lines.captions(df).collect()} == {2: "Revenue", 3: None, 6: "note two"}
    assert {r.pos: r.context for r in lines.table_context(df).collect()} == {2: "Revenue\n12", 3: "", 6: "note one\nnote two"}


def test_sections_by_size_and_headings(spark):
    df = spark.createDataFrame([([("a" * 5, True), ("b" * 5, False), ("c", True), ("d" * 9, True), ("e", True)],)], "e array<struct<text:string,header:boolean>>")
    assert df.select(lines.size_sections(F.col("e"), 10)).first()[0] == [0, 0, 1, 1, 2]
    doc = spark.createDataFrame([(1, "intro\nRevenue Growth\n\nThis is a long line of prose that follows.\nSmall Title\nx")], "doc_id int, text string")
    got = {r.pos: r.heading for r in lines.subheadings(lines.lines_of(doc)).collect()}
    assert got == {0: None, 1: "Revenue Growth", 2: "Revenue Growth", 3: "Revenue Growth", 4: "Revenue Growth", 5: "Revenue Growth"}


def test_snippet(spark):
    df = spark.createDataFrame([("aaaa bbbb cccc dddd revenue eeee ffff gggg", ["revenue"])], "t string, q array<string>")
    r = df.select(text.snippet(F.col("t"), F.col("q"), 16).alias("s"), text.query_terms(F.lit("Revenue 營收成長 a")).alias("q")).first()
    assert "revenue" in r.s and r.s.startswith("…") and r.q == ["revenue", "營收", "收成", "成長"]


def test_text_predicates(spark):
    df = spark.createDataFrame([("src1*",), ("src10",), ("a[b",)], "p string")
    assert [r[0] for r in df.select(text.is_glob(F.col("p"))).collect()] == [True, False, True]
    t = spark.createDataFrame([("| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |",)], "m string").select(text.table_rows(F.col("m")), text.compact_table(F.col("m"))).first()
    assert t[0] == 2 and t[1] == "a | b\n1\n2 | 3"


def test_changed_files_are_processed_once(spark, tmp_path):
    src, state, ckpt = (str(tmp_path / x) for x in ("in", "state", "ckpt"))
    seen = []

    def run(rows, n):
        spark.createDataFrame(rows, "path string, hash string").coalesce(1).write.mode("append").parquet(src)
        q = incremental.process_changed(spark.readStream.schema("path string, hash string").parquet(src), state, lambda df, _: seen.extend((r.path, r.hash) for r in df.collect()), ckpt)
        q.awaitTermination(120)
        assert q.exception() is None and len(seen) == n

    run([("a", "1"), ("b", "1")], 2)
    run([("a", "1"), ("b", "2"), ("c", "1")], 4)
    assert sorted(seen) == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]


def test_budget_outlives_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    for _ in range(2):
        spark.createDataFrame([(k, i) for k in "ab" for i in range(3)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
        stream = incremental.within_budget(spark.readStream.schema("k string, v int").parquet(src), "k", 4)
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(r.k for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert out.count("a") == out.count("b") == 4


def test_replay(spark, tmp_path):
    path = str(tmp_path / "d")
    incremental.record(spark, path, "plan", spark.createDataFrame([("k", "v1")], "key string, value string"))
    incremental.record(spark, path, "plan", spark.createDataFrame([("k", "v2")], "key string, value string"))
    wanted = spark.createDataFrame([Row(kind="plan", key="k"), Row(kind="plan", key="m")])
    decisions = spark.read.parquet(path)
    assert {r.key: r.value for r in incremental.replay(wanted, decisions).collect()} == {"k": "v2", "m": None}
    with pytest.raises(Exception, match="no recorded decision"):
        incremental.replay(wanted, decisions, strict=True).collect()


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, x int")
    p = str(tmp_path / "t")
    storage.write_partitioned(rows, p, "ticker")
    storage.write_partitioned(spark.createDataFrame([("A", 9)], "ticker string, x int"), p, "ticker")
    assert {(r.ticker, r.x) for r in spark.read.parquet(p).collect()} == {("A", 9), ("B", 2)}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("hi")
    (tmp_path / "f" / "b.md").write_text("no")
    assert [r.hash for r in storage.discover(spark, str(tmp_path / "f")).collect()] == ["49f68a5c8493ec2c0bf489821c21fc3b"]
    assert storage.read_records(spark, str(tmp_path / "none.json")) is None


def test_waves_see_what_earlier_ones_found(spark):
    plan = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", 0), (1, 2, "c", 1), (2, 0, "d", None)], "query_id int, id int, task string, depends_on int")

    def execute(ready, found):
        base = ready.select("query_id", "id", "wave", F.col("task").alias("ticker"), F.col("depends_on").alias("of"))
        if found is None:
            return base.select("query_id", "id", "wave", "ticker", F.lit(1).alias("rank"))
        parent = agent.parent_entities(found).withColumnRenamed("id", "of")
        return base.join(parent, ["query_id", "of"]).select("query_id", "id", "wave", F.concat("entity", "ticker").alias("ticker"), F.lit(1).alias("rank"))

    got = {(r.query_id, r.id): (r.wave, r.ticker) for r in agent.run_waves(agent.todos(plan), execute).collect()}
    assert got == {(1, 0): (0, "a"), (1, 1): (1, "ab"), (1, 2): (2, "abc"), (2, 0): (0, "d")}


def test_evidence_text(spark):
    rows = spark.createDataFrame([(1, 2, 7, "f2"), (1, 1, 9, "f1")], "query_id int, rank int, doc_id int, source string")
    corpus = spark.createDataFrame([(7, "seven"), (9, "nine")], "doc_id int, text string")
    assert retrieve.evidence_text(rows, corpus).first().prompt == "[Reference 1: f1, chunk #9]\nnine\n\n[Reference 2: f2, chunk #7]\nseven"
