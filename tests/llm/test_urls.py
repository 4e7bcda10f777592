from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


from quarry.llm import url_filter as U
from quarry.llm.queries import RULES, op2_url_filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def shape(path):
    return re.sub(r"[0-9]+", "{n}", re.sub(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9A-Za-z])", "{h}", path))


def rule_of(host, path, rules):
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit) if fit else None


def apart(a, b):
    """Whether two (good, bad) differ by a z-test of two proportions; a is the worse."""
    n, m = sum(a), sum(b)
    both = (a[0] + b[0]) / (n + m)
    error = math.sqrt(both * (1 - both) * (1 / n + 1 / m))
    return error > 0 and b[0] / m - a[0] / n > U.Z * error


def brute(urls, rules, labels=None):
    """Verdicts by a recursive tree over lists of urls."""
    rows = [(*parse(u), i) for i, u in enumerate(urls)]
    fits = [rule_of(h, p, rules) for h, p, _ in rows]
    good = labels if labels is not None else [None if f is None else f[2] == "allow" for f in fits]
    leaf = {}
    count = lambda ids: (sum(good[i] is True for i in ids), sum(good[i] is False for i in ids))
    pure = lambda ids, parent: (count(ids)[0] + U.PRIOR * parent) / (sum(count(ids)) + U.PRIOR)

    def grow(name, ids, purity, d):
        kids = defaultdict(list)
        for i in ids:
            parts = shape(rows[i][1]).split("/", U.DEPTH + 1)
            if d > U.DEPTH + 1 or d >= len(parts):
                leaf[i] = (name, purity)
            else:
                kids[parts[d]].append(i)
        first = defaultdict(list)
        for k, own in kids.items():
            many = len(kids) > U.MAX_CHILDREN and len(own) < U.MIN_SHARE * sum(map(len, kids.values()))
            first["*" if many else k] += own
        known = sorted((k for k in first if sum(count(first[k]))), key=lambda k: (count(first[k])[0] / sum(count(first[k])), k.encode()))
        branches = []
        for k in known:
            if branches and not apart(count(first[branches[-1][-1]]), count(first[k])):
                branches[-1].append(k)
            else:
                branches.append([k])
        named = {"{%d}" % n if len(b) > 1 else b[0]: b for n, b in enumerate(branches)}
        rest = [k for k in first if k not in known]
        for branch, members in [*named.items(), *([("{?}", rest)] if rest else [])]:
            own = [i for k in members for i in first[k]]
            grow(f"{name}/{branch}", own, pure(own, purity), d + 1)

    hosts = defaultdict(list)
    for h, _, i in rows:
        hosts[h].append(i)
    for h, ids in hosts.items():
        grow(h, ids, pure(ids, 0.5), 1)
    for (h, p, i), f in zip(rows, fits):
        name, purity = leaf[i]
        yield i, h, p, f and f[1], f[2] if f else ("block" if purity < U.REJECT else "allow"), name, round(purity, 9)


def as_rows(df):
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in df.collect())


CASES = [None, "", "no scheme", "http://", "HTTP://A.Com", "x://com/", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://example.com/EN/", "http://a.example.com?x=/en/", "https://xnet/es/1", "https://x.net/es/", "https://x.net/es", "http://a://b/c", "http://h/a//b/?q#f", "http://h\n.com/a\nb", "http://é.net/fr/ü", "http://u:p@com:80/", "http://h/" + "s/" * 3000]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "z", "z") for i, u in enumerate(CASES)], "page_id long, url string, host string, verdict string")
    assert as_rows(U.judge(pages, RULES)) == sorted(brute(CASES, RULES))
    assert U.judge(pages.limit(0), RULES).count() == 0


def test_tree_blocks_bad_branches_and_keeps_good_ones(spark):
    rng = random.Random(1)
    urls, labels = [], []
    for _ in range(3000):
        kind = rng.choice(["blog", "news", "spam", "user"])
        tail = f"{kind}/{rng.randrange(1000)}" if kind != "user" else f"user/name{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}{rng.choice('klmnop')}/deadbeef{rng.randrange(100)}"
        urls.append(f"https://h{rng.randrange(3)}.org/{tail}")
        known = rng.random() < 0.3
        labels.append(rng.random() < (0.05 if kind == "spam" else 0.95) if known else None)
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(zip(urls, labels))], "page_id long, url string, good boolean")
    got = as_rows(U.judge(pages, [], label_col="good"))
    assert got == sorted(brute(urls, [], labels))
    for i, _, p, _, v, t, _ in got:
        assert (v == "block") == p.startswith("/spam/")
    assert any("*" in r[5] for r in got)


def test_labelled_branches_bear_on_unlabelled_ones(spark):
    urls = [f"http://bad.org/spam/{i}" for i in range(30)] + [f"http://bad.org/new{c}/1" for c in "abc"] + [f"http://good.org/a/{i}" for i in range(30)] + ["http://good.org/b/1", "http://new.org/b/1"]
    labels = [False] * 30 + [None] * 3 + [True] * 30 + [None] * 2
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(zip(urls, labels))], "page_id long, url string, good boolean")
    got = {r.page_id: r for r in U.judge(pages, [], label_col="good").collect()}
    assert [got[i].verdict for i in (30, 31, 32, 63, 64)] == ["block"] * 3 + ["allow"] * 2
    assert got[64].purity == 0.5 and {got[i].template for i in (30, 31, 32)} == {"bad.org/{?}/{?}"}


def test_a_thousand_rules(spark):
    rng = random.Random(3)
    rules = [(rng.choice(["allow", "block"]), f"h{i % 300}.org" if i % 3 else f"a{i}.h{i % 300}.org", f"/{'x' * (i % 5)}") for i in range(1000)]
    urls = [f"http://{rng.choice(['', 'www.', 'a3.', 'b.a6.'])}h{rng.randrange(320)}.org/{'x' * rng.randrange(6)}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r[:5] for r in as_rows(U.judge(pages, rules))] == [r[:5] for r in sorted(brute(urls, rules))]


def test_op2_by_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    want = sorted((rows[i].page_id, *rest) for i, *rest in brute([r.url for r in rows], RULES))
    assert as_rows(op2_url_filter(spark, d)) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_result_can_be_filtered(spark, sf):
    found = op2_url_filter(spark, f"/root/testdata/{sf}")
    rows = found.collect()
    for c in found.columns:
        one = next((r[c] for r in rows if r[c] is not None), None)
        assert found.where(F.col(c) == F.lit(one)).count() == sum(r[c] == one for r in rows)
        assert found.where(F.col(c).isNull()).count() == sum(r[c] is None for r in rows)
