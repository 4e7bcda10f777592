from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import jaccard, words
from quarry.llm import substring_dedup as S
from quarry.llm.queries import op3_substring_dedup

F = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode("utf-8", "replace").lower().split()


def slow_blocks(text):
    """(first word, number of words): the rule of the module, word by word."""
    own, lines = [], []
    for i, line in enumerate((text or "").split("\n")):
        own += words_of(line)
        lines += [i] * len(words_of(line))
    n = len(own)
    g = [int(x) for x in words.runs(words.of(b" ".join(own)), S.MARK)] if n >= S.MARK else []
    whole = {i for i in set(lines) if S.MIN_WORDS <= lines.count(i) <= S.LONG}
    cuts = {0, n}
    for p in range(n):
        if lines[p] in whole and (p == 0 or lines[p - 1] != lines[p]):
            cuts |= {p, p + lines.count(lines[p])}
        r = S.MIN_WORDS
        if lines[p] not in whole and r <= p < len(g) - r and all(g[q] > g[p] for q in range(p - r, p)) and all(g[q] >= g[p] for q in range(p + 1, p + r + 1)):
            cuts.add(p)
    cuts = sorted(cuts)
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b - a >= S.MIN_WORDS]


def brute_blocks(rows, similar=0.8):
    """(doc_id, place, size, keep_id, removed) of repeated blocks, by comparing all pairs."""
    occ = []
    for d, t in rows:
        own = words_of(t)
        if d is not None:
            occ += [(d, a, n, {tuple(own[i : i + 5]) for i in range(a, a + n - 4)}) for a, n in slow_blocks(t)]
    parent = list(range(len(occ)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(occ):
        for j in range(i):
            shared = len(a[3] & occ[j][3])
            if shared >= similar * (len(a[3]) + len(occ[j][3]) - shared) - 1e-9:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, o in enumerate(occ):
        groups[root(i)].append(o[:3])
    return sorted((d, a, n, min(g)[0], (d, a) != min(g)[:2]) for g in groups.values() if len(g) > 1 for d, a, n in g)


def brute_runs(rows, size, places):
    """[(doc_id, place, not the first)] of the runs of ``size`` words at ``places(words)`` that occur more than once."""
    seen = defaultdict(list)
    for d, t in rows:
        if d is not None:
            own = words_of(t)
            for i in places(own):
                seen[tuple(own[i : i + size])].append((d, i))
    return [(d, i, k > 0) for v in seen.values() if len(v) > 1 for k, (d, i) in enumerate(sorted(v))]


def assert_equal(found, rows):
    found, text = found.collect(), dict(rows)
    blocks = [r for r in found if r.kind == "block"]
    assert sorted((r.doc_id, r.number, r.size, r.keep_id, r.removed) for r in blocks) == brute_blocks(rows)
    parts = defaultdict(set)
    for r in blocks:
        parts[r.component_id].add((r.keep_id))
    assert all(len(k) == 1 for k in parts.values())
    covered = [{(r.doc_id, r.number + i) for r in found if r.kind == "passage" and r.removed is gone for i in range(r.size)} for gone in (True, False)]
    h = lambda own: words.of(b" ".join(own))
    runs = brute_runs(rows, S.RUN, lambda own: S.runs(h(own), np.zeros(len(own), int)).tolist())
    assert covered == [{(d, i + k) for d, i, later in runs if later is gone for k in range(S.RUN)} for gone in (True, False)]
    # Every window of WINDOW words that repeats has such a run within it.
    starts = defaultdict(set)
    for d, i, _ in runs:
        starts[d].add(i)
    for d, i, _ in brute_runs(rows, S.WINDOW, lambda own: range(len(own) - S.WINDOW + 1)):
        assert starts[d] & set(range(i, i + S.WINDOW - S.RUN + 1))
    for r in found:
        assert words_of(text[r.doc_id][r.start : r.end]) == words_of(text[r.doc_id])[r.number : r.number + r.size]
        assert not text[r.doc_id][r.start].isspace() and not text[r.doc_id][r.end - 1].isspace()


def table(seed):
    """Lines of all lengths, copied whole, with changes, inside other lines and wrapped."""
    rng = random.Random(seed)
    vocabulary = [f"wé{i}" for i in range(2000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [say(rng.randrange(25, 140)) for _ in range(8)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            kind, line = rng.random(), say(rng.randrange(1, 90))
            if kind < 0.3:
                line = list(rng.choice(shared))
                for _ in range(rng.randrange(0, 5)):
                    line[rng.randrange(len(line))] = rng.choice(vocabulary)
            elif kind < 0.5:
                line = say(rng.randrange(60)) + rng.choice(shared) + say(rng.randrange(150))
            elif kind < 0.6:
                part = rng.choice(shared)
                lines += [" ".join(part[i : i + 9]) for i in range(0, len(part), 9)]
            lines.append(rng.choice([" ", "  "]).join(line))
        rows.append((d, rng.choice(["\n", "\n\n"]).join(lines)))
    return rows


@pytest.mark.parametrize("chunk", [jaccard.CHUNK, 3])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    line = " ".join(f"w{i}" for i in range(55))
    rows = table(1) + [(100, None), (101, ""), (102, "\n\n"), (None, line), (103, line), (104, "the " * 300), (105, line + "\n" + line)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, nodes string")
    assert_equal(S.classes(docs), rows)
    assert S.classes(docs.limit(0)).count() == 0


def test_op3_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{F}/documents.parquet").collect()]
    assert_equal(op3_substring_dedup(spark, F), rows)


def test_bands_follow_the_similarity():
    for similar in (0.5, 0.7, 0.8, 0.95):
        n = jaccard.banding(similar)
        missed = (1 - similar**jaccard.ROWS) ** n
        assert missed <= 1 - jaccard.RECALL < (1 - similar**jaccard.ROWS) ** (n - 1)


@pytest.mark.parametrize("seed", range(3))
def test_passages_inside_a_line_and_over_short_lines(spark, seed):
    """A passage of 50 words loses its copies but for a few words at their ends; a run of 29 words is none."""
    rng = random.Random(seed)
    say = lambda n: " ".join(f"wé{rng.randrange(9999)}" for _ in range(n))
    one = say(50)
    wrapped = "\n".join(" ".join(one.split()[i : i + 7]) for i in range(0, 50, 7))
    a, b, c, d, e, f = (say(80) for _ in range(6))
    short = " ".join(one.split()[:29])
    rows = [(1, f"{a} {one} {b}", 0), (2, f"{c} {one.upper().replace('É', 'é')} {d}", 0), (3, f"{e}\n{wrapped}\n{f}", 0), (4, f"{say(9)} {short}", 7), (None, one, 8), (5, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in S.cleaned_rows(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert {k: got[k] for k in (1, 4, None, 5)} == {1: (rows[0][1], 0), 4: rows[3][1:], None: (one, 8), 5: (None, None)}
    for k, before, after in ((2, c, d), (3, e, f)):
        text, n = got[k]
        left = words_of(text)
        assert n == len(text) and left[:80] == words_of(before) and left[-80:] == words_of(after)
        assert len(left) - 160 <= 2 * (S.WINDOW - S.RUN) and not text.startswith(" ")


def test_cleaned_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "other")
    rows = [(1, f"head\n{long}\ntail", 9), (2, f"{long}\nonly here", None), (3, long, 1), (4, None, None), (5, "", 0), (6, f"a\n\n{near}", 7), (None, long, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.cleaned_rows(docs).collect()}
    assert got == {1: (rows[0][1], 9), 2: ("only here", 9), 4: (None, None), 5: ("", 0), 6: ("a\n\n", 3), None: (long, 8)}
    assert S.cleaned_rows(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(4))
    docs = spark.createDataFrame([(1, a), (2, f"{b}\n{a}\ny"), (2, f"{c} {d}"), (2, f"{c} {d}")], "doc_id long, text string")
    assert sorted(r.text for r in S.cleaned_rows(docs).collect()) == sorted([a, f"{b}\ny", f"{c} {d}", f"{c} {d}"])
