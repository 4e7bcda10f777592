from __future__ import annotations

import hashlib
import random
import struct
import zlib

import public_tokenizers as vocab
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bpe, packing
from quarry.llm.queries import op9_byte_bpe, op10_packing

RANKS = vocab.path("byte_bpe_multi_50k.tiktoken")
JSON = vocab.path("byte_bpe_50k.json")
LETTERS = list("ab  \n\t'stre.,12²½ªº_éßñ漢字🙂  \u0085\x1c\x00|<>") + ["<|endoftext|>", "'ll", " the"]


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        return bpe.encoder(f.read(), vocab.PATTERN)


@pytest.fixture(scope="module")
def other(enc):
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_encode_equals_the_library(enc, other):
    rng = random.Random(2)
    for _ in range(2000):
        s = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        ids = enc.encode(s)
        assert ids == other.encode_ordinary(s), s
        assert enc.decode(ids) == s.encode()
    long = "ab" * 20000 + "a" * 30001 + "!?" * 9000
    assert enc.encode(long) == other.encode_ordinary(long)
    assert not enc.queue.top and not enc.queue.buckets
    assert enc.encode(None) == enc.encode("") == []


def test_forgetting_changes_nothing(enc, other):
    small = bpe.Encoder(enc.ranks, vocab.PATTERN, memo=3)
    for s in ["one two three four five", "six seven one", "one two three four five"]:
        assert small.encode(s) == other.encode_ordinary(s)


def test_queue_order():
    q, rng, want = bpe.RankQueue(50256), random.Random(1), []
    for _ in range(500):
        item = (rng.randrange(50257), rng.randrange(99))
        q.push(*item)
        want.append(item)
    assert [q.pop() for _ in want] == sorted(want) and not q.top


def test_encode_and_decode_frames(spark, other):
    rows = [(1, "Hello wörld\n", "x"), (2, None, None), (None, "", "y"), (1, "Hello wörld\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = bpe.encode(docs, RANKS, vocab.PATTERN)
    assert sorted(map(str, ((r.doc_id, r.ids) for r in made.collect()))) == sorted(map(str, ((d, other.encode_ordinary(t or "")) for d, t, _ in rows)))
    back = bpe.decode(made, RANKS, vocab.PATTERN).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(docs.limit(0), RANKS, vocab.PATTERN).count() == 0


def test_op9_by_brute_force(spark, other):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op9_byte_bpe(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, g = other.encode_ordinary(r.text or ""), got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 6143])
def test_pieces(n):
    got = packing.pieces(n, 2048)
    assert [s for s, _ in got] == [sum(k for _, k in got[:i]) for i in range(len(got))]
    assert sum(k for _, k in got) == n and all(k & (k - 1) == 0 and k <= 2048 for _, k in got)
    rest = [k for _, k in got if k < 2048]
    assert rest == sorted(set(rest), reverse=True)


def test_pieces_of_split_equal_whole_texts():
    with open(JSON, encoding="utf-8") as f:
        t = packing._tokens(f.read(), vocab.PATTERN)
    assert t._split
    rng = random.Random(4)
    for _ in range(1500):
        s = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        assert t([s])[0] == t._ids([s])[0], s


def check_packed(rows, docs):
    tok = Tokenizer.from_file(JSON)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by.pop(d), key=lambda r: r.start)
        at = 0
        for p in parts:
            assert (p.start, p.offset, p.doc_tokens) == (at, 0, len(ids)) and p.length & (p.length - 1) == 0
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert not by


def test_op10_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    check_packed(op10_packing(spark, d).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


TRAP = "a <|endoftext|>b <|endoftext|><|endoftext |> é"


def test_pack_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b", 3), (3, "x " * 9000, 4), (4, TRAP, 5)], "doc_id long, text string, start long")
    rows = packing.pack(docs, JSON, vocab.PATTERN).collect()
    check_packed(rows, [(1, None), (2, ""), (None, "a b"), (3, "x " * 9000), (4, TRAP)])
    assert all(len(r.ids) == r.length for r in rows)
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted(r.length for r in rows)
    assert packing.pack(docs.limit(0), JSON, vocab.PATTERN).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, JSON, vocab.PATTERN, longest=1000)
