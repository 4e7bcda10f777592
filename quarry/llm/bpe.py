"""Byte-level BPE with a hierarchical-bitmap rank queue.

The merge with the lowest rank comes next, the leftmost first. Pairs wait in one bucket
per rank, which holds positions of the piece's linked list. A bitmap of two levels says
which buckets have entries: find-first-set on the upper word gives the lower word, and
on that the rank. Merging leaves the entries of vanished pairs behind; they are skipped
when they come up. A piece of n bytes takes O(n) bucket operations, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pretokens import Splitter
from quarry.llm.scratch import importable

_BIT = [1 << i for i in range(256)]


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's leftmost position."""

    def __init__(self, ranks: int):
        self.top = 0
        self.words = [0] * ((ranks >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        high = rank >> 8
        if not self.words[high]:
            self.top |= 1 << high
        self.words[high] |= _BIT[rank & 255]

    def pop(self) -> tuple[int, int]:
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        low = word & -word
        rank = high << 8 | low.bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[high] = word = word ^ low
            if not word:
                self.top ^= 1 << high
        return rank, at


class _Memo(dict):
    """Ids of pieces, found when first met; forgets all when ``most`` are held."""

    def __init__(self, find, most: int):
        super().__init__()
        self._find, self._most = find, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self._most:
            self.clear()
        self[piece] = found = self._find(piece.encode("utf-8"))
        return found


class Encoder:
    """Encoding by a table of ranks (token bytes -> id), and decoding.

    ``memo`` pieces are remembered at most, to bound a worker's memory; forgetting
    changes no result.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 1_000_000):
        self.ranks = ranks
        self.split = Splitter(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.queue = RankQueue(max(ranks.values(), default=0))
        self._memo = _Memo(self.piece, memo)

    def piece(self, b: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        get, queue = self.ranks.get, self.queue
        whole = get(b)
        if whole is not None:
            return (whole,)
        n = len(b)
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        push, pop = queue.push, queue.pop
        for i in range(n - 1):
            r = get(b[i : i + 2])
            if r is not None:
                rank_at[i] = r
                push(r, i)
        while queue.top:
            r, i = pop()
            if rank_at[i] != r:
                continue  # its pair has gone
            j = after[i]
            after[i] = k = after[j]
            rank_at[i] = rank_at[j] = -1
            if k < n:
                before[k] = i
                r = get(b[i : after[k]])
                if r is not None:
                    rank_at[i] = r
                    push(r, i)
            p = before[i]
            if p >= 0:
                r = get(b[p:k])
                rank_at[p] = -1 if r is None else r
                if r is not None:
                    push(r, p)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[b[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is empty."""
        return list(chain.from_iterable(map(self._memo.__getitem__, self.split(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; an id outside the table is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(table: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file's content; kept by the worker process across tasks."""
    key = (hashlib.md5(table).hexdigest(), pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def _mapped(docs: DataFrame, path: str, id_col: str, col: str, work, schema: str, pattern: str) -> DataFrame:
    importable(docs.sparkSession)
    with open(path, "rb") as f:  # the size of a vocabulary, whatever the input
        table = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(table.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield work(enc, b.slice(at, 512))

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{col}`").alias("value")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``.

    Whole texts; a null text is empty and has no ids. Null and repeated doc_ids pass
    through, other columns are not read. An empty table gives no rows. ``path`` is a rank
    file on the driver; its content is sent to the executors.
    """

    def work(enc: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [enc.encode(x.as_py()) for x in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _mapped(docs, path, id_col, text_col, work, "doc_id long, ids array<int>", pattern)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary) from ids; null ids give no bytes."""

    def work(enc: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        out = [enc.decode(x.as_py() or []) for x in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return _mapped(encoded, path, id_col, ids_col, work, "doc_id long, bytes binary", pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` and then ``decode`` give, as digests."""

    def work(enc: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, made, read = [], [], []
        for x in b.column(1):
            ids = enc.encode(x.as_py())
            sizes.append(len(ids))
            made.append(hashlib.sha256(",".join(map(enc.names.__getitem__, ids)).encode()).hexdigest())
            read.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.string()), pa.array(read, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, path, id_col, text_col, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pattern)
