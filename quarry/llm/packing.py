"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many full-length pieces as fit and the powers of
two in the binary form of the rest. Pieces of equal length share a bucket, from which
batches of equal shape are drawn; each piece is a sequence of its own, so no sequence
crosses documents and none needs padding. No row depends on another: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pretokens import Splitter
from quarry.llm.scratch import importable

MEMO = 400_000
#: Bits of a sequence id: bucket, partition, place in the partition.
_PARTITION_BITS, _PLACE_BITS = 21, 37


class _Memo(dict):
    """Ids of pieces, asked for when first met; forgets all when ``MEMO`` are held, to bound a worker's memory."""

    def __init__(self, ask):
        super().__init__()
        self._ask = ask

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = found = self._ask(piece)
        return found


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte: itself if it prints, else the next free one from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return {b: chr(b if b in prints else next(free)) for b in range(256)}


class Tokens:
    """Token ids of texts by a tokenizers file, as little-endian uint32 bytes.

    A byte-level tokenizer encodes each piece of its split on its own, so the library's model
    is asked for a piece once. Tokenizers of other kinds, and texts in which an added token is written out, are left to the library whole.
    """

    def __init__(self, table: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(table)
        said = json.loads(table)
        pre = said.get("pre_tokenizer") or {}
        alone = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not said.get("normalizer")
        self._split = Splitter(pattern) if alone else None
        added = [re.escape(x["content"]) for x in said.get("added_tokens") or []]
        self._added = re.compile("|".join(added)).search if added else lambda text: None
        letters, model = _byte_letters(), self._tok.model
        self._memo = _Memo(lambda p: np.array([t.id for t in model.tokenize(p.encode("utf-8").decode("latin-1").translate(letters))], "<u4").tobytes())

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self._split is None:
            return self._ids(texts)
        of, split, added = self._memo.__getitem__, self._split, self._added
        return [self._ids([t])[0] if added(t) else b"".join(map(of, split(t))) for t in texts]


_TOKENS: dict[str, Tokens] = {}


def _tokens(table: str, pattern: str) -> Tokens:
    key = hashlib.md5((pattern + table).encode()).hexdigest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(table, pattern)
    return _TOKENS[key]


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens, longest first."""
    out = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at = len(out) * longest
    for bit in reversed(range((n - at).bit_length())):
        if (n - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 1, longest: int = 2048, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<int>].

    Every document ends with ``end_id``, so an empty or null text gives one piece of one
    token; a document of any length is encoded whole. ``longest`` must be a power of two. ``sequence_id`` is unique and sorts by bucket (its top
    bits are log2 of the length), so a bucket is a range of ids; ``offset`` is always 0,
    and no padding is ever needed. Null and repeated doc_ids are documents like any
    other; other columns are not read. An empty table gives no rows. ``path`` is a tokenizers
    file on the driver, whose content is sent to the executors.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    importable(spark)
    with open(path, encoding="utf-8") as f:  # the size of a vocabulary, whatever the input
        table = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(table.value, pattern)
        place = TaskContext.get().partitionId() << _PLACE_BITS
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                doc, rows, bodies = [], [], []
                for i, body in enumerate(tokens([x or "" for x in b.column(1).to_pylist()])):
                    body += end
                    n = len(body) // 4
                    for start, length in pieces(n, longest):
                        part = body[4 * start : 4 * (start + length)]
                        doc.append(i)
                        rows.append((start, length, zlib.crc32(part), n, (length.bit_length() - 1) << (_PARTITION_BITS + _PLACE_BITS) | place, 0))
                        bodies.append(part)
                        place += 1
                cols = [b.column(0).take(pa.array(doc, pa.int32()))] + [pa.array(c) for c in np.array(rows, np.int64).reshape(-1, 6).T]
                if with_ids:
                    flat = np.frombuffer(b"".join(bodies), "<i4")
                    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in bodies])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
