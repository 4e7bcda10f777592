"""Substring dedup by paragraph MinHash banding.

Texts are words: A-Z lower-cased, separated by ASCII white space. Two kinds of paragraphs are banded, so
that neither lines nor what stands around a passage decide whether it is found:

* **Blocks** cover each text without overlap and are compared by similarity. A line of ``MIN_WORDS`` to ``LONG`` words is a block;
  stretches of shorter and longer lines are cut, whatever their lines, where the hash of the next few words is the least of ``MIN_WORDS`` words on either
  side. Blocks have MinHash values of their five-word shingles, in as many bands of ``jaccard.ROWS`` as find a pair of the wanted
  similarity with probability ``jaccard.RECALL``; of the blocks that share a band, the exact Jaccard similarity decides, and components of the links are the classes.
* **Runs** of ``RUN`` words find passages of ``WINDOW`` words or more that are equal, wherever they start. Of each window of ``WINDOW`` words the MinHash of one row over its
  runs of ``RUN`` words, the least hash, says which run stands for it; neighbouring windows share it, so it is about 9 % of all runs.
  Equal windows have an equal run. Runs are known by 95 bits, and equal ones are a class.

The first occurrence of a class by (doc_id, place) stays, the others are removed. Equal runs that touch join to one passage; of a longer passage at most
``WINDOW - RUN`` words stay at either end, six on average.

No group is gathered: crowded bands are cut into pieces that meet in twos (``jaccard``), copies of blocks are one node, runs are counted by
partial aggregation, and occurrences only join their class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import jaccard, words
from quarry.llm.scratch import importable, release, stored

MIN_WORDS, LONG, MARK = 30, 120, 3
WINDOW, RUN = 50, 30
_CHUNK = 1 << 20


def _texts(bodies: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Several encoded texts as one, with the byte offsets at which its words begin and end, and the text of each word."""
    whole = b"\n".join(bodies)
    first, last = words.bounds(whole)
    starts = np.cumsum([0] + [len(x) + 1 for x in bodies[:-1]])
    return whole, first, last, np.searchsorted(starts, first, "right") - 1


def blocks(h: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the blocks of texts whose words follow each other; no line is in two texts."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(first, n))
    whole = (size >= MIN_WORDS) & (size <= LONG)
    cut = np.zeros(n + 1, bool)
    g = words.runs(h, MARK)
    reach = 2 * MIN_WORDS + 1
    if len(g) >= reach:
        at = words.least(g, reach)
        low = np.flatnonzero(at == np.arange(len(at)) + MIN_WORDS)
        cut[low[doc[low] == doc[low + reach + MARK - 2]] + MIN_WORDS] = True
    cut[:-1] &= ~np.repeat(whole, size)
    cut[first[whole]] = cut[(first + size)[whole]] = cut[0] = cut[n] = True
    cut[1:n] |= doc[1:] != doc[:-1]
    places = np.flatnonzero(cut)
    sizes = np.diff(places)
    enough = sizes >= MIN_WORDS
    return places[:-1][enough], sizes[enough]


def runs(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """First words of the runs that are the least of some window within a text."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    return np.unique(words.least(words.runs(h, RUN), WINDOW - RUN + 1)[doc[: len(h) - WINDOW + 1] == doc[WINDOW - 1 :]])


def _offsets(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)


def _scan(n_bands: int):
    """A row for each block, with its node, bands and words, and one for the runs of each text, of which one that an equal one goes before in the text is marked."""

    def made(rows: pa.RecordBatch, keep: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        whole, first, last, doc = _texts(bodies)
        h, n, start = words.hashes(whole, first, last), len(bodies), _offsets(doc, len(bodies))
        at, size = blocks(h, doc, np.searchsorted(np.flatnonzero(np.frombuffer(whole, np.uint8) == 10), first))
        own = [b" ".join(whole[a:e].split()) for a, e in zip(first[at].tolist(), last[at + size - 1].tolist())]
        found = jaccard.bands_of(words.runs(h, jaccard.SHINGLE), at, at + size - jaccard.SHINGLE + 1, n_bands)
        starts = runs(h, doc)
        x, y = (words.runs(h, RUN, base)[starts] if len(starts) else np.zeros(0, np.uint64) for base in words.BASES)
        y, row = y >> np.uint64(33), doc[starts]
        order = np.lexsort((starts, y, x, row))
        same = (row[order[1:]] == row[order[:-1]]) & (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
        again = np.zeros(len(starts), bool)
        again[order[1:]] = same
        texts = np.flatnonzero(np.bincount(row, minlength=n))
        per_run = np.concatenate([np.zeros(len(at) + 1, np.int32), np.cumsum(np.bincount(row, minlength=n)[texts])]).astype(np.int32)
        empty, owner = len(texts), pa.array(np.asarray(keep, np.int32)[np.concatenate([doc[at], texts])])
        padded = lambda values, kind: pa.chunked_array([pa.array(values, kind), pa.nulls(empty, kind)]).combine_chunks()
        nothing = pa.array(np.concatenate([np.ones(len(at), bool), np.zeros(empty, bool)]))
        listed = lambda values: pa.ListArray.from_arrays(pa.array(per_run), pa.array(values), mask=nothing)
        by_band = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * n_bands).astype(np.int32)), pa.array(found.reshape(-1)))
        here = starts - start[row]
        cols = [
            rows.column(0).take(owner), rows.column(1).take(owner), padded(at - start[doc[at]], pa.int32()), padded(size, pa.int32()),
            padded([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.concat_arrays([by_band, pa.nulls(empty, by_band.type)]), padded([x.decode() for x in own], pa.string()),
            listed(np.where(again, -1 - here, here).astype(np.int32)), listed(x.view(np.int64)), listed(y.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc", "key", "at", "size", "node", "bands", "body", "run_at", "xs", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, bodies, held = [], [], 0
            for i, text in enumerate(b.column(2)):
                body = words.encoded(text.as_py())
                if len(body) < 2 * MIN_WORDS - 1:
                    continue
                keep.append(i)
                bodies.append(body)
                held += len(body)
                if held > _CHUNK:
                    yield made(b, keep, bodies)
                    keep, bodies, held = [], [], 0
            if keep:
                yield made(b, keep, bodies)

    return run


def key_of(text: Column) -> Column:
    """With the id this names a row; rows that repeat both are alike in everything that is found."""
    return F.xxhash64(text)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), key_of(text).alias("key"), text.alias("text")).where("doc is not null")


def _scanned(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    importable(docs.sparkSession)
    schema = "doc long, key long, at int, size int, node binary, bands array<long>, body string, run_at array<int>, xs array<long>, ys array<int>"
    found = _rows(docs, id_col, text_col).mapInArrow(_scan(jaccard.banding(similar)), schema)
    return stored(found.withColumn("id", F.monotonically_increasing_id()), "substring-rows")


def _order(at: str) -> Column:
    """Occurrences by (doc, place) as a decimal, which fits the buffers of hash aggregation."""
    return ((F.col("doc").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)")).cast("decimal(38,0)") + F.col(at)).cast("decimal(38,0)")


def _block_classes(found: DataFrame, similar: float) -> DataFrame:
    """(doc, key, at, size, component_id, keep_id, class_size, removed) of the blocks that have a duplicate. A class is known by its smallest block."""
    each = found.where("node is not null")
    banded = each.select(F.explode("bands").alias("band"), "id")
    part = jaccard.classes(each.select("id", "node", (8 * F.col("size")).alias("size"), "body"), _starred(banded), similar)
    members = stored(each.select("id", "doc", "key", "at", "size").join(part, "id"), "substring-members")
    heads = members.groupBy("component").agg(F.count("*").alias("class_size"), F.min(_order("at")).alias("first")).where("class_size > 1")
    keep = F.expr(f"(first - pmod(first, {2**31})) div {2**31}")
    out = members.join(heads, "component").select("doc", "key", "at", "size", F.col("component").alias("component_id"), keep.alias("keep_id"), "class_size", (_order("at") != F.col("first")).alias("removed"))
    release(*part._reads)
    out._reads = [members]
    return out


def _starred(banded: DataFrame) -> DataFrame:
    """Edges (u, v) from the members of each band to its first one."""
    first = banded.groupBy("band").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return banded.join(first, "band").where("id <> v").select(F.col("id").alias("u"), "v")


def _run_classes(found: DataFrame) -> DataFrame:
    """(doc, key, s, x, keep_id, removed) of all runs that occur more than once."""
    each = found.where("run_at is not null").select("doc", "key", F.explode(F.arrays_zip("run_at", "xs", "ys")).alias("r")).select("doc", "key", F.col("r.run_at").alias("at"), F.col("r.xs").alias("x"), F.col("r.ys").alias("y"))
    counted = each.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("doc").alias("keep_id")).where("n > 1").drop("n")
    least = stored(counted, "substring-least")
    # A negative place marks a run that its own text has before.
    at = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    out = each.join(least.hint("shuffle_hash"), ["x", "y"]).select("doc", "key", at.alias("s"), "x", "keep_id", ((F.col("at") < 0) | (F.col("doc") != F.col("keep_id"))).alias("removed"))
    out._reads = [least]
    return out


def _joined(s: np.ndarray, x: np.ndarray, keep: np.ndarray, gone: np.ndarray) -> Iterator[tuple]:
    """(kind, first word, words, class, keep_id, removed) of the passages that runs in order make, those that stay and those that go apart, each named by its first run."""
    for removed in (False, True):
        i = np.flatnonzero(gone == removed)
        if len(i):
            opens = np.flatnonzero(np.concatenate([[True], s[i[1:]] > s[i[:-1]] + RUN]))
            ends = np.append(opens[1:], len(i)) - 1
            for a, e in zip(i[opens], i[ends]):
                yield "passage", int(s[a]), int(s[e] - s[a]) + RUN, int(x[a]), int(keep[a]), removed


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = jaccard.SIMILAR) -> DataFrame:
    """One row per repeated paragraph: doc_id, kind, number, size, start, end, component_id, keep_id, removed.

    ``kind`` is "block" (similar to others of its class) or "passage" (equal runs that touch, those that stay and those that go
    apart). ``number`` and ``size`` count words, start and end are code points in the text. Of a class the
    occurrence with the smallest (doc_id, number) stays; ``keep_id`` is its document. A passage has the class and keep_id of its first
    run. Paragraphs that repeat within one document count as well.

    Null, empty and short texts have no paragraphs. Rows with a null doc_id take no part. Rows that repeat an id and the text are one document, given
    as often as it is there; rows that repeat an id with other texts are told apart, but what they share stays in both. Texts of any length are read whole.
    Ties cannot occur within a text. Other columns are not read. An empty table gives no rows.
    """
    found = _scanned(docs, id_col, text_col, similar)
    blocks_of = _block_classes(found, similar)
    runs_of = _run_classes(found)
    fields = ("at", "size", "component_id", "keep_id", "removed")
    gathered = lambda rows, prefix: rows.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("w")).select("doc", "key", *[F.col("w")[c].alias(prefix + c) for c in fields])  # noqa: E731  # of one text
    same = runs_of.select("doc", "key", F.col("s").alias("at"), F.lit(RUN).alias("size"), F.col("x").alias("component_id"), "keep_id", "removed")
    per_block, per_run = gathered(blocks_of, ""), gathered(same, "run_")
    both = stored(per_block.join(per_run, ["doc", "key"], "full"), "substring-found")
    release(found, *blocks_of._reads, *runs_of._reads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                array = lambda c, i, part=part: part.column(c)[i].values.to_numpy(zero_copy_only=False)
                for i, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    rows = []
                    if part.column(2)[i].is_valid:
                        rows += zip(repeat("block"), *(array(c, i).tolist() for c in range(2, 7)))
                    if part.column(7)[i].is_valid:
                        rows += _joined(*(array(c, i) for c in (7, 9, 10, 11)))
                    raw = words.encoded(text)
                    first, last = words.bounds(raw)
                    number = np.array([r[1] for r in rows])
                    spans = words.code_points(raw, first[number], last[number + np.array([r[2] for r in rows]) - 1])
                    out += [(doc, *r[:3], *span, *r[3:]) for r, span in zip(rows, spans)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "kind", "number", "size", "start", "end", "component_id", "keep_id", "removed"])

    joined = _rows(docs, id_col, text_col).join(both.hint("shuffle_hash"), ["doc", "key"]).select("doc", "text", *fields, *[f"run_{c}" for c in fields])
    return joined.mapInArrow(run, "doc_id long, kind string, number int, size int, start int, end int, component_id long, keep_id long, removed boolean")


def _without(text: str, at: np.ndarray, size: np.ndarray) -> str:
    """The text without runs of words (first word, number of words) and one white space after each that doesn't go on."""
    raw = words.encoded(text)
    first, last = words.bounds(raw)
    edge = np.zeros(len(first) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    opens, closes = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    out, here = [], 0
    for start, end in words.code_points(raw, first[opens], last[closes - 1]):
        out.append(text[here:start])
        here = end + 1 if text[end : end + 1].isspace() else end
    return "".join([*out, text[here:]])


def cleaned_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", similar: float = jaccard.SIMILAR) -> DataFrame:
    """``docs`` without the paragraphs that repeat one kept elsewhere; its columns, ``size_col`` counted anew.

    What goes are the removed blocks and passages of ``classes``, with one white space after each. Rows are known by id and text, so a row
    loses only what was found in its own text. Documents that lose nothing are as they
    were; documents of which nothing but white space is left are left out. Rows with a null id are kept whole, as are those with null, empty
    or short texts; rows that repeat id and text lose the same. An empty table gives no rows.
    """
    found = _scanned(docs, id_col, text_col, similar)
    blocks_of = _block_classes(found, similar)
    gone = stored(blocks_of.where("removed").select("doc", "key", "at", "size"), "substring-blocks-gone")
    release(*blocks_of._reads)
    runs_of = _run_classes(found)
    more = runs_of.where("removed").select("doc", "key", F.col("s").alias("at"), F.lit(RUN).alias("size"))
    spans = stored(gone.unionByName(more).groupBy("doc", "key").agg(F.collect_list(F.struct("at", "size")).alias("w")), "substring-gone")  # of one text
    release(found, gone, *runs_of._reads)
    spans = spans.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), F.col("w.at").alias("_at"), F.col("w.size").alias("_size"))
    same = (F.col(f"`{id_col}`").cast("long") == F.col("_doc")) & (key_of(F.col(f"`{text_col}`")) == F.col("_key"))
    names = docs.columns
    place, size = names.index(text_col), names.index(size_col) if size_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols, (starts, sizes) = list(part.columns[:-2]), part.columns[-2:]
                texts = cols[place].to_pylist()
                cut = [starts[i].is_valid and t is not None for i, t in enumerate(texts)]
                new = [_without(t, starts[i].values.to_numpy(), sizes[i].values.to_numpy()) if c else t for i, (c, t) in enumerate(zip(cut, texts))]
                cols[place] = pa.array(new, cols[place].type)
                if size is not None:
                    cols[size] = pa.array([len(t) if c else o for o, t, c in zip(cols[size].to_pylist(), new, cut)], cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array([not c or bool(t.strip()) for t, c in zip(new, cut)], pa.bool_()))

    joined = docs.join(spans.hint("shuffle_hash"), same, "left").select(*[F.col(f"`{c}`") for c in names], "_at", "_size")
    return joined.mapInArrow(run, docs.schema)
