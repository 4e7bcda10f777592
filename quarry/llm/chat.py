"""Chat formatting with a grammar round trip.

A turn is written as

    <|im_start|>role\\ntext<|im_end|>\\n

and a conversation is its turns in order. A text may itself hold control strings. Escaping
adds one backslash after the ``<`` of each ``<``, backslashes, ``|``; reading takes one away. So an
escaped text holds no ``<|``, whatever it held before. In a role, ``%``, ``<`` and line breaks
become percent codes.

A turn is first rendered as it is and read back by the grammar; only if what is read
differs from the source, its conflicting parts are escaped and it is rendered again, until
the reading is identical. Most texts stay untouched. Loss is taken on the texts of the
trained roles, given as spans of the formatted turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import importable, width

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_CODES = re.compile(r"%(25|3C|0A|0D)")
_TURN = re.compile(r"<\|im_start\|>([^\n<]*)\n([^<]*(?:<(?!\|)[^<]*)*)<\|im_end\|>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("<", "%3C").replace("\n", "%0A").replace("\r", "%0D")


def unescape_role(role: str) -> str:
    return _CODES.sub(lambda m: {"25": "%", "3C": "<", "0A": "\n", "0D": "\r"}[m[1]], role)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, both unescaped, with the span of the escaped text; what is not of the grammar is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def _read(formatted: str) -> list[tuple[str, str]] | None:
    try:
        return [t[:2] for t in parse(formatted)]
    except ValueError:
        return None


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn and the span of its text. Null role and text are empty."""
    role, text = role or "", text or ""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        made = f"{START}{r}\n{t}{END}\n"
        if _read(made) == [(role, text)]:
            at = len(START) + len(r) + 1
            return made, at, at + len(t)
    raise AssertionError("escaping both always reads back")


def format_turns(turns: DataFrame, train: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_end (code points of ``formatted``; null without loss).

    Rows are rendered each on its own, so no row moves. A conversation is the concatenation of its turns'
    ``formatted`` in order. Null roles and texts are empty; null ids and turn numbers pass through; other
    columns are not read. An empty table gives no rows.
    """
    importable(turns.sparkSession)
    own = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, starts, ends = [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3)):
                formatted, start, end = render(role, text.as_py())
                loss = (role or "") in train
                made.append(formatted)
                starts.append(start if loss else None)
                ends.append(end if loss else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return own.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start int, loss_end int")


@dataclass
class _Reader:
    """What is read back from one conversation's formatted turns, as they come."""

    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    all: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def feed(self, formatted: str, spans: list[tuple[int, int]]) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        for start, end in spans:
            text = unescape(formatted[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "replace"))
        self.chars += len(formatted)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation of ``format_turns``.

    All of it is read from the formatted text and the loss spans, none from the source. Turns are taken by number,
    those without a number first; equal numbers go by text. Rows with a null conv_id are one conversation.
    """
    importable(formatted.sparkSession)
    rows = formatted.repartition(width(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def out(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, done = None, None, []
        tell = lambda: (key, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)
        for b in batches:
            for conv, text, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if reader is None or conv != key:
                    if reader is not None:
                        done.append(tell())
                    key, reader = conv, _Reader()
                reader.feed(text, [] if start is None else [(start, end)])
            if done:
                yield out(done)
                done = []
        if reader is not None:
            yield out([tell()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
