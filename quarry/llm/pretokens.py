"""Splitting text into the pieces that byte-level BPE encodes separately."""

from __future__ import annotations

import re

import regex

#: The standard library's classes agree with the Unicode properties on these characters.
_PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-ɏ]*").fullmatch


class Splitter:
    """``split(text)``: the matches of ``pattern``, in order.

    Patterns in terms of \\p{L} and \\p{N} are slow in the Unicode engine; texts of
    common characters go through an equivalent pattern of the standard engine.
    """

    def __init__(self, pattern: str):
        self._full = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._fast = re.compile(plain).findall if r"\p" not in plain else None

    def __call__(self, text: str) -> list[str]:
        if self._fast and _PLAIN(text):
            return self._fast(text)
        return self._full(text)
