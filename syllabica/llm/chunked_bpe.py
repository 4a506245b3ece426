"""Encoding texts chunk by chunk between boundaries that no token match crosses.

A single space between two non-space characters is such a boundary: in the
public split pattern a letter, number or punctuation run ends before it and the
next one takes it as its first character. Chunks repeat, so their ids are
remembered, for a bounded number of chunks.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
#: White space of the first 256 code points, besides the space and the line feed.
_ODD_SPACE = [bytes([c]) for c in (9, 11, 12, 13, 28, 29, 30, 31, 133, 160)]


def segments(text: str) -> tuple[str, list[str]]:
    """The chunk before the first safe boundary, and the others without their leading space."""
    try:
        raw = text.encode("latin-1")
        plain = not (b"  " in raw or b" \n" in raw or b"\n " in raw or raw[:1] == b" " or raw[-1:] == b" "
                     or any(c in raw for c in _ODD_SPACE))
    except UnicodeEncodeError:
        plain = False
    if plain:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _BOUNDARY.split(text)
    return first, [chunk[1:] for chunk in rest]


class ChunkCoder(dict):
    """Token ids of chunks, as 32-bit bytes, by the chunk without its leading space."""

    def __init__(self, encode: Callable[[str], Iterable[int]], keep: int = 200_000, longest: int = 40) -> None:
        super().__init__()
        self.encode, self.keep, self.longest = encode, keep, longest

    def __missing__(self, chunk: str) -> bytes:
        ids = self._bytes(" " + chunk)
        if len(chunk) <= self.longest and len(self) < self.keep:
            self[chunk] = ids
        return ids

    def _bytes(self, chunk: str) -> bytes:
        return array("I", self.encode(chunk)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, by its whole length."""
        if len(self) >= self.keep:
            self.clear()
        first, rest = segments(text)
        return np.frombuffer(b"".join([self._bytes(first), *map(self.__getitem__, rest)]), np.uint32)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_encoding(path: str, pattern: str):
    """The encoding of a rank file without special tokens."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def rank_coder(path: str, pattern: str) -> ChunkCoder:
    """A coder by a rank file. It ends with its task: a worker keeps no memory of it."""
    return ChunkCoder(rank_encoding(path, pattern).encode_ordinary)
