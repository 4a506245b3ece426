"""Texts cut into their top-level JSON values, good and bad ones apart.

A file may hold one object, an array of objects, an object per line, or
pretty-printed objects one after the other; it may be broken in the middle. Values are
read one after the other, braces inside strings included; behind a value that
can't be read the next line that opens one at the same indent or less is tried.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PIECES = "ruta string, n int, texto string, bueno boolean"
_KINDS = {"ruta": pa.string(), "n": pa.int32(), "texto": pa.string(), "bueno": pa.bool_()}
#: Values that are handed over at a time, and characters of them.
MOST_VALUES, MOST_CHARS = 10_000, 4_000_000
_BLANK = re.compile(r"[\s\ufeff]*")
_OPENING = re.compile(r"^([ \t]*)[{\[]", re.MULTILINE)


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_constant)


def _read(text: str, at: int) -> tuple[object, int] | None:
    try:
        return _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None


def _elements(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
    """The elements of an array that was read whole."""
    at += 1
    while True:
        at = _BLANK.match(text, at).end()
        if at >= end or text[at] == "]":
            return
        if text[at] == ",":
            at += 1
            continue
        value, stop = _read(text, at)
        yield text[at:stop], isinstance(value, dict)
        at = stop


def _next_opening(text: str, after: int, indent: int) -> int:
    """Where the next line opens a value at most ``indent`` deep, or the end."""
    line = text.find("\n", after)
    while line >= 0:
        m = _OPENING.search(text, line + 1)
        if not m:
            break
        if len(m[1]) <= indent:
            return m.start()
        line = text.find("\n", m.end())
    return len(text)


def values(text: str) -> Iterator[tuple[str, bool]]:
    """Each top-level object, or object of a top-level array, as written, with True; all other text with False.

    Text is bad that no value can be read from, a value that is no object included. Blank texts hold nothing.
    """
    at = _BLANK.match(text).end()
    while at < len(text):
        found = _read(text, at) if text[at] in "{[" else None
        if found is None:
            line = text.rfind("\n", 0, at) + 1
            # behind other values on its line, a bad text has the indent of that line
            indent = len(text[line:at]) if not text[line:at].strip() else len(text[line:]) - len(text[line:].lstrip(" \t"))
            stop = _next_opening(text, at, indent)
            yield text[at:stop].rstrip(), False
        elif text[at] == "[":
            stop = found[1]
            yield from _elements(text, at, stop)
        else:
            stop = found[1]
            yield text[at:stop], True
        at = _BLANK.match(text, stop).end()


def _batch(found: list[tuple[str, int, str, bool]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], names=list(_KINDS))


def cut_up(files: DataFrame) -> DataFrame:
    """(ruta, n, texto, bueno) of (value, ruta): the values of each text, numbered from 0. Works on streams too.

    One text at a time is held beside the batch it came in, and of its values those that go out together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for text, path in zip(batch.column(0), batch.column(1), strict=True):
                path = path.as_py()
                for n, (value, good) in enumerate(values(text.as_py() or "")):
                    found.append((path, n, value, good))
                    size += len(value)
                    if len(found) == MOST_VALUES or size >= MOST_CHARS:
                        yield _batch(found)
                        found, size = [], 0
            if found:
                yield _batch(found)

    return files.select("value", "ruta").mapInArrow(run, PIECES)
