"""License scan: phrases word by word, and short notices with a bounded number of edits.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece whole. A
version or clause that tells licences apart allows no edits. The pieces are found as exact strings; only around a piece does the ``regex``
library look for the notice with errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents, slices

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices searched with edits, and their labels; what follows the bar tells licences apart and must be exact.
NOTICES = {
    "licensed under the apache license, version |2.0": "apache-2.0",
    "licensed under the apache license, version |1.1": "apache-1.1",
    "licensed under the gnu general public license, version |2": "gpl-2.0",
    "licensed under the gnu general public license, version |3": "gpl-3.0",
    "licensed under the gnu lesser general public license, version |2.1": "lgpl-2.1",
    "licensed under the gnu lesser general public license, version |3": "lgpl-3.0",
    "licensed under the gnu affero general public license, version |3": "agpl-3.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted, free of charge": "mit-notice",
    "licensed under |cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under |cc by-nc-sa 4.0": "cc-by-nc-sa-4.0",
    "licensed under |cc by-nd 4.0": "cc-by-nd-4.0",
    "licensed under |cc by-sa 4.0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution": "cc-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "subject to the terms of the mozilla public license": "mpl-notice",
}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("edits", pa.int32()), ("similarity", pa.float64())]))
_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct(
    [("label", pa.string()), ("word", pa.int64())]))), ("spans", _SPANS)])
SCHEMA = ("doc_id long, n_words long, base array<struct<label:string,word:long>>, "
          "spans array<struct<label:string,start:long,end:long,edits:int,similarity:double>>")


def allowed_edits(notice: str, share: float) -> int:
    return int(len(notice) * share)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of a notice with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeFinder:
    """Finds every notice with at most its number of edits.

    ``|`` in a notice begins its exact part, which holds no edits and isn't followed by more of
    its number. Notices that differ in the exact part alone are sought together.
    """

    def __init__(self, notices: dict[str, str], share: float) -> None:
        import regex

        bodies: dict[str, dict[str, str]] = {}
        for notice, label in notices.items():
            body, _, exact = notice.partition("|")
            bodies.setdefault(body, {})[exact] = label
        self.rules = []
        for body, tails in bodies.items():
            edits = allowed_edits(body, share)
            tail = "|".join(f"({regex.escape(exact)}" + (r"(?!\d|\.\d*[1-9])" if exact[-1:].isdigit() else "") + ")" for exact in tails)
            found = regex.compile(f"(?:{regex.escape(body)}){{e<={edits}}}(?:{tail})", regex.BESTMATCH)
            self.rules.append((body, list(tails.items()), edits, pieces(body, edits), found))

    def seeds(self, raw: bytes) -> bool:
        return any(any(piece.encode() in raw for _, piece in parts) for _, _, _, parts, _ in self.rules)

    def spans(self, text: str) -> list[dict]:
        """Spans in characters; of overlapping spans of a label the one with fewest edits stays."""
        out = []
        for body, tails, edits, parts, pattern in self.rules:
            if not any(exact in text for exact, _ in tails):
                continue
            # every match lies in the window of one of its pieces; what may follow a number is seen as well
            beyond = max(len(exact) for exact, _ in tails) + 8
            windows = set()
            for at, piece in parts:
                i = text.find(piece)
                while i >= 0:
                    windows.add((max(0, i - at - edits), i - at + len(body) + edits + beyond))
                    i = text.find(piece, i + 1)
            found: dict[tuple[int, int], tuple[int, int]] = {}
            left = list(windows)
            while left:
                a, b = left.pop()
                m = pattern.search(text, a, b) if b - a >= len(body) - edits else None
                if m:
                    found[m.span()] = sum(m.fuzzy_counts), m.lastindex - 1
                    # the best match of a window may stand before, between or after others
                    left += [(a, m.start()), (m.end(), b)]
            out += [{"label": tails[n][1], "start": start, "end": end, "edits": wrong, "similarity": 1 - wrong / (len(body) + len(tails[n][0]))}
                    for (start, end), (wrong, n) in found.items()]
        kept: list[dict] = []
        for span in sorted(out, key=lambda s: (s["edits"], s["start"], s["label"], s["end"])):
            if not any(s["label"] == span["label"] and s["start"] < span["end"] and span["start"] < s["end"] for s in kept):
                kept.append(span)
        return sorted(kept, key=lambda s: (s["start"], s["end"], s["label"]))


def phrase_pattern(phrases: dict[str, str]) -> re.Pattern[bytes]:
    word, gap = rb"0-9a-z\x80-\xff", rb"[^0-9a-z\x80-\xff]+"
    body = b"|".join(b"(" + gap.join(re.escape(w.encode()) for w in p.split()) + b")" for p in phrases)
    return re.compile(rb"(?<![" + word + rb"])(?:" + body + rb")(?![" + word + rb"])")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         share: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``base`` (phrase places by word) and ``spans`` of fuzzy notices.

    A-Z is lower-cased; words are runs of digits, a-z and characters beyond ASCII.
    ``share`` is the part of a notice's characters before its exact part (``NOTICES``) that
    may be wrong; spans are in characters of the text. A null or empty text has no words, places or spans;
    repeated rows give repeated results; other columns are ignored.
    """
    phrases, notices = phrases or PHRASES, notices or NOTICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, pattern, labels = NoticeFinder(notices, share), phrase_pattern(phrases), list(phrases.values())
        for batch in batches:
            for part in slices(batch):
                n_words, base, spans = [], [], []
                for text in part.column("text").to_pylist():
                    raw = text.encode().translate(_LOWER)
                    inside = _IS_WORD[np.frombuffer(raw, np.uint8)]
                    starts = inside.copy()
                    starts[1:] &= ~inside[:-1]
                    first = np.flatnonzero(starts)
                    n_words.append(len(first))
                    base.append([{"label": labels[m.lastindex - 1], "word": int(np.searchsorted(first, m.start()))}
                                 for m in pattern.finditer(raw)])
                    spans.append(finder.spans(raw.decode()) if finder.seeds(raw) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(base, _TYPE.field("base").type),
                     pa.array(spans, _SPANS)], schema=_TYPE)

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def joined(labels: Column) -> Column:
    """Distinct labels, sorted, with commas between them."""
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def summary(found: DataFrame) -> DataFrame:
    """One row of figures per document from the places and spans of ``scan``.

    ``score`` is 1 for a phrase found word by word, else the best similarity of a
    notice, else 0.
    """
    base, spans = F.col("base"), F.col("spans")
    words = base["word"]
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], spans["label"])).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(spans["similarity"]), F.lit(0.0))).alias("score"),
        F.size(spans).cast("long").alias("n_spans"))
