"""Packing documents into sequences of a fixed length by minimum bin slack.

Documents become token ids and are cut at every full sequence; what is left over
has a length below the capacity. Pieces are dealt into buckets of bounded size by
a hash. In a bucket, a window is opened with the longest piece left, and a bitset
subset-sum over the multiset of remaining lengths finds the filling closest to
the capacity; walking the bitsets back gives how many pieces of each length to
take. The same filling is used as often as its lengths last.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked_bpe import ChunkCoder, rank_encoding
from .frames import documents, slices, staged, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Chunks whose merges by ranks are the tokenizer's own.
_LATIN = re.compile(r"[\n -~\u00c0-\u024f]*")
_TYPE = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many pieces of each length come closest to the capacity without exceeding it.

    ``lengths`` are the keys of ``counts``, in order. Bit n of a bitset says that
    the lengths looked at so far can sum to n.
    """
    reach, goal, everything, trail = 1, 1 << capacity, (2 << capacity) - 1, []
    for i in range(bisect.bisect_right(lengths, capacity) - 1, -1, -1):
        if reach & goal:
            break
        length = lengths[i]
        trail.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << take * length) & everything
            left, step = left - take, step * 2
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until no piece is left."""
    counts, lengths = dict(counts), sorted(counts)
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        chosen = Counter(fill(counts, lengths if counts[longest] else lengths[:-1], capacity - longest))
        counts[longest] += 1
        chosen[longest] += 1
        times = min(counts[length] // n for length, n in chosen.items())
        yield dict(chosen), times
        for length, n in chosen.items():
            counts[length] -= n * times
            if not counts[length]:
                lengths.pop(bisect.bisect_left(lengths, length))


def pack_lengths(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces of one length are taken in their order."""
    order = np.argsort(length, kind="stable")
    values, first, n = np.unique(length[order], return_index=True, return_counts=True)
    free = dict(zip(values.tolist(), first.tolist(), strict=True))
    window, offset, done = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0
    for chosen, times in windows(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity):
        at = 0
        for size in sorted(chosen, reverse=True):
            rows = order[free[size]: free[size] + chosen[size] * times]
            free[size] += len(rows)
            window[rows] = done + np.arange(len(rows)) // chosen[size]
            offset[rows] = at + np.arange(len(rows)) % chosen[size] * size
            at += size * chosen[size]
        done += times
    return window, offset


def special_tokens(tokenizer_path: str) -> list[str]:
    """Strings that a tokenizer file takes as one token wherever they stand."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return [token["content"] for token in json.load(file).get("added_tokens", [])]


def _coders(tokenizer_path: str, rank_path: str):
    """A coder, and the tokenizer for what it leaves, read when it is first needed; they end with their task."""
    import public_tokenizers

    @functools.cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer_path)

    merge = rank_encoding(rank_path, public_tokenizers.PATTERN).encode_ordinary

    def encode(chunk: str) -> list[int]:
        return merge(chunk) if _LATIN.fullmatch(chunk) else whole().encode(chunk, add_special_tokens=False).ids

    return ChunkCoder(encode), whole


def pieces(docs: DataFrame, tokenizer_path: str, rank_path: str, capacity: int, end_id: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut at every full sequence: places, lengths and checksums.

    ``rank_path`` holds the vocabulary of ``tokenizer_path`` as ranks; chunks of
    letters of the Latin blocks are merged by them, all others by the tokenizer
    itself, as are texts that contain one of its special tokens.
    """

    special = special_tokens(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, whole = _coders(tokenizer_path, rank_path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    marked = any(token in text for token in special)
                    ids = np.array(whole().encode(text, add_special_tokens=False).ids, "<u4") if marked else coder.ids(text)
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    rows += [(doc_id, a, min(capacity, n - a), zlib.crc32(raw[4 * a: 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_TYPE)

    return documents(docs, id_col, text_col).mapInArrow(tidy(run), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, rank_path: str, capacity: int = 2048, end_id: int = 1, per_bucket: int = 32_768,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; offsets have no gaps.

    A null or empty text is one piece that holds ``end_id`` alone. Repeated rows
    are packed once each; a null id stays null; other columns are ignored.
    """
    found = staged(pieces(docs, tokenizer_path, rank_path, capacity, end_id, id_col, text_col), "packing-pieces")
    n = max(1, -(-found.count() // per_bucket))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        window, offset = pack_lengths(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=window * n + frame["bucket"], offset=offset).drop(columns="bucket")

    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(n))
    return found.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, PACKED)
