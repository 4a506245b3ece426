"""Suffix-array dedup of bytes: (position, rank) rows sorted by Spark at growing extents.

Sorting every byte position is out of reach at scale, so only anchors are: in any
window of ``min_bytes`` bytes the gram with the least hash, which depends on the
window's bytes alone, so equal windows have equal anchors. About one position in
36 is an anchor. What is around anchors is then ranked at growing extents:

1. the gram itself and the whole neighbourhood, which holds every window of the
   anchor: an anchor whose gram is unique drops out; where an equal neighbourhood
   starts earlier, all these windows are later copies, and
2. for what is left, groups of ``GROUP`` windows (their common core, then their
   union) and at last
3. single windows.

In each round a position is one plain row with its pair of names (core, extent).
Spark shuffles the rows by core and sorts them by extent and place; neighbours in
this order say which cores are unique and which extents come later, and only rows
of repeated cores are answered. Rows grow with the text. Names are 128-bit hashes
of the strings. Documents are dealt into buckets of bounded size; a bucket sends
a name once, with its first position, so a passage that a third of all documents
share gives one row per bucket. Nothing is staged: a lost executor recomputes its
share.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import tidy
from .words import mix, powers

GROUP, ROUNDS = 8, 3
#: Bytes of text that a task holds.
BUCKET_BYTES = 500_000
_BYTE = np.random.default_rng(40).integers(0, 2**64, 256, dtype=np.uint64)
#: ``place`` is the bucket in the high half; in the low half twice the position, and one more
#: where the bucket holds the name repeatedly. Texts of a bucket are shorter than 2 GB.
_SENT = "core long, extent long, doc long, place long"


class Items:
    """Strings of one round: names of core and extent, and where they are."""

    def __init__(self, core: np.ndarray, extent: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        order = np.lexsort((pos, doc, extent, core))
        core, extent = core[order], extent[order]
        new = np.ones(len(core), bool)
        new[1:] = (core[1:] != core[:-1]) | (extent[1:] != extent[:-1])
        first = np.flatnonzero(new)
        #: for each string its name's number, and whether it is the first in this bucket
        self.name, self.lead = np.empty(len(core), np.int64), np.zeros(len(core), bool)
        self.name[order] = np.cumsum(new) - 1
        self.lead[order[first]] = True
        self.many = np.diff(np.append(first, len(core))) > 1
        self.core, self.extent, self.doc, self.pos = core[first], extent[first], doc[order[first]], pos[order[first]]

    def sent(self, bucket: int) -> pa.Table:
        """One row per name."""
        return pa.table({"core": self.core.view(np.int64), "extent": self.extent.view(np.int64), "doc": self.doc.astype(np.int64),
                         "place": (bucket << 32) + self.pos.astype(np.int64) * 2 + self.many})

    def read(self, answer: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each string: whether its core is repeated, and whether an equal extent starts earlier.

        The answer holds the positions of the names with a repeated core, and whether the extent starts earlier elsewhere.
        """
        pos, later = answer
        order = np.argsort(self.pos)
        at = order[np.searchsorted(self.pos[order], pos)]
        repeated, first = np.zeros(len(self.core), bool), np.ones(len(self.core), bool)
        repeated[at], first[at] = True, ~later
        return repeated[self.name], ~(self.lead & first[self.name])


def ranked(sent: DataFrame, turn: int) -> DataFrame:
    """The names whose core is repeated: 8 times the position, 2 times the round, and 1 if an equal extent starts earlier.

    Of a core the rows are sorted by extent and place; the first of an extent is its earliest.
    """
    order = Window.partitionBy("core").orderBy("extent", "doc", "place")
    before, after = F.lag("extent").over(order), F.lead("extent").over(order)
    low = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    seen = sent.select("place", low.alias("low"), (before.isNotNull() | after.isNotNull() | (low % 2 == 1)).alias("repeated"),
                       before.eqNullSafe(F.col("extent")).cast("long").alias("later"))
    return seen.where("repeated").select(F.shiftright("place", 32).cast("int").alias("bucket"),
                                         (F.shiftright("low", 1) * 8 + F.lit(2 * turn) + F.col("later")).alias("found"))


class Bucket:
    """The documents of a bucket as one run of bytes, and what is known of their windows."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], min_bytes: int) -> None:
        self.size = min_bytes
        self.step = GROUP if min_bytes >= 4 * GROUP else 1
        self.reach = max(self.step, min_bytes * 3 // 4 // self.step * self.step)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.end = self.start + lengths
        self.ids = ids
        n = len(self.bytes)
        up, self.down = powers(n)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:n], out=self.total[1:])
        self.later = np.zeros(n, bool)

    def _poly(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.total[at + length] - self.total[at]) * self.down[at]

    def name(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix(self._poly(at, length) + np.uint64(length))

    def second(self, at: np.ndarray, length: int) -> np.ndarray:
        """A name that doesn't follow from ``name``: both halves, mixed one after the other."""
        half = length // 2
        return mix(mix(self._poly(at, half)) * np.uint64(3) + self._poly(at + half, length - half))

    def _apart(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names that no other place has."""
        return mix(mix(self.ids[k].astype(np.uint64)) + at.astype(np.uint64))

    def _mark(self, first: np.ndarray, last: np.ndarray) -> None:
        """Windows that start from ``first`` to ``last`` are later copies."""
        edge = np.zeros(len(self.bytes) + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, last + 1, -1)
        self.later |= np.cumsum(edge)[:-1] > 0

    def _anchors(self) -> None:
        """Anchors with their document and the first and last window that each stands for."""
        gram, n = self.size - self.reach + 1, len(self.bytes)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(self.start, self.end - self.size + 1), 1)
        np.add.at(edge, self.end, -1)
        inside = np.cumsum(edge)[:-1] == 0
        found = []
        for a in range(0, n - self.size + 1, 1 << 18):
            windows = min(1 << 18, n - self.size + 1 - a)
            b = a + windows + self.reach - 1
            grams = mix((self.total[a + gram: b + gram] - self.total[a:b]) * self.down[a:b] + np.uint64(gram))
            key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(0xFFFFFFFF, 0xFFFFFFFF - (b - a), -1, dtype=np.uint64)
            width = 1
            while 2 * width <= self.reach:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if width < self.reach:
                key = np.minimum(key[:windows], key[self.reach - width:][:windows])
            at = np.flatnonzero(inside[a: a + windows])
            anchor = (np.uint64(0xFFFFFFFF) - (key[at] & np.uint64(0xFFFFFFFF))).astype(np.int64)
            change = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(at) else at
            found.append(np.stack([anchor[change], at[change], at[np.append(change[1:], len(at)) - 1] if len(at) else at]) + a)
        anchor, first, last = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        # an anchor that two blocks have met is one
        change = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        self.anchor, self.first = anchor[change], first[change]
        self.last = last[np.append(change[1:], len(anchor)) - 1] if len(anchor) else last
        self.doc = np.searchsorted(self.start, self.first, side="right") - 1

    def rounds(self) -> Generator[Items, tuple[np.ndarray, np.ndarray], None]:
        """Yields what each round sends and takes what comes back."""
        size, reach, step = self.size, self.reach, self.step
        self._anchors()
        p, k, first, last = self.anchor, self.doc, self.first, self.last
        whole = (p - reach + 1 >= self.start[k]) & (p + size <= self.end[k])
        # a neighbourhood that leaves the document equals no other
        extent = self._apart(k, p)
        extent[whole] = self.second(p[whole] - reach + 1, reach - 1 + size)
        items = Items(self.name(p, size - reach + 1), extent, self.ids[k], p)
        repeated, later = items.read((yield items))
        later &= whole
        self._mark(p[later] - reach + 1, p[later])
        left = repeated & ~later
        p, k, first, last = p[left], k[left], first[left], last[left]

        # groups of windows that start from p - step * g - step + 1 to p - step * g
        low, high = (p - last) // step, (p - first) // step
        many = high - low + 1
        row = np.repeat(np.arange(len(p)), many)
        g = np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        end = p[row] - step * g
        begin = end - step + 1
        open_ = self._open(np.maximum(begin, first[row]), np.minimum(end, last[row]))
        row, begin, end = row[open_], begin[open_], end[open_]
        k, first, last = k[row], first[row], last[row]
        whole = (begin >= self.start[k]) & (end + size <= self.end[k])
        # the core lies inside every window of the group
        extent = self._apart(k, end)
        extent[whole] = self.second(begin[whole], size + step - 1)
        items = Items(self.name(end, size - step + 1), extent, self.ids[k], end)
        repeated, later = items.read((yield items))
        later &= whole
        self._mark(begin[later], end[later])
        keep = repeated & ~later
        inner_from, inner_to, k = np.maximum(begin, first)[keep], np.minimum(end, last)[keep], k[keep]
        many = inner_to - inner_from + 1
        row = np.repeat(np.arange(len(k)), many)
        start = np.repeat(inner_from, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        row, start = row[~self.later[start]], start[~self.later[start]]
        items = Items(self.name(start, size), self.second(start, size), self.ids[k[row]], start)
        _, later = items.read((yield items))
        self._mark(start[later], start[later])

    def _open(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a window from ``first`` to ``last`` isn't known to be a later copy."""
        known = np.concatenate([[0], np.cumsum(self.later)])
        return known[last + 1] - known[first] < last - first + 1

    def result(self) -> tuple[list[bytes], list[list[dict]]]:
        """What is left of each document, and the removed spans by their places in it."""
        edge = np.zeros(len(self.bytes) + 1, np.int32)
        starts = np.flatnonzero(self.later)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.size, -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept, spans = [], []
        for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True):
            mine = gone[a:b]
            if not mine.any():
                kept.append(self.bytes[a:b].tobytes())
                spans.append([])
                continue
            flips = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            kept.append(self.bytes[a:b][~mine].tobytes())
            spans.append([{"start": x, "end": y} for x, y in flips.reshape(-1, 2).tolist()])
        return kept, spans


def _free(name: str, columns: list[str]) -> str:
    """``name``, longer where there is such a column."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _compressed(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        raw = pa.array([None if x is None else pack(x.encode()) for x in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([raw if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def _restored(table: pa.Table, text_col: str) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    texts = pa.array([None if x is None else unpack(x).decode() for x in table[text_col].to_pylist()], pa.string())
    return table.set_column(table.schema.get_field_index(text_col), text_col, texts)


def _without_repeats(docs: DataFrame, min_bytes: int, bucket_bytes: int, id_col: str, text_col: str,
                     told: Callable[[pa.Table, list[bytes], list[list[dict]]], pa.Table], schema: T.StructType) -> DataFrame:
    """What ``told`` makes of the documents of each bucket, what is left of them and their removed spans."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    number = _free("__bucket", docs.columns)
    # texts are shuffled compressed
    narrow = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text_col else f for f in docs.schema.fields])
    dealt = (docs.mapInArrow(tidy(lambda batches: _compressed(batches, text_col)), narrow)
             .withColumn(number, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(buckets)).cast("int")))

    def advance(table: pa.Table, replies: pa.Table | None, turn: int) -> tuple[pa.Table, Bucket, Items | None]:
        """The bucket after ``turn`` answered rounds, and what the next one sends."""
        table = _restored(table, text_col)
        sorted_by = pa.table({"id": pc.fill_null(table[id_col].cast(pa.int64()), -(2**63)), "text": pc.fill_null(table[text_col], "")})
        order = pc.sort_indices(sorted_by, sort_keys=[("id", "ascending"), ("text", "ascending")])
        table, sorted_by = table.take(order), sorted_by.take(order)
        bucket = Bucket(sorted_by["id"].to_numpy(), [t.encode() for t in sorted_by["text"].to_pylist()], min_bytes)
        run = bucket.rounds()
        items: Items | None = next(run)
        if turn:
            found = replies["found"].to_numpy()
        for done in range(turn):
            mine = found[found >> 1 & 3 == done]
            try:
                items = run.send((mine >> 3, mine & 1 > 0))
            except StopIteration:
                items = None
        return table, bucket, items

    def send(table: pa.Table, replies: pa.Table | None, turn: int) -> pa.Table:
        if not table.num_rows:
            return Items(*(np.zeros(0, np.uint64) for _ in range(4))).sent(0)
        return advance(table, replies, turn)[2].sent(table[number][0].as_py())

    def first_sender():
        return lambda table: send(table, None, 0)

    def sender(turn: int):
        return lambda table, replies: send(table, replies, turn)

    answered = None
    for turn in range(ROUNDS):
        grouped = dealt.groupBy(number)
        if answered is None:
            sent = grouped.applyInArrow(first_sender(), _SENT)
        else:
            sent = grouped.cogroup(answered.groupBy("bucket")).applyInArrow(sender(turn), _SENT)
        # shuffled by bucket here, so that later rounds read the answers and don't sort anew
        reply = ranked(sent, turn).repartition("bucket")
        answered = reply if answered is None else answered.unionByName(reply)

    names = docs.columns

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, bucket, _ = advance(table, replies, ROUNDS)
        return told(table.select(names), *bucket.result())

    return dealt.groupBy(number).cogroup(answered.groupBy("bucket")).applyInArrow(finish, schema)


def remove_repeats(docs: DataFrame, min_bytes: int = 100, bucket_bytes: int = BUCKET_BYTES,
                   id_col: str = "doc_id", text_col: str = "text", kept: str = "__kept", spans: str = "__spans") -> DataFrame:
    """``docs`` with ``kept`` (bytes) and ``spans`` (start, end in bytes): every byte goes that a
    string of ``min_bytes`` bytes covers which also starts earlier.

    Texts are UTF-8 bytes; earlier is a smaller id, or the same document and an
    earlier start; strings are judged on the input, overlaps count, and no string
    crosses documents. Null texts are empty. A null id comes before all others;
    rows that repeat an id are ordered by their text, rows that are the same are
    copies of each other. All other columns are kept, but for those named as the
    two new ones. A document needs some 40 times its bytes of memory in one task.
    ``bucket_bytes`` sets how much a task holds.
    """
    docs = docs.drop(kept, spans)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def told(table: pa.Table, left: list[bytes], gone: list[list[dict]]) -> pa.Table:
        return table.append_column(kept, pa.array(left, pa.binary())).append_column(spans, pa.array(gone, span_type))

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField(kept, T.BinaryType()),
                           T.StructField(spans, T.ArrayType(span))])
    return _without_repeats(docs, min_bytes, bucket_bytes, id_col, text_col, told, schema)


def drop_repeats(docs: DataFrame, min_bytes: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same rows and columns and texts without what ``remove_repeats`` removes.

    Where a removed span begins or ends inside a character, the rest of that
    character goes as well. A null text stays null.
    """

    def told(table: pa.Table, left: list[bytes], gone: list[list[dict]]) -> pa.Table:
        at = table.schema.get_field_index(text_col)
        texts = [kept.decode(errors="ignore") if spans else text for text, kept, spans in zip(table[at].to_pylist(), left, gone, strict=True)]
        return table.set_column(at, text_col, pa.array(texts, pa.string()))

    # in the task that finds the spans: an operator of its own would double the Python processes of executors
    return _without_repeats(docs, min_bytes, BUCKET_BYTES, id_col, text_col, told, docs.schema)
