"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are runs of byte classes (letters, capitals, digits, each mark by itself),
hashed words, the share of distinct words and the length. A bounded sample of
labelled documents gives term weights and the latent directions; every document
is then compared with every vector of the sample in blocks, and its nearest
neighbours vote with a power of their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents, slices
from .words import word_hashes

SHAPES, WORDS, STEPS = 512, 1024, 20
TERMS = SHAPES + WORDS + 2 * STEPS
_CLASS = np.array([1 if c >= 128 or 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else c + 4
                   for c in range(256)], np.uint32)
_VECTORS = pa.schema([("doc_id", pa.int64()), ("terms", pa.binary())])


def terms(texts: list[str]) -> np.ndarray:
    """Term counts of whole texts: a row per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    hashes, at = word_hashes(texts)
    for row, text, a, b in zip(out, texts, at[:-1], at[1:], strict=True):
        kind = _CLASS[np.frombuffer(text.encode(), np.uint8)]
        kind = kind[np.concatenate([[True], kind[1:] != kind[:-1]])] if len(kind) else kind
        if len(kind) >= 3:
            shape = ((kind[:-2] * np.uint32(65599) + kind[1:-1]) * np.uint32(65599) + kind[2:]) * np.uint32(2654435761)
            row[:SHAPES] = np.bincount(shape >> np.uint32(23), minlength=SHAPES)
        n = b - a
        if n:
            words = hashes[a:b]
            row[SHAPES: SHAPES + WORDS] = np.bincount((words & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS)
            row[SHAPES + WORDS + min(STEPS - 1, STEPS * len(np.unique(words)) // n)] = n
            row[SHAPES + WORDS + STEPS + min(STEPS - 1, int(n).bit_length() - 1)] = n
    return out


class LatentVotes:
    """Term weights, latent directions and labelled vectors of a sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, directions: int, neighbours: int, power: float) -> None:
        self.labels, self.neighbours, self.power = labels.astype(np.float32), min(neighbours, len(labels)), power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
        weighted = self._weighted(counts)
        self.axes = np.linalg.eigh(weighted.T @ weighted)[1][:, -directions:].astype(np.float32)
        self.known = self.vectors(counts)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        value = np.log1p(counts) * self.weight
        return value / np.maximum(np.linalg.norm(value, axis=1, keepdims=True), 1e-9)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        latent = self._weighted(counts) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        for i in range(0, len(counts) if self.neighbours else 0, block):
            near = self.vectors(counts[i: i + block]) @ self.known.T
            ids = np.argpartition(near, len(self.labels) - self.neighbours, axis=1)[:, -self.neighbours:]
            vote = np.maximum(np.take_along_axis(near, ids, 1), 0).astype(np.float64) ** self.power
            total = vote.sum(axis=1)
            mean = (vote * self.labels[ids]).sum(axis=1) / np.where(total > 0, total, 1)
            out[i: i + block] = np.where(total > 0, mean, self.prior)
        return np.clip(out, 0, 1)


def labelled_sample(labels: DataFrame, label: str, learn: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` ids with their label, the same ones in every run; ids labelled twice count once."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
    return rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = 4000,
                  directions: int = 64, neighbours: int = 31, power: float = 4.0, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every document.

    ``learn`` is a condition on ``doc_id`` that says whose labels may be learnt
    from; at most ``sample`` of them are. Texts are read whole. Empty or null
    texts and texts that resemble no labelled one score the sample's mean label;
    without any label every score is 0.5. Repeated rows are scored alike.
    """
    texts = documents(docs, id_col, text_col)
    chosen = labelled_sample(labels, label, learn, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [row.tobytes() for row in terms(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], schema=_VECTORS)

    # ``chosen`` has at most ``sample`` rows, and as many vectors come to the driver.
    picked = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(count, "doc_id long, terms binary")
    picked = picked.groupBy("doc_id").agg(F.min("terms").alias("terms")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()
    counts = np.frombuffer(b"".join(picked.column("terms").to_pylist()), np.float32).reshape(-1, TERMS)
    model = docs.sparkSession.sparkContext.broadcast(
        LatentVotes(counts, picked.column("label").to_numpy(), directions, neighbours, power))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1_000_000):
                score = model.value.score(terms(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return texts.mapInArrow(vote, "doc_id long, score double")
