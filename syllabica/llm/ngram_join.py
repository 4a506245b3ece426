"""N-gram Jaccard join by MinHash bands, verified on the full n-gram sets.

Documents with equal sets are one class of copies and are compared once. Ids
that share a band are gathered into candidate families; only members of a family
travel with their sets, once for each pair of bounded blocks of the family, and
candidate pairs are verified block against block. No pair leaves a task: what
comes out is each member's number of links and a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import documents, slices, staged, tidy
from .words import mix, word_hashes

_SIGNED = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("root", pa.int64()), ("doc_id", pa.int64()), ("blocks", pa.int64()), ("grams", pa.binary())])


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """The (bands, rows) with the most rows a band that find a pair at the threshold with ``recall``.

    Among more rows fewer chance candidates are met; ``most`` bounds bands x rows.
    """
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no number of bands reaches this recall")


def gram_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's word n-grams; a shorter text is one n-gram of all its words."""
    hashes, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled = mix(rolled + hashes[k: k + len(rolled)] + np.uint64(k + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(rolled[a: b - n + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short + hashes[k: k + 1])
            yield short
        else:
            yield rolled[:0]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash values of a set, hashed band by band."""
    rng = np.random.default_rng(5)
    flip = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)[:, None]
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[None, i: i + 4096] ^ flip) * factor).min(axis=1))
    least = mix(least).reshape(bands, rows)
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = mix(out + least[:, r])
    return out.view(np.int64)


def verified(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, bands: int, rows: int,
             width: int = 4096) -> np.ndarray:
    """Which pairs share a band and reach the threshold; ``right`` None: pairs within ``left``, above the diagonal."""
    every = left + (right or [])
    signs = np.stack([band_hashes(g, bands, rows) for g in every])
    m = len(left)
    other = signs if right is None else signs[m:]
    near = np.zeros((m, len(other)), bool)
    for k in range(bands):
        near |= signs[:m, k][:, None] == other[:, k][None]
    if right is None:
        near &= np.triu(np.ones_like(near), 1)
    use = np.zeros(len(every), bool)
    use[:m] = near.any(axis=1)
    use[0 if right is None else m:][: len(other)] |= near.any(axis=0)
    chosen = np.flatnonzero(use)
    if not len(chosen):
        return near
    size = np.array([len(g) for g in every])
    owner = np.repeat(chosen, size[chosen])
    _, gram, n = np.unique(np.concatenate([every[i] for i in chosen]), return_inverse=True, return_counts=True)
    keep = n[gram] > 1
    owner, (_, gram) = owner[keep], np.unique(gram[keep], return_inverse=True)
    common = np.zeros(near.shape, np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        a, b = np.searchsorted(gram, [first, first + width])
        holds = np.zeros((len(every), width), np.float32)
        holds[owner[a:b], gram[a:b] - first] = 1
        common += holds[:m] @ (holds if right is None else holds[m:]).T
    total = size[:m][:, None] + (size if right is None else size[m:])[None] - common
    return near & (common >= threshold * total - 1e-6)


def forest(ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each member of a linked group to the group's first."""
    root = np.arange(len(ids))
    a, b = np.nonzero(pairs)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def similar(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, per_block: int = 256,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, copy_id, n_links`` of every document.

    ``class_id`` is the smallest id of all documents connected by links,
    ``copy_id`` the smallest with the same n-gram set, and ``n_links`` counts the
    other sets whose Jaccard similarity is at least ``threshold``, among those a
    shared band finds: a pair at the threshold is found with probability
    ``recall``, a closer one more surely. Words are lower-cased. Texts with fewer
    than n words are one n-gram; texts without words, and rows without an id, link
    to nothing. Rows that repeat an id are compared as they stand under that id.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = documents(docs, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, signs = [], []
                for grams in gram_sets(part.column("text").to_pylist(), n):
                    keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                    signs.append(band_hashes(grams, bands, rows) if len(grams) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()),
                                                  pa.array(signs, pa.list_(pa.int64()))], schema=_SIGNED)

    signed = staged(texts.mapInArrow(tidy(sign), "doc_id long, set_key binary, bands array<long>"), "ngram-signed")
    copies = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("copy_id"), F.any_value("bands").alias("bands"))
    placed = copies.select("copy_id", F.posexplode("bands").alias("band", "value"))
    hubs = placed.groupBy("band", "value").agg(F.min("copy_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    families = staged(components(placed.join(hubs, ["band", "value"]).select("copy_id", "hub"), "copy_id", "hub"), "ngram-families")
    sizes = families.groupBy("root").agg(F.ceil(F.count("*") / per_block).alias("blocks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams = [g.tobytes() for g in gram_sets(part.column("text").to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("doc_id"), part.column("blocks"),
                                                  pa.array(grams, pa.binary())], schema=_SETS)

    # families grow with the documents: merged at every size, never broadcast
    families = families.join(sizes, "root").withColumnRenamed("id", "doc_id")
    members = (texts.join(families.hint("merge"), "doc_id")
               .select("root", "doc_id", "blocks", "text")
               .mapInArrow(tidy(sets), "root long, doc_id long, blocks long, grams binary")
               .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
               .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with")).drop("with", "blocks"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", ignore_index=True)
        grams = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        ids, first = frame["doc_id"].to_numpy(), (frame["own"] == frame["low"]).to_numpy()
        within = bool((frame["low"] == frame["high"]).all())
        a = np.flatnonzero(first)
        b = a if within else np.flatnonzero(~first)
        pairs = np.zeros((len(ids), len(ids)), bool)
        if len(a) and len(b):
            other = None if within else [grams[i] for i in b]
            pairs[np.ix_(a, b)] = verified([grams[i] for i in a], other, threshold, bands, rows)
        pairs &= ids[:, None] != ids[None]
        links = pairs.sum(axis=0) + pairs.sum(axis=1)
        linked = np.flatnonzero(links)
        x, y = forest(ids, pairs)
        return pd.concat([pd.DataFrame({"a": ids[linked], "b": pd.NA, "n": links[linked]}),
                          pd.DataFrame({"a": x, "b": y, "n": 0})]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    compared = staged(members.groupBy("root", "low", "high").applyInPandas(compare, "a long, b long, n long"), "ngram-links")
    links = compared.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "copy_id")
    joined = components(compared.where("b IS NOT NULL"))
    classes = joined.join(joined.groupBy("root").agg(F.min("id").alias("class_id")), "root").select(F.col("id").alias("copy_id"), "class_id")
    own = signed.select("doc_id", "set_key").join(copies.select("set_key", "copy_id"), "set_key", "left")
    copy = F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_id", "doc_id"))
    return (own.select("doc_id", copy.alias("copy_id")).join(classes, "copy_id", "left").join(links, "copy_id", "left")
            .select("doc_id", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id",
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))
