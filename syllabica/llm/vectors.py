"""Vectors for searches by shards: which take part, and how shards meet the queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``vec`` (doubles) and ``dim`` of the vectors that take part.

    Null and empty vectors, vectors holding null or non-finite components and
    rows without an id take no part; other columns are ignored.
    """
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"))
            .where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.coalesce(finite, F.lit(False)))
            .withColumn("dim", F.size("vec")))


def searched(rows: DataFrame, is_query: Column, k: int, per_shard: int, per_block: int,
             build: Callable[[np.ndarray, np.ndarray], object], score: str) -> DataFrame:
    """``query_id, vec_id, score`` (of type ``score``): what ``build(ids, vectors)`` of each shard finds for each query.

    A shard is indexed once and then reads all queries, ``per_block`` at a time. It
    has ``per_shard`` rows on average, however many rows there are. Rows are dealt by a
    hash of id and vector, so a hot id spreads out. Of equal rows ``k`` are kept: more
    can't be among the ``k`` best. A shard holds vectors of one length.
    """
    rows = (rows.groupBy("id", "vec", "dim").agg(F.count("*").alias("n"))
            .withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k))))))
    n_shards = max(1, -(-rows.count() // per_shard))
    shard = F.pmod(F.xxhash64("id", "vec"), F.lit(n_shards)).cast("int")
    candidates = rows.select("id", "vec", "dim", shard.alias("shard"), F.lit(False).alias("asks"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    queries = rows.where(is_query).select("id", "vec", "dim", every.alias("shard"), F.lit(True).alias("asks"))
    dealt = candidates.union(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "shard", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                dim, number, asks = place[a].tolist()
                if key != (dim, number):
                    key, held, index = (dim, number), [], None
                part = batch.slice(a, b - a)
                ids, vectors = part.column("id").to_numpy(), part.column("vec").flatten().to_numpy().reshape(-1, dim)
                if not asks:
                    held.append((ids.copy(), vectors.copy()))
                    continue
                if held:
                    index, held = build(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for i in range(0, len(ids) if index else 0, per_block):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in index.search(ids[i: i + per_block], vectors[i: i + per_block], k)],
                                                     names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query among those of the shards, ties to the smaller id; rows of one query id together."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
