"""Tables that a stream changes key by key, in a fixed number of buckets.

A batch rewrites the buckets its keys fall into and no others. Each version of a
bucket is a folder of its own; the ledger of a batch, one row per bucket,
says which version holds. Batch n reads the ledger of batch n-1 and writes its own files, so
a batch that is run again overwrites what it wrote and changes nothing else, and
a reader of an older ledger still finds its files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "cubo"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """Buckets that the keys of a batch fall into, ``buckets`` numbers at most."""
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def _ledger(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """Bucket to version, as of a batch; one row per bucket."""
    if batch < 0:
        return {}
    rows = spark.read.schema(f"{BUCKET} int, version long").parquet(f"{path}/libro/lote={batch:012d}")
    return {r[0]: r[1] for r in rows.collect()}


def _version(path: str, version: int) -> str:
    return f"{path}/version={version:012d}"


def _rows(spark: SparkSession, path: str, schema: T.StructType, held: dict[int, int]) -> DataFrame:
    """What the given buckets hold in the given versions."""
    paths = [f"{_version(path, v)}/{BUCKET}={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def held(spark: SparkSession, path: str, batch: int, schema: T.StructType, buckets: Sequence[int]) -> DataFrame:
    """What ``buckets`` hold as of a batch."""
    return _rows(spark, path, schema, {b: v for b, v in _ledger(spark, path, batch).items() if b in set(buckets)})


def rewrite(
    spark: SparkSession, path: str, batch: int, buckets: Sequence[int], n: int, keys: Sequence[str], schema: T.StructType,
    merged: Callable[[DataFrame], DataFrame],
) -> None:
    """New versions of ``buckets``: ``merged`` of the rows they held before this batch.

    ``merged`` must return rows of those buckets only. Buckets left empty leave the ledger.
    """
    before = _ledger(spark, path, batch - 1)
    rows = merged(held(spark, path, batch - 1, schema, buckets)).select(*[f.name for f in schema.fields]).withColumn(BUCKET, bucket_of(keys, n))
    if buckets:
        # a file per bucket: rows meet by bucket before they are written
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(_version(path, batch))
        written = {r[0] for r in spark.read.schema(f"{BUCKET} int").parquet(_version(path, batch)).distinct().collect()}
        after = {b: v for b, v in before.items() if b not in set(buckets)} | {b: batch for b in written}
    else:
        after = before
    ledger = spark.createDataFrame(sorted(after.items()), f"{BUCKET} int, version long")
    ledger.coalesce(1).write.mode("overwrite").parquet(f"{path}/libro/lote={batch:012d}")


def newest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table after the last batch that wrote its ledger."""
    last = spark.read.schema(f"{BUCKET} int, version long, lote long").parquet(f"{path}/libro").agg(F.max("lote")).first()[0]
    return _rows(spark, path, schema, _ledger(spark, path, -1 if last is None else last))
