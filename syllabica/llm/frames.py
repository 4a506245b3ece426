"""What the operators share: column picking, staging, batches of texts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabica.session import shared_dir


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, parts: int) -> Column:
    """The fold of an id: crc32 of its decimal text modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def give_back() -> None:
    """Hand memory that this process no longer uses back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task's batches; after the last one memory is handed back.

    Executors keep a task's Python process for the stages that follow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def slices(batch: pa.RecordBatch, most: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch by the texts of a column into pieces of about ``most`` bytes of text.

    A single longer text is a piece of its own: texts are never cut.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)
