"""Byte-level BPE: whole texts to ids and back, by a local rank file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunked_bpe import rank_coder, read_ranks
from .frames import documents, slices

_TYPE = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id``, ``token_ids`` and the ``decoded`` bytes of every text.

    Each match of ``pattern`` is merged separately by the tiktoken library and no
    special token is recognised. Texts are pre-split at safe boundaries, so a very
    long text never meets the pattern as one string. A null or empty text has no
    ids; repeated rows and ids are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ranks = rank_coder(rank_path, pattern), read_ranks(rank_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            for part in slices(batch):
                ids = [coder.ids(text) for text in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32))
                decoded = pa.array([b"".join(map(tokens.__getitem__, x.tolist())) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values), decoded], schema=_TYPE)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")
