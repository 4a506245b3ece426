"""Joins to the library's own tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table that is a constant of the library (regions, states, operations).

    The hint is safe here and only here: such a table never grows with the data.
    Frames of a caller are joined plainly, so Spark measures them, and adaptive
    execution splits a key that holds a large share of the rows.
    """
    return df.join(F.broadcast(table), list(on), how)
