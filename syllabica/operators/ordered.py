"""Order-dependent state over long sequences without one task per sequence.

A plain window puts a whole partition key in one task, so a document holding a
third of all lines stalls the job. Here each sequence is cut into buckets of
its order column. State is computed inside the buckets, one summary row per
bucket is carried across, and both are joined. The rows are shuffled once, by
(keys, bucket); the summary branch reads only the state columns and is combined
before its own shuffle.

Both branches read the input, so a job that chains several of these should
write the input of each layer to a table first (``sources.tables.cut_lineage``).
Where all rows lie in one bucket no sequence is cut and nothing is carried across: the
state is computed by one window over the keys, whose order later layers of the same keys share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

BUCKET = "__bucket"
DEFAULT_WIDTH = 65536


def width_bucket(order: str, width: int = DEFAULT_WIDTH) -> Column:
    """Bucket of a dense integer order column."""
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def _ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with the number of their range; written once, as two branches have to see the same ranges."""
    cut = df.repartitionByRange(*order).withColumn(BUCKET, F.spark_partition_id().cast("bigint"))
    return cut_lineage(cut, "tramos")


def _one_bucket(df: DataFrame, bucket: Column) -> bool:
    """Whether all rows lie in one bucket, or none has any."""
    first, last = df.agg(F.min(bucket), F.max(bucket)).first()
    return first == last


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    *,
    counts: Mapping[str, Column] | None = None,
    carries: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to every row, in ``order`` inside ``keys``.

    ``counts``: running sum up to and including the row.
    ``carries``: last non-null value up to and including the row.
    ``previous`` / ``following``: the value on the neighbouring row.

    ``keys`` must not be null and ``bucket`` must not decrease along ``order``.
    Without keys the buckets are ranges of the order instead, however its values
    are spread, so what is carried across is a row per range.
    ``order`` must be unique inside ``keys`` for a repeatable result.
    The extent of the buckets is looked up when this is called.
    """
    counts, carries = dict(counts or {}), dict(carries or {})
    previous, following = dict(previous or {}), dict(following or {})
    by = [*keys, BUCKET]
    inputs = {
        **{f"__v_{n}": F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for n, c in counts.items()},
        **{f"__v_{n}": c for n, c in carries.items()},
        **{f"__v_{n}": F.struct(c.alias("v")) for n, c in previous.items()},
        **{f"__v_{n}": F.struct(c.alias("v")) for n, c in following.items()},
    }
    keyed = (df.withColumn(BUCKET, bucket) if keys else _ranges(df, order)).withColumns(inputs)
    whole = bool(keys) and _one_bucket(df, bucket)

    here = W.partitionBy(*(keys if whole else by)).orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {}
    for n in counts:
        local[f"__l_{n}"] = F.sum(f"__v_{n}").over(upto)
    for n in carries:
        local[f"__l_{n}"] = F.last(f"__v_{n}", ignorenulls=True).over(upto)
    for n in previous:
        local[f"__l_{n}"] = F.lag(f"__v_{n}").over(here)
    for n in following:
        local[f"__l_{n}"] = F.lead(f"__v_{n}").over(here)
    if whole:
        rows = keyed.where(reduce(and_, [F.col(f"`{k}`").isNotNull() for k in by])).withColumns(local)
        state = [F.col(f"__l_{n}").alias(n) for n in [*counts, *carries]] + [F.col(f"__l_{n}")["v"].alias(n) for n in [*previous, *following]]
        named = {*counts, *carries, *previous, *following}
        return rows.select(*[c for c in df.columns if c not in named], *state)
    rows = keyed.withColumns(local)

    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    aggregates = []
    for n in counts:
        aggregates.append(F.sum(f"__v_{n}").alias(f"__s_{n}"))
    for n in carries:
        present = F.col(f"__v_{n}").isNotNull()
        aggregates.append(F.max_by(f"__v_{n}", F.when(present, place)).alias(f"__s_{n}"))
    for n in previous:
        aggregates.append(F.max_by(f"__v_{n}", place).alias(f"__s_{n}"))
    for n in following:
        aggregates.append(F.min_by(f"__v_{n}", place).alias(f"__s_{n}"))
    summary = keyed.groupBy(*by).agg(*aggregates)

    over_keys = W.partitionBy(*keys).orderBy(BUCKET) if keys else W.orderBy(BUCKET)
    before = over_keys.rowsBetween(W.unboundedPreceding, -1)
    across = {}
    for n in counts:
        across[f"__a_{n}"] = F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0).cast("bigint"))
    for n in carries:
        across[f"__a_{n}"] = F.last(f"__s_{n}", ignorenulls=True).over(before)
    for n in previous:
        across[f"__a_{n}"] = F.lag(f"__s_{n}").over(over_keys)
    for n in following:
        across[f"__a_{n}"] = F.lead(f"__s_{n}").over(over_keys)
    offsets = summary.withColumns(across).select(*by, *across)

    # a row per sequence and bucket: as many as there are sequences, so never a copy for every executor
    joined = rows.join(offsets.hint("merge"), by, "inner")
    out = {}
    for n in counts:
        out[n] = F.col(f"__l_{n}") + F.col(f"__a_{n}")
    for n in carries:
        out[n] = F.coalesce(f"__l_{n}", f"__a_{n}")
    for n in [*previous, *following]:
        out[n] = F.coalesce(f"__l_{n}", f"__a_{n}")["v"]
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, name: str = "n"
) -> DataFrame:
    """Row number from 1 inside ``keys``; with no keys, over the whole table."""
    return running(df, keys, order, bucket, counts={name: F.lit(1)})
