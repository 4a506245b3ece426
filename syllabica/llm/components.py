"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root`` of every id that an edge between different ids touches.

    Each round every id points to the first of itself and its neighbours in a
    hashed order, and edges are drawn anew between the ids pointed at. No list of
    neighbours is gathered, so an id with very many of them is no burden. Rounds
    end when no edge is left; the pointers are then followed from first to last.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    pointers: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(both.groupBy("a").agg(F.min(order("b")).alias("near"))
                      .select(F.col("a").alias("id"), F.least(order("a"), F.col("near"))["id"].alias("root")), "pointers")
        pointers.append(step)
        for end in ("a", "b"):
            left = left.join(step.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("root", end)
        left = staged(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not pointers:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = pointers[0]
    for step in pointers[1:]:
        later = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        out = out.join(later, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return out
