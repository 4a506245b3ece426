"""Bucketed scans against plain windows and brute force, whatever the width."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabica.operators.ordered import numbered, running, width_bucket
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; values are sparse."""
    rnd = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}"
        data.append((key, i, rnd.choice([None, None, None, f"v{i}"]), rnd.random() < 0.2))
    return spark.createDataFrame(data, "k string, seq bigint, v string, flag boolean")


@pytest.mark.parametrize("width", [1, 7, 50, 10000])
def test_running_equals_window(hot, width):
    w = W.partitionBy("k").orderBy("seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    want = hot.select(
        "k", "seq", F.sum(F.col("flag").cast("bigint")).over(upto).alias("n"), F.last("v", True).over(upto).alias("c"),
        F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("s"),
    )
    got = running(
        hot, ["k"], ["seq"], width_bucket("seq", width), counts={"n": F.col("flag")}, carries={"c": F.col("v")},
        previous={"p": F.col("v")}, following={"s": F.col("v")},
    ).select("k", "seq", "n", "c", "p", "s")
    assert rows(got) == rows(want)


def test_numbering_without_keys(hot):
    got = numbered(hot, [], ["seq"], width_bucket("seq", 13))
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 601))
    assert all(r["n"] == r["seq"] + 1 for r in got.collect())


def test_short_sequences_are_not_cut(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "y"), (None, 3, "z"), ("c", None, "z")], "k string, seq bigint, v string")
    got = running(df, ["k"], ["seq"], width_bucket("seq"), counts={"n": F.lit(1)}, carries={"v": F.col("v")}, following={"s": F.col("seq")})
    # nothing is carried between buckets where all rows lie in one; rows without a key or a place drop out as ever
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["k", "seq", "n", "v", "s"]
    assert rows(got) == [("a", 1, 1, "x", 2), ("a", 2, 2, "x", None), ("b", 5, 1, "y", None)]
    cut = running(df, ["k"], ["seq"], width_bucket("seq", 2), counts={"n": F.lit(1)}, carries={"v": F.col("v")}, following={"s": F.col("seq")})
    assert "Join" in cut._jdf.queryExecution().optimizedPlan().toString() and rows(cut) == rows(got)
