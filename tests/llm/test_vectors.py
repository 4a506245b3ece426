"""Top-k and nearest neighbours against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabica.llm import bit_sliced, vp_trees

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * 0.4).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(40)]  # ties
    rows += [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []),
             (550, [0.0] * 8), (None, rows[3][1]), (600, [0.5, 0.25])]
    return rows, spark.createDataFrame([(i, v, 1, 0.5, 9) for i, v in rows], SCHEMA)


def usable(rows, zero):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
            and (zero or any(v))]


def expected(rows, score, k=5):
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        others = sorted((-score(x, y), i) for j, x in rows for i, y in rows if j == q and i != q and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(others[:k])]
    return sorted(out)


@pytest.mark.parametrize("slices", [2, 6, 12])
def test_bit_sliced(spark, slices):
    rows, df = vectors(spark)
    want = expected([(i, np.floor(256 * v).astype(int)) for i, v in usable(rows, True)], lambda a, b: int(a @ b))
    got = bit_sliced.top_k(df, F.col("id") % 50 == 0, slices=slices, per_shard=40, per_block=3)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_vp_trees_exact(spark):
    rows, df = vectors(spark)
    one = lambda a, b: float(vp_trees.cosine(a[None], b[None])[0])
    got = vp_trees.nearest(df, F.col("id") % 50 == 0, factor=1, leaf=4, per_shard=60, per_block=3)
    assert sorted(tuple(r) for r in got.collect()) == expected(usable(rows, False), one)


@pytest.mark.parametrize("per_shard", [6, 1000])
def test_repeated_ids(spark, per_shard):
    rng = np.random.default_rng(5)
    rows = [(i % 7 * 25, rng.normal(size=4).astype(np.float32).tolist()) for i in range(30)]
    rows += [rows[0]] * 9 + [rows[1]] * 9  # a query and a candidate, each there ten times
    df = spark.createDataFrame([(i, v, 1, 0.5, 9) for i, v in rows], SCHEMA)
    arrays = [(i, np.array(v, float)) for i, v in rows]
    one = lambda a, b: float(vp_trees.cosine(a[None], b[None])[0])
    near = vp_trees.nearest(df, F.col("id") % 50 == 0, factor=1, leaf=2, per_shard=per_shard).collect()
    assert sorted(tuple(r) for r in near) == expected(arrays, one)
    top = bit_sliced.top_k(df, F.col("id") % 50 == 0, per_shard=per_shard).collect()
    assert sorted(tuple(r) for r in top) == expected([(i, np.floor(256 * v).astype(int)) for i, v in arrays], lambda a, b: int(a @ b))
    assert all(r["query_id"] != r["vec_id"] for r in near + top)


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3e300, 0.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in vp_trees.nearest(df, F.col("id") % 50 == 0, factor=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 50, 1.0), (0, 1, 0.948683), (0, 2, 0.707107), (50, 0, 1.0), (50, 1, 0.948683), (50, 2, 0.707107)]
    with pytest.raises(Exception, match="too large"):
        bit_sliced.top_k(df, F.col("id") % 50 == 0).collect()


def test_empty_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bit_sliced.top_k(df, F.col("id") % 50 == 0).count() == 0
    assert vp_trees.nearest(df, F.col("id") % 50 == 0).count() == 0


def test_recall_of_the_registered_factor(spark):
    import pyarrow.parquet as pq

    sf_dir = "/root/testdata/sf0.01"
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    best = {int(ids[q]): set(ids[np.argsort(-n)[:5]].tolist()) for q, n in zip(asked, near, strict=True)}
    got = vp_trees.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0).collect()
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) >= 0.9 * 5 * len(best)
