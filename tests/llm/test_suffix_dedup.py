"""Removed bytes against every window of every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabica.llm import suffix_dedup
from tests.llm.helpers import empty, prose, table


def brute(rows, size):
    """What is left of each text and its removed spans; rows in order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - size + 1):
            window = raw[s: s + size]
            if window in seen:
                gone[s: s + size] = [True] * size
            seen.add(window)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, bytes(b for b, g in zip(raw, gone, strict=True) if not g), spans))
    return out


def found(df, size, **options):
    rows = suffix_dedup.remove_repeats(df, size, **options).collect()
    return [(r["doc_id"], bytes(r["__kept"]), len(r["__spans"])) for r in rows]


def key(row):
    return (row[0] is not None, row[0] or 0, row[1])


def test_mixed_rows(spark):
    passage = prose(60, 1)
    rows = [(4, prose(90, 2) + passage + prose(30, 3)), (2, passage), (9, passage[7:] + "é" * 150), (1, ""), (None, passage),
            (3, None), (7, "ab" * 400), (8, prose(3000, 4)), (11, prose(3000, 4)[20:]), (12, passage), (12, passage), (5, "é" * 149)]
    expected = sorted(brute(rows, 100), key=key)
    assert sorted(found(table(spark, rows), 100), key=key) == expected
    assert sorted(found(table(spark, rows), 100, bucket_bytes=3000), key=key) == expected


def test_columns_and_empty_tables(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    rows = [(1, "x" * 300), (2, None), (3, "é" * 120)]
    left = suffix_dedup.drop_repeats(table(spark, rows))
    assert left.columns == table(spark, rows).columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: "x", 2: None, 3: "é"}


def test_clashing_columns(spark):
    clash = {c: F.lit(c) for c in ("__id", "__text", "__bucket", "__kept", "__spans", "core", "bucket", "turn")}
    df = table(spark, [(1, "x" * 300), (2, None)]).withColumns(clash)
    left = suffix_dedup.drop_repeats(df)
    assert left.columns == df.columns
    assert {(r["doc_id"], r["text"], r["__kept"], r["__bucket"]) for r in left.collect()} == {(1, "x", "__kept", "__bucket"), (2, None, "__kept", "__bucket")}
    assert {(r["doc_id"], bytes(r["__kept"]), r["__text"]) for r in suffix_dedup.remove_repeats(df).collect()} == {(1, b"x", "__text"), (2, b"", "__text")}


def answered(sent, n):
    """What Spark's sort answers to each of ``n`` buckets."""
    cores, out = {}, [([], []) for _ in range(n)]
    for row in sent:
        cores.setdefault(row["core"], []).append(row)
    for rows in cores.values():
        if len(rows) > 1 or rows[0]["place"] % 2:
            first = {}
            for row in sorted(rows, key=lambda r: (r["doc"], r["place"])):
                at, later = out[row["place"] >> 32]
                at.append((row["place"] & 0xFFFFFFFF) >> 1)
                later.append(row["extent"] in first)
                first[row["extent"]] = row
    return [(np.array(at, np.int64), np.array(later, bool)) for at, later in out]


@pytest.mark.parametrize("seed", range(6))
def test_rounds_without_spark(seed):
    """Strings over small alphabets, short windows, several buckets."""
    rng = random.Random(seed)
    for _ in range(25):
        size = rng.choice([1, 2, 5, 33, 40, 100])
        base = bytes(rng.choice(rng.choice([b"a", b"ab", b"abcdefgh"])) for _ in range(600)).decode()
        rows = [(i, "".join(base[(a := rng.randrange(600)): a + rng.randint(1, 400)] for _ in range(rng.randint(0, 4)))) for i in range(6)]
        n = rng.choice([1, 2, 3])
        dealt = [[r for r in rows if r[0] % n == b] for b in range(n)]
        buckets = [suffix_dedup.Bucket(np.array([i for i, _ in d], np.int64), [t.encode() for _, t in d], size) for d in dealt]
        runs = [b.rounds() for b in buckets]
        items = [next(r) for r in runs]
        for _ in range(suffix_dedup.ROUNDS):
            answers = answered([row for k, x in enumerate(items) for row in x.sent(k).to_pylist()], n)
            for k, run in enumerate(runs):
                try:
                    items[k] = run.send(answers[k])
                except StopIteration:
                    pass
        got = {i: text for bucket, d in zip(buckets, dealt, strict=True) for (i, _), text in zip(d, bucket.result()[0], strict=True)}
        assert got == {i: kept for i, kept, _ in brute(rows, size)}
