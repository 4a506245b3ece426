"""Removed lines against every run of lines."""

import random
import re

import pytest

from syllabica.llm import line_dedup
from tests.llm.helpers import empty, table


def brute(rows, m, words=None):
    """Later copies of ``m`` lines, and of single lines of so many words, go."""
    seen, out = set(), []
    for i, text in rows:
        lines = text.split("\n")
        filled = [k for k, line in enumerate(lines) if line.strip(" ")]
        gone = set()
        for a in range(len(filled) - m + 1):
            run = tuple(lines[k] for k in filled[a: a + m])
            if run in seen:
                gone.update(filled[a: a + m])
            seen.add(run)
        for k in filled:
            if words and len(re.findall(r"[^ \t\n\x0b\f\r]+", lines[k])) >= words:
                if lines[k] in seen:
                    gone.add(k)
                seen.add(lines[k])
        out.append((i, "\n".join(line for k, line in enumerate(lines) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_runs(spark, m):
    rng = random.Random(m)
    pool = [*"abcdef", "", "  ", "long line " * 50]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(100, "x\n" * 300), (101, "x\n" * 200)]
    got = line_dedup.drop_repeated_lines(table(spark, rows), m)
    assert got.columns == table(spark, rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute(rows, m)


def test_awkward_rows(spark):
    rows = [(None, "a\nb"), (3, "a\nb\nc"), (4, None), (5, ""), (6, "z\nz2"), (6, "z\nz2"), (7, "q\na\nb"), (7, "other\nlines")]
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in line_dedup.drop_repeated_lines(table(spark, rows)).collect())
    assert got == sorted([("None", "a\nb"), ("3", "c"), ("4", "None"), ("5", ""), ("6", "z\nz2"), ("6", "z\nz2"), ("7", "q"), ("7", "other\nlines")])
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_long_single_lines(spark):
    long, short = "many words " * 30, "few words"
    rows = [(1, f"a\n{long}\nb"), (2, long), (3, f"c\n{long}\nd"), (4, f"e\n{short}\nf"), (5, f"g\n{short}\nh"), (6, f"i\n{short}\nh")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_lines(table(spark, rows), min_words=50).collect())
    assert got == [(1, f"a\n{long}\nb"), (2, ""), (3, "c\nd"), (4, f"e\n{short}\nf"), (5, f"g\n{short}\nh"), (6, "i")]


@pytest.mark.parametrize("seed", range(4))
def test_runs_and_long_lines(spark, seed):
    rng = random.Random(seed)
    pool = [*"abcdefgh", " ", "w " * 49, "w " * 50, "one\ttwo " * 25, "x" * 400, "many words " * 40]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(90, "many words " * 40)]
    got = line_dedup.drop_repeated_lines(table(spark, rows), 2, min_words=50)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == brute(rows, 2, 50)


def test_intervals(spark):
    rows = [(1, "a\nb\n\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "c\nd\nz\nb\nc\nd"), (4, None), (5, "q\na\nr"), (None, "m\nn"), (6, "m\nn")]
    got = line_dedup.repeated_intervals(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 3, 1, 0), (3, 0, 2, 1, 2), (3, 3, 3, 1, 1), (6, 0, 2, None, 0)]
    assert line_dedup.repeated_intervals(empty(spark)).count() == 0
    for least, n in ((3, 3), (4, 4)):
        rows = [(1, "\n".join(map(str, range(9)))), (2, "\n".join(map(str, [*range(2, 2 + n), "x"])))]
        assert [tuple(r) for r in line_dedup.repeated_intervals(table(spark, rows), least).collect()] == [(2, 0, n, 1, 2)]
