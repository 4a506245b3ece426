"""Fill-in-the-middle against cuts of a list of lines."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syllabica.llm import fill_middle
from tests.llm.helpers import empty, table

TEXTS = ["", None, "\n", "one", "one\n", "a\nb\nc", "\n\n\nx\n\n", "a <P> b\nc", "<S>", "x<M>", "<", "<P\nS>\n<\n", "é\U0001f600\n x\r\ny",
         "a\n" * 5000 + "end", "no line end " * 20_000, "\r\n\r\n", "<S\n<S\nP>"]


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def expected(doc_id, text, fim=100, spm=50, seed="7"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    units = lines(text)
    n = len(units)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("fim", "spm", "seed"), [(100, 50, "7"), (60, 0, "x"), (100, 100, "7")])
def test_forms_and_way_back(spark, fim, spm, seed):
    rows = [(i + len(TEXTS) * k, text) for k in range(6) for i, text in enumerate(TEXTS)] + [(None, "no\nid\n"), (3, "one"), (3, "one")]
    got = fill_middle.fill_in_middle(table(spark, rows), seed, fim, spm)
    back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in back))) == sorted(str(expected(i, t, fim, spm, seed)) for i, t in rows)
    whole = {i: t or "" for i, t in rows}
    assert all(r["back"] == whole[r["doc_id"]] for r in back)


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("\n\r ab é"), max_size=30), st.integers(0, 40), st.integers(0, 40))
def test_one_match_gives_all_parts(text, one, two):
    units = lines(text)
    a, b = sorted([one % (len(units) + 1), two % (len(units) + 1)])
    assert fill_middle.parts(text, a, b) == ("".join(units[:a]), "".join(units[a:b]), "".join(units[b:]))


def test_very_many_lines():
    prefix, middle, suffix = fill_middle.parts("ab\n" * 1_000_000, 400_000, 900_000)
    assert (len(prefix), len(middle), len(suffix)) == (1_200_000, 1_500_000, 300_000)
