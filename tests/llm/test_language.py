"""Language by compression: sizes against plain calls of the library, awkward rows and held-out accuracy."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from syllabica.llm import language_zstd
from syllabica.llm.frames import remainder

SCHEMA = "doc_id long, text string, lang string, part int, score string, lang_pred string"
WORDS = {"xa": ["kalimo", "tarun", "pesal", "vidora", "kal"], "yb": ["schtern", "grofft", "blind", "zwerk", "un"], "zc": ["oeuille", "mantre", "vois", "gi"]}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "p") for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def learnt():
    return [(i, prose(lang, 60, i), lang) for i, lang in enumerate(sorted(WORDS) * 30)]


def test_awkward_rows(spark, learnt):
    odd = [(1000, None, "xa"), (1001, "", None), (1002, "12 34 !! \n", "yb"), (1003, prose("yb", 40, 1).upper(), None), (None, prose("zc", 40, 2), "xa"),
           (1004, prose("xa", 300_000, 3), "zc"), (1004, prose("xa", 50, 4), "zc"), (1005, "tarun " * 500 + prose("xa", 30, 5), None)]
    held_out = F.col("doc_id") >= 1000
    got = language_zstd.identify(table(spark, learnt + odd), ~held_out)
    assert got.columns == ["doc_id", "lang_pred", "score", "rejected"]
    rows = got.collect()
    assert len(rows) == len(learnt) + len(odd)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["lang_pred"])
        assert 0 <= r["score"] <= 1
    assert all(by_id[i] == {lang} for i, _, lang in learnt)
    assert [by_id[i] for i in (1000, 1001, 1002, 1003, None, 1004, 1005)] == [{"und"}, {"und"}, {"und"}, {"yb"}, {"zc"}, {"xa"}, {"xa"}]
    assert all(r["rejected"] and r["score"] == 0 for r in rows if r["lang_pred"] == "und")


def test_nothing_learnt_and_one_language(spark, learnt):
    none = language_zstd.identify(table(spark, learnt), F.col("doc_id") < 0)
    assert {tuple(r)[1:] for r in none.collect()} == {("und", 0.0, True)}
    assert language_zstd.identify(table(spark, []), F.lit(True)).count() == 0
    alone = language_zstd.identify(table(spark, [r for r in learnt if r[2] == "xa"]), F.lit(True))
    assert {tuple(r)[1:] for r in alone.collect()} == {("xa", 1.0, False)}


def test_languages_of_held_out_rows_do_not_matter(spark, learnt):
    learn = remainder("doc_id", 4) != 2
    changed = [(i, t, lang if i % 7 else None) for i, t, lang in learnt]
    held = [(2000 + i, prose(lang, 30, 2000 + i), "zc") for i, lang in enumerate(sorted(WORDS) * 4)]
    other = [(i, t, None) for i, t, _ in held]
    answers = [sorted(map(str, language_zstd.identify(table(spark, changed + rows), learn & (F.col("doc_id") < 2000)).collect())) for rows in (held, other)]
    assert answers[0] == answers[1]


def test_sizes_are_those_of_plain_compression(learnt):
    by_language = {lang: b" ".join(language_zstd.lowered(t) for _, t, of in learnt if of == lang) for lang in WORDS}
    judges = language_zstd.Compressors(sorted(WORDS), by_language, 6, 4096)
    for seed, lang in enumerate(WORDS):
        text = prose(lang, 3000, seed)
        raw = language_zstd.lowered(text)
        want = []
        for name in sorted(WORDS):
            content = zstandard.ZstdCompressionDict(by_language[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            want.append(sum(len(zstandard.ZstdCompressor(level=6, dict_data=content, write_content_size=False).compress(raw[i: i + 4096]))
                            for i in range(0, len(raw), 4096)))
        got = judges.sizes(text)
        assert min(range(3), key=got.__getitem__) == min(range(3), key=want.__getitem__)
        assert all(abs(a - b) <= 0.05 * b + 30 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1000])
def test_passages(n):
    raw = b" ".join(b"w%d" % i for i in range(n))
    found = language_zstd.passages(raw, 4, 64)
    assert len(found) <= 4 and all(len(p) <= 4 * 64 for p in found) and all(p in raw for p in found)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = remainder("doc_id", 4) == 2
    got = language_zstd.identify(docs, ~held_out).where(held_out).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
