"""Quality and toxicity: held-out accuracy, awkward rows, what may be learnt from."""

import pickle
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from syllabica.llm import quality_knn, toxicity_kn
from syllabica.llm.frames import remainder
from syllabica.llm.words import BLOCK, LONG, powers, word_hashes
from tests.llm.helpers import empty, prose, table


def corpus(n=240):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = prose(rng.randint(30, 120), i % 5).split()
        toxic, poor = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(max(3, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword", "foulword"]))
        text = " ".join(words)
        rows.append((i, text.upper().replace(" ", "!! ") if poor else text))
        labels.append((i, int(not poor), int(toxic), "en"))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


ODD = [(9001, ""), (9002, None), (None, "some text without an id"), (9003, "!"), (9004, "long " * 60_000), (5, "a second text of this id")]


def test_quality(spark):
    rows, labels = corpus()
    learn = remainder("doc_id", 3) != 1
    got = quality_knn.score_quality(table(spark, rows + ODD), labels_of(spark, [*labels, (None, 1, 0, ""), (1, None, None, "")]), learn).collect()
    assert len(got) == len(rows + ODD) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _, _ in labels}
    held = {r["doc_id"] for r in spark.createDataFrame(rows, "doc_id long, t string").where(~learn).collect()} - {5}
    tried = [r for r in got if r["doc_id"] in held]
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in tried) >= 0.95 * len(tried)


def test_toxicity(spark):
    rows, labels = corpus()
    learn = remainder("doc_id", 5) != 0
    docs = table(spark, rows + ODD).drop("score")
    model = toxicity_kn.fit_toxicity(docs, labels_of(spark, labels), learn)
    scored = toxicity_kn.add_score(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    got = scored.collect()
    assert len(got) == len(rows + ODD) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: t for i, _, t, _ in labels}
    held = {r["doc_id"] for r in spark.createDataFrame(rows, "doc_id long, t string").where(~learn).collect()} - {5}
    tried = [r for r in got if r["doc_id"] in held]
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in tried) >= 0.95 * len(tried)
    assert {r["doc_id"]: r["score"] for r in got}[9001] == {r["doc_id"]: r["score"] for r in got}[9002]


def test_short_and_wholly_toxic_texts(spark):
    rows, labels = corpus()
    docs = table(spark, rows).drop("score")
    model = toxicity_kn.fit_toxicity(docs, labels_of(spark, labels), remainder("doc_id", 5) != 0)
    common = rows[1][1].split()[0].strip("!").lower()
    toxic = model.score(["vileword", "nastyword foulword", "vileword " * 40, f"{common} vileword nastyword"])
    assert min(toxic) >= 0.5 > max(model.score([common, "", "never seen words", rows[1][1]]))


def test_words_and_pairs_are_all_told_apart(spark):
    rows, labels = corpus()
    learn = remainder("doc_id", 5) != 0
    # a word whose hash begins with the same 18 bits
    many = [f"w{i}" for i in range(2_000_000)]
    first = word_hashes([" ".join(many)])[0] >> np.uint64(46)
    same = many[int(np.flatnonzero(first == word_hashes(["vileword"])[0][0] >> np.uint64(46))[0])]
    rows += [(1000 + i, f"{prose(20, i % 5)} {same}") for i in range(20)]
    docs = table(spark, rows).drop("score")
    model = toxicity_kn.fit_toxicity(docs, labels_of(spark, labels), learn)
    assert model.score(["vileword"])[0] >= 0.5 > model.score([same])[0]
    known = {r["doc_id"] for r in spark.createDataFrame(labels, "doc_id long, q int, t int, x string")
             .where(learn & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 0)).collect()}
    words = [text.lower().replace("!!", "").split() for i, text in rows if i in known]
    assert len(model.keys) == len({p for text in words for p in zip(["", *text], text, strict=False)})
    # probabilities shared by both models are those of all documents
    every = [w for _, text in rows for w in text.lower().replace("!!", "").split()]
    vile = toxicity_kn.places(model.words, toxicity_kn.words_of(["vileword"])[0])
    assert np.isclose(model.shared[vile][0], (every.count("vileword") + 1) / (len(every) + len(set(every)) + 1))


def test_a_task_finds_pairs_without_their_keys(spark):
    rows, labels = corpus(120)
    docs = table(spark, rows).drop("score")
    model = toxicity_kn.fit_toxicity(docs, labels_of(spark, labels), remainder("doc_id", 5) != 0)
    small = pickle.loads(pickle.dumps(pickle.loads(pickle.dumps(model))))
    held = sum(v.nbytes for v in vars(small).values())
    assert held <= 8 * len(model.keys) + 24 * len(model.words) + 100 and not hasattr(small, "keys")
    size = len(model.words) + 2
    sought = np.concatenate([model.keys, model.keys + 1, np.random.default_rng(1).integers(0, size * size, 5000), [0, size * size - 1]])
    assert np.array_equal(small._places(sought), toxicity_kn.places(model.keys, sought))
    texts = [text for _, text in rows] + ["", "never seen words", "vileword " * 40]
    assert np.array_equal(small.score(texts, model.curve), model.score(texts))
    # executors keep the Python processes of other stages, so no task gets many texts at once
    assert max(r[0] for r in spark.range(5000).coalesce(1).mapInArrow(_sizes, "n long").collect()) <= toxicity_kn.ROWS


def test_powers_of_any_length_agree():
    up, down = powers(LONG + 5)
    for n in (0, 7, BLOCK, BLOCK + 1, LONG, LONG + 5):
        assert [len(x) for x in powers(n)] == [n + 1, n + 1]
        assert np.array_equal(powers(n)[0], up[: n + 1]) and np.array_equal(powers(n)[1], down[: n + 1])
    long = "ab1 " * BLOCK
    assert set(word_hashes([long, "ab1"])[0].tolist()) == {word_hashes(["ab1"])[0][0]}


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])


def test_labels_outside_the_fold_change_nothing(spark):
    rows, labels = corpus(120)
    learn = remainder("doc_id", 5) != 0
    turned = labels_of(spark, labels).withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    docs = table(spark, rows).drop("score")
    score = lambda marks: sorted((r["doc_id"], r["score"]) for r in toxicity_kn.add_score(docs, toxicity_kn.fit_toxicity(docs, marks, learn)).collect())
    assert score(labels_of(spark, labels)) == score(turned)


def test_without_labels_or_rows(spark):
    none = labels_of(spark, [])
    docs = table(spark, ODD).drop("score")
    assert toxicity_kn.fit_toxicity(docs, none, F.lit(True)) is None
    assert {r["score"] for r in toxicity_kn.add_score(docs, None).collect()} == {0.0}
    assert {r["score"] for r in quality_knn.score_quality(docs, none, F.lit(True)).collect()} == {0.5}
    rows, labels = corpus(60)
    assert quality_knn.score_quality(empty(spark), labels_of(spark, labels), F.lit(True)).count() == 0
    assert toxicity_kn.fit_toxicity(empty(spark).drop("score"), labels_of(spark, labels), F.lit(True)) is None
