"""The pipeline's stages on their own inputs, and the registered queries."""

import re

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from syllabica.llm import frames, queries
from tests.compare import connect, differences
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_links
from tests.llm.test_suffix_dedup import brute as brute_bytes

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    assert entry.queries()[name] is queries.QUERIES[name]
    df = queries.QUERIES[name](spark, SF_DIR)
    if name in queries.ORACLES:
        assert differences(df, queries.ORACLES[name], connect(SF_DIR)) is None
    else:
        assert df.count() > 0


def test_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages, given, texts = dict(corpus_pipeline.STAGES), {}, {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        given[name] = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        docs = corpus_pipeline.staged(stage(spark, docs, SF_DIR), "stage")
        if name != "packing":
            assert docs.columns == documents.columns and docs.schema["n_chars"].dataType == documents.schema["n_chars"].dataType
            texts[name] = sorted((r["doc_id"], r["text"]) for r in docs.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert len(stages) == 5 and len(texts["toxicity"]) >= 0.8 * documents.count()
    assert texts["line dedup"] == brute_lines(given["line dedup"], 2, 50)
    assert [i for i, _ in texts["n-gram join"]] == [i for i, c, _, _ in brute_links(given["n-gram join"]) if i == c]
    assert texts["suffix dedup"] == sorted((i, kept.decode(errors="ignore")) for i, kept, _ in brute_bytes(given["suffix dedup"], 100))
    assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in given["packing"]}
    again = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_one_of_each_group_of_awkward_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "en"), (1, long, "en"), (2, long, "de"), (None, long, "en"), (None, long, "en"), (3, "short", "en"), (3, "short", "fr"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR)
    # rows without an id stay, rows alike in all columns are one, rows of one id that differ stay
    assert got.columns == docs.columns
    want = [(1, long, "en"), (None, long, "en"), (None, long, "en"), (3, "short", "en"), (3, "short", "fr"), (4, None, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), SF_DIR).count() == 0


def nested_python(plan):
    """Python operators of a plan that run in one stage with one above them: each has a process of its own in every task."""
    above, found = [], []
    for line in plan.split("\n"):
        node = line.lstrip(" :+-*(0123456789)")
        depth = len(line) - len(node)
        above = [a for a in above if a[0] < depth] if node else above
        kind = "stage" if re.match("Exchange|BroadcastExchange", node) else "python" if re.match(r"MapIn|FlatMap|\w*EvalPython", node) else ""
        if kind == "python" and above and above[-1][1] == "python":
            found.append(node)
        above += [(depth, kind)] if kind else []
    return found


def test_one_python_process_a_task(spark, capsys):
    assert nested_python("MapInArrow a\n+- *(1) Project\n   +- FlatMapCoGroupsInArrow b\n      :- Exchange\n      :  +- MapInArrow c") == ["FlatMapCoGroupsInArrow b"]
    docs = spark.createDataFrame([(1, "x" * 300, "en"), (2, None, "de")], "doc_id long, text string, lang string")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("suffix dedup", "packing"):
            capsys.readouterr()
            stage(spark, docs, SF_DIR).explain()
            plan = capsys.readouterr().out
            assert "InArrow" in plan or "InPandas" in plan
            assert nested_python(plan) == [], name


def test_tasks_hand_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(frames, "give_back", lambda: calls.append(len(seen)))
    batch, seen = pa.RecordBatch.from_pydict({"n": [1, 2]}), []
    for part in frames.tidy(lambda batches: (b.slice(1) for b in batches))(iter([batch, batch])):
        seen.append(part.to_pydict())
    # once, after the last batch
    assert seen == [{"n": [2]}] * 2 and calls == [2]
    monkeypatch.undo()
    frames.give_back()
