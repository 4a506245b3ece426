"""Rules with several rows per document, other scripts, and whole files."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from syllabica.functions import content as K
from syllabica.functions import text as T
from syllabica.operators import paragraphs as P
from syllabica.operators import versions as ver
from syllabica.operators.ordered import width_bucket
from syllabica.operators.quality import apply_patches
from syllabica.plans import streams
from syllabica.sources import catalogue_files as files
from syllabica.streaming import jobs
from tests.conftest import rows

TEXTS = ["Ά Й й ñ Ç", "1º ESO 2ª", "ﬁn ½ ™ ﬃ", "Ǆ ǆ １２ ①", "é é ḗ", "한국어 क्षि", "Straße", "№ ℌ"]


def python_fold(text, form):
    return "".join(p for p in unicodedata.normalize(form, text) if unicodedata.category(p) != "Mn")


@pytest.mark.parametrize("form", ["NFD", "NFKD"])
def test_letters_of_every_script(spark, form):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = dict(rows(df.select("i", T.bare_letters(F.col("t"), form).alias("b"))))
    hangul = {5: "한국어 " + python_fold("क्षि", form)}  # syllables stay whole
    assert got == {i: hangul.get(i, python_fold(t, form)) for i, t in enumerate(TEXTS)}


def test_slugs_keys_and_spoken_text(spark):
    df = spark.createDataFrame([("1º ESO ½",)], "t string")
    got = df.select(T.slug(F.col("t"), "dash").alias("a"), T.name_key(F.col("t")).alias("b"), T.encode_spoken(F.lit("™ ½ ά")).alias("c")).first()
    assert (got.a, got.b) == ("1o-eso-1-2", "1oeso12")
    assert got.c["text"] == "TM 12 "
    assert T.slug(F.lit("x" * 80), "file") is not None
    long = df.select(T.slug(F.lit("palabra " * 12), "file").alias("s"), T.slug(F.lit("palabra " * 12), "file", 50).alias("t")).first()
    assert len(long.s) == 95 and len(long.t) == 50


def test_every_year_seen(spark):
    data = [(1, 0, "1.1", [1], "Uno"), (1, 1, "1.1", [3], "dos"), (1, 2, "1.1", [], "tres"), (1, 3, "2.1", [], "sin")]
    df = spark.createDataFrame(data, "doc_id int, seq int, codigo string, cursos array<int>, text string")
    assert rows(P.criteria_by_year(df), "codigo", "curso", "text") == [("1.1", 1, "Uno tres"), ("1.1", 3, "dos tres")]


def test_text_that_is_no_json_misses_nothing(spark):
    df = spark.createDataFrame([("no es json",), ('{"competencias":[],"criterios":["1"],"saberes":["A"]}',)], "p string")
    got = df.select(K.missing_parts(F.lit("conexion_curricular"), F.col("p")).alias("m")).collect()
    assert [r.m for r in got] == [[], ["competencias"]]


def test_two_sections_of_one_document(spark):
    docs = spark.createDataFrame([(1, '{"a":1,"c":3}'), (2, "{}")], "id_situacion bigint, contenido string")
    new = spark.createDataFrame([(1, "a", '{"v":1}', 1), (1, "b", "[2]", 1), (1, "a", '{"v":2}', 2)], "id_situacion bigint, seccion string, payload string, n int")
    got = {r.id_situacion: json.loads(r.contenido) for r in ver.merge_sections(docs, new, "n").collect()}
    assert got == {1: {"a": {"v": 2}, "b": [2], "c": 3}, 2: {}}


def test_two_decisions_on_one_document(spark):
    text = json.dumps({s: {"t": "a", "_alternativa": {"t": "b"}} for s in ("s", "u")} | {"o": 1})
    docs = spark.createDataFrame([(1, 7, text), (2, 7, "{}")], "id_situacion bigint, id_usuario bigint, contenido string")
    picks = spark.createDataFrame([(1, "s", "alternativa"), (1, "u", "actual"), (1, "x", "actual"), (2, "s", "actual")], "id_situacion bigint, seccion string, cual string")
    history = spark.createDataFrame([(1, 4)], "id_situacion bigint, numero_version int")
    out = ver.resolve_proposals(docs, picks, history, width_bucket("id_situacion"))
    assert [json.loads(r.contenido) for r in out["documents"].collect()] == [{"s": {"t": "b"}, "u": {"t": "a"}, "o": 1}]
    assert rows(out["versions"], "id_situacion", "numero_version") == [(1, 5), (1, 6)]
    assert rows(out["choices"], "seccion", "posicion_elegida") == [("s", "alternativa"), ("u", "actual")]


def test_two_patches_of_one_document(spark):
    docs = spark.createDataFrame([(i, "borrador", "t") for i in (1, 2)], "id_situacion bigint, estado string, titulo string")
    patches = spark.createDataFrame(
        [(1, {"titulo": "x"}, 1), (1, {"titulo": "y", "estado": "finalizada"}, 2), (1, {"estado": "generando"}, 3), (2, {"estado": "generando"}, 1)],
        "id_situacion bigint, cambios map<string,string>, n int")
    got = rows(apply_patches(docs, patches, ["estado", "titulo"], "n"), "id_situacion", "estado", "titulo", "resultado")
    assert got == [(1, "finalizada", "y", "aplicado"), (2, "borrador", "t", "estado_no_editable")]


def test_all_records_of_a_file(spark, tmp_path):
    one = {"materia": "Música", "cursos_aplicables": ["1º ESO"]}
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(one | {"materia": f"M{i}"}) for i in range(5)) + "\n", encoding="utf-8")
    (tmp_path / "array.json").write_text(json.dumps([one, one | {"materia": "Otra"}], indent=2), encoding="utf-8")
    (tmp_path / "whole.json").write_text(json.dumps(one, indent=2), encoding="utf-8")
    (tmp_path / "broken.json").write_text('{"materia": ', encoding="utf-8")
    found = files.read_catalogue(spark, str(tmp_path))
    assert sorted(r[0] for r in rows(found, "materia")) == ["M0", "M1", "M2", "M3", "M4", "Música", "Música", "Otra"]
    assert found.select("fichero").distinct().count() == 8
    assert files.unreadable_records(spark, str(tmp_path)).count() == 1


def test_stream_over_a_folder_table(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    for sf_dir in (str(tmp_path), "/root/testdata/sf0.001"):
        target = tmp_path / f"out{len(sf_dir)}"
        stream = streams._events(spark, sf_dir)
        jobs.run_append(stream, str(target / "rows"), str(target / "control")).awaitTermination()
        assert spark.read.parquet(str(target / "rows")).count() == batch.count()
