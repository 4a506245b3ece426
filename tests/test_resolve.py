"""Trap rows: same code in another subject, year or region; null subjects."""

import json

import pytest

from syllabica.operators import coverage as cov
from syllabica.operators import resolve as res
from syllabica.operators.relabel import reassign
from syllabica.plans.resolving import event_contents
from tests.conftest import rows

CATALOGUE = "id bigint, comunidad string, kind string, codigo string, materia string, cursos_aplicables array<string>"
DOCS = "id_situacion bigint, comunidad string, materia string, curso string, contenido string"


@pytest.fixture(scope="module")
def catalogue(spark):
    m, y = "Matemáticas A", ["4º ESO"]
    return spark.createDataFrame([
        (1, "ceuta", "competencias", "CE1", m, y), (2, "ceuta", "competencias", "CE1", "Biología y Geología", y),
        (3, "ceuta", "competencias", "CE2", m, y), (4, "ceuta", "competencias", "CCL", None, []),
        (5, "ceuta", "criterios", "1.1", m, y), (6, "ceuta", "criterios", "1.1", m, ["1º ESO"]),
        (7, "ceuta", "saberes", "A.3", m, y), (8, "cataluna", "competencias", "CE1", m, y),
        (9, "cataluna", "competencias", "1", "Música", y), (10, "cataluna", "criterios", "1.1", "Música", y),
    ], CATALOGUE)


def document(number, region, subject, year, **lists):
    return (number, region, subject, year, json.dumps({"conexion_curricular": lists}))


def resolved(spark, catalogue, *docs):
    frame = spark.createDataFrame(list(docs), DOCS)
    cited = res.citations_of(frame)
    return cited, res.resolve_codes(cited, frame, catalogue), frame


def test_only_the_scope_of_the_document(spark, catalogue):
    doc = document(1, "ceuta", "Matemáticas A", "4º ESO", competencias=["CE1", "CCL"], criterios=[{"codigo": "1.1"}], saberes=["A.3"])
    _, found, _ = resolved(spark, catalogue, doc)
    assert rows(found, "codigo", "id") == [("1.1", 5), ("A.3", 7), ("CCL", 4), ("CE1", 1)]


def test_invented_codes_are_orphans(spark, catalogue):
    doc = document(1, "ceuta", "Matemáticas A", "4º ESO", competencias=["CE1", "CE99"], criterios=["9.9"])
    cited, found, _ = resolved(spark, catalogue, doc)
    assert rows(res.orphan_codes(cited, found), "codigo") == [("9.9",), ("CE99",)]


def test_first_citation_owns_a_shared_spelling(spark, catalogue):
    doc = document(1, "cataluna", "Música", "4º ESO", competencias=["CE1", "1"])
    cited, found, _ = resolved(spark, catalogue, doc)
    assert rows(found, "codigo", "id") == [("CE1", 9)]
    assert rows(res.orphan_codes(cited, found), "codigo") == [("1",)]


def test_unknown_region_sees_nothing(spark, catalogue):
    _, found, _ = resolved(spark, catalogue, document(1, None, "Matemáticas A", "4º ESO", competencias=["CE1", "CCL"]))
    assert rows(found) == []


def test_causes_are_kept_apart(spark, catalogue):
    docs = (
        document(1, "ceuta", "Matemáticas", "4º ESO", competencias=["CE1"]),
        document(2, "ceuta", "Matemáticas A", "4º ESO", competencias=["CE99"]),
        document(3, "ceuta", "Matemáticas A", "4º ESO", competencias=["CE1"]),
    )
    frame = spark.createDataFrame(list(docs), DOCS)
    out = res.rebuild_links(frame, catalogue)
    assert rows(out["summary"], "id_situacion", "causa", "competencias") == [
        (1, "sin_curriculo", 0), (2, "inventados", 0), (3, "limpio", 1)]
    assert rows(res.missing_pair_counts(out["summary"])) == [("Matemáticas", "4º ESO", 1)]


def test_rewritten_documents(spark, catalogue):
    doc = document(
        1, "cataluna", "Música", "4º ESO", competencias=[{"codigo": "CE1"}], criterios=[{"codigo": "1.1", "competencia": "CE1"}])
    out = res.rebuild_links(spark.createDataFrame([doc], DOCS), catalogue)["documents"].first()
    section = json.loads(out["contenido"])["conexion_curricular"]
    assert section == {"competencias": [{"codigo": "1"}], "criterios": [{"codigo": "1.1", "competencia": "1"}]}
    assert out["cambiado"] and out["codigos_normalizados"] == ["CE1"]


def test_claimed_spellings_are_rewritten_too(spark, catalogue):
    doc = document(1, "cataluna", "Música", "4º ESO", competencias=[{"codigo": "CE1"}, {"codigo": "C.E. 1"}])
    out = res.rebuild_links(spark.createDataFrame([doc], DOCS), catalogue)
    section = json.loads(out["documents"].first()["contenido"])["conexion_curricular"]
    assert section == {"competencias": [{"codigo": "1"}, {"codigo": "1"}]}
    assert rows(out["summary"], "huerfanos") == [(1,)]


def test_rebuild_twice_changes_nothing(spark, catalogue):
    doc = document(1, "cataluna", "Música", "4º ESO", competencias=["CE1"])
    frame = spark.createDataFrame([doc], DOCS)
    first = res.rebuild_links(frame, catalogue)
    again = res.rebuild_links(first["documents"].select(*frame.columns), catalogue)
    assert rows(res.link_changes(first["links"], again["links"])) == []


def test_coverage(spark):
    schema = "comunidad string, materia string, cursos_aplicables array<string>"
    three = [("ceuta", "Matemáticas", ["1º ESO", "2º ESO", "3º ESO"]), ("ceuta", "Matemáticas A", ["4º ESO"])]
    comp = spark.createDataFrame([*three, ("ceuta", "Latín", ["4º ESO"]), ("ceuta", None, ["1º ESO"])], schema)
    rest = spark.createDataFrame(three, schema)
    table = cov.coverage_by_subject(cov.complete_pairs(comp, rest, rest))
    assert rows(table, "materia", "cursos") == [("Matemáticas", ["1º ESO", "2º ESO", "3º ESO"]), ("Matemáticas A", ["4º ESO"])]
    assert rows(cov.subjects_of(table, "4º ESO")) == [("Matemáticas A",)]


def test_alternatives_for_missing_pairs(spark):
    pairs = spark.createDataFrame([("ceuta", "Matemáticas A", "4º ESO"), ("ceuta", "Matemáticas B", "4º ESO")], "comunidad string, materia string, curso string")
    docs = spark.createDataFrame([
        (1, "ceuta", "Matemáticas", "4º ESO"), (2, None, "Matemáticas A", "4º ESO"), (3, "ceuta", "Matemáticas A", "4º ESO")],
        "id_situacion bigint, comunidad string, materia string, curso string")
    assert rows(cov.alternatives(docs, pairs), "id_situacion", "motivo", "alternativas") == [
        (1, "sin_curriculo", ["Matemáticas A", "Matemáticas B"]), (2, "sin_comunidad", [])]


def test_citations_are_spelled_after_their_documents_are_dealt(spark):
    cited = spark.createDataFrame([(1, "criterios", "CE 1", 0), (1, "criterios", "CE1", 1), (2, "criterios", "1", 0)],
                                  "id_situacion bigint, kind string, codigo string, pos bigint")
    found = res.owned_variants(cited)
    assert rows(found, "id_situacion", "variante", "codigo", "rank") == [
        (1, "1", "CE 1", 1), (1, "CE 1", "CE 1", 0), (1, "CE1", "CE 1", 2), (2, "1", "1", 0), (2, "CE1", "1", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # one shuffle, below the spelling: the task that reads the citations sorts nothing
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_documents_of_a_small_file_are_dealt(spark):
    found = event_contents(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_rules_of_a_reassignment_go_to_the_documents(spark):
    docs = spark.createDataFrame([(1, "VIEJA", "1º ESO", False), (2, "VIEJA", None, False)],
                                 "id_situacion bigint, materia string, curso string, con_curriculo boolean")
    parts = reassign(docs, [("VIEJA", "1º ESO", "NUEVA", "1º ESO")])
    assert rows(parts["reassigned"], "id_situacion", "materia_nueva") == [(1, "NUEVA")]
    assert rows(parts["unmatched"], "id_situacion") == [(2,)]
    assert "hashpartitioning" not in parts["reassigned"]._jdf.queryExecution().executedPlan().toString()
