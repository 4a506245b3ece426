"""Upserts, purges, splits, versions: trap rows, and jobs run twice."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from syllabica.functions import regions as geo
from syllabica.operators import catalogue as cat
from syllabica.operators import documents as docs
from syllabica.operators import providers as prov
from syllabica.operators import relabel
from syllabica.operators import retention as ret
from syllabica.operators import versions as ver
from syllabica.operators.ordered import width_bucket
from tests.conftest import rows

NOW = datetime(2024, 6, 1)


def test_purge_boundary_and_cascade(spark):
    marks = [None, 30 * 86400, 90 * 86400 - 1, 90 * 86400, 90 * 86400 + 1]
    users = spark.createDataFrame(
        [(i, NOW - timedelta(seconds=s) if s is not None else None) for i, s in enumerate(marks)], "id_usuario bigint, eliminado_en timestamp_ntz")
    documents = spark.createDataFrame([(10 + i, i) for i in range(5)] + [(20, 4)], "id_situacion bigint, id_usuario bigint")
    versions = spark.createDataFrame([(d, n) for d in (10, 13, 20) for n in (1, 2)], "id_situacion bigint, numero_version int")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    out = ret.purge(users, documents, {"versions": versions}, now)
    assert rows(out["users"], "id_usuario") == [(0,), (1,), (2,)]
    assert rows(out["documents"], "id_situacion") == [(10,), (11,), (12,)]
    assert rows(out["versions"], "id_situacion", "numero_version") == [(10, 1), (10, 2)]
    assert rows(out["purged"], "id_usuario", "situaciones") == [(3, 1), (4, 2)]
    again = ret.purge(out["users"], out["documents"], {"versions": out["versions"]}, now)
    assert rows(again["purged"]) == [] and rows(again["documents"]) == rows(out["documents"])


def test_choices_and_adaptations_survive_deletes(spark):
    choices = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id_eleccion bigint, id_situacion bigint")
    gone = spark.createDataFrame([(5,)], "id_situacion bigint")
    assert rows(ret.clear_reference(choices, gone, "id_situacion", "id_situacion"), "id_eleccion", "id_situacion") == [
        (1, None), (2, 6), (3, None)]


def test_zero_counts(spark):
    empty = spark.createDataFrame([], "id_usuario bigint, estado string")
    assert rows(docs.state_counts(empty), "n") == [(0,)] * 5
    odd = spark.createDataFrame([(1, "borrador"), (1, "rara")], "id_usuario bigint, estado string")
    assert dict(rows(docs.state_counts(odd), "estado", "n"))["rara"] == 1
    users = spark.createDataFrame([(1,), (2,)], "id_usuario bigint")
    assert rows(docs.users_with_counts(users, odd, ["borrador"]), "id_usuario", "total", "borrador") == [(1, 2, 1), (2, 0, 0)]


@pytest.mark.parametrize("states, verdict", [(["generando", "error_generacion"], "provisional"), (["error_generacion"], "definitivo"), (["borrador"], "sin_errores")])
def test_error_report(spark, states, verdict):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "id_situacion bigint, estado string")
    assert docs.error_report(df).first()["veredicto"] == verdict


def test_page_breaks_ties_and_holds_the_limit(spark):
    df = spark.createDataFrame([(i, NOW) for i in range(150)], "id_situacion bigint, fecha_modificacion timestamp")
    assert [r[0] for r in docs.page(df, 2, 1).collect()] == [148, 147]
    assert docs.page(df, 100).count() == 100
    for size in (0, 9999):
        with pytest.raises(ValueError):
            docs.page(df, size)


def listing(spark, *data):
    schema = "comunidad string, codigo string, materia string, idioma string, cursos_aplicables array<string>, descriptores array<string>, descripcion string, carga bigint"
    return spark.createDataFrame(list(data), schema)


def test_upsert_merges_and_repeats(spark):
    new = listing(
        spark, ("ceuta", "CE1", "M", "es", ["2º ESO"], ["STEM1"], "vieja", 1), ("ceuta", "CE1", "M", "es", ["1º ESO"], ["CD1"], "nueva", 2),
        ("cataluna", "CE1", "M", "ca", ["1º ESO"], [], "otra", 3))
    first = cat.upsert_competences(None, new)
    wanted = ["comunidad", "cursos_aplicables", "descriptores", "descripcion", "id_competencia"]
    assert rows(first, *wanted[:4]) == [("cataluna", ["1º ESO"], [], "otra"), ("ceuta", ["1º ESO", "2º ESO"], ["CD1", "STEM1"], "nueva")]
    assert cat.load_counts(first).first().asDict() == {"nuevas": 2, "actualizadas": 1}
    second = cat.upsert_competences(first, new)
    assert rows(second, *wanted) == rows(first, *wanted)
    assert cat.load_counts(second).first().asDict() == {"nuevas": 0, "actualizadas": 3}


def test_criteria_key_has_the_sorted_years(spark):
    schema = "comunidad string, codigo string, materia string, idioma string, cursos_aplicables array<string>, descripcion string, id_competencia bigint, carga bigint"
    new = spark.createDataFrame([
        ("c", "1.1", "M", "es", ["2º ESO", "1º ESO"], "a", 1, 1), ("c", "1.1", "M", "es", ["1º ESO", "2º ESO"], "b", 2, 2), ("c", "1.1", "M", "es", ["3º ESO"], "c", 1, 3)], schema)
    assert rows(cat.upsert_criteria(None, new), "cursos_aplicables", "descripcion", "id_competencia") == [(["1º ESO", "2º ESO"], "b", 2), (["3º ESO"], "c", 1)]


def split_tables(spark):
    old, y = "Tecnología", ["2º ESO", "3º ESO", "4º ESO"]
    comp = [(n, "ceuta", f"CE{n}", old, y if n < 7 else y[:2]) for n in range(1, 8)]
    crit = [(f"{n}-{c}", f"{n}.1", old, [c], n) for c in y for n in range(1, 8) if not (n == 7 and c == y[2])]
    return {
        "competencias": spark.createDataFrame(comp, "id_competencia bigint, comunidad string, codigo string, materia string, cursos_aplicables array<string>"),
        "criterios": spark.createDataFrame(crit, "id_criterio string, codigo string, materia string, cursos_aplicables array<string>, id_competencia bigint"),
        "saberes": spark.createDataFrame([(i, old, [c]) for i, c in enumerate(y)], "id_saber bigint, materia string, cursos_aplicables array<string>"),
        "enlaces": spark.createDataFrame([(1, 1)], "id_situacion bigint, id_competencia bigint"),
        "situaciones": spark.createDataFrame([(1, old, "2º ESO"), (2, old, "4º ESO")], "id_situacion bigint, materia string, curso string"),
    }


def per_subject(df):
    return dict(rows(df.groupBy("materia").count()))


def test_subject_split_and_back(spark):
    old, new = "Tecnología", "Tecnología y Digitalización"
    out = relabel.split_subject(split_tables(spark), old, new, "4º ESO", ["2º ESO", "3º ESO"])
    assert per_subject(out["competencias"]) == {new: 7, old: 6}
    assert per_subject(out["criterios"]) == {new: 14, old: 6}
    assert per_subject(out["saberes"]) == {new: 2, old: 1}
    assert rows(out["situaciones"]) == [(1, new, "2º ESO"), (2, old, "4º ESO")]
    parent = out["competencias"].select("id_competencia", F.col("materia").alias("m"))
    assert out["criterios"].join(parent, "id_competencia").where("m <> materia").count() == 0
    assert out["enlaces"].join(out["competencias"], "id_competencia").count() == 1
    back = relabel.merge_subjects(out, old, new)
    assert per_subject(back["criterios"]) == {old: 20} and per_subject(back["competencias"]) == {old: 7}
    assert back["criterios"].join(back["competencias"].select("id_competencia"), "id_competencia", "left_anti").count() == 0


@pytest.mark.parametrize("track, math", [(None, None), ("A", "Matemáticas A"), ("B", "Matemáticas B")])
def test_reassignment(spark, track, math):
    df = spark.createDataFrame([
        (1, "Lengua Castellana y Literatura", "4º ESO", False), (2, "Tecnología y Digitalización", "4º ESO", False), (3, "Matemáticas", "4º ESO", False),
        (4, "Música", "1º ESO", True)], "id_situacion bigint, materia string, curso string, con_curriculo boolean")
    history = spark.createDataFrame([(1, 3)], "id_situacion bigint, numero_version int")
    out = relabel.reassignment_job(df, history, width_bucket("id_situacion"), track)
    assert dict(rows(out["documents"], "id_situacion", "materia")) == {1: "Lengua", 2: "Tecnología", 3: math or "Matemáticas", 4: "Música"}
    assert rows(out["unmatched"], "id_situacion") == ([] if math else [(3,)])
    kept = {r.id_situacion: (r.numero_version, json.loads(r.contenido)["materia"]) for r in out["versions"].collect()}
    assert kept[1] == (4, "Lengua Castellana y Literatura") and kept[2][0] == 1 and 4 not in kept


def test_restore_only_one_section(spark):
    df = spark.createDataFrame([(1, '{"a":{"v":9},"b":{"v":9}}'), (2, '{"a":{"v":9}}')], "id_situacion bigint, contenido string")
    old = spark.createDataFrame(
        [(1, 1, '{"a":{"v":1}}'), (1, 2, '{"a":{"v":2}}'), (1, 3, '{"b":{"v":3}}'), (2, 1, '{"b":1}')], "id_situacion bigint, numero_version int, contenido string")
    got = {r.id_situacion: (json.loads(r.contenido), r.resultado) for r in ver.restore_section(df, old, "a").collect()}
    assert got == {1: ({"a": {"v": 2}, "b": {"v": 9}}, "restaurada"), 2: ({"a": {"v": 9}}, "sin_version_previa")}


def test_choice_keeps_the_provenance_of_both(spark):
    text = '{"s":{"t":"a","_meta":{"proveedor":"gemini","version_prompt":"v1"},"_alternativa":{"t":"b","_meta":{"proveedor":"fake"}}},"o":1}'
    df = spark.createDataFrame([(1, 7, text)], "id_situacion bigint, id_usuario bigint, contenido string")
    pick = spark.createDataFrame([(1, "s", "alternativa")], "id_situacion bigint, seccion string, cual string")
    none = spark.createDataFrame([], "id_situacion bigint, numero_version int")
    out = ver.resolve_proposals(df, pick, none, width_bucket("id_situacion"))
    choice = out["choices"].first()
    assert json.loads(choice.meta_elegida)["proveedor"] == "fake" and json.loads(choice.meta_descartada)["proveedor"] == "gemini"
    assert (choice.variante_elegida, choice.variante_descartada) == ("?", "v1")
    assert json.loads(out["documents"].first().contenido) == {"s": {"t": "b", "_meta": {"proveedor": "fake"}}, "o": 1}
    assert "_alternativa" in json.loads(json.loads(out["versions"].first().contenido)["contenido"])["s"]


def test_failed_operation_restores_the_state(spark):
    data = [("finalizada", "seccion_generada", "finalizada"), ("borrador", "seccion_generada", "generada"), ("generada", "operacion_fallida", "generada"),
            ("borrador", "error", "error_generacion"), ("finalizada", "inicio", "generando")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(data)], "id_situacion bigint, estado_previo string, evento string")
    assert [r[1] for r in rows(ver.next_states(df), "id_situacion", "estado_nuevo")] == [c for _, _, c in data]


@pytest.mark.parametrize("text, code", [
    ("Andalucía", "andalucia"), ("ANDALUCIA", "andalucia"), ("Euskadi", "pais-vasco"), ("pais vasco", "pais-vasco"), ("Castilla-La Mancha", "castilla-la-mancha"),
    ("Comunitat Valenciana", "valencia"), ("Atlántida", None), ("", None), (None, None)])
def test_region_texts(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string")
    assert geo.region_code(df, "t").first()["comunidad"] == code


def test_region_of_a_row_and_clearing(spark):
    df = spark.createDataFrame(
        [(1, "Lérida", "Andalucía"), (2, "Nada", "andalucia"), (3, None, None), (4, "Araba/Álava", None)], "id int, provincia string, comunidad_autonoma string")
    assert rows(geo.row_region(df), "id", "comunidad") == [(1, "cataluna"), (2, "andalucia"), (3, None), (4, "pais-vasco")]
    cleared = geo.set_province(df.withColumnRenamed("provincia", "nueva"), "nueva")
    assert rows(cleared, "id", "provincia", "comunidad_autonoma") == [(1, "lleida", "Cataluña"), (2, None, None), (3, None, None), (4, "araba", "País Vasco")]
    assert len(geo.REGIONS) == 19 and len(geo.PROVINCES) == 52


def test_model_list_adopts_a_later_label(spark):
    df = spark.createDataFrame([(1, "m1, m2|Dos,, m1|Uno, m2|Otro, |x")], "k int, l string")
    assert rows(prov.model_list(df, "k", "l"), "pos", "id", "etiqueta") == [(0, "m1", "Uno"), (1, "m2", "Dos")]


def test_patches(spark):
    from syllabica.operators.quality import apply_patches

    df = spark.createDataFrame([(i, "borrador", "t") for i in range(4)], "id_situacion bigint, estado string, titulo string")
    p = spark.createDataFrame([(0, {"titulo": None}), (1, {"estado": "generando", "titulo": "x"}), (2, {})], "id_situacion bigint, cambios map<string,string>")
    assert rows(apply_patches(df, p, ["estado", "titulo"]), "id_situacion", "estado", "titulo", "resultado") == [
        (0, "borrador", None, "aplicado"), (1, "borrador", "t", "estado_no_editable"), (2, "borrador", "t", "sin_cambios"), (3, "borrador", "t", None)]
