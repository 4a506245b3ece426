import hashlib
import json

import pytest
from pyspark.sql import functions as F

from syllabica.functions import codes as C
from syllabica.functions import content as K
from syllabica.functions import text as T
from syllabica.operators import quality as Q


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    out = df.select(fn(*[F.col(c) for c in df.columns]).alias("r")).first()[0]
    return out.asDict(recursive=True) if hasattr(out, "asDict") else out


@pytest.mark.parametrize("code, variants", [
    ("CE1", ["CE1", "1"]), ("CE 3", ["CE 3", "3", "CE3"]), ("CE-3", ["CE-3", "3"]), ("C.E. 5", ["C.E. 5", "5", "C.E.5"]),
    ("ce7", ["ce7", "7"]), ("A.3", ["A.3"]), ("1. 1", ["1. 1", "CE1. 1", "1.1"]), ("1", ["1", "CE1"]), ("CE", ["CE"]),
    ("criterio", ["criterio"]), ("—", ["—"]), ("", []), ("   ", []), (None, []),
])
def test_code_variants(spark, code, variants):
    assert one(spark, C.code_variants, code) == variants


@pytest.mark.parametrize("text, years, track", [
    ("Cursos de primero a tercero", ["1º ESO", "2º ESO", "3º ESO"], None), ("Cursos primero y segundo.", ["1º ESO", "2º ESO"], None),
    ("Cuarto curso: Matemáticas A", ["4º ESO"], "A"), ("Curso cuarto: Matemáticas B", ["4º ESO"], "B"),
    ("Primer curso", ["1º ESO"], None), ("Curso de cuarto", ["4º ESO"], None), ("Cursos de tercero a primero", [], None),
])
def test_year_markers(spark, text, years, track):
    found = one(spark, C.parse_years, text)
    assert (found["years"], found["track"]) == (years, track)


@pytest.mark.parametrize("text", ["El curso pasado fue largo", "curso quinto", "Primer", ""])
def test_not_year_markers(spark, text):
    assert one(spark, C.parse_years, text) is None


def test_catalan_years(spark):
    assert one(spark, C.header_years_ca, "1r, 2n i 3r") == ["1º ESO", "2º ESO", "3º ESO"]
    assert one(spark, C.header_years_ca, "1r curs") is None
    assert one(spark, C.title_years_ca, "Optativa de primer a tercer") == ["1º ESO", "2º ESO", "3º ESO"]
    assert one(spark, C.title_years_ca, "matèria optativa de quart d'ESO") == ["4º ESO"]


def test_descriptors(spark):
    hard = "Descriptores del Perfil de salida: STEM1, STEM9, CD2. CE1"
    assert one(spark, C.descriptors, hard) == ["STEM1", "CD2"]
    assert one(spark, C.descriptor_list, "STEM3, CD1, CPSAA3, CE3.") == ["STEM3", "CD1", "CPSAA3", "CE3"]
    assert one(spark, C.descriptor_list, "texto STEM3") is None
    assert len(C.DESCRIPTORS) == 34


def test_codes_taken_apart(spark):
    assert one(spark, C.parse_official_item, "BYG.1.A.8. Valor") == {
        "code": "BYG.1.A.8", "prefix": "BYG", "year": 1, "block": "A", "number": 8, "text": "Valor"}
    assert one(spark, C.parse_criterion, "1.1 Identificar los datos.")["code"] == "1.1"
    assert one(spark, C.parse_criterion, "1. Sin subnúmero") is None
    assert one(spark, C.cited_years, "GE\nH.3.A.2. BYG.1.A.1") == [1, 3]
    assert one(spark, C.dotted_order, "1.10") == [1, 10]


@pytest.mark.parametrize("line, out", [
    ("contenidos GE", "contenidos"), ("formatos GEH", "formatos"), ("norma UNE", "norma UNE"), ("letra G", "letra"),
])
def test_code_residue(spark, line, out):
    assert one(spark, C.drop_code_residue, line, "GEH") == out


@pytest.mark.parametrize("odd", [" ", " ", " "])
def test_odd_spaces(spark, odd):
    assert one(spark, T.norm_heading, f"Física y{odd}Química") == "Física y Química"


def test_normal_forms(spark):
    assert one(spark, T.fold, " ANDALUCÍA ñç") == "andalucia nc"
    assert one(spark, T.fold, "Año") == "ano"
    assert one(spark, T.name_key, "Llatí: Llengua i Cultura") == "llatillenguaicultura"
    assert one(spark, T.slug, "Educación Física") == "educacion_fisica"
    assert one(spark, lambda c: T.slug(c, "dash"), "Educación – Física") == "educacion-fisica"
    assert one(spark, lambda c: T.slug(c, "ascii"), "cèl·lula") == "cellula"
    assert one(spark, lambda c: T.slug(c, "file"), "¡Hola, qué!") == "hola-qué"
    assert one(spark, lambda c: T.slug(c, "file"), "¡!") == "situacion"
    assert one(spark, T.join_lines, "educació- n  x") == "educación x"
    assert one(spark, T.clean_title, "Valores Éticos.") == "Valores Éticos"
    assert one(spark, T.clean_cover_title, "Plàstica de primer a tercer (nota)") == "Plàstica"
    assert one(spark, T.is_bullet_only, " - ") is True
    assert one(spark, T.strip_bullet, "− Estrategias") == "Estrategias"


@pytest.mark.parametrize("address, masked", [
    ("ana.perez@ejemplo.es", "a*******z@ejemplo.es"), ("ab@x.es", "a*@x.es"), ("@x", "*@x"), ("nada", "****"), (None, None), ("", None),
])
def test_mask_email(spark, address, masked):
    assert one(spark, T.mask_email, address) == masked


def test_fingerprint(spark):
    assert one(spark, T.fingerprint, "es", "hola") == hashlib.sha256(b"es\x00hola").hexdigest()[:16]


def test_spoken_text(spark):
    assert one(spark, T.spoken_text, "Text — amb guió") == "Text , amb guió"
    assert one(spark, T.spoken_text, "ikaskuntza-egoera") == "ikaskuntza-egoera"
    assert one(spark, T.encode_spoken, "ŵ é") == {"text": "w e", "lost": 2}
    assert one(spark, T.encode_spoken, "é ñ") == {"text": "é ñ", "lost": 0}


def test_damage_ignores_line_feeds(spark):
    assert one(spark, Q.damage_count, "a\nb\tc") == 0
    assert one(spark, Q.damage_count, "a\x07b�") == 2


@pytest.mark.parametrize("content", [
    "null", "{}", '{"conexion_curricular":{"competencias":null}}', '{"conexion_curricular":{"competencias":"CE1"}}',
    '{"conexion_curricular":{"competencias":[{"x":1},{"codigo":" "},{"codigo":null},3]}}', '{"conexion_curricular":"x"}', "roto", None,
])
def test_twisted_content_cites_nothing(spark, content):
    assert one(spark, lambda c: K.cited_codes(c, "competencias"), content) == []


def test_cited_codes_in_order(spark):
    content = '{"conexion_curricular":{"competencias":["CE2",{"codigo":" CE1 "},"CE2"]}}'
    assert one(spark, lambda c: K.cited_codes(c, "competencias"), content) == ["CE2", "CE1"]


def test_rewrite_keeps_unknown_keys_and_orphans(spark):
    content = ('{"descripcion":{"t":"CE1"},"conexion_curricular":{"z":1,"competencias":[{"codigo":"CE1","n":2},"CE1"],'
               '"criterios":[{"codigo":"9.9","competencia":"CE1"}]}}')
    out = json.loads(one(spark, lambda c: K.rewrite_codes(c, F.create_map(F.lit("CE1"), F.lit("1"))), content))
    assert out["descripcion"] == {"t": "CE1"}
    assert out["conexion_curricular"] == {
        "z": 1, "competencias": [{"codigo": "1", "n": 2}, "CE1"], "criterios": [{"codigo": "9.9", "competencia": "1"}]}


ALL = '{"competencias":[1],"criterios":[1],"saberes":[1]}'


@pytest.mark.parametrize("section, payload, gone", [
    ("conexion_curricular", ALL, []), ("conexion_curricular", '{"competencias":[1],"saberes":[1]}', ["criterios"]),
    ("conexion_curricular", '{"competencias":[1],"criterios":[],"saberes":[1]}', ["criterios"]),
    ("conexion_curricular", "{}", ["competencias", "criterios", "saberes"]),
    ("conexion_curricular", '{"_error_parseo":true}', []), ("descripcion", "{}", []), ("objetivos", '{"objetivos":0}', ["objetivos"]),
])
def test_missing_parts(spark, section, payload, gone):
    assert one(spark, K.missing_parts, section, payload) == gone


def test_sections(spark):
    assert json.loads(one(spark, K.merge_section, '{"a":1,"b":2}', "a", '{"q":3}')) == {"a": {"q": 3}, "b": 2}
    assert one(spark, K.section_of, '{"a":1}', "b") is None
    assert one(spark, K.schema_drift, '{"a":1,"_meta":2}', '{"a":2}')["accepted"] is True
    assert one(spark, K.schema_drift, '{"a":1,"b":2}', '{"a":2,"c":1}') == {"missing": ["b"], "added": ["c"], "accepted": False}


def test_permissions(spark):
    need = ["leer", "crear"]
    for raw, ok in [('["leer","crear","x"]', True), ('["leer"]', False), ('{"leer":true,"crear":1}', True), ('{"leer":true,"crear":false}', False), ("3", False)]:
        assert one(spark, lambda c: Q.has_permissions(c, need), raw) is ok


def test_contracts(spark):
    content = json.dumps({"conexion_curricular": {"competencias": ["1"], "criterios": ["1", "2", "3"], "saberes": ["1"] * 9}})
    assert one(spark, Q.contract_breaches, content) == ["competencias:numero", "saberes:numero"]
    assert one(spark, Q.contract_breaches, "{}") == []
