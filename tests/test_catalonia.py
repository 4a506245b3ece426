"""Positioned lines of the Catalan bulletin to records."""

from pyspark.sql import functions as F

from syllabica.operators import catalonia as K
from tests.conftest import rows


def line_table(spark, documents):
    """{doc: [(page, x, y, size, bold, text)]} in reading order."""
    data = [(d, i, p, float(x), float(y), float(s), b, t) for d, items in documents.items() for i, (p, x, y, s, b, t) in enumerate(items)]
    return spark.createDataFrame(data, "doc_id string, seq bigint, page int, x double, y double, size double, bold boolean, text string")


def line(page, y, text, x=85, size=10, bold=False):
    return page, x, y, size, bold, text


MATHS = [
    line(1, 50, "Matemàtiques", size=20), line(1, 80, "Decret 175/2022 de currículum"), line(1, 90, "Competència específica 1"),
    line(1, 100, "Interpretar problemes"), line(1, 110, "de la vida."), line(1, 120, "Criteris d’avaluació"),
    # the headings are centred over their columns, the text is set left: heights differ a little
    line(1, 131, "1r, 2n i 3r", x=173), line(1, 133, "4t", x=413), line(1, 145, "1.1 Llegir", x=91), line(1, 145, "1.1 Llegir més", x=313),
    line(1, 155, "enunciats.", x=91), line(1, 155, "i millor.", x=313), line(1, 165, "1.2. Resoldre.", x=91),
    line(2, 40, "Competència específica 2"), line(2, 50, "Raonar."), line(2, 60, "Criteris d'avaluacio"), line(2, 70, "1r, 2n i 3r", x=173), line(2, 70, "4t", x=413),
    line(2, 80, "sense codi", x=91), line(2, 90, "2.1 Provar.", x=91), line(2, 100, "2.1 Provar bé.", x=313), line(2, 101, "4t", x=413),
    line(3, 40, "Sabers", size=12), line(3, 50, "Sentit numèric.", bold=True), line(3, 60, "Quantitat", x=103), line(3, 70, "–", x=112), line(3, 70, "Nombres grans", x=120),
    line(3, 80, "i petits", x=120), line(3, 90, "Estimació", x=121), line(3, 100, "Sentit de la mesura", bold=True), line(3, 110, "Magnitud", x=104),
    line(3, 120, "Atributs", x=120),
]
CULTURE = [
    line(1, 50, "Cultura Científica (matèria optativa de quart d'ESO)", size=18), line(1, 60, "Criteris d'avaluació"), line(1, 70, "sense codi"),
    line(1, 80, "1.1. Analitzar"), line(1, 90, "conceptes."), line(2, 40, "Sabers", size=12), line(2, 50, "Bloc 1. La cèl·lula", bold=True),
    line(2, 60, "La teoria", x=103), line(2, 70, "cel·lular", x=103), line(2, 80, "Bloc 2. Buit", bold=True),
]
LANGUAGES = [
    line(1, 50, "Aranès i Literatura", size=18), line(1, 60, "Llengua Catalana", size=18), line(1, 70, "ESO", size=18),
    line(1, 80, "Competència específica 3"), line(1, 90, "Criteris d'avaluació"), line(1, 100, "1r i 2n", x=150), line(1, 110, "3.1 Parlar.", x=300),
]
LOST = [line(1, 50, "Robòtica", size=18), line(1, 60, "Criteris d'avaluació"), line(1, 70, "1.1 Muntar.")]


def test_records(spark):
    articles = spark.createDataFrame([("Robotica", ["4º ESO"])], "materia string, cursos array<string>")
    out = K.extract(line_table(spark, {"m": MATHS, "c": CULTURE, "l": LANGUAGES, "r": LOST, "x": [line(1, 5, "i")], "s": [line(1, 9, "Sense res", size=9)]}), articles)
    got = {(r["materia"], r["ciclo"]): r.asDict(recursive=True) for r in out["records"].collect()}
    assert sorted(got) == [("Aranès i Literatura", "1º ESO i 2º ESO"), ("Cultura Científica", "4º ESO"), ("Llengua Catalana", "1º ESO i 2º ESO"),
                           ("Matemàtiques", "1º ESO i 2º ESO i 3º ESO"), ("Matemàtiques", "4º ESO"), ("Robòtica", "4º ESO"), ("Sense res", "Únic")]
    low, high = got["Matemàtiques", "1º ESO i 2º ESO i 3º ESO"], got["Matemàtiques", "4º ESO"]
    assert low["competencias_especificas"] == high["competencias_especificas"] == [
        {"codigo": "1", "descripcion": "Interpretar problemes de la vida.", "descriptores": []}, {"codigo": "2", "descripcion": "Raonar.", "descriptores": []}]
    text = lambda r: [(c["codigo"], c["competencia"], c["descripcion"]) for c in r["criterios_evaluacion"]]
    assert text(low) == [("1.1", "1", "Llegir enunciats."), ("1.2", "1", "Resoldre."), ("2.1", "2", "Provar.")]
    # a later heading of the same section is a line of its body
    assert text(high) == [("1.1", "1", "Llegir més i millor."), ("2.1", "2", "Provar bé. 4t")]
    assert low["saberes_basicos"] == [
        {"codigo": "1", "bloque": "1. Sentit numèric · Quantitat", "titulo": "Sentit numèric · Quantitat", "items": ["Nombres grans i petits", "Estimació"]},
        {"codigo": "2", "bloque": "2. Sentit de la mesura · Magnitud", "titulo": "Sentit de la mesura · Magnitud", "items": ["Atributs"]}]
    culture = got["Cultura Científica", "4º ESO"]
    assert text(culture) == [("1.1", "1", "Analitzar conceptes.")]
    assert culture["saberes_basicos"] == [{"codigo": "1", "bloque": "1. Bloc 1. La cèl·lula", "titulo": "Bloc 1. La cèl·lula", "items": ["La teoria cel·lular"]}]
    assert text(got["Aranès i Literatura", "1º ESO i 2º ESO"]) == text(got["Llengua Catalana", "1º ESO i 2º ESO"]) == [("3.1", "3", "Parlar.")]
    assert rows(out["avisos"], "doc_id", "materia", "motivo") == [("s", "Sense res", "sin_criterios"), ("s", "Sense res", "sin_cursos"), ("x", None, "sin_titulo")]


def test_titles(spark):
    cases = {"Cultura Científica (matèria optativa de quart d'ESO)": "Cultura Científica", "Educació Visual de primer a tercer": "Educació Visual",
             "Llatí.": "Llatí", "Física d’ segon curs": "Física", "Música de cambra": "Música de cambra"}
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", K.clean_title(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == cases
