"""Positioned lines and table cells of one bulletin to records."""

from pyspark.sql import functions as F

from syllabica.functions import codes as C
from syllabica.operators import andalusia as A
from syllabica.sources.tables import cut_lineage
from tests.conftest import rows


def line_table(spark, items):
    """(page, x, bold, in_table, text) in reading order."""
    data = [("d", i, p, float(x), float(i), b, t, text) for i, (p, x, b, t, text) in enumerate(items)]
    return spark.createDataFrame(data, "doc_id string, seq bigint, page int, x double, y double, bold boolean, in_table boolean, text string")


def cell_table(spark, tables):
    """{(page, table_no): rows}; a null cell is empty."""
    data = [("d", p, n, r, c, len(row), text) for (p, n), table in tables.items() for r, row in enumerate(table) for c, text in enumerate(row)]
    return spark.createDataFrame(data, "doc_id string, page int, table_no int, row int, col int, n_cols int, text string")


def title(page, text, in_table=False):
    return (page, 220, True, in_table, text)


def plain(page, text):
    return (page, 64, False, False, text)


def bold(page, text):
    return (page, 64, True, False, text)


MUSIC = [
    title(0, "ANEXO II"), title(1, "Música."), title(2, "Música"), bold(2, "Competencias específicas."), bold(2, "1. Escuchar obras"), bold(2, "de todo tipo."),
    plain(2, "CCL1, CCEC2."), bold(2, "2."), bold(2, "Crear sonidos."), plain(2, "Número 104 - Boletín"), plain(3, "Saberes básicos."),
    plain(3, "A. Escucha."), plain(3, "MUS.1.A.1. Timbre y"), plain(3, "altura."), plain(3, "BYG.1.A.7. De otra materia."),
    title(4, "Música", in_table=True),
]
MUSIC_TABLES = {
    (3, 0): [["PRIMER CURSO", "TERCER CURSO"], ["MUS.1.A.2. Ritmo.\nMUS.1.A.3.", "MUS.3.A.1. Com-"], ["", "pás binario."], ["MUS.1.A.1. Tim", None]],
    (4, 0): [["Competencias", "Criterios de evaluación", "Saberes básicos", "Criterios de evaluación", "Saberes básicos"],
             ["1. Escuchar", "1.1. Oír con MU\natención y", "MUS.1.A.1.", "1.1. Tocar", "MU\nS.3.A.1."],
             [None, "2.1. Bailar", "MUS.1.A.2. MUS.3.A.1.", None, None]],
    (5, 0): [[None, "con gusto.\n1.10. Leer", "MUS.1.A.1.", "en grupo.\n9.9. Sin curso", None], [None, "2.1. y saltar.", None, None, None]],
    (6, 0): [[None, "sobra.\n1.1. Cantar", "MUS.4.A.1."], [None, "a voces.", None]],
}
MATHS = [title(7, "Matemáticas A"), plain(8, "A. Números."), plain(8, "MAA.4.A.1. Enteros."), title(9, "Vacía")]
MATHS_TABLES = {(8, 0): [["1. Contar\nbien", "1.1. Sumar", "MAA.4.A.1."], ["y pronto", "1.2. Restar", "MAA.4.A.1."]]}


def extract(spark, lines, tables):
    return A.extract(line_table(spark, lines), cell_table(spark, tables))


def test_whole_bulletin(spark):
    out = extract(spark, MUSIC + MATHS, MUSIC_TABLES | MATHS_TABLES)
    got = {(r["materia"], r["ciclo"]): r.asDict(recursive=True) for r in out["records"].collect()}
    assert sorted(got) == [("Matemáticas A", "4º ESO"), ("Música", "1º ESO"), ("Música", "3º ESO"), ("Música", "4º ESO")]
    first = got["Música", "1º ESO"]
    assert first["competencias_especificas"] == [
        {"codigo": "1", "descripcion": "Escuchar obras de todo tipo.", "descriptores": ["CCL1", "CCEC2"]},
        {"codigo": "2", "descripcion": "Crear sonidos.", "descriptores": []}]
    # the residue of the cut code goes; what follows on the next page is glued to the criterion left open in that column
    assert first["criterios_evaluacion"] == [
        {"codigo": "1.1", "competencia": "1", "descripcion": "Oír con atención y"},
        {"codigo": "1.10", "competencia": "1", "descripcion": "Leer"},
        {"codigo": "2.1", "competencia": "2", "descripcion": "Bailar y saltar."}]
    assert first["saberes_basicos"] == [{
        "codigo": "A", "bloque": "A. Escucha", "titulo": "Escucha", "items": ["Timbre y altura.", "Ritmo."],
        "codigos_items": ["MUS.1.A.1", "MUS.1.A.2"]}]
    third = got["Música", "3º ESO"]
    # a criterion of two years is continued in the last one; the other column has its own
    assert [(c["codigo"], c["descripcion"]) for c in third["criterios_evaluacion"]] == [("1.1", "Tocar en grupo."), ("2.1", "Bailar con gusto. y saltar.")]
    # pages are read whole, so the next title, on the last one, is read too
    assert third["saberes_basicos"][0]["items"] == ["Compás binario. Matemáticas A"]
    # another number of columns: nothing is open any more
    assert [c["descripcion"] for c in got["Música", "4º ESO"]["criterios_evaluacion"]] == ["Cantar a voces."]
    maths = got["Matemáticas A", "4º ESO"]
    assert maths["itinerario"] == "A" and maths["materia_oficial"] == "Matemáticas"
    assert [(c["codigo"], c["descripcion"]) for c in maths["competencias_especificas"]] == [("1", "Contar bien y pronto")]
    assert A.year_mismatches(out["records"]).count() == 0
    warned = rows(out["avisos"], "materia", "curso", "codigo", "motivo")
    assert warned == sorted([("Música", 4, None, "sin_saberes"), ("Música", None, "9.9", "sin_curso"), ("Vacía", None, None, "sin_contenido")],
                            key=lambda r: tuple((v is None, str(v)) for v in r))


def test_nothing_to_read(spark):
    out = extract(spark, [plain(0, "Texto")], {})
    assert out["records"].count() == 0 and out["avisos"].count() == 0


def test_cells(spark):
    def cell(text, prefix=""):
        return spark.range(1).select(C.criteria_of_cell(F.lit(text), F.lit(prefix)).alias("p")).first()["p"].asDict(recursive=True)

    assert cell("1.1. Elaborar contenidos GE\npropios en distintos GE\nformatos.", "GEH") == {
        "preludio": "", "criterios": [{"codigo": "1.1", "texto": "Elaborar contenidos propios en distintos formatos."}]}
    assert cell("1.1. Usar la norma UNE\ny la ISO.", "GEH")["criterios"][0]["texto"] == "Usar la norma UNE y la ISO."
    assert cell("y sostenible en el tiempo.\n2.1. Analizar los datos.") == {
        "preludio": "y sostenible en el tiempo.", "criterios": [{"codigo": "2.1", "texto": "Analizar los datos."}]}
    assert cell("") == cell("Criterios de evaluación\n \n") == {"preludio": "", "criterios": []}
    assert cell("a\nb\n1.1 c\nd\n1.2 e") == {"preludio": "a b", "criterios": [{"codigo": "1.1", "texto": "c d"}, {"codigo": "1.2", "texto": "e"}]}


def test_lines_and_cells_are_staged_once(spark):
    staged = []

    def stage(df, name):
        staged.append(name)
        return cut_lineage(df, name)

    lines = spark.createDataFrame([("d", 0, 1, 220.0, 1.0, True, False, "Música")], "doc_id string, seq bigint, page int, x double, y double, bold boolean, in_table boolean, text string")
    cells = spark.createDataFrame([("d", 2, 0, 0, 0, 2, "x")], "doc_id string, page int, table_no int, row int, col int, n_cols int, text string")
    out = A.extract(lines, cells, stage=stage)
    assert staged[:2] == ["vistas", "tablas"]
    assert rows(out["avisos"], "materia", "motivo") == [("Música", "sin_contenido")]


def test_no_derived_table_may_be_sent_whole(spark):
    """Every join of cells, titles and records is by sorting, whatever size Spark takes a side for."""
    plans = {}

    def stage(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut_lineage(df, name)

    lines = spark.createDataFrame([(1, 0, 0, 220.0, 0.0, True, False, "Música")], "doc_id bigint, seq bigint, page int, x double, y double, bold boolean, in_table boolean, text string")
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 3, "1. Oír")], "doc_id bigint, page int, table_no int, row int, col int, n_cols int, text string")
    out = A.extract(lines, cells, stage=stage)
    plans["records"] = out["records"]._jdf.queryExecution().optimizedPlan().toString()
    joins = [(name, line) for name in ("secciones", "saberes", "celdas", "trozos", "records") for line in plans[name].splitlines() if "Join " in line]
    assert joins and [j for j in joins if "strategy=merge" not in j[1]] == []
