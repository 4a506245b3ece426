from pyspark.sql import functions as F

from syllabica.functions import codes as C
from syllabica.operators import bulletin as B
from syllabica.operators import paragraphs as P
from syllabica.sources.catalogue_files import split_writable
from tests.conftest import rows


def keep(df, _name):
    """A small layer held as it is, without what it was made from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def paragraphs(spark, items):
    data = [("d", i, c, t) for i, (c, t) in enumerate(items)]
    return spark.createDataFrame(data, "doc_id string, seq bigint, cls string, text string")


def subject(heading):
    return [
        ("centro_negrita", heading), ("parrafo", "Competencias específicas."), ("parrafo_2", "1. Resolver problemas del entorno."),
        ("parrafo_2", "Descriptores del Perfil de salida: STEM1, STEM2."), ("parrafo", "Criterios de evaluación."),
        ("parrafo", "Competencia específica 1."), ("parrafo_2", "1.1 Identificar los datos."), ("parrafo", "Saberes básicos."),
        ("parrafo_2", "A. Resolución de problemas."), ("parrafo_2", "− Estrategias de descomposición."),
    ]


def extract(spark, items, **profile):
    return B.extract_blocks(paragraphs(spark, items), B.Profile(**profile), keep)


def test_minimal_bulletin(spark):
    rec = extract(spark, subject("Física y Química"), subjects={"Física y Química": "FyQ"}).first().asDict(recursive=True)
    assert rec["materia_oficial"] == "Física y Química" and rec["ciclo"] == "Único"
    assert rec["competencias_especificas"] == [
        {"codigo": "CE1", "descripcion": "Resolver problemas del entorno.", "descriptores": ["STEM1", "STEM2"]}]
    assert rec["criterios_evaluacion"] == [{"codigo": "1.1", "competencia": "CE1", "descripcion": "Identificar los datos."}]
    assert rec["saberes_basicos"] == [{
        "codigo": "A", "bloque": "A. Resolución de problemas", "titulo": "Resolución de problemas", "items": ["Estrategias de descomposición."]}]


def test_year_groups(spark):
    items = [
        ("c", "Latín"), ("p", "Competencias específicas"), ("p", "1. Una"), ("p", "Cursos de primero a tercero"),
        ("p", "Criterios de evaluación"), ("p", "1.1 Uno"), ("p", "Saberes básicos"), ("p", "Primer curso"), ("p", "A. Bloque"), ("p", "- x"),
        ("p", "1. Conteo."), ("p", "Segundo curso"), ("p", "A. Bloque"), ("p", "- y"), ("p", "Cuarto curso"), ("p", "Competencias específicas"),
        ("p", "2. Dos"), ("p", "Orientaciones metodológicas"), ("p", "Primer curso"), ("c", "Otra"), ("p", "1.2 Fuera"),
    ]
    out = extract(spark, items, subjects={"Latín": "Latín"}, header_class="c")
    got = [
        (r.grupo, r.cursos_aplicables, [c.codigo for c in r.competencias_especificas], [b["items"] for b in r.saberes_basicos])
        for r in out.orderBy("grupo").collect()
    ]
    assert got == [(1, ["1º ESO", "2º ESO", "3º ESO"], ["CE1"], [["x", "y"]]), (2, ["4º ESO"], ["CE1", "CE2"], [])]
    good, skipped = split_writable(out)
    assert rows(good, "grupo") == [(1,)] and rows(skipped, "cursos_aplicables") == [(["4º ESO"],)]


def test_a_header_in_capitals_closes_only_if_it_is_no_section(spark):
    items = [("c", "LATÍN"), ("c", "CRITERIOS DE EVALUACIÓN"), ("p", "Criterios de evaluación"), ("p", "1.1 a"), ("c", "OTRA MATERIA"), ("p", "1.2 b")]
    out = extract(spark, items, subjects={"LATÍN": "Latín"}, header_class="c", capitals=True)
    assert [c.codigo for c in out.first()["criterios_evaluacion"]] == ["1.1"]


def test_continuations_and_prelude(spark):
    items = [("", "cola anterior"), ("", "1.1. Analizar los"), ("", "datos."), ("", "2.1. Otro")]
    got = P.glue_lines(paragraphs(spark, items), F.col("text").rlike(r"^\d+\.\d+"))
    assert rows(got, "record", "text") == [(0, "cola anterior"), (1, "1.1. Analizar los datos."), (2, "2.1. Otro")]


def test_code_without_text_is_dropped(spark):
    df = spark.createDataFrame([("BYG.1.A.1", 0, " "), ("BYG.1.A.2", 1, "Con texto."), ("BYG.1.A.2", 2, "Con más texto.")], "codigo string, seq int, text string")
    assert rows(P.longest_reading(df, ["codigo"]), "codigo", "text") == [("BYG.1.A.2", "Con más texto.")]


def test_table_kinds(spark):
    cells = [("d", 1, 1, 3, "PRIMERO"), ("d", 1, 1, 3, "MAT.1.A.1. Conteo."), ("d", 1, 2, 3, "Competencias"), ("d", 1, 2, 3, "x\n1.1. Analizar"), ("d", 1, 3, 2, "1.1. Analizar")]
    df = spark.createDataFrame(cells, "doc_id string, page int, table_no int, n_cols int, text string")
    assert rows(P.table_kinds(df), "table_no", "es_de_criterios") == [(1, False), (2, True), (3, False)]


def test_two_and_three_indents(spark):
    def line(d, i, x, bold, text):
        return (d, i, float(x), bold, text)

    data = [
        line("tres", 0, 85, True, "Sentit."), line("tres", 1, 103, False, "Magnitud"), line("tres", 2, 106, False, "·"), line("tres", 3, 120, False, "Atributs"),
        line("tres", 4, 120, False, "mesurables"), line("tres", 5, 103, False, "Buit"), line("dos", 0, 85, True, "Bloc 1."), line("dos", 1, 103, False, "La teoria"),
        line("dos", 2, 105, False, "cel·lular"), line("dos", 3, 103, False, "Una altra"), line("dos", 4, 85, True, "Bloc buit"),
    ]
    df = spark.createDataFrame(data, "doc_id string, seq bigint, x double, bold boolean, text string")
    assert rows(P.knowledge_blocks(df), "doc_id", "bloque", "text") == [
        ("dos", "Bloc 1", "La teoria cel·lular"), ("dos", "Bloc 1", "Una altra"), ("tres", "Sentit · Magnitud", "Atributs mesurables")]


def test_columns_split_at_midpoints(spark):
    heads = spark.createDataFrame([("d", 173.0), ("d", 413.0)], "doc_id string, x double")
    lines = spark.createDataFrame([("d", 91.0), ("d", 313.0), ("d", 292.9), ("d", 293.0)], "doc_id string, x double")
    got = P.into_columns(lines, P.column_ranges(heads, ["doc_id"]), ["doc_id"])
    assert rows(got, "x", "columna") == [(292.9, 1), (293.0, 2), (313.0, 2), (91.0, 1)]


def test_column_boundary_needs_a_wide_gap(spark):
    df = spark.createDataFrame([("a", 60.0), ("a", 90.0), ("b", 60.0), ("b", 200.0), ("c", 5.0)], "doc_id string, x double")
    assert rows(P.column_boundary(df)) == [("a", None), ("b", 130.0), ("c", None)]


def test_longest_name_wins(spark):
    df = spark.createDataFrame([(1, "Tecnología y Digitalización."), (2, "Tecnología, y Música en primer curso.")], "id int, text string")
    names = ["Tecnología", "Tecnología y Digitalización", "Música"]
    assert rows(P.longest_matches(df, names), "id", "materia") == [(1, "Tecnología y Digitalización"), (2, "Música"), (2, "Tecnología")]


def test_majority_prefix_and_years_from_codes(spark):
    df = spark.createDataFrame([("d", 1, "MAA"), ("d", 2, "MAA"), ("d", 3, "MAB")], "doc_id string, seq int, prefix string")
    assert rows(P.majority_prefix(df), "seq") == [(1,), (2,)]
    crit = spark.createDataFrame(
        [("d", 1, "1.1", [1, 3], "Uno"), ("d", 2, "1.1", [], "sigue"), ("d", 3, "2.1", [], "sin año")], "doc_id string, seq bigint, codigo string, cursos array<int>, text string")
    assert rows(P.criteria_by_year(crit), "codigo", "curso", "text") == [("1.1", 1, "Uno sigue"), ("1.1", 3, "Uno sigue")]


def test_repeated_titles_collapse(spark):
    df = paragraphs(spark, [("", "Música"), ("", "MÚSICA."), ("", "Latín"), ("", "Música")])
    assert rows(P.collapse_repeats(df), "seq") == [(0,), (2,), (3,)]


def coded(spark, *texts):
    return P.official_items(paragraphs(spark, [("", t) for t in texts]))


def test_year_comes_from_the_code(spark):
    got = coded(spark, "A. Proyecto científico.", "BYG.1.A.1. Formulación de hipótesis.", "BYG.3.A.1. Formulación, con más detalle.")
    assert rows(got, "curso", "codigo", "titulo") == [(1, "BYG.1.A.1", "Proyecto científico"), (3, "BYG.3.A.1", "Proyecto científico")]


def test_items_continue_and_empty_codes_drop(spark):
    got = coded(
        spark, "A. Bloque.", "BYG.1.A.1.", "BYG.1.A.2. Formulación de hipó-", "tesis, preguntas y", "TERCER CURSO", "conjeturas.", "B. Otro bloque.", "suelta",
        "BYG.1.B.1. Uno", "BYG.1.B.1. Uno más largo", "BYG.1.C.1. Tres")
    assert rows(got, "codigo", "text", "titulo") == [
        ("BYG.1.A.2", "Formulación de hipótesis, preguntas y conjeturas.", "Bloque"), ("BYG.1.B.1", "Uno más largo", "Otro bloque"),
        ("BYG.1.C.1", "Tres", "Bloque C")]


def test_competences_in_running_text(spark):
    data = [
        (0, True, "1. Interpretar y"), (1, True, "transmitir."), (2, False, "Texto en redonda."), (3, False, "STEM3, CD1, CE3."), (4, True, "Negrita suelta"),
        (5, True, "2."), (6, True, "Abordar problemas."), (7, True, "Saberes básicos"), (8, True, "3. Fuera"),
    ]
    df = spark.createDataFrame([("d", *r) for r in data], "doc_id string, seq bigint, bold boolean, text string")
    assert rows(P.competences_in_text(df), "codigo", "descripcion", "descriptores") == [
        ("1", "Interpretar y transmitir.", ["STEM3", "CD1", "CE3"]), ("2", "Abordar problemas.", [])]


def test_year_sets_and_titles_of_a_cover(spark):
    lines = spark.createDataFrame(
        [("d", 1, 1, 20.0, "Aranès"), ("d", 2, 1, 19.95, "Llengua Catalana"), ("d", 3, 1, 11.0, "subtítol"), ("d", 4, 2, 30.0, "fora")],
        "doc_id string, seq int, page int, size double, text string")
    assert rows(P.cover_titles(lines), "text") == [("Aranès",), ("Llengua Catalana",)]
    groups = spark.createDataFrame([("d", "1º ESO,2º ESO"), ("d", "4º ESO"), ("d", "4º ESO")], "doc_id string, grupo string")
    titles = P.cover_titles(lines).withColumnRenamed("text", "titulo")
    assert len(rows(P.shared_curriculum(titles, groups))) == 4


def test_prelude_is_glued_to_the_criterion_above(spark):
    records = spark.createDataFrame([("d", 1, 10, "1.1", "Identificar, valorar y")], "doc_id string, col int, orden bigint, codigo string, text string")
    prelude = spark.createDataFrame([("d", 1, 20, "respetar."), ("d", 1, 5, "antes"), ("d", 3, 20, "otra")], "doc_id string, col int, orden bigint, text string")
    got = P.glue_to_open_record(prelude, records, ["doc_id", "col"])
    assert rows(got, "col", "codigo", "text") == [(1, "1.1", "Identificar, valorar y respetar.")]


def test_markers_in_many_ranges(spark):
    """The same groups whether a subject's markers are one range or many."""
    cycle = [
        ("p", "Cursos de primero a tercero"), ("p", "Competencias específicas"), ("p", "1. Una"), ("p", "Criterios de evaluación"), ("p", "1.1 Uno"),
        ("p", "Saberes básicos"), ("p", "Primer curso"), ("p", "A. Bloque"), ("p", "- x"), ("p", "Cuarto curso: Matemáticas A"), ("p", "Saberes básicos"),
        ("p", "B. Otro"), ("p", "- y"), ("p", "Cursos primero y segundo"), ("p", "Saberes básicos"), ("p", "Segundo curso"), ("p", "- z"),
    ]
    items = [("c", "Latín"), *cycle * 40, ("c", "Griego"), *cycle[5:]]
    profile = B.Profile({"Latín": "Latín", "Griego": "Griego"}, header_class="c")

    def groups():
        inside = keep(B.label_subjects(paragraphs(spark, items), profile), "materias")
        placed, opened = B.label_groups(inside, profile, keep)
        return rows(placed, "tramo", "grupo", "seccion", "marca", "seq"), rows(opened.withColumn("c", F.array_join("cursos", ",")), "tramo", "grupo", "c", "itinerario")

    whole, B.MARK_RANGE = (groups(), B.MARK_RANGE), 7
    try:
        assert groups() == whole[0]
    finally:
        B.MARK_RANGE = whole[1]
    assert len(whole[0][1]) > 100


def test_names_of_an_item_are_found_once(spark):
    df = spark.createDataFrame([("Música y Tecnología",), ("nada",), (None,)], "text string")
    got = P.longest_matches(df, ["Tecnología", "Música"], "text")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert rows(got, "materia") == [("Música",), ("Tecnología",)]


def test_markers_are_parsed_once(spark):
    items = [("c", "Latín"), ("p", "Cuarto curso: Matemáticas A"), ("p", "Saberes básicos"), ("p", "A. Bloque"), ("p", "- x"), ("p", None)]
    staged = {}

    def stage(df, name):
        staged[name] = df
        return keep(df, name)

    out = B.extract_blocks(paragraphs(spark, items), B.Profile({"Latín": "Latín"}, header_class="c"), stage)
    assert rows(out.select("grupo", F.array_join("cursos_aplicables", ",").alias("c")), "grupo", "c") == [(1, "4º ESO")]
    # what a paragraph marks is written with it
    assert {"y", "tipo"} <= set(staged["materias"].columns)
    years = spark.createDataFrame([("Primer curso",)], "text string").select(C.parse_years(F.col("text")).alias("y"))
    assert rows(years, "y.years") == [(["1º ESO"],)]
    assert years._jdf.queryExecution().analyzed().toString().count("lower(trim(") == 1
