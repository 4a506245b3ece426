"""Regional bulletins from positioned lines and table cells, one small bulletin per account."""

from pyspark.sql import functions as F

from ..operators import andalusia as A
from ..operators import catalonia as K
from .registry import query, read, spread


def _customers(spark, sf_dir):
    c = spread(read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment"))
    maths = F.col("c_mktsegment") != "BUILDING"
    return c.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("n"),
        F.struct(F.lit(True).alias("siempre"), (F.col("c_nationkey") % 2 == 0).alias("par"), maths.alias("mates"),
                 (F.col("c_mktsegment") == "HOUSEHOLD").alias("vacia")).alias("hay"),
    )


def _rows(customers, entries, fields):
    """One row per entry whose condition holds; ``{}`` in a text stands for the account, ``[]`` for its nation."""
    made = []
    for when, *values in entries:
        text = F.lit(values[-1])
        if values[-1]:
            for mark, column in (("{}", "doc_id"), ("[]", "n")):
                text = F.replace(text, F.lit(mark), F.col(column).cast("string")) if mark in values[-1] else text
        row = F.struct(*[F.lit(v).alias(f) for v, f in zip(values[:-1], fields, strict=True)], text.cast("string").alias("text"))
        made.append(F.when(F.col(f"hay.{when}"), row))
    entry = F.posexplode(F.array_compact(F.array(*made))).alias("seq", "r")
    return customers.select("doc_id", entry).select("doc_id", F.col("seq").cast("bigint").alias("seq"), "r.*")


def _line(page, text, when="siempre", x=64.0, bold=False, in_table=False):
    return when, page, x, bold, in_table, text


def _title(page, text, when="siempre", in_table=False):
    return _line(page, text, when, 220.0, True, in_table)


_LINES = [
    _title(0, "ANEXO II"), _title(1, "Música."), _title(2, "Música"), _line(2, "Competencias específicas.", bold=True),
    _line(2, "1. Escuchar {} obras", bold=True), _line(2, "de todo tipo.", bold=True), _line(2, "CCL1, CCEC2."), _line(2, "2.", bold=True),
    _line(2, "Crear sonidos.", bold=True), _line(2, "Número 104 - Boletín"), _line(3, "Saberes básicos."), _line(3, "A. Escucha."),
    _line(3, "MUS.1.A.1. Timbre y"), _line(3, "altura."), _line(3, "BYG.1.A.7. De otra materia."), _title(4, "Música", in_table=True),
    _title(7, "Matemáticas A", "mates"), _line(8, "A. Números.", "mates"), _line(8, "MAA.4.A.1. Enteros.", "mates"), _title(9, "Vacía", "vacia"),
]
_TABLES = {
    ("siempre", 3): [["PRIMER CURSO", "TERCER CURSO"], ["MUS.1.A.2. Ritmo.\nMUS.1.A.3.", "MUS.3.A.1. Com-"], ["", "pás binario."], ["MUS.1.A.1. Tim", None]],
    ("siempre", 4): [["Competencias", "Criterios de evaluación", "Saberes básicos", "Criterios de evaluación", "Saberes básicos"],
                     ["1. Escuchar", "1.1. Oír con MU\natención y", "MUS.1.A.1.", "1.1. Tocar", "MU\nS.3.A.1."],
                     [None, "2.1. Bailar", "MUS.1.A.2. MUS.3.A.1.", None, None]],
    ("siempre", 5): [[None, "con gusto.\n1.10. Leer", "MUS.1.A.1.", "en [].\n9.9. Sin curso", None], [None, "2.1. y saltar.", None, None, None]],
    ("par", 6): [[None, "sobra.\n1.1. Cantar", "MUS.4.A.1."], [None, "a voces.", None]],
    ("mates", 8): [["1. Contar\nbien", "1.1. Sumar", "MAA.4.A.1."], ["y pronto", "1.2. Restar", "MAA.4.A.1."]],
}
_CELLS = [(when, page, 0, r, c, len(row), text) for (when, page), table in _TABLES.items() for r, row in enumerate(table) for c, text in enumerate(row)]


@query(
    "boja_records",
    """WITH c AS (SELECT c_custkey AS doc_id, CAST(c_nationkey AS VARCHAR) AS n, c_nationkey % 2 = 0 AS par, c_mktsegment <> 'BUILDING' AS mates, c_mktsegment = 'HOUSEHOLD' AS vacia,
        '1 Escuchar ' || c_custkey || ' obras de todo tipo. [CCL1 CCEC2]|2 Crear sonidos. []' AS m, CASE WHEN c_mktsegment <> 'BUILDING' THEN ' Matemáticas A' ELSE '' END AS sigue,
        CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' Vacía' ELSE '' END AS fin FROM customer)
    SELECT doc_id, 'Música' AS materia, 1 AS curso, m AS competencias, '1.1 1 Oír con atención y|1.10 1 Leer|2.1 2 Bailar y saltar.' AS criterios,
      'A. Escucha: MUS.1.A.1 Timbre y altura., MUS.1.A.2 Ritmo.' AS saberes, CAST(NULL AS VARCHAR) AS codigo, CAST(NULL AS VARCHAR) AS motivo FROM c
    UNION ALL SELECT doc_id, 'Música', 3, m, '1.1 1 Tocar en ' || n || '.|2.1 2 Bailar con gusto. y saltar.', 'A. Escucha: MUS.3.A.1 Compás binario.' || sigue, NULL, NULL FROM c
    UNION ALL SELECT doc_id, 'Música', 4, m, '1.1 1 Cantar a voces.', '', NULL, NULL FROM c WHERE par
    UNION ALL SELECT doc_id, 'Matemáticas A', 4, '1 Contar bien y pronto []', '1.1 1 Sumar|1.2 1 Restar', 'A. Números: MAA.4.A.1 Enteros.' || fin, NULL, NULL FROM c WHERE mates
    UNION ALL SELECT doc_id, 'Música', 4, NULL, NULL, NULL, NULL, 'sin_saberes' FROM c WHERE par
    UNION ALL SELECT doc_id, 'Música', NULL, NULL, NULL, NULL, '9.9', 'sin_curso' FROM c
    UNION ALL SELECT doc_id, 'Vacía', NULL, NULL, NULL, NULL, NULL, 'sin_contenido' FROM c WHERE vacia""",
)
def boja_records(spark, sf_dir):
    """Lines and cells to records: tables over pages, a change of width, pieces without years; what is missing is reported."""
    customers = _customers(spark, sf_dir)
    lines = _rows(customers, _LINES, ["page", "x", "bold", "in_table"]).withColumn("y", F.col("seq").cast("double"))
    cells = _rows(customers, _CELLS, ["page", "table_no", "row", "col", "n_cols"]).drop("seq")
    out = A.extract(lines, cells)
    records = shown(out["records"]).select("*", *[F.lit(None).cast("string").alias(c) for c in ("codigo", "motivo")])
    warned = out["avisos"].select("doc_id", "materia", "curso", *[F.lit(None).cast("string").alias(c) for c in ("competencias", "criterios", "saberes")], "codigo", "motivo")
    return records.unionByName(warned)


def shown(records):
    """Records with their lists as text."""
    comp = F.transform("competencias_especificas", lambda c: F.concat(
        c["codigo"], F.lit(" "), c["descripcion"], F.lit(" ["), F.array_join(c["descriptores"], " "), F.lit("]")))
    crit = F.transform("criterios_evaluacion", lambda c: F.concat_ws(" ", c["codigo"], c["competencia"], c["descripcion"]))
    items = F.transform("saberes_basicos", lambda b: F.concat(b["bloque"], F.lit(": "), F.array_join(
        F.zip_with(b["codigos_items"], b["items"], lambda k, t: F.concat_ws(" ", k, t)), ", ")))
    return records.select(
        "doc_id", "materia", "curso", F.array_join(comp, "|").alias("competencias"), F.array_join(crit, "|").alias("criterios"), F.array_join(items, "|").alias("saberes"))


@query(
    "code_year_mismatches",
    """SELECT l_orderkey AS materia, 'MAT.' || l_linenumber || '.A.' || l_suppkey AS codigo, count(*) AS veces FROM lineitem
       WHERE l_linenumber <> 1 + CAST(l_quantity AS INTEGER) % 4 GROUP BY ALL""",
)
def code_year_mismatches(spark, sf_dir):
    """Item codes that name another year than their record does."""
    code = F.concat(F.lit("MAT."), "l_linenumber", F.lit(".A."), "l_suppkey")
    year = F.concat((F.col("l_quantity").cast("int") % 4 + 1).cast("string"), F.lit("º ESO"))
    records = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("materia"), F.array(year).alias("cursos_aplicables"), F.array(F.struct(F.array(code).alias("codigos_items"))).alias("saberes_basicos"))
    return A.year_mismatches(records).groupBy("materia", "codigo").agg(F.count(F.lit(1)).alias("veces"))


def _put(page, y, text, when="siempre", x=85.0, size=10.0, bold=False):
    return when, page, x, float(y), size, bold, text


_CATALAN = [
    _put(1, 50, "Matemàtiques", "tabla", size=20.0), _put(1, 60, "Llengua Catalana", "doble", size=20.0),
    _put(1, 50, "Cultura Científica (matèria optativa de quart d'ESO)", "cultura", size=20.0), _put(1, 50, "Robòtica", "robotica", size=20.0),
    _put(1, 80, "Decret 175/2022 de currículum"), _put(1, 90, "Competència específica 1", "tabla"), _put(1, 100, "Interpretar {} problemes", "tabla"),
    _put(1, 110, "de la vida.", "tabla"), _put(1, 120, "Criteris d’avaluació"), _put(1, 131, "1r, 2n i 3r", "tabla", 173.0), _put(1, 133, "4t", "tabla", 413.0),
    _put(1, 145, "1.1 Llegir", "tabla", 91.0), _put(1, 145, "1.1 Llegir més", "tabla", 313.0), _put(1, 155, "enunciats.", "tabla", 91.0),
    _put(1, 155, "i millor.", "tabla", 313.0), _put(1, 165, "1.2. Resoldre.", "tabla", 91.0), _put(1, 170, "sense codi", "sola"),
    _put(1, 180, "1.1. Analitzar []", "sola"), _put(1, 190, "conceptes.", "sola"), _put(2, 40, "Competència específica 2", "tabla"), _put(2, 50, "Raonar.", "tabla"),
    _put(2, 60, "Criteris d'avaluacio", "tabla"), _put(2, 70, "1r, 2n i 3r", "tabla", 173.0), _put(2, 70, "4t", "tabla", 413.0),
    _put(2, 90, "2.1 Provar.", "tabla", 91.0), _put(2, 100, "2.1 Provar bé.", "tabla", 313.0), _put(2, 101, "4t", "tabla", 413.0), _put(3, 40, "Sabers", size=12.0),
    _put(3, 50, "Sentit numèric.", "tabla", bold=True), _put(3, 60, "Quantitat", "tabla", 103.0), _put(3, 70, "–", "tabla", 112.0),
    _put(3, 70, "Nombres grans", "tabla", 120.0), _put(3, 80, "i petits", "tabla", 120.0), _put(3, 90, "Estimació", "tabla", 121.0),
    _put(3, 100, "Bloc 1. La cèl·lula", "sola", bold=True), _put(3, 110, "La teoria", "sola", 103.0), _put(3, 120, "cel·lular", "sola", 104.0),
    _put(3, 130, "Bloc 2. Buit", "sola", bold=True),
]


@query(
    "xtec_records",
    """WITH c AS (SELECT c_custkey AS doc_id, CAST(c_nationkey AS VARCHAR) AS n, c_nationkey % 2 = 0 AS tabla, c_mktsegment AS s,
        '1 Interpretar ' || c_custkey || ' problemes de la vida.|2 Raonar.' AS comps FROM customer),
    t AS (SELECT *, unnest(CASE WHEN s = 'HOUSEHOLD' THEN ['Matemàtiques', 'Llengua Catalana'] ELSE ['Matemàtiques'] END) AS titulo FROM c WHERE tabla),
    k(ciclo, criterios) AS (VALUES ('1º ESO i 2º ESO i 3º ESO', '1.1 1 Llegir enunciats.|1.2 1 Resoldre.|2.1 2 Provar.'), ('4º ESO', '1.1 1 Llegir més i millor.|2.1 2 Provar bé. 4t'))
    SELECT doc_id, titulo AS materia, ciclo, comps AS competencias, criterios, '1. Sentit numèric · Quantitat: Nombres grans i petits, Estimació' AS saberes, CAST(NULL AS VARCHAR) AS motivo FROM t, k
    UNION ALL SELECT doc_id, CASE WHEN s = 'BUILDING' THEN 'Robòtica' ELSE 'Cultura Científica' END, CASE WHEN s = 'BUILDING' THEN 'Únic' ELSE '4º ESO' END, '',
      '1.1 1 Analitzar ' || n || ' conceptes.', '1. Bloc 1. La cèl·lula: La teoria cel·lular', NULL FROM c WHERE NOT tabla
    UNION ALL SELECT doc_id, 'Robòtica', NULL, NULL, NULL, NULL, 'sin_cursos' FROM c WHERE NOT tabla AND s = 'BUILDING'""",
)
def xtec_records(spark, sf_dir):
    """Positioned lines to records: two columns or none, both forms of indent, shared titles, years from the cover."""
    c = spread(read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment"))
    even, segment = F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")
    documents = c.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("n"),
        F.struct(F.lit(True).alias("siempre"), even.alias("tabla"), (~even).alias("sola"), (even & (segment == "HOUSEHOLD")).alias("doble"),
                 (~even & (segment == "BUILDING")).alias("robotica"), (~even & (segment != "BUILDING")).alias("cultura")).alias("hay"))
    articles = spark.createDataFrame([("Filosofia", ["4º ESO"])], "materia string, cursos array<string>")
    out = K.extract(_rows(documents, _CATALAN, ["page", "x", "y", "size", "bold"]), articles)
    comp = F.transform("competencias_especificas", lambda c: F.concat_ws(" ", c["codigo"], c["descripcion"]))
    crit = F.transform("criterios_evaluacion", lambda c: F.concat_ws(" ", c["codigo"], c["competencia"], c["descripcion"]))
    items = F.transform("saberes_basicos", lambda b: F.concat(b["bloque"], F.lit(": "), F.array_join(b["items"], ", ")))
    none = F.lit(None).cast("string")
    records = out["records"].select("doc_id", "materia", "ciclo", F.array_join(comp, "|").alias("competencias"), F.array_join(crit, "|").alias("criterios"),
                                    F.array_join(items, "|").alias("saberes"), none.alias("motivo"))
    return records.unionByName(out["avisos"].select("doc_id", "materia", *[none.alias(c) for c in ("ciclo", "competencias", "criterios", "saberes")], "motivo"))
