"""Readable pages, markup paragraphs, export rows and document context."""

from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import quality as qual
from ..sources import markup
from ..sources.export import export_rows as flatten_export
from .frames import CATALOGUE_SQL, DOCUMENTS_SQL, LINES_SQL, catalogue, citing_documents, documents
from .registry import query, read


@query("readable_text")
def readable_text(spark, sf_dir):
    """Pages as they would be read aloud (parsed as HTML, so no SQL twin)."""
    return markup.readable_text(read(spark, sf_dir, "pages", "page_id", "html")).select("page_id", "lectura")


@query(
    "xml_paragraphs",
    f"""WITH {LINES_SQL} SELECT doc_id, CASE WHEN seq % 2 = 0 THEN 'a' ELSE '' END AS cls, count(*) AS parrafos, CAST(sum(length(trim(text))) AS BIGINT) AS letras,
          md5(string_agg(trim(text), chr(10) ORDER BY seq)) AS texto
        FROM lines WHERE regexp_matches(text, '[^\\s\\x{{00A0}}]') GROUP BY ALL""",
)
def xml_paragraphs(spark, sf_dir):
    """Documents written as a bulletin's XML and read back as paragraphs."""
    texts = F.split("text", "\n")
    safe = F.transform(texts, lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    tags = F.transform(safe, lambda t, i: F.concat(F.when(i % 2 == 0, '<p class="a">').otherwise(F.lit("<p>")), t, F.lit("</p>")))
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.concat(F.lit("<documento><texto>"), F.array_join(tags, "\n"), F.lit("</texto></documento>")).alias("raw")
    )
    rows = markup.paragraphs_from_xml(docs)
    return rows.groupBy("doc_id", "cls").agg(
        F.count(F.lit(1)).alias("parrafos"), F.sum(F.length(F.trim("text")).cast("bigint")).alias("letras"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "\n").cast("binary")).alias("texto"),
    )


@query(
    "escaped_paragraphs",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    p AS (SELECT doc_id, i, trim(regexp_replace(t, '[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g')) AS t FROM l)
    SELECT doc_id, 'akn_p' AS cls, count(*) AS parrafos, md5(string_agg(t, chr(10) ORDER BY i)) AS texto FROM p WHERE t <> '' GROUP BY doc_id
    UNION ALL SELECT doc_id, 'akn_heading', 1, md5('Títol ' || lang) FROM documents""",
)
def escaped_paragraphs(spark, sf_dir):
    """The same documents as HTML escaped inside an attribute."""
    body = F.concat(F.lit("<p>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br />")), F.lit("</p>"))
    once = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").select(
        "doc_id",
        F.concat(
            F.lit("<act><body><hcontainer><heading>Títol "), "lang", F.lit('</heading><content period="'), once, F.lit('"/></hcontainer></body></act>')
        ).alias("raw"),
    )
    rows = markup.paragraphs_from_escaped_html(docs)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "\n")
    return rows.groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("parrafos"), F.md5(texts.cast("binary")).alias("texto"))


@query(
    "export_rows",
    f"""WITH {DOCUMENTS_SQL}, rows AS (
      SELECT id_situacion, 0 AS o, 'descripcion' AS seccion, 'Descripción' AS etiqueta, titulo AS valor, CAST(NULL AS VARCHAR) AS detalle FROM docs
      UNION ALL SELECT id_situacion, 1, 'objetivos', '1.', 'Analizar', '1, 2' FROM docs
      UNION ALL SELECT id_situacion, 2, 'objetivos', '2.', '', NULL FROM docs
      UNION ALL SELECT id_situacion, 3, 'conexion_curricular', 'Aviso', 'Esta conexión curricular está incompleta: falta saberes básicos. Regenera la sección para completarla.', NULL FROM docs
      UNION ALL SELECT id_situacion, 4, 'conexion_curricular', 'Competencias específicas · ' || id_usuario, '—', NULL FROM docs
      UNION ALL SELECT id_situacion, 5, 'conexion_curricular', 'Criterios de evaluación · —', 'x', '1' FROM docs
      UNION ALL SELECT id_situacion, 6, 'secuencia_sesiones', 'Sesión 1', curso, 'apertura · 50 min' FROM docs
      UNION ALL SELECT id_situacion, 7, 'secuencia_sesiones', 'Actividades', 'leer', NULL FROM docs
      UNION ALL SELECT id_situacion, 8, 'secuencia_sesiones', 'Actividades', 'medir', NULL FROM docs
      UNION ALL SELECT id_situacion, 9, 'secuencia_sesiones', 'Criterios trabajados', '1.1, 2.1', NULL FROM docs
      UNION ALL SELECT id_situacion, 10, 'evaluacion', 'Instrumento · Prueba', '—', '40%' FROM docs
      UNION ALL SELECT id_situacion, 11, 'evaluacion', 'Criterio 1.1', 'bien', 'Excelente' FROM docs
      UNION ALL SELECT id_situacion, 12, 'evaluacion', 'Criterio 1.1', '—', 'Logrado' FROM docs
      UNION ALL SELECT id_situacion, 13, 'evaluacion', 'Criterio 1.1', '—', 'En proceso' FROM docs
      UNION ALL SELECT id_situacion, 14, 'evaluacion', 'Criterio 1.1', '—', 'Iniciado' FROM docs
      UNION ALL SELECT id_situacion, 15, 'atencion_diversidad', 'Principios DUA aplicados', 'varios', NULL FROM docs
      UNION ALL SELECT id_situacion, 16, 'atencion_diversidad', 'Ajustes no significativos', 'tiempo', NULL FROM docs WHERE tipo_adaptacion IS NULL OR tipo_adaptacion <> 'significativa'
      UNION ALL SELECT id_situacion, 17, 'atencion_diversidad', 'Ajustes significativos', 'meta', NULL FROM docs WHERE tipo_adaptacion IS NULL OR tipo_adaptacion <> 'no_significativa')
    SELECT id_situacion, seccion, row_number() OVER (PARTITION BY id_situacion ORDER BY o) - 1 AS orden, etiqueta, valor, detalle FROM rows""",
)
def export_rows(spark, sf_dir):
    content = F.concat(
        F.lit('{"objetivos":{"objetivos":[{"texto":"Analizar","competencias":["1","2"]},{"competencias":[]}]},"descripcion":{"texto":"'), "titulo",
        F.lit('","pregunta_guia":""},"conexion_curricular":{"competencias":[{"codigo":"'), "id_usuario",
        F.lit('"}],"criterios":[{"competencia":"1","justificacion":"x"}]},"secuencia_sesiones":{"sesiones":[{"numero":1,"titulo":"'), "curso",
        F.lit('","fase":"apertura","duracion_minutos":50,"actividades":["leer",{"descripcion":"medir"},""],"criterios":["1.1","2.1"]}]},'),
        F.lit('"evaluacion":{"instrumentos":[{"nombre":"Prueba","peso":40}],"rubricas":[{"criterio":"1.1","niveles":{"excelente":"bien","logrado":""}}]},'),
        F.lit('"atencion_diversidad":{"principios_dua":["varios"],"ajustes_no_significativos":["tiempo"],"ajustes_significativos":["meta"]}}'),
    )
    return flatten_export(documents(spark, sf_dir).withColumn("contenido", content))


def _context(spark, sf_dir):
    rows = catalogue(spark, sf_dir)
    text = F.concat(F.lit("texto "), F.col("codigo"))
    comp = rows.where("kind = 'competencias'").select(
        F.col("id").alias("id_competencia"), "comunidad", "materia", "cursos_aplicables", "codigo", text.alias("descripcion"),
        F.array("comunidad").alias("descriptores"),
    )
    parents = comp.select("comunidad", "materia", F.col("codigo").alias("padre"), "id_competencia")
    crit = rows.where("kind = 'criterios'").withColumn("padre", (F.col("codigo").cast("int") - 15).cast("string")).join(
        parents, ["comunidad", "materia", "padre"], "left"
    ).select(F.col("id").alias("id_criterio"), "comunidad", "materia", "cursos_aplicables", "codigo", text.alias("descripcion"), "id_competencia")
    items = rows.where("kind = 'saberes'").select(
        F.col("id").alias("id_saber"), "comunidad", "materia", "cursos_aplicables", "codigo", text.alias("descripcion"), F.lit("B").alias("bloque")
    )
    docs = citing_documents(spark, sf_dir)
    return ctx.document_context(docs, ctx.scope_context(docs, comp, crit, items))


_CONTEXT_SQL = f"""
WITH {CATALOGUE_SQL}, s AS (
  SELECT DISTINCT user_id AS id_situacion, 'Brand#' || (1 + user_id % 27) AS comunidad,
    (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[1 + user_id % 6] AS materia, CASE WHEN user_id % 2 = 0 THEN '1º ESO' ELSE '2º ESO' END AS curso FROM events),
h AS (SELECT s.id_situacion, c.* FROM s JOIN cat c ON c.comunidad = s.comunidad AND c.materia = s.materia AND c.curso = s.curso),
k AS (SELECT h.id_situacion, h.codigo, coalesce((SELECT min(p.codigo) FROM h p WHERE p.id_situacion = h.id_situacion AND p.kind = 'competencias'
        AND p.codigo = CAST(CAST(h.codigo AS INTEGER) - 15 AS VARCHAR)), '?') AS padre FROM h WHERE kind = 'criterios')
"""


@query(
    "context_rows",
    _CONTEXT_SQL + """SELECT s.id_situacion, coalesce((SELECT string_agg(codigo, ',' ORDER BY codigo) FROM h WHERE h.id_situacion = s.id_situacion AND kind = 'competencias'), '') AS competencias,
      coalesce((SELECT string_agg(codigo || '>' || padre, ',' ORDER BY codigo) FROM k WHERE k.id_situacion = s.id_situacion), '') AS criterios,
      coalesce((SELECT string_agg(codigo, ',' ORDER BY codigo) FROM h WHERE h.id_situacion = s.id_situacion AND kind = 'saberes'), '') AS saberes,
      (SELECT count(DISTINCT kind) FROM h WHERE h.id_situacion = s.id_situacion) = 3 AS completa FROM s""",
)
def context_rows(spark, sf_dir):
    codes = {n: F.coalesce(F.array_join(F.transform(n, lambda e: e["codigo"]), ","), F.lit("")).alias(n) for n in ("competencias", "saberes")}
    crit = F.array_join(F.transform("criterios", lambda e: F.concat(e["codigo"], F.lit(">"), e["competencia"])), ",")
    return _context(spark, sf_dir).select(
        "id_situacion", codes["competencias"], F.coalesce(crit, F.lit("")).alias("criterios"), codes["saberes"], "completa"
    )


@query(
    "context_text",
    _CONTEXT_SQL + """, c AS (SELECT id_situacion, string_agg('- ' || codigo || ' [' || comunidad || ']: texto ' || codigo, chr(10) ORDER BY codigo) AS t FROM h WHERE kind = 'competencias' GROUP BY ALL),
    r AS (SELECT id_situacion, string_agg('- ' || codigo || ' (→' || padre || '): texto ' || codigo, chr(10) ORDER BY codigo) AS t FROM k GROUP BY ALL),
    b AS (SELECT id_situacion, string_agg('- ' || codigo || ' [B]: texto ' || codigo, chr(10) ORDER BY codigo) AS t FROM h WHERE kind = 'saberes' GROUP BY ALL)
    SELECT s.id_situacion, '### Competencias específicas' || chr(10) || coalesce(c.t, '- (ninguna cargada)') || chr(10) || chr(10) || '### Criterios de evaluación' || chr(10)
      || coalesce(r.t, '- (ninguno cargado)') || chr(10) || chr(10) || '### Saberes básicos' || chr(10) || coalesce(b.t, '- (ninguno cargado)') AS texto
    FROM s LEFT JOIN c USING (id_situacion) LEFT JOIN r USING (id_situacion) LEFT JOIN b USING (id_situacion)""",
)
def context_text(spark, sf_dir):
    text = ctx.scope_text(F.col("competencias"), F.col("criterios"), F.col("saberes"))
    return _context(spark, sf_dir).select("id_situacion", text.alias("texto"))


@query(
    "adaptation_context",
    f"""WITH {DOCUMENTS_SQL} SELECT a.id_situacion, o.titulo AS titulo_origen,
        CASE WHEN o.id_situacion IS NOT NULL THEN '### descripcion' || chr(10) || '- texto: ' || o.curso END AS resumen_origen
        FROM docs a LEFT JOIN docs o ON o.id_situacion = a.id_situacion_origen WHERE a.tipo_adaptacion IS NOT NULL""",
)
def adaptation_context(spark, sf_dir):
    rows = documents(spark, sf_dir)
    origins = rows.withColumn("contenido", F.concat(F.lit('{"descripcion":{"texto":"'), "curso", F.lit('"}}')))
    return ctx.adaptation_context(rows.drop("titulo"), origins).select("id_situacion", "titulo_origen", "resumen_origen")


_TERMS = [
    ("es", "the", "der"), ("fr", "the", "le"), ("de", "the", "der"),
]


@query(
    "translation_report",
    """WITH t AS (SELECT doc_id, lang, CASE WHEN n_chars % 3 = 0 THEN 'the' ELSE 'm' || doc_id END AS msgid,
         CASE WHEN n_chars % 5 = 0 THEN '' WHEN n_chars % 5 = 1 THEN 'le' ELSE text END AS msgstr, n_chars % 7 = 0 AS fuzzy FROM documents)
    SELECT lang, count(*) AS mensajes, count(*) FILTER (msgstr = '') AS sin_traducir, count(*) FILTER (fuzzy) AS dudosas,
      count(*) FILTER (msgid = 'the' AND lang <> 'en' AND msgstr <> CASE lang WHEN 'fr' THEN 'le' ELSE 'der' END) AS terminos,
      count(*) FILTER (lang = 'de' AND contains(lower(msgstr), 'die ')) AS separador FROM t GROUP BY lang""",
)
def translation_report(spark, sf_dir):
    n = F.col("n_chars")
    rows = read(spark, sf_dir, "documents").select(
        "lang", F.when(n % 3 == 0, "the").otherwise(F.concat(F.lit("m"), "doc_id")).alias("msgid"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "le").otherwise(F.col("text")).alias("msgstr"), (n % 7 == 0).alias("fuzzy"),
    )
    terms = spark.createDataFrame(_TERMS, "lang string, msgid string, oficial string")
    return qual.translation_report(rows, terms, {"de": "die "})


