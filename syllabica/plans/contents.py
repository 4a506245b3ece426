"""Document JSON: missing parts, drift, contracts, metadata, validation."""

from pyspark.sql import functions as F

from ..functions import content as K
from ..operators import quality as ops
from ..operators.joins import fixed_lookup
from .registry import query, read

_EVENTS_SQL = """
e AS (SELECT *, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events)
"""


def _events(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").withColumns({"k": k, "n": k.cast("int")})


def _payload(n, k):
    """A section reply: complete, short of a key, with an empty list, or text."""
    return (
        F.when(n < 40, F.concat(F.lit('{"competencias":["'), k, F.lit('"],"criterios":["1.1"],"saberes":["A.1"]}')))
        .when(n < 60, F.concat(F.lit('{"competencias":["'), k, F.lit('"],"saberes":["A.1"]}')))
        .when(n < 80, F.lit('{"competencias":[],"criterios":["1.1"],"saberes":["A.1"]}'))
        .when(n < 90, F.lit('{"_error_parseo":true,"texto_crudo":"x"}'))
        .otherwise(F.concat(F.lit("sin formato "), k))
    )


@query(
    "missing_parts",
    f"""WITH {_EVENTS_SQL} SELECT event_id, CASE WHEN n < 40 THEN '' WHEN n < 60 THEN 'criterios'
        WHEN n < 80 THEN 'competencias' ELSE '' END AS faltan FROM e""",
)
def missing_parts(spark, sf_dir):
    rows = _events(spark, sf_dir)
    gone = K.missing_parts(F.lit("conexion_curricular"), _payload(F.col("n"), F.col("k")))
    return rows.select("event_id", F.array_join(gone, ",").alias("faltan"))


@query(
    "parse_failures",
    f"""WITH {_EVENTS_SQL} SELECT event_id, n < 90 AS parsed, CASE WHEN n >= 90 THEN 'sin formato ' || k END AS raw_text FROM e""",
)
def parse_failures(spark, sf_dir):
    parsed = K.parse_failure(_payload(F.col("n"), F.col("k")))
    return _events(spark, sf_dir).select("event_id", parsed.alias("p")).select("event_id", "p.parsed", "p.raw_text")


@query(
    "incomplete_rate",
    f"""WITH {_EVENTS_SQL} SELECT 'conexion_curricular' AS seccion, event_type AS idioma, count(*) AS secciones,
        count(*) FILTER (n BETWEEN 40 AND 79) AS incompletas,
        round(count(*) FILTER (n BETWEEN 40 AND 79) / count(*), 6) AS tasa FROM e GROUP BY event_type""",
)
def incomplete_rate(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        F.lit("conexion_curricular").alias("seccion"),
        F.col("event_type").alias("idioma"),
        _payload(F.col("n"), F.col("k")).alias("payload"),
    )
    return ops.incomplete_rate(rows)


@query(
    "section_meta",
    f"""WITH {_EVENTS_SQL} SELECT event_id, 'v' || k AS version_prompt, event_type AS proveedor, 'm' || user_id AS modelo,
        CAST(n AS BIGINT) AS tokens_prompt, CAST(CASE WHEN n < 50 THEN n * 2 END AS BIGINT) AS tokens_respuesta FROM e""",
)
def section_meta(spark, sf_dir):
    payload = F.concat(
        F.lit('{"texto":"x","_meta":{"version_prompt":"v'), "k", F.lit('","proveedor":"'), "event_type",
        F.lit('","modelo":"m'), "user_id", F.lit('","tokens_prompt":'), "n",
        F.when(F.col("n") < 50, F.concat(F.lit(',"tokens_respuesta":'), F.col("n") * 2)).otherwise(F.lit("")), F.lit("}}"),
    )
    rows = _events(spark, sf_dir).select("event_id", K.section_meta(payload).alias("m"))
    return rows.select(
        "event_id", "m.version_prompt", "m.proveedor", "m.modelo", "m.tokens_prompt", "m.tokens_respuesta"
    )


@query(
    "token_totals",
    f"""WITH {_EVENTS_SQL} SELECT user_id AS id_situacion, CAST(sum(n) AS BIGINT) AS tokens_prompt,
        CAST(sum(CASE WHEN n < 50 THEN n * 2 ELSE 0 END) AS BIGINT) AS tokens_respuesta FROM e GROUP BY user_id""",
)
def token_totals(spark, sf_dir):
    """Tokens per document; a missing count is zero, not an unknown total."""
    rows = _events(spark, sf_dir).select("user_id", "n", F.when(F.col("n") < 50, F.col("n") * 2).alias("r"))
    return rows.groupBy(F.col("user_id").alias("id_situacion")).agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("tokens_prompt"),
        F.sum(F.coalesce("r", F.lit(0))).alias("tokens_respuesta"),
    )


@query(
    "control_keys_dropped",
    f"""WITH {_EVENTS_SQL} SELECT event_id, '{{"texto":"' || event_type || '","n":' || n || '}}' AS contenido FROM e""",
)
def control_keys_dropped(spark, sf_dir):
    raw = F.concat(
        F.lit('{"texto":"'), "event_type", F.lit('","_meta":{"a":1},"n":'), "n", F.lit(',"_alternativa":{"texto":"y"}}')
    )
    return _events(spark, sf_dir).select("event_id", K.without_keys(raw).alias("contenido"))


@query(
    "schema_drift",
    f"""WITH {_EVENTS_SQL} SELECT event_id, CASE WHEN n < 30 THEN '' ELSE 'b' END AS faltan,
        CASE WHEN n < 30 THEN '' WHEN n < 60 THEN 'c' ELSE '' END AS sobran, n < 30 AS aceptada FROM e""",
)
def schema_drift(spark, sf_dir):
    n = F.col("n")
    reply = F.when(n < 30, '{"b":2,"a":1}').when(n < 60, '{"a":1,"c":2}').otherwise(F.lit('{"a":1}'))
    before = F.concat(F.lit('{"a":'), "k", F.lit(',"_meta":{},"b":0}'))
    rows = _events(spark, sf_dir).select("event_id", K.schema_drift(before, reply).alias("d"))
    return rows.select(
        "event_id",
        F.array_join("d.missing", ",").alias("faltan"),
        F.array_join("d.added", ",").alias("sobran"),
        F.col("d.accepted").alias("aceptada"),
    )


@query(
    "suggestions",
    f"""WITH {_EVENTS_SQL} SELECT event_id, 'T' || k AS titulo, event_type AS resumen FROM e WHERE n < 75
        UNION ALL SELECT event_id, 'U' || k, '' FROM e WHERE n < 25""",
)
def suggestions(spark, sf_dir):
    n = F.col("n")
    first = F.concat(F.lit('{"titulo":" T'), "k", F.lit(' ","resumen":"'), "event_type", F.lit('","otra":1}'))
    raw = (
        F.when(n < 25, F.concat(F.lit("["), first, F.lit(',{"titulo":"U'), "k", F.lit('"},{"resumen":"sin"},3]')))
        .when(n < 50, F.concat(F.lit('{"propuestas":['), first, F.lit("]}")))
        .when(n < 75, F.concat(F.lit('{"x":1,"items":['), first, F.lit("]}")))
        .otherwise(F.lit('{"texto":"nada"}'))
    )
    rows = _events(spark, sf_dir).select("event_id", F.explode(K.suggestions(raw)).alias("s"))
    return rows.select("event_id", "s.titulo", "s.resumen")


@query(
    "content_contracts",
    f"""WITH {_EVENTS_SQL}, b AS (SELECT event_id, list_filter([
        CASE WHEN event_type = 'error' THEN 'instrumentos:momento' END,
        CASE WHEN n <> 50 THEN 'instrumentos:peso' END,
        CASE WHEN n < 10 THEN 'objetivos:numero' END,
        CASE WHEN n >= 90 THEN 'rubricas:niveles' END,
        CASE WHEN event_type <> 'click' THEN 'sesiones:fase' END], lambda x: x IS NOT NULL) AS l FROM e)
    SELECT event_id, array_to_string(l, ',') AS motivos FROM b""",
)
def content_contracts(spark, sf_dir):
    n = F.col("n")
    goals = F.when(n < 10, '[{"texto":"a"}]').otherwise(F.lit('[{"texto":"a"},{"texto":"b"},{"texto":"c"},{"texto":"d"}]'))
    levels = F.when(n < 90, '{"iniciado":"a","en_proceso":"b","logrado":"c","excelente":"d"}').otherwise(F.lit('{"iniciado":"a"}'))
    moment = F.when(F.col("event_type") == "error", "final").otherwise(F.lit("sumativa"))
    phase = F.when(F.col("event_type") == "click", "cierre").otherwise(F.col("event_type"))
    content = F.concat(
        F.lit('{"objetivos":{"objetivos":'), goals, F.lit('},"evaluacion":{"instrumentos":[{"momento":"'), moment,
        F.lit('","peso":50},{"momento":"inicial","peso":'), "n", F.lit('}],"rubricas":[{"niveles":'), levels,
        F.lit('}]},"secuencia_sesiones":{"sesiones":[{"fase":"'), phase, F.lit('","actividades":["x","y"]}]}}'),
    )
    rows = _events(spark, sf_dir)
    return rows.select("event_id", F.array_join(ops.contract_breaches(content), ",").alias("motivos"))


@query(
    "operation_applicability",
    f"""WITH {_EVENTS_SQL}, r AS (SELECT event_id,
          (['resumir', 'expandir', 'traducir', 'alternativa', 'otra'])[1 + n % 5] AS operacion,
          (['descripcion', 'objetivos', 'conexion_curricular', 'secuencia_sesiones', 'evaluacion', 'atencion_diversidad'])[1 + n % 6] AS seccion
        FROM e)
    SELECT event_id, operacion, seccion FROM r WHERE operacion <> 'otra' AND seccion <> 'conexion_curricular'""",
)
def operation_applicability(spark, sf_dir):
    """Requests whose operation may be applied to their section."""
    allowed = spark.createDataFrame(
        [(o, s) for o in K.OPERATIONS for s in K.OPERABLE_SECTIONS], "operacion string, seccion string"
    )
    ops_, n = [*K.OPERATIONS, "otra"], F.col("n")
    rows = _events(spark, sf_dir).select(
        "event_id",
        F.element_at(F.array(*[F.lit(o) for o in ops_]), n % 5 + 1).alias("operacion"),
        F.element_at(F.array(*[F.lit(s) for s in K.SECTIONS]), n % 6 + 1).alias("seccion"),
    )
    return fixed_lookup(rows, allowed, ["operacion", "seccion"], "left_semi").select("event_id", "operacion", "seccion")


@query(
    "validation_reasons",
    """WITH d AS (SELECT doc_id, lang, left(text, 300) AS titulo, text AS materiales_contexto, source AS materia,
         CAST(n_chars % 300 AS INTEGER) AS num_sesiones FROM documents),
    t AS (SELECT *, length(regexp_replace(titulo, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{3000}\\x{0085}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{3000}\\x{0085}]+$', '', 'g')) AS nt,
         length(regexp_replace(materiales_contexto, '^\\s+|\\s+$', '', 'g')) AS nm FROM d)
    SELECT doc_id, concat_ws(',', CASE WHEN nt < 2 THEN 'titulo:corto' END, CASE WHEN nt > 255 THEN 'titulo:largo' END,
      CASE WHEN nm > 10000 THEN 'materiales_contexto:largo' END,
      CASE WHEN num_sesiones NOT BETWEEN 1 AND 200 THEN 'num_sesiones:rango' END,
      CASE WHEN lang NOT IN ('es', 'ca', 'gl', 'eu', 'en', 'fr', 'ar') THEN 'idioma:valor' END) AS motivos FROM t""",
)
def validation_reasons(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("idioma"),
        F.col("text").alias("titulo"),
        F.col("text").alias("materiales_contexto"),
        F.col("source").alias("materia"),
        (F.col("n_chars") % 300).cast("int").alias("num_sesiones"),
    )
    return ops.validation_reasons(rows).select("doc_id", F.array_join("motivos", ",").alias("motivos"))


@query(
    "apply_patches",
    """WITH p AS (SELECT o_orderkey, o_orderpriority, o_orderstatus,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'aplicado' WHEN '2-HIGH' THEN 'estado_no_editable'
              WHEN '3-MEDIUM' THEN 'sin_cambios' WHEN '4-NOT SPECIFIED' THEN 'aplicado' END AS resultado FROM orders)
    SELECT o_orderkey AS id_situacion, resultado,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'finalizada' ELSE o_orderstatus END AS estado,
      CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS curso FROM p""",
)
def apply_patches(spark, sf_dir):
    docs = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_situacion"), F.col("o_orderstatus").alias("estado"), F.col("o_orderpriority").alias("curso")
    )
    empty = F.create_map().cast("map<string,string>")
    none = F.lit(None).cast("string")
    changes = (
        F.when(F.col("curso") == "1-URGENT", F.create_map(F.lit("estado"), F.lit("finalizada")))
        .when(F.col("curso") == "2-HIGH", F.create_map(F.lit("estado"), F.lit("generando")))
        .when(F.col("curso") == "3-MEDIUM", empty)
        .when(F.col("curso") == "4-NOT SPECIFIED", F.create_map(F.lit("curso"), none))
    )
    patches = docs.select("id_situacion", changes.alias("cambios")).where(F.col("cambios").isNotNull())
    return ops.apply_patches(docs, patches, ["estado", "curso"]).select("id_situacion", "resultado", "estado", "curso")


@query(
    "role_permissions",
    f"""WITH {_EVENTS_SQL} SELECT event_id, CASE WHEN n < 50 THEN event_type IN ('click', 'view') ELSE n < 75 END AS permitido FROM e""",
)
def role_permissions(spark, sf_dir):
    """All of the permissions asked for, from a list or an object of flags."""
    kind, n = F.col("event_type"), F.col("n")
    listed = F.when(kind.isin("click", "view"), '["sda:leer","sda:crear"]').otherwise(F.lit('["sda:leer"]'))
    flags = F.when(n < 75, '{"sda:leer":true,"sda:crear":1}').otherwise(F.lit('{"sda:leer":true,"sda:crear":false}'))
    raw = F.when(n < 50, listed).otherwise(flags)
    return _events(spark, sf_dir).select(
        "event_id", ops.has_permissions(raw, ["sda:leer", "sda:crear"]).alias("permitido")
    )


@query(
    "summary_text",
    f"""WITH {_EVENTS_SQL} SELECT event_id, '### descripcion' || chr(10) || '- texto: ' || event_type || chr(10) || '- n: ' || n
        || chr(10) || '- lista: [' || n || ',2]' || chr(10) || '### notas' || chr(10) || '- a' || chr(10) || '- ' || n AS resumen FROM e""",
)
def summary_text(spark, sf_dir):
    raw = F.concat(
        F.lit('{"descripcion":{"texto":"'), "event_type", F.lit('","_meta":{"x":1},"n":'), "n", F.lit(',"lista":['), "n",
        F.lit(',2]},"_oculta":1,"notas":["a",'), "n", F.lit("]}"),
    )
    return _events(spark, sf_dir).select("event_id", K.summary_text(raw).alias("resumen"))
