"""Table-changing jobs over the driver tables: upserts, versions, purges."""

from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import quality as qual
from ..operators import retention as ret
from ..operators import versions as ver
from ..operators.ordered import width_bucket
from ..sources.tables import parse_artefacts
from .frames import DOCUMENTS_SQL, USERS_SQL, documents, users
from .registry import query, read

# ---------------------------------------------------------------------------
# Upserts: finished orders are the kept table, the others the listed rows.
# ---------------------------------------------------------------------------
_LISTED_SQL = """
listed AS (
  SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS nueva, 'c' || o_custkey AS comunidad,
         'CE' || month(o_orderdate) AS codigo, o_orderpriority AS materia, (1 + year(o_orderdate) % 4) || 'º ESO' AS curso,
         o_orderstatus AS descriptor, 'v' || CAST(floor(o_totalprice) AS BIGINT) AS descripcion
  FROM orders)
"""


def _listed(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderstatus") != "F").alias("nueva"),
        F.concat(F.lit("c"), "o_custkey").alias("comunidad"),
        F.concat(F.lit("CE"), F.month("o_orderdate")).alias("codigo"),
        F.col("o_orderpriority").alias("materia"),
        F.lit("es").alias("idioma"),
        F.array(F.concat(F.year("o_orderdate") % 4 + 1, F.lit("º ESO"))).alias("cursos_aplicables"),
        F.array("o_orderstatus").alias("descriptores"),
        F.concat(F.lit("v"), F.floor("o_totalprice").cast("bigint")).alias("descripcion"),
        F.col("o_orderkey").alias("carga"),
    )


def _upserted(spark, sf_dir):
    rows = _listed(spark, sf_dir)
    kept = cat.upsert_competences(None, rows.where(~F.col("nueva")))
    return cat.upsert_competences(kept, rows.where("nueva"))


@query(
    "upsert_catalogue",
    f"""WITH {_LISTED_SQL} SELECT comunidad, codigo, materia, string_agg(DISTINCT curso, ',' ORDER BY curso) AS cursos,
        string_agg(DISTINCT descriptor, ',' ORDER BY descriptor) AS descriptores,
        arg_max(descripcion, (nueva, o_orderkey)) AS descripcion, bool_and(nueva) AS creada,
        count(*) FILTER (nueva) AS listada FROM listed GROUP BY ALL""",
)
def upsert_catalogue(spark, sf_dir):
    return _upserted(spark, sf_dir).select(
        "comunidad", "codigo", "materia", F.array_join("cursos_aplicables", ",").alias("cursos"),
        F.array_join("descriptores", ",").alias("descriptores"), "descripcion", "creada", "listada",
    )


@query(
    "upsert_counts",
    f"""WITH {_LISTED_SQL}, k AS (SELECT bool_and(nueva) AS creada, count(*) FILTER (nueva) AS listada
        FROM listed GROUP BY comunidad, codigo, materia)
    SELECT count(*) FILTER (creada) AS nuevas, CAST(sum(listada) - count(*) FILTER (creada) AS BIGINT) AS actualizadas FROM k""",
)
def upsert_counts(spark, sf_dir):
    return cat.load_counts(_upserted(spark, sf_dir))


@query(
    "upsert_criteria",
    f"""WITH {_LISTED_SQL} SELECT comunidad, codigo, materia, curso AS cursos, arg_max(descripcion, (nueva, o_orderkey)) AS descripcion,
        arg_max(o_custkey, (nueva, o_orderkey)) AS id_competencia, bool_and(nueva) AS creada FROM listed
        GROUP BY comunidad, codigo, materia, curso""",
)
def upsert_criteria(spark, sf_dir):
    rows = _listed(spark, sf_dir).withColumn("id_competencia", F.substring("comunidad", 2, 20).cast("bigint"))
    kept = cat.upsert_criteria(None, rows.where(~F.col("nueva")))
    merged = cat.upsert_criteria(kept, rows.where("nueva"))
    return merged.select(
        "comunidad", "codigo", "materia", F.array_join("cursos_aplicables", ",").alias("cursos"),
        "descripcion", "id_competencia", "creada",
    )


@query(
    "upsert_items",
    """WITH l AS (SELECT p_partkey, p_brand AS comunidad, 'A.' || p_size AS codigo, p_type AS materia, p_name AS descripcion,
         'B' || CAST(floor(p_retailprice / 10) AS BIGINT) AS bloque, p_retailprice > 1000 AS nueva FROM part)
    SELECT comunidad, codigo, materia, descripcion, arg_max(bloque, (nueva, p_partkey)) AS bloque, bool_and(nueva) AS creada
    FROM l GROUP BY comunidad, codigo, materia, descripcion""",
)
def upsert_items(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("comunidad"), F.concat(F.lit("A."), "p_size").alias("codigo"), F.col("p_type").alias("materia"),
        F.col("p_name").alias("descripcion"), F.array(F.lit("1º ESO")).alias("cursos_aplicables"), F.lit("es").alias("idioma"),
        F.concat(F.lit("B"), F.floor(F.col("p_retailprice") / 10).cast("bigint")).alias("bloque"),
        F.col("p_partkey").alias("carga"), (F.col("p_retailprice") > 1000).alias("nueva"),
    )
    kept = cat.upsert_items(None, rows.where(~F.col("nueva")))
    merged = cat.upsert_items(kept, rows.where("nueva"))
    return merged.select("comunidad", "codigo", "materia", "descripcion", "bloque", "creada")


@query(
    "upsert_reference",
    """SELECT coalesce(s_suppkey, c_custkey) AS id, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS n_nationkey,
        CASE WHEN s_suppkey IS NULL THEN 'conservada' WHEN c_custkey IS NULL THEN 'creada'
             WHEN s_nationkey <> c_nationkey THEN 'actualizada' ELSE 'igual' END AS resultado
       FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""",
)
def upsert_reference(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    return cat.upsert_reference(old, new, ["id"], ["n_nationkey"])


@query(
    "extraction_summary",
    """WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, CAST(len(l) AS BIGINT) AS competencias, CAST(len(l) AS BIGINT) AS criterios, CAST(1 AS BIGINT) AS bloques,
           CAST(len(l) AS BIGINT) AS items FROM w""",
)
def extraction_summary(spark, sf_dir):
    lines = F.split("text", "\n")
    blocks = read(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("materia"), F.array(F.lit("1º ESO")).alias("cursos_aplicables"),
        lines.alias("competencias_especificas"), lines.alias("criterios_evaluacion"),
        F.array(F.struct(lines.alias("items"))).alias("saberes_basicos"),
    )
    out = cat.extraction_summary(blocks)
    return out.select(F.col("materia").alias("doc_id"), "competencias", "criterios", "bloques", "items")


@query(
    "table_differences",
    """WITH a AS (SELECT l_partkey AS k FROM lineitem), b AS (SELECT p_partkey AS k FROM part)
    SELECT k, 'declarada' AS solo_en FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)
    UNION ALL SELECT k, 'derivada' FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)""",
)
def table_differences(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem", "l_partkey").select(F.col("l_partkey").alias("k"))
    b = read(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("k"))
    return cat.table_differences(a, b)


@query(
    "one_sided_pairs",
    """WITH a AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O')
    SELECT id, p, 'sin_saberes' AS falta FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT id, p, 'sin_criterios' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def one_sided_pairs(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p"), "o_orderstatus")
    return cat.one_sided_pairs(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["id", "p"])


@query(
    "colliding_keys",
    """SELECT p_name AS corta, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""",
)
def colliding_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "part", "p_name", "p_brand").select(F.col("p_name").alias("corta"), "p_brand")
    return qual.colliding_keys(rows, ["corta"], "p_brand")


@query(
    "repeated_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def repeated_keys(spark, sf_dir):
    return qual.repeated_keys(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------------------
# Invariants and retention
# ---------------------------------------------------------------------------
@query(
    "fk_mismatch",
    """SELECT l_orderkey, l_linenumber, l_linestatus, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE l_linestatus <> o_orderstatus""",
)
def fk_mismatch(spark, sf_dir):
    children = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_linestatus").alias("estado")
    )
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("estado"))
    found = qual.subject_mismatches(children, parents, ["k"], "estado")
    return found.select(
        F.col("k").alias("l_orderkey"), "l_linenumber", F.col("estado").alias("l_linestatus"),
        F.col("del_padre").alias("o_orderstatus"),
    )


@query(
    "fk_dangling",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
def fk_dangling(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id").withColumn("k", F.col("user_id"))
    urgent = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    parents = urgent.select(F.col("o_custkey").alias("k"))
    return qual.dangling(rows, parents, ["k"]).select("event_id", "user_id")


@query(
    "ghost_rows",
    """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)
       AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)""",
)
def ghost_rows(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey")
    lines = read(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' AND l_quantity > 40")
    sellers = read(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("p_partkey"))
    return ret.ghosts(parts, "p_partkey", lines.select(F.col("l_partkey").alias("p_partkey")), sellers)


_PURGE_SQL = f"""
WITH {USERS_SQL}, {DOCUMENTS_SQL},
gone_users AS (SELECT id_usuario FROM users WHERE eliminado_en <= TIMESTAMP '2024-06-01' - INTERVAL 90 DAYS),
gone_docs AS (SELECT id_situacion, id_usuario FROM docs WHERE id_usuario IN (SELECT id_usuario FROM gone_users))
"""


def _purge(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").select(
        F.col("l_orderkey").alias("id_situacion"), "l_linenumber", "l_partkey", "l_quantity"
    )
    return ret.purge(users(spark, sf_dir).select("id_usuario", "eliminado_en"), documents(spark, sf_dir).select("id_situacion", "id_usuario"), {"versions": lines}, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


@query("purge_cascade", _PURGE_SQL + """SELECT l_orderkey AS id_situacion, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE l_orderkey NOT IN (SELECT id_situacion FROM gone_docs)""")
def purge_cascade(spark, sf_dir):
    return _purge(spark, sf_dir)["versions"]


@query("purge_documents", _PURGE_SQL + "SELECT id_situacion, id_usuario FROM docs WHERE id_situacion NOT IN (SELECT id_situacion FROM gone_docs)")
def purge_documents(spark, sf_dir):
    return _purge(spark, sf_dir)["documents"]


@query(
    "purged_accounts",
    _PURGE_SQL + """SELECT id_usuario, (SELECT count(*) FROM gone_docs d WHERE d.id_usuario = g.id_usuario) AS situaciones FROM gone_users g""",
)
def purged_accounts(spark, sf_dir):
    return _purge(spark, sf_dir)["purged"].select("id_usuario", "situaciones")


@query(
    "purge_summary",
    _PURGE_SQL + """SELECT (SELECT count(*) FROM gone_users) AS cuentas_purgadas, (SELECT count(*) FROM gone_docs) AS situaciones_borradas,
    TIMESTAMP '2024-06-01' - INTERVAL 90 DAYS AS corte""",
)
def purge_summary(spark, sf_dir):
    cut = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    return ret.purge_summary(_purge(spark, sf_dir)["purged"], cut)


@query(
    "tombstones",
    f"""WITH {USERS_SQL} SELECT id_usuario, CASE WHEN eliminado_en IS NULL AND id_usuario IN (SELECT user_id FROM events WHERE event_type = 'error')
        THEN TIMESTAMP '2024-06-01' ELSE eliminado_en END AS eliminado_en FROM users""",
)
def tombstones(spark, sf_dir):
    leaving = read(spark, sf_dir, "events", "user_id", "event_type").where("event_type = 'error'")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    accounts = users(spark, sf_dir).select("id_usuario", "eliminado_en")
    return ret.tombstone(accounts, leaving.select(F.col("user_id").alias("id_usuario")), now)


@query(
    "hard_delete",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def hard_delete(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    gone = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0")
    return ret.delete_rows(rows, gone.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query(
    "references_cleared",
    """SELECT event_id, CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN user_id END AS id_usuario FROM events""",
)
def references_cleared(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id").select("event_id", F.col("user_id").alias("id_usuario"))
    gone = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0")
    return ret.clear_reference(rows, gone, "id_usuario", "c_custkey").select("event_id", "id_usuario")


@query(
    "orphan_artefacts",
    """SELECT doc_id AS id_situacion, lower(source) AS seccion, left(sha256(lang || chr(0) || text), 16) AS huella FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def orphan_artefacts(spark, sf_dir):
    huella = F.substring(F.sha2(F.concat("lang", F.lit("\x00"), "text"), 256), 1, 16)
    paths = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("/audio/"), "doc_id", F.lit("/"), F.lower("source"), F.lit("-"), huella, F.lit(".mp3")).alias("path")
    )
    kept = read(spark, sf_dir, "labels", "doc_id").select(F.col("doc_id").alias("id_situacion"))
    return ret.orphan_artefacts(parse_artefacts(paths), kept).select("id_situacion", "seccion", "huella")


@query(
    "claims_applied",
    """WITH d AS (SELECT c_custkey AS id_usuario, c_nationkey AS id_rol, c_name, c_acctbal > 5000 AS pide, c_mktsegment,
         CASE WHEN c_nationkey < 20 THEN 'NATION_' || c_nationkey ELSE 'otro' END AS rol_pedido,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'aplicar' WHEN 'MACHINERY' THEN 'descartar' END AS decision FROM customer)
    SELECT id_usuario, CASE WHEN decision = 'aplicar' AND NOT pide THEN 'sin_reclamacion' WHEN decision = 'aplicar' AND rol_pedido = 'otro' THEN 'rol_inexistente'
        WHEN decision = 'aplicar' THEN 'aplicada' WHEN decision = 'descartar' AND pide THEN 'descartada' END AS resultado,
      CASE WHEN decision = 'aplicar' AND pide AND rol_pedido <> 'otro' THEN 'Nombre ' || c_name ELSE c_name END AS nombre,
      CASE WHEN decision = 'aplicar' AND pide AND rol_pedido <> 'otro' THEN NULL ELSE 'gemini' END AS proveedor_ia,
      pide AND NOT (coalesce(decision = 'descartar', false) OR (coalesce(decision = 'aplicar', false) AND rol_pedido <> 'otro')) AS pendiente FROM d""",
)
def claims_applied(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    role = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise(F.lit("otro"))
    claim = F.concat(F.lit('{"nombre":"Nombre '), "c_name", F.lit('","rol":"'), role, F.lit('"}'))
    accounts = c.select(
        F.col("c_custkey").alias("id_usuario"), F.col("c_nationkey").alias("id_rol"), F.col("c_name").alias("nombre"),
        F.lit("gemini").alias("proveedor_ia"), F.lit(None).cast("timestamp_ntz").alias("eliminado_en"),
        F.when(F.col("c_acctbal") > 5000, claim).alias("reclamacion"),
    )
    decisions = c.select(
        F.col("c_custkey").alias("id_usuario"),
        F.when(F.col("c_mktsegment") == "BUILDING", "aplicar").when(F.col("c_mktsegment") == "MACHINERY", "descartar").alias("decision"),
    ).where(F.col("decision").isNotNull())
    roles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id_rol"), F.col("n_name").alias("nombre_rol"))
    out = ret.apply_claims(accounts, decisions, roles)
    return out.select("id_usuario", "resultado", "nombre", "proveedor_ia", F.col("reclamacion").isNotNull().alias("pendiente"))


# ---------------------------------------------------------------------------
# Versions and proposals: an event is a version of its account's document,
# holding the section named by its type.
# ---------------------------------------------------------------------------
def _versions(spark, sf_dir):
    content = F.concat(F.lit('{"'), "event_type", F.lit('":{"n":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("id_situacion"), F.col("event_id").alias("numero_version"), content.alias("contenido")
    )


@query(
    "latest_with_section",
    """SELECT user_id AS id_situacion, max(event_id) AS numero_version,
       '{"n":' || arg_max(json_extract_string(props, '$.k'), event_id) || '}' AS seccion_previa
       FROM events WHERE event_type = 'click' GROUP BY user_id""",
)
def latest_with_section(spark, sf_dir):
    return ver.latest_with_section(_versions(spark, sf_dir), "click")


@query(
    "restore_section",
    """WITH v AS (SELECT user_id, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT c_custkey AS id_situacion, CASE WHEN k IS NULL THEN 'sin_version_previa' ELSE 'restaurada' END AS resultado,
      CASE WHEN k IS NULL THEN '0' ELSE k END AS restaurada, c_name AS intacta FROM customer LEFT JOIN v ON user_id = c_custkey""",
)
def restore_section(spark, sf_dir):
    docs = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id_situacion"),
        F.concat(F.lit('{"click":{"n":0},"otra":{"t":"'), "c_name", F.lit('"}}')).alias("contenido"),
    )
    out = ver.restore_section(docs, _versions(spark, sf_dir), "click")
    return out.select(
        "id_situacion", "resultado",
        F.get_json_object("contenido", "$.click.n").alias("restaurada"),
        F.get_json_object("contenido", "$.otra.t").alias("intacta"),
    )


@query(
    "merge_sections",
    """SELECT o_orderkey AS id_situacion, o_orderpriority AS vieja, CASE WHEN o_orderstatus = 'F' THEN o_custkey || '' END AS nueva FROM orders""",
)
def merge_sections(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    docs = o.select(
        F.col("o_orderkey").alias("id_situacion"),
        F.concat(F.lit('{"descripcion":{"texto":"'), "o_orderpriority", F.lit('"}}')).alias("contenido"),
    )
    sections = o.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id_situacion"), F.lit("objetivos").alias("seccion"),
        F.concat(F.lit('{"n":'), "o_custkey", F.lit("}")).alias("payload"),
    )
    return ver.merge_sections(docs, sections).select(
        "id_situacion", F.get_json_object("contenido", "$.descripcion.texto").alias("vieja"),
        F.get_json_object("contenido", "$.objetivos.n").alias("nueva"),
    )


@query(
    "snapshot_versions",
    f"""WITH {DOCUMENTS_SQL}, h AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT id_situacion, coalesce(n, 0) + 1 AS numero_version, titulo, estado, tipo_adaptacion FROM docs LEFT JOIN h ON user_id = id_situacion
    WHERE estado = 'borrador'""",
)
def snapshot_versions(spark, sf_dir):
    changing = documents(spark, sf_dir).where("estado = 'borrador'")
    kept = read(spark, sf_dir, "events", "user_id").groupBy(F.col("user_id").alias("id_situacion")).agg(
        F.count(F.lit(1)).alias("numero_version")
    )
    out = ver.snapshots(changing, kept, F.lit("cambio"), width_bucket("id_situacion"))
    return out.select(
        "id_situacion", "numero_version", *[F.get_json_object("contenido", f"$.{f}").alias(f) for f in ("titulo", "estado", "tipo_adaptacion")]
    )


@query(
    "copy_documents",
    f"""WITH {DOCUMENTS_SQL} SELECT -id_situacion - 1 AS id_situacion, id_situacion AS id_copiada, titulo || ' (copia)' AS titulo, 'borrador' AS estado,
        CAST(NULL AS VARCHAR) AS tipo_adaptacion FROM docs""",
)
def copy_documents(spark, sf_dir):
    out = ver.copy_documents(documents(spark, sf_dir), -F.col("id_situacion") - 1)
    return out.select("id_situacion", "id_copiada", "titulo", "estado", "tipo_adaptacion")


@query(
    "adapt_documents",
    f"""WITH {DOCUMENTS_SQL} SELECT -id_situacion - 1 AS id_situacion, id_situacion AS id_situacion_origen,
        CASE WHEN o_totalprice > 200000 THEN '[ACS] ' ELSE '[ACNS] ' END || titulo AS titulo, estado_nuevo AS estado
        FROM (SELECT *, 'borrador' AS estado_nuevo FROM docs)""",
)
def adapt_documents(spark, sf_dir):
    kind = F.when(F.col("o_totalprice") > 200000, "significativa").otherwise(F.lit("no_significativa"))
    out = ver.adapt_documents(documents(spark, sf_dir), -F.col("id_situacion") - 1, kind, F.lit("perfil"))
    return out.select("id_situacion", "id_situacion_origen", "titulo", "estado")


def _proposals(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    now = F.concat(F.lit('{"texto":"a","_meta":{"version_prompt":"v1","modelo":"m'), F.col("user_id") % 3, F.lit('"}'))
    other = F.concat(
        F.lit('{"texto":"b","_meta":{'),
        F.when(F.col("k") < 50, '"version_prompt":"v2",').otherwise(F.lit("")),
        F.lit('"modelo":"m9"}}'),
    )
    content = F.concat(
        F.lit('{"'), "event_type", F.lit('":'), now,
        F.when(F.col("k") < 90, F.concat(F.lit(',"_alternativa":'), other)).otherwise(F.lit("")), F.lit("}}"),
    )
    docs = e.select(F.col("event_id").alias("id_situacion"), F.col("user_id").alias("id_usuario"), content.alias("contenido"))
    decisions = e.select(
        F.col("event_id").alias("id_situacion"), F.col("event_type").alias("seccion"),
        F.when(F.col("value") < 10, "actual").otherwise(F.lit("alternativa")).alias("cual"),
    )
    none = docs.select("id_situacion", F.lit(1).alias("numero_version")).where(F.lit(False))
    return ver.resolve_proposals(docs, decisions, none, width_bucket("id_situacion"))


_CHOICES_SQL = """
choices AS (
  SELECT event_id AS id_situacion, event_type AS seccion, CASE WHEN value < 10 THEN 'actual' ELSE 'alternativa' END AS posicion,
    'v1' AS v_act, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'v2' ELSE '?' END AS v_alt, 'm' || user_id % 3 AS m_act
  FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 90)
"""


@query(
    "resolve_proposals",
    f"""WITH {_CHOICES_SQL} SELECT id_situacion, CASE posicion WHEN 'actual' THEN 'a' ELSE 'b' END AS texto, CAST(NULL AS VARCHAR) AS pendiente FROM choices""",
)
def resolve_proposals(spark, sf_dir):
    docs = _proposals(spark, sf_dir)["documents"]
    block = F.get(F.map_values(F.from_json("contenido", "map<string,string>")), F.lit(0))
    return docs.select(
        "id_situacion", F.get_json_object(block, "$.texto").alias("texto"), F.get_json_object(block, "$._alternativa").alias("pendiente")
    )


@query(
    "proposal_versions",
    f"""WITH {_CHOICES_SQL} SELECT id_situacion, CAST(1 AS BIGINT) AS numero_version, 'Elección en «' || seccion || '»: se queda la ' || posicion AS descripcion_cambio FROM choices""",
)
def proposal_versions(spark, sf_dir):
    return _proposals(spark, sf_dir)["versions"].select("id_situacion", "numero_version", "descripcion_cambio")


@query(
    "win_rate",
    f"""WITH {_CHOICES_SQL}, s AS (
      SELECT seccion, v_act AS variante, m_act AS modelo, CAST(posicion = 'actual' AS INTEGER) AS gana FROM choices
      UNION ALL SELECT seccion, v_alt, 'm9', CAST(posicion = 'alternativa' AS INTEGER) FROM choices)
    SELECT seccion, variante, modelo, count(*) AS comparaciones, CAST(sum(gana) AS BIGINT) AS victorias, round(sum(gana) / count(*), 6) AS tasa
    FROM s GROUP BY ALL""",
)
def win_rate(spark, sf_dir):
    return ver.win_rates(_proposals(spark, sf_dir)["choices"])


@query(
    "position_rates",
    f"""WITH {_CHOICES_SQL} SELECT seccion, posicion AS posicion_elegida, count(*) AS elecciones FROM choices GROUP BY ALL""",
)
def position_rates(spark, sf_dir):
    return ver.position_rates(_proposals(spark, sf_dir)["choices"])


@query(
    "state_transitions",
    f"""WITH {DOCUMENTS_SQL}, e AS (SELECT id_situacion, estado AS estado_previo, (['inicio', 'seccion_generada', 'error', 'operacion_fallida', 'otro'])
        [CAST(left(curso, 1) AS INTEGER)] AS evento FROM docs)
    SELECT id_situacion, evento, CASE evento WHEN 'inicio' THEN 'generando' WHEN 'error' THEN 'error_generacion'
      WHEN 'seccion_generada' THEN CASE WHEN estado_previo = 'finalizada' THEN 'finalizada' ELSE 'generada' END ELSE estado_previo END AS estado_nuevo FROM e""",
)
def state_transitions(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("inicio", "seccion_generada", "error", "operacion_fallida", "otro")])
    rows = documents(spark, sf_dir).select(
        "id_situacion", F.col("estado").alias("estado_previo"),
        F.element_at(names, F.substring("curso", 1, 1).cast("int")).alias("evento"),
    )
    return ver.next_states(rows).select("id_situacion", "evento", "estado_nuevo")
