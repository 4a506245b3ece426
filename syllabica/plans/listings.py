"""Listings, state counts, versions and schedules of documents."""

from pyspark.sql import functions as F

from ..operators import documents as ops
from ..operators.ordered import width_bucket
from .frames import DOCUMENTS_SQL, USERS_SQL, documents, users
from .registry import query, read

_ORDER_STATES = ["borrador", "generando", "generada", "error_generacion", "finalizada"]


@query(
    "state_counts_zero_fill",
    f"""WITH {DOCUMENTS_SQL}, known(estado) AS (VALUES ('borrador'), ('generando'), ('generada'), ('error_generacion'), ('finalizada'))
    SELECT coalesce(k.estado, d.estado) AS estado, coalesce(n, 0) AS n
    FROM known k FULL JOIN (SELECT estado, count(*) AS n FROM docs GROUP BY estado) d ON d.estado = k.estado""",
)
def state_counts_zero_fill(spark, sf_dir):
    return ops.state_counts(documents(spark, sf_dir))


@query(
    "total_and_breakdown",
    f"""WITH {DOCUMENTS_SQL} SELECT estado, count(*) AS n, grouping(estado) = 1 AS es_total
        FROM docs GROUP BY ROLLUP (estado)""",
)
def total_and_breakdown(spark, sf_dir):
    return ops.total_and_breakdown(documents(spark, sf_dir))


@query(
    "account_counts",
    f"""WITH {USERS_SQL} SELECT count(*) FILTER (eliminado_en IS NULL) AS activos,
        count(*) FILTER (eliminado_en IS NOT NULL) AS dados_de_baja FROM users""",
)
def account_counts(spark, sf_dir):
    return ops.account_counts(users(spark, sf_dir))


@query(
    "owner_state_matrix",
    f"""WITH {DOCUMENTS_SQL}, {USERS_SQL}, per_owner AS (
      SELECT id_usuario, count(*) AS total, count(*) FILTER (estado = 'borrador') AS borrador,
             count(*) FILTER (estado = 'generando') AS generando, count(*) FILTER (estado = 'generada') AS generada,
             count(*) FILTER (estado = 'error_generacion') AS error_generacion,
             count(*) FILTER (estado = 'finalizada') AS finalizada
      FROM docs GROUP BY id_usuario)
    SELECT u.id_usuario, correo, coalesce(total, 0) AS total, coalesce(borrador, 0) AS borrador,
           coalesce(generando, 0) AS generando, coalesce(generada, 0) AS generada,
           coalesce(error_generacion, 0) AS error_generacion, coalesce(finalizada, 0) AS finalizada
    FROM users u LEFT JOIN per_owner p ON p.id_usuario = u.id_usuario""",
)
def owner_state_matrix(spark, sf_dir):
    accounts = users(spark, sf_dir).select("id_usuario", "correo")
    return ops.users_with_counts(accounts, documents(spark, sf_dir), _ORDER_STATES)


@query(
    "users_by_role",
    f"""WITH {USERS_SQL} SELECT id_usuario, n_name AS nombre_rol, eliminado_en IS NOT NULL AS de_baja
        FROM users JOIN nation ON n_nationkey = id_rol""",
)
def users_by_role(spark, sf_dir):
    roles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id_rol"), F.col("n_name").alias("nombre_rol"))
    return ops.users_by_role(users(spark, sf_dir), roles).select("id_usuario", "nombre_rol", "de_baja")


@query(
    "guard_counts",
    f"""WITH {DOCUMENTS_SQL}, {USERS_SQL}, a AS (
      SELECT count(*) FILTER (es_administrador AND eliminado_en IS NULL) AS admins_activos FROM users),
    d AS (SELECT count(*) FILTER (estado = 'generando') AS en_curso FROM docs)
    SELECT admins_activos, en_curso, admins_activos > 1 AS puede_quitar_admin, en_curso = 0 AS puede_relanzar FROM a, d""",
)
def guard_counts(spark, sf_dir):
    return ops.guard_counts(users(spark, sf_dir), documents(spark, sf_dir))


@query(
    "document_page",
    f"""WITH {DOCUMENTS_SQL} SELECT id_situacion, titulo, fecha_modificacion FROM docs
        WHERE estado = 'finalizada' AND titulo ILIKE '%high%'
        ORDER BY fecha_modificacion DESC, id_situacion DESC LIMIT 10 OFFSET 20""",
)
def document_page(spark, sf_dir):
    found = ops.filter_documents(documents(spark, sf_dir), state="finalizada", q="high")
    return ops.page(found, 10, 20).select("id_situacion", "titulo", "fecha_modificacion")


@query(
    "document_page_deep",
    f"""WITH {DOCUMENTS_SQL}, r AS (SELECT id_situacion, titulo, row_number() OVER (ORDER BY fecha_modificacion DESC, id_situacion DESC) AS lugar, count(*) OVER () AS n FROM docs)
        SELECT id_situacion, titulo, CAST(lugar AS INTEGER) AS lugar FROM r WHERE lugar > n // 2 AND lugar <= n // 2 + 25""",
)
def document_page_deep(spark, sf_dir):
    """The page in the middle of all documents, by an index of their order."""
    order = [F.col("fecha_modificacion").desc(), F.col("id_situacion").desc()]
    index = ops.rank_index(documents(spark, sf_dir).select("id_situacion", "titulo", "fecha_modificacion"), order)
    return ops.page_at(index, 25, index.total // 2).select("id_situacion", "titulo", "lugar")


@query(
    "pending_first_deep",
    f"""WITH {USERS_SQL}, r AS (SELECT id_usuario, row_number() OVER (ORDER BY reclamacion IS NULL, correo, id_usuario) AS lugar, count(*) OVER () AS n FROM users)
        SELECT id_usuario, CAST(lugar AS INTEGER) AS lugar FROM r WHERE lugar > n // 3 * 2 AND lugar <= n // 3 * 2 + 100""",
)
def pending_first_deep(spark, sf_dir):
    order = [F.col("reclamacion").isNull(), F.col("correo"), F.col("id_usuario")]
    index = ops.rank_index(users(spark, sf_dir), order, 20)
    return ops.page_at(index, 100, index.total // 3 * 2).select("id_usuario", "lugar")


@query(
    "document_count",
    f"""WITH {DOCUMENTS_SQL} SELECT count(*) AS total FROM docs
        WHERE curso = '2-HIGH' AND estado = 'finalizada' AND id_situacion_origen IS NULL""",
)
def document_count(spark, sf_dir):
    found = ops.filter_documents(documents(spark, sf_dir), year="2-HIGH", state="finalizada", include_adaptations=False)
    return found.agg(F.count(F.lit(1)).alias("total"))


@query(
    "visible_documents",
    f"""WITH {DOCUMENTS_SQL} SELECT id_situacion, id_usuario FROM docs
        WHERE id_usuario IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')""",
)
def visible_documents(spark, sf_dir):
    viewers = users(spark, sf_dir).where(F.col("c_mktsegment") == "FURNITURE")
    rows = ops.visible_documents(documents(spark, sf_dir), viewers.select("id_usuario", "es_administrador"))
    return rows.select("id_situacion", "id_usuario")


@query(
    "management_view",
    f"WITH {DOCUMENTS_SQL} SELECT id_situacion, id_usuario, curso, estado, fecha_modificacion FROM docs",
)
def management_view(spark, sf_dir):
    return ops.management_view(
        documents(spark, sf_dir), ["id_situacion", "id_usuario", "curso", "estado", "fecha_modificacion"]
    )


@query(
    "claims_without_secret",
    f"""WITH {USERS_SQL} SELECT id_usuario, '{{"nombre":"' || json_extract_string(reclamacion, '$.nombre') || '"}}' AS solicitud
        FROM users WHERE reclamacion IS NOT NULL""",
)
def claims_without_secret(spark, sf_dir):
    rows = users(spark, sf_dir).where(F.col("reclamacion").isNotNull())
    return rows.select("id_usuario", ops.without_secret(F.col("reclamacion")).alias("solicitud"))


@query(
    "derived_flags",
    f"""WITH {DOCUMENTS_SQL} SELECT id_situacion, tipo_adaptacion IS NOT NULL AS es_adaptacion,
        tipo_adaptacion IS NOT NULL AND id_situacion_origen IS NULL AS origen_perdido FROM docs""",
)
def derived_flags(spark, sf_dir):
    return ops.derived_flags(documents(spark, sf_dir)).select("id_situacion", "es_adaptacion", "origen_perdido")


@query(
    "own_documents",
    f"""WITH {DOCUMENTS_SQL} SELECT id_situacion, estado FROM docs WHERE id_usuario = 7""",
)
def own_documents(spark, sf_dir):
    """What one account that is no administrator may see."""
    return ops.visible_to(documents(spark, sf_dir), 7, False).select("id_situacion", "estado")


@query(
    "backup_usable",
    f"""WITH {USERS_SQL} SELECT id_usuario, c_mktsegment <> 'BUILDING' AND coalesce(eliminado_en < TIMESTAMP '2024-05-01', false) AS respaldo FROM users""",
)
def backup_usable(spark, sf_dir):
    """A backup address counts only if it is there and verified."""
    address = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("correo"))
    verified = F.when(F.col("eliminado_en") < F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"), F.col("eliminado_en"))
    return users(spark, sf_dir).select("id_usuario", ops.backup_usable(address, verified).alias("respaldo"))


@query(
    "grace_expired",
    f"""WITH {USERS_SQL} SELECT id_usuario, coalesce(eliminado_en <= TIMESTAMP '2024-06-01' - INTERVAL 90 DAYS, false) AS vencida,
        eliminado_en + to_days(90) AS fin_gracia, eliminado_en + to_seconds(604800) AS fin_enlace FROM users""",
)
def grace_expired(spark, sf_dir):
    marked = F.col("eliminado_en")
    return users(spark, sf_dir).select(
        "id_usuario",
        ops.grace_expired(marked, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).alias("vencida"),
        (marked + F.expr("INTERVAL 90 DAYS")).alias("fin_gracia"),
        ops.expires_at(marked, "semana").alias("fin_enlace"),
    )


@query("owner_index", f"WITH {USERS_SQL} SELECT id_usuario, correo FROM users")
def owner_index(spark, sf_dir):
    return ops.owner_index(users(spark, sf_dir))


@query(
    "pending_first",
    f"""WITH {USERS_SQL} SELECT id_usuario, correo FROM users
        ORDER BY reclamacion IS NULL, correo, id_usuario LIMIT 500 OFFSET 5""",
)
def pending_first(spark, sf_dir):
    return ops.pending_first(users(spark, sf_dir), 500, 5, cap=None).select("id_usuario", "correo")


@query(
    "first_and_rest",
    f"""WITH {DOCUMENTS_SQL} SELECT id_situacion, greatest((SELECT count(*) FROM docs) - 20, 0) AS y_mas
        FROM docs ORDER BY o_totalprice DESC, id_situacion LIMIT 20""",
)
def first_and_rest(spark, sf_dir):
    rows = documents(spark, sf_dir).select("id_situacion", (-F.col("o_totalprice")).alias("neg"))
    return ops.first_and_rest(rows, ["neg", "id_situacion"]).select("id_situacion", "y_mas")


@query(
    "page_size_clamp",
    "SELECT c_custkey AS id, CAST(greatest(1, least(CAST(floor(c_acctbal) AS INTEGER), 100)) AS INTEGER) AS tamano FROM customer",
)
def page_size_clamp(spark, sf_dir):
    asked = F.floor("c_acctbal").cast("int")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ops.page_size(asked).alias("tamano"))


@query(
    "error_report",
    f"""WITH {DOCUMENTS_SQL}, c AS (SELECT count(*) FILTER (estado = 'generando') AS generando,
        count(*) FILTER (estado = 'error_generacion') AS error, count(*) AS total FROM docs)
    SELECT generando, error, total,
      CASE WHEN error = 0 THEN 'sin_errores' WHEN generando > 0 THEN 'provisional' ELSE 'definitivo' END AS veredicto,
      'RESUMEN generando=' || generando || ' error=' || error || ' total=' || total AS resumen FROM c""",
)
def error_report(spark, sf_dir):
    return ops.error_report(documents(spark, sf_dir))


@query(
    "failed_documents",
    f"WITH {DOCUMENTS_SQL} SELECT id_situacion, 'definitivo' AS veredicto FROM docs WHERE estado = 'error_generacion'",
)
def failed_documents(spark, sf_dir):
    return ops.failed_documents(documents(spark, sf_dir))


@query(
    "relaunch_schedule",
    f"""WITH {DOCUMENTS_SQL} SELECT id_situacion,
        CAST((row_number() OVER (ORDER BY id_situacion) - 1) * 30 AS BIGINT) AS retraso
        FROM docs WHERE estado = 'error_generacion'""",
)
def relaunch_schedule(spark, sf_dir):
    return ops.relaunch_schedule(documents(spark, sf_dir), 30)


@query(
    "adaptations_with_origin",
    f"""WITH {DOCUMENTS_SQL} SELECT a.id_situacion, a.tipo_adaptacion, o.titulo AS titulo_origen, o.curso AS contenido_origen
        FROM docs a LEFT JOIN docs o ON o.id_situacion = a.id_situacion_origen WHERE a.tipo_adaptacion IS NOT NULL""",
)
def adaptations_with_origin(spark, sf_dir):
    rows = documents(spark, sf_dir)
    origins = rows.select("id_situacion", "titulo", F.col("curso").alias("contenido"))
    joined = ops.with_origin(rows.drop("titulo"), origins)
    return joined.select("id_situacion", "tipo_adaptacion", "titulo_origen", "contenido_origen")


@query(
    "version_numbers",
    """WITH last AS (SELECT o_custkey AS id_situacion, count(*) AS ultima FROM orders GROUP BY o_custkey)
    SELECT e.event_id, e.user_id AS id_situacion, CAST(coalesce(ultima, 0) + row_number() OVER (
        PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS BIGINT) AS numero_version
    FROM events e LEFT JOIN last ON last.id_situacion = e.user_id""",
)
def version_numbers(spark, sf_dir):
    """New versions (events) numbered after those kept (orders) per document."""
    batch = read(spark, sf_dir, "events", "event_id", "ts", "user_id").select(
        "event_id", "ts", F.col("user_id").alias("id_situacion")
    )
    kept = read(spark, sf_dir, "orders", "o_custkey").select(F.col("o_custkey").alias("id_situacion"))
    history = kept.groupBy("id_situacion").agg(F.count(F.lit(1)).alias("numero_version"))
    rows = ops.next_versions(batch, history, ["ts", "event_id"], F.date_trunc("minute", "ts"))
    return rows.select("event_id", "id_situacion", "numero_version")


@query("version_history", "SELECT user_id AS id_situacion, event_id AS numero_version FROM events")
def version_history(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "user_id", "event_id")
    return ops.version_history(rows.select(F.col("user_id").alias("id_situacion"), F.col("event_id").alias("numero_version")))


@query(
    "neighbouring_versions",
    """SELECT event_id, lag(event_type) OVER w AS event_type_anterior, lead(event_type) OVER w AS event_type_siguiente
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def neighbouring_versions(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    out = ops.neighbours(rows, ["user_id"], ["event_id"], width_bucket("event_id"), "event_type")
    return out.select("event_id", "event_type_anterior", "event_type_siguiente")
