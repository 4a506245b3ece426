"""The driver tables shaped as documents, accounts, catalogue rows and versions.

Every frame has its SQL twin beside it; both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import read

DOCUMENTS_SQL = """
docs AS (
  SELECT o_orderkey AS id_situacion, o_custkey AS id_usuario,
         'SdA ' || o_orderkey || ' ' || o_orderpriority AS titulo,
         o_orderpriority AS curso, o_orderdate AS fecha_modificacion,
         CASE WHEN o_orderstatus = 'F' THEN 'finalizada'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'error_generacion'
              WHEN o_orderstatus = 'O' THEN 'borrador'
              WHEN o_orderpriority = '5-LOW' THEN 'archivada'
              ELSE 'generada' END AS estado,
         CASE o_orderpriority WHEN '2-HIGH' THEN 'significativa'
                              WHEN '3-MEDIUM' THEN 'no_significativa' END AS tipo_adaptacion,
         CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND o_totalprice >= 100000
              THEN o_orderkey - 1 END AS id_situacion_origen,
         o_totalprice
  FROM orders)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    high, medium = F.col("o_orderpriority") == "2-HIGH", F.col("o_orderpriority") == "3-MEDIUM"
    return o.select(
        F.col("o_orderkey").alias("id_situacion"),
        F.col("o_custkey").alias("id_usuario"),
        F.concat(F.lit("SdA "), "o_orderkey", F.lit(" "), "o_orderpriority").alias("titulo"),
        F.col("o_orderpriority").alias("curso"),
        F.col("o_orderdate").alias("fecha_modificacion"),
        F.when(F.col("o_orderstatus") == "F", "finalizada")
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "error_generacion")
        .when(F.col("o_orderstatus") == "O", "borrador")
        .when(F.col("o_orderpriority") == "5-LOW", "archivada")
        .otherwise("generada").alias("estado"),
        F.when(high, "significativa").when(medium, "no_significativa").alias("tipo_adaptacion"),
        F.when((high | medium) & (F.col("o_totalprice") >= 100000), F.col("o_orderkey") - 1).alias(
            "id_situacion_origen"
        ),
        "o_totalprice",
    )


USERS_SQL = """
users AS (
  SELECT c_custkey AS id_usuario, c_nationkey AS id_rol, c_mktsegment,
         lower(c_name) || '@' || lower(c_mktsegment) || '.es' AS correo,
         CASE WHEN c_acctbal < 0
              THEN TIMESTAMP '2024-06-01 00:00:00' + to_hours(3 * CAST(floor(c_acctbal) AS INTEGER)) END AS eliminado_en,
         c_mktsegment = 'BUILDING' AS es_administrador,
         CASE WHEN c_acctbal > 9000 THEN '{"nombre":"' || c_name || '","contrasena_hash":"x"}' END AS reclamacion
  FROM customer)
"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id_usuario"),
        F.col("c_nationkey").alias("id_rol"),
        "c_mktsegment",
        F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".es")).alias("correo"),
        F.when(
            F.col("c_acctbal") < 0,
            F.expr("timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, 3 * cast(floor(c_acctbal) as int))"),
        ).alias("eliminado_en"),
        (F.col("c_mktsegment") == "BUILDING").alias("es_administrador"),
        F.when(
            F.col("c_acctbal") > 9000,
            F.concat(F.lit('{"nombre":"'), "c_name", F.lit('","contrasena_hash":"x"}')),
        ).alias("reclamacion"),
    )


PLACES_SQL = """
places AS (
  SELECT DISTINCT o_orderstatus AS estado, 'n' || c_nationkey AS comunidad, c_mktsegment AS materia,
         o_orderpriority AS curso
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def order_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three catalogue tables in one pass: ``tabla`` is the order status.

    Orders are reduced to their distinct (customer, year, status) before the
    join, so a customer holding a third of all orders meets it as a few rows.
    """
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").distinct()
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.concat(F.lit("n"), "c_nationkey").alias("comunidad"),
        F.col("c_mktsegment").alias("materia"),
        F.col("o_orderpriority").alias("curso"),
        (F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1).alias("tabla"),
    )


# Catalogue rows by brand: a bounded set of (brand, type, size) combinations,
# however many parts there are. Sizes ending in 0 are valid for every subject,
# sizes ending in 5 for every year.
CATALOGUE_SQL = """
cat AS (
  SELECT min(p_partkey) AS id, p_brand AS comunidad,
         CASE WHEN p_size <= 20 THEN 'competencias' WHEN p_size <= 35 THEN 'criterios' ELSE 'saberes' END AS kind,
         CAST(p_size AS VARCHAR) AS codigo,
         CASE WHEN CAST(p_size AS VARCHAR) LIKE '%0' THEN NULL ELSE p_type END AS materia,
         CASE WHEN CAST(p_size AS VARCHAR) LIKE '%5' THEN NULL
              ELSE CASE WHEN p_size <= 25 THEN '1º ESO' ELSE '2º ESO' END END AS curso
  FROM part GROUP BY p_brand, p_type, p_size)
"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, comunidad, kind, codigo, materia, cursos_aplicables)."""
    size = F.col("p_size")
    code = size.cast("string")
    rows = (
        read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
        .groupBy("p_brand", "p_type", "p_size")
        .agg(F.min("p_partkey").alias("id"))
    )
    return rows.select(
        "id",
        F.col("p_brand").alias("comunidad"),
        F.when(size <= 20, "competencias").when(size <= 35, "criterios").otherwise("saberes").alias("kind"),
        code.alias("codigo"),
        F.when(~code.endswith("0"), F.col("p_type")).alias("materia"),
        F.when(code.endswith("5"), F.array().cast("array<string>"))
        .otherwise(F.array(F.when(size <= 25, "1º ESO").otherwise("2º ESO")))
        .alias("cursos_aplicables"),
    )


# Events as documents citing codes: the account is the document, the key in
# ``props`` the code, spelled in one of three ways by the hour of the event.
CITATIONS_SQL = """
cited_raw AS (
  SELECT user_id AS id_situacion, event_id AS pos,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, hour(ts) AS h
  FROM events),
scopes AS (
  SELECT DISTINCT id_situacion, 'Brand#' || (1 + id_situacion % 27) AS comunidad,
         (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[1 + id_situacion % 6] AS materia,
         CASE WHEN id_situacion % 2 = 0 THEN '1º ESO' ELSE '2º ESO' END AS curso
  FROM cited_raw),
cited AS (
  SELECT id_situacion,
         CASE WHEN k <= 20 THEN 'competencias' WHEN k <= 35 THEN 'criterios' ELSE 'saberes' END AS kind,
         CASE WHEN h < 8 THEN 'CE' || k WHEN h < 16 THEN '' || k ELSE 'C.E. ' || k END AS codigo,
         min(pos) AS pos
  FROM cited_raw GROUP BY ALL)
"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_situacion, kind, codigo, pos) with repeated citations removed."""
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.hour("ts")
    spelled = (
        F.when(hour < 8, F.concat(F.lit("CE"), k)).when(hour < 16, k.cast("string")).otherwise(
            F.concat(F.lit("C.E. "), k)
        )
    )
    return (
        read(spark, sf_dir, "events", "event_id", "ts", "user_id", "props")
        .select(
            F.col("user_id").alias("id_situacion"),
            F.when(k <= 20, "competencias").when(k <= 35, "criterios").otherwise("saberes").alias("kind"),
            spelled.alias("codigo"),
            F.col("event_id").alias("pos"),
        )
        .groupBy("id_situacion", "kind", "codigo")
        .agg(F.min("pos").alias("pos"))
    )


def citing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_situacion, comunidad, materia, curso) of the citing accounts."""
    owner = F.col("user_id")
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return (
        read(spark, sf_dir, "events", "user_id")
        .distinct()
        .select(
            owner.alias("id_situacion"),
            F.concat(F.lit("Brand#"), owner % 27 + 1).alias("comunidad"),
            F.element_at(F.array(*[F.lit(t) for t in types]), (owner % 6 + 1).cast("int")).alias("materia"),
            F.when(owner % 2 == 0, "1º ESO").otherwise("2º ESO").alias("curso"),
        )
    )


LINES_SQL = """
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq
  FROM documents),
lines AS (
  SELECT doc_id, CAST(seq AS BIGINT) AS seq, text, CAST(length(text) AS BIGINT) AS size FROM raw_lines)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, text, size): every line of every document."""
    return (
        read(spark, sf_dir, "documents", "doc_id", "text")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
        .select("doc_id", F.col("seq").cast("bigint").alias("seq"), "text", F.length("text").cast("bigint").alias("size"))
    )
