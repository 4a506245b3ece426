"""Streaming jobs run over the events files, each with a batch twin in SQL."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import jobs, keyed
from .registry import query, read


def _events(spark, sf_dir):
    """The events table, one file or a folder of them, as a stream; times as ``timestamp``."""
    schema = read(spark, sf_dir, "events").schema
    # a pattern: a plain path would have to be a folder
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _folders(spark, name):
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/datos", f"{base}/control"


def _appended(spark, name, stream):
    target, checkpoint = _folders(spark, name)
    jobs.run_append(stream, target, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _changes(spark, name, stream):
    target, checkpoint = _folders(spark, name)
    jobs.run_changes(stream, ["id_tarea"], target, checkpoint, buckets=8).awaitTermination()
    return keyed.newest(spark, target, stream.schema)


@query(
    "rate_limit_breaches",
    """WITH w AS (SELECT date_trunc('day', ts) AS desde, event_type AS ruta, CAST(user_id AS VARCHAR) AS quien, count(*) AS peticiones FROM events GROUP BY ALL)
    SELECT desde, ruta, quien, peticiones, CAST(2 AS BIGINT) AS maximo FROM w
    WHERE peticiones > 2 AND desde + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def rate_limit_breaches(spark, sf_dir):
    """Accounts over a route's daily limit, in windows the watermark closed."""
    requests = _events(spark, sf_dir).select(
        "ts", F.col("event_type").alias("ruta"), F.col("user_id").alias("id_usuario"), F.lit("0.0.0.0").alias("ip")
    )
    limits = spark.createDataFrame(
        [(r, "day", 2) for r in ("click", "view", "error", "purchase", "login", "signup", "logout", "search")],
        "ruta string, periodo string, maximo bigint",
    )
    out = _appended(spark, "limites", jobs.rate_breaches(requests, limits, "day"))
    return out.withColumn("desde", F.col("desde").cast("timestamp_ntz"))


@query(
    "rate_limits_short",
    """WITH u AS (SELECT 'minute' AS periodo, CAST(60 AS BIGINT) AS n, 1 AS maximo UNION ALL SELECT 'hour', 3600, 3),
    w AS (SELECT periodo, maximo, make_timestamp(epoch_us(ts) // (n * 1000000) * n * 1000000) AS desde, n, '10.0.0.' || user_id % 10 AS quien, count(*) AS peticiones FROM events, u GROUP BY ALL)
    SELECT periodo, desde, 'todas' AS ruta, quien, peticiones, CAST(maximo AS BIGINT) AS maximo FROM w
    WHERE peticiones > maximo AND desde + to_seconds(n) <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def rate_limits_short(spark, sf_dir):
    """Addresses over a limit per minute and per hour; callers without an account."""
    requests = _events(spark, sf_dir).select(
        "ts", F.lit("todas").alias("ruta"), F.lit(None).cast("bigint").alias("id_usuario"), F.concat(F.lit("10.0.0."), F.col("user_id") % 10).alias("ip")
    )
    limits = spark.createDataFrame([("todas", "minute", 1), ("todas", "hour", 3)], "ruta string, periodo string, maximo bigint")
    parts = [_appended(spark, f"limites-{p}", jobs.rate_breaches(requests, limits, p)).withColumn("periodo", F.lit(p)) for p in ("minute", "hour")]
    return parts[0].unionByName(parts[1]).withColumn("desde", F.col("desde").cast("timestamp_ntz"))


def _task_events(spark, sf_dir):
    """Four tasks per account: a document is generated anew, and its earlier success says nothing of the later task."""
    kind = F.col("event_type")
    return _events(spark, sf_dir).select(
        F.concat_ws("-", "user_id", F.col("event_id") % 4).alias("id_tarea"), F.col("user_id").alias("id_situacion"), "ts",
        F.when((kind == "purchase") & (F.col("value") > 90), "SUCCESS").when(kind == "error", "ERROR").otherwise(F.lit("PROGRESO")).alias("event"),
        kind.alias("section"),
    )


_TASKS_SQL = """WITH e AS (SELECT user_id || '-' || event_id % 4 AS id_tarea, user_id AS id_situacion, ts, event_type AS section,
    CASE WHEN event_type = 'purchase' AND value > 90 THEN 'SUCCESS' WHEN event_type = 'error' THEN 'ERROR' ELSE 'PROGRESO' END AS event FROM events)"""


@query(
    "latest_task_states",
    f"""{_TASKS_SQL} SELECT id_tarea, id_situacion, arg_max(event, (event = 'SUCCESS', ts, event, section)) AS event,
      arg_max(section, (event = 'SUCCESS', ts, event, section)) AS section, bool_or(event = 'SUCCESS') AS final FROM e GROUP BY ALL""",
)
def latest_task_states(spark, sf_dir):
    out = _changes(spark, "estados", jobs.task_states(_task_events(spark, sf_dir)))
    return out.select("id_tarea", "id_situacion", "event", "section", "final")


@query(
    "failure_verdicts",
    f"""{_TASKS_SQL} SELECT id_tarea, id_situacion, count(*) FILTER (event = 'ERROR') AS fallos,
        CASE WHEN count(*) FILTER (event = 'ERROR') > 2 THEN 'definitivo' ELSE 'provisional' END AS veredicto
       FROM e GROUP BY ALL HAVING count(*) FILTER (event = 'ERROR') > 0 AND NOT bool_or(event = 'SUCCESS')""",
)
def failure_verdicts(spark, sf_dir):
    return _changes(spark, "fallos", jobs.failure_verdicts(_task_events(spark, sf_dir))).where("veredicto <> 'lograda'")


@query(
    "distinct_requests",
    "SELECT DISTINCT user_id AS id_situacion, event_type AS seccion, left(sha256('es' || chr(0) || json_extract_string(props, '$.k')), 16) AS huella FROM events",
)
def distinct_requests(spark, sf_dir):
    requests = _events(spark, sf_dir).select(
        F.col("user_id").alias("id_situacion"), F.col("event_type").alias("seccion"), "ts", F.lit("es").alias("idioma"), F.col("k").cast("string").alias("texto")
    )
    out = _appended(spark, "peticiones", jobs.distinct_requests(requests))
    return out.select("id_situacion", "seccion", "huella")


_INCOMPLETE_SQL = """
WITH e AS (SELECT ts, event_type AS seccion, CAST(json_extract_string(props, '$.k') AS INTEGER) < 30 AS incompleta FROM events),
w AS ({windows})
SELECT desde, hasta, 'objetivos' AS seccion, count(*) AS secciones, count(*) FILTER (incompleta) AS incompletas FROM w
WHERE hasta <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY desde, hasta
"""


def _sections(spark, sf_dir):
    payload = F.when(F.col("k") < 30, '{"objetivos":[]}').otherwise(F.lit('{"objetivos":["x"]}'))
    return _events(spark, sf_dir).select("ts", F.lit("objetivos").alias("seccion"), payload.alias("payload"))


def _plain_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("desde", "hasta")})


@query(
    "incomplete_by_day",
    _INCOMPLETE_SQL.format(windows="SELECT date_trunc('day', ts) AS desde, date_trunc('day', ts) + INTERVAL 1 DAY AS hasta, incompleta FROM e"),
)
def incomplete_by_day(spark, sf_dir):
    return _plain_times(_appended(spark, "tasa", jobs.incomplete_by_window(_sections(spark, sf_dir), "1 day")))


@query(
    "incomplete_sliding",
    _INCOMPLETE_SQL.format(
        windows="SELECT date_trunc('day', ts) + d * INTERVAL 12 HOUR AS desde, date_trunc('day', ts) + d * INTERVAL 12 HOUR + INTERVAL 1 DAY AS hasta, incompleta "
        "FROM e, (VALUES (-1), (0), (1)) v(d) WHERE ts >= date_trunc('day', ts) + d * INTERVAL 12 HOUR AND ts < date_trunc('day', ts) + d * INTERVAL 12 HOUR + INTERVAL 1 DAY"
    ),
)
def incomplete_sliding(spark, sf_dir):
    return _plain_times(_appended(spark, "tasa", jobs.incomplete_by_window(_sections(spark, sf_dir), "1 day", "12 hours")))
