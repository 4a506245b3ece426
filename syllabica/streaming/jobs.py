"""Streams of requests, task events, section events and catalogue files.

Every function takes a streaming frame and returns one, or starts a query with
a checkpoint in the shared folder. Event times are ``timestamp``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.content import missing_parts
from ..functions.text import fingerprint
from ..operators.catalogue import load_catalogue
from ..sources.catalogue_files import checked_region, flatten_catalogue, parsed_records, pieces, rejected_pieces, whole_files, with_defaults
from ..sources.tables import cut_lineage
from . import keyed

# Seconds of a limit's period, terminal events and retries.
PERIODS = {"minute": 60, "hour": 3600, "day": 86400}
TERMINAL_EVENTS = ["SUCCESS", "FAILURE"]
MAX_RETRIES = 2
#: Buckets of a table that a stream changes.
BUCKETS = 64


def rate_breaches(requests: DataFrame, limits: DataFrame, period: str, delay: str = "10 minutes") -> DataFrame:
    """Windows in which a caller passed a route's limit for one period.

    ``requests``: ts, ruta, id_usuario, ip; the caller is the account, else the
    address. ``limits`` is the fixed table (ruta, periodo, maximo).
    """
    wanted = limits.where(F.col("periodo") == period).select("ruta", "maximo")
    counted = (
        requests.withWatermark("ts", delay)
        .withColumn("quien", F.coalesce(F.col("id_usuario").cast("string"), "ip"))
        .groupBy(F.window("ts", f"{PERIODS[period]} seconds").alias("w"), "ruta", "quien")
        .agg(F.count(F.lit(1)).alias("peticiones"))
    )
    return counted.join(wanted, ["ruta"], "inner").where(F.col("peticiones") > F.col("maximo")).select(
        F.col("w.start").alias("desde"), "ruta", "quien", "peticiones", "maximo"
    )


_STATES = "id_tarea string, id_situacion bigint, event string, section string, ts bigint, final boolean"
_SEEN = "final boolean, ts bigint, event string, section string"
_VERDICTS = "id_tarea string, id_situacion bigint, fallos bigint, veredicto string"
#: The time of an event without one.
_NO_TIME = -(1 << 63)


def _by_task(events: DataFrame, delay: str, *values: Column | str) -> GroupedData:
    """Events by task with one column ``valor``, an array of the time in microseconds and ``values``.

    Spark turns each column of each key into pandas by itself, also where a key only times out, and
    a step's own pandas operations cost as much; so a step gets few columns and plain values.
    """
    micros = F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)).cast("string")
    slim = events.select("id_tarea", "id_situacion", "ts", F.array(micros, *values).alias("valor"))
    return slim.withWatermark("ts", delay).groupBy("id_tarea", "id_situacion")


def _row(names: pd.Index, *values: object) -> pd.DataFrame:
    """A frame of one row; from a dictionary of columns it would take six times as long."""
    cells = np.empty((1, len(values)), object)
    cells[0] = values
    return pd.DataFrame(cells, columns=names)


def _expire(state: GroupState, newest: int, lives_ms: int) -> None:
    """Forget the key once the watermark is ``lives_ms`` past its newest event."""
    state.setTimeoutTimestamp(max(newest // 1000 + lives_ms, state.getCurrentWatermarkMs() + 1))


def task_states(events: DataFrame, delay: str = "1 hour", lives_ms: int = 86_400_000) -> DataFrame:
    """Each change of a task's latest event; a terminal one beats all progress, also progress that comes later.

    ``events``: id_tarea, id_situacion, ts, event, section. A document's next run is a task of its own. Of one rank the
    newest event counts, then the greater by event and section. The state of a task is one event, kept
    until the watermark is ``lives_ms`` past its newest one; later events are late and dropped.
    For ``run_changes``.
    """
    names = pd.Index(["id_tarea", "id_situacion", "event", "section", "ts", "final"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = before = state.get if state.exists else None
        newest = before[1] if before else 0
        for frame in frames:
            for micros, event, section in frame["valor"].tolist():
                now = (event in TERMINAL_EVENTS, int(micros), event, section)
                best, newest = max(best, now) if best else now, max(newest, now[1])
        state.update(best)
        _expire(state, newest, lives_ms)
        if best != before:
            yield _row(names, *key, best[2], best[3], None if best[1] == _NO_TIME else best[1], best[0])

    by_task = _by_task(events, delay, "event", F.coalesce("section", F.lit("")))
    return by_task.applyInPandasWithState(step, _STATES, _SEEN, "update", "EventTimeTimeout").withColumn("ts", F.timestamp_micros("ts"))


def failure_verdicts(events: DataFrame, retries: int = MAX_RETRIES, delay: str = "1 hour", lives_ms: int = 86_400_000) -> DataFrame:
    """Each change of a failing task's verdict: provisional until its retries are spent, ``lograda`` once it succeeds.

    The state of a task is a count, a flag and a time, and expires as in ``task_states``. For ``run_changes``.
    """
    names = pd.Index(["id_tarea", "id_situacion", "fallos", "veredicto"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, done, newest = before = state.get if state.exists else (0, False, 0)
        for frame in frames:
            for micros, event in frame["valor"].tolist():
                failures, done, newest = failures + (event == "ERROR"), done or event == "SUCCESS", max(newest, int(micros))
        state.update((failures, done, newest))
        _expire(state, newest, lives_ms)
        if failures and (failures, done) != before[:2]:
            verdict = "lograda" if done else "definitivo" if failures > retries else "provisional"
            yield _row(names, *key, failures, verdict)

    by_task = _by_task(events, delay, "event")
    return by_task.applyInPandasWithState(step, _VERDICTS, "fallos bigint, lograda boolean, ts bigint", "update", "EventTimeTimeout")


def distinct_requests(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of equal requests: same document, section and fingerprint."""
    keyed = requests.withColumn("huella", fingerprint(F.col("idioma"), F.col("texto"))).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["id_situacion", "seccion", "huella"])


def incomplete_by_window(sections: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Incomplete sections over all, by event-time window, tumbling or sliding."""
    gone = F.size(missing_parts(F.col("seccion"), F.col("payload"))) > 0
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        sections.withWatermark("ts", delay)
        .withColumn("incompleta", gone)
        .groupBy(window.alias("w"), "seccion")
        .agg(F.count(F.lit(1)).alias("secciones"), F.count_if("incompleta").alias("incompletas"))
        .select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "seccion", "secciones", "incompletas")
    )


def run_append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything available now, appended to files."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_changes(
    stream: DataFrame, keys: Sequence[str], target: str, checkpoint: str, buckets: int = BUCKETS, available_now: bool = True,
) -> StreamingQuery:
    """Changed rows of ``stream`` put in place of those with the same ``keys``; a batch rewrites only the buckets it touches.

    The stream gives a key once a batch, as its state does.
    """
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        fresh = cut_lineage(batch, f"cambios-{number}")
        found = keyed.touched(fresh, keys, buckets)
        kept = lambda old: old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)
        keyed.rewrite(batch.sparkSession, target, number, found, buckets, keys, schema, kept)

    writer = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def catalogue_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(fichero, texto, bueno) of catalogue files as they arrive."""
    return pieces(whole_files(spark.readStream, path))


def catalogue_stream(spark: SparkSession, path: str, region: str | None = None, language: str = "es") -> DataFrame:
    """Records of new catalogue files of a folder as they arrive."""
    return with_defaults(parsed_records(catalogue_pieces(spark, path)), checked_region(region), language)


TABLES = {
    "competencias": "comunidad string, codigo string, materia string, id_competencia bigint, idioma string, cursos_aplicables array<string>, "
                    "descriptores array<string>, descripcion string, creada boolean, listada bigint",
    "criterios": "comunidad string, codigo string, materia string, cursos_aplicables array<string>, id_criterio bigint, idioma string, "
                 "descripcion string, id_competencia bigint, creada boolean, listada bigint",
    "saberes": "comunidad string, codigo string, materia string, descripcion string, cursos_aplicables array<string>, id_saber bigint, "
               "idioma string, bloque string, creada boolean, listada bigint",
}
SUBJECT_KEY = ["comunidad", "materia"]


def load_files(
    found: DataFrame, target: str, checkpoint: str, region: str | None = None, language: str = "es", buckets: int = BUCKETS,
    available_now: bool = True,
) -> StreamingQuery:
    """Arriving ``catalogue_pieces`` upserted into the three tables under ``target``; what can't be read goes to ``target/rechazos``.

    Rows of a subject meet in one bucket, and a batch rewrites only the buckets of its subjects: n files cost n
    and not n squared. A batch that is run again gives the same tables and rejects.
    """
    fallback = checked_region(region)

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = cut_lineage(batch, f"lote-{number}")
        rejected_pieces(staged).write.mode("overwrite").parquet(f"{target}/rechazos/lote={number:012d}")
        records = with_defaults(parsed_records(staged), fallback, language)
        flat = flatten_catalogue(records)
        touched = keyed.touched(records, SUBJECT_KEY, buckets)
        for name, schema in TABLES.items():
            put = lambda old, name=name: load_catalogue(flat, {**held, name: old})[name]
            held = {n: keyed.held(spark, f"{target}/{n}", number - 1, T.StructType.fromDDL(TABLES[n]), touched) for n in TABLES if n != name}
            keyed.rewrite(spark, f"{target}/{name}", number, touched, buckets, SUBJECT_KEY, T.StructType.fromDDL(schema), put)

    writer = found.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def loaded(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One of the three tables after the last batch."""
    return keyed.newest(spark, f"{target}/{name}", T.StructType.fromDDL(TABLES[name]))
