"""Listings, counts and life-cycle facts of authored documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp
from ..session import shared_dir
from ..sources.tables import write_new_state
from .ordered import numbered, running

# Document states in display order, paging and grace limits.
STATES = ["borrador", "generando", "generada", "error_generacion", "finalizada"]
LANGUAGES = ["es", "ca", "gl", "eu", "en", "fr", "ar"]
ADAPTATIONS = ["no_significativa", "significativa"]
SERVER_STATES = ["generando", "error_generacion"]
PAGE_SIZE, PAGE_CAP = 10, 100
GRACE_DAYS = 90
LINK_LIVES = {"corto": 1800, "hora": 3600, "dia": 86400, "semana": 604800}


# ---------------------------------------------------------------------------
# Predicates and projections
# ---------------------------------------------------------------------------
def filter_documents(
    df: DataFrame,
    *,
    owner: int | None = None,
    year: str | None = None,
    subject: str | None = None,
    state: str | None = None,
    q: str | None = None,
    include_adaptations: bool = True,
) -> DataFrame:
    """Optional filters, all of which must hold; shared by page and count."""
    exact = {"id_usuario": owner, "curso": year, "materia": subject, "estado": state}
    for column, wanted in exact.items():
        if wanted not in (None, ""):
            df = df.where(F.col(column) == wanted)
    if q:
        df = df.where(F.col("titulo").ilike(f"%{q}%"))
    if not include_adaptations:
        df = df.where(F.col("id_situacion_origen").isNull())
    return df


def visible_to(df: DataFrame, viewer: int, is_admin: bool) -> DataFrame:
    """Owners see their rows, administrators all."""
    return df if is_admin else df.where(F.col("id_usuario") == viewer)


def visible_documents(df: DataFrame, viewers: DataFrame) -> DataFrame:
    """Rows some viewer of (id_usuario, es_administrador) may see.

    One administrator in the table opens every row, which is decided by a
    scalar aggregate and not by pairing viewers with documents.
    """
    admins = viewers.agg(F.coalesce(F.bool_or("es_administrador"), F.lit(False)).alias("hay_admin"))
    owners = viewers.select("id_usuario").distinct().withColumn("propia", F.lit(True))
    joined = df.join(owners, ["id_usuario"], "left")
    return joined.where(admins.scalar() | F.coalesce("propia", F.lit(False))).drop("propia")


def management_view(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Metadata only: an allow-list, so new free-text columns stay out."""
    return df.select(*allowed)


def without_secret(c: Column, key: str = "contrasena_hash") -> Column:
    """JSON object without its secret key."""
    return F.to_json(F.map_filter(F.from_json(c, "map<string,variant>"), lambda k, _: k != key))


def derived_flags(df: DataFrame) -> DataFrame:
    """Adaptation flags; the kind decides, since the origin may be gone."""
    kind, origin = F.col("tipo_adaptacion"), F.col("id_situacion_origen")
    return df.withColumns({
        "es_adaptacion": kind.isNotNull(),
        "origen_perdido": kind.isNotNull() & origin.isNull(),
    })


def backup_usable(address: Column, verified: Column) -> Column:
    return address.isNotNull() & (address != "") & verified.isNotNull()


def grace_expired(marked: Column, now: Column, days: int = GRACE_DAYS) -> Column:
    """Whether the grace period is over; the boundary day counts as over."""
    return F.coalesce(marked <= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def expires_at(issued: Column, kind: str) -> Column:
    return issued + F.expr(f"INTERVAL {LINK_LIVES[kind]} SECONDS")


def owner_index(users: DataFrame) -> DataFrame:
    """Every account's id and e-mail, ordered by e-mail."""
    return users.select("id_usuario", "correo").orderBy("correo", "id_usuario")


# ---------------------------------------------------------------------------
# Pages and orders
# ---------------------------------------------------------------------------
def page(df: DataFrame, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """Newest first, id breaking ties; a size that ``checked_size`` refuses is an error."""
    size = checked_size(limit)
    return (
        df.orderBy(F.col("fecha_modificacion").desc(), F.col("id_situacion").desc())
        .offset(max(0, offset))
        .limit(size)
    )


@dataclass(frozen=True)
class RankIndex:
    """Rows cut into ranges of an order, and how many rows lie before each range."""

    table: DataFrame
    order: Sequence[Column]
    before: Sequence[tuple[int, int]]
    total: int


def rank_index(df: DataFrame, order: Sequence[Column], ranges: int = 200) -> RankIndex:
    """An index for pages at any depth: written once to the shared folder, a folder per range of the order.

    ``order`` must be unique. The driver holds a number per range.
    """
    path = f"{shared_dir(df.sparkSession)}/rangos"
    cut = df.repartitionByRange(ranges, *order).withColumn("rango", F.spark_partition_id())
    table = df.sparkSession.read.parquet(write_new_state(cut, path, ["rango"]))
    before, total = [], 0
    for row in table.groupBy("rango").count().orderBy("rango").collect():
        before.append((row["rango"], total))
        total += row["count"]
    return RankIndex(table, order, before, total)


def page_at(index: RankIndex, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """A page and each row's ``lugar`` from 1: only the ranges that hold its places are read and sorted."""
    size, offset = checked_size(limit), max(0, offset)
    ends = [start for _, start in index.before[1:]] + [index.total]
    held = [(r, start) for (r, start), end in zip(index.before, ends, strict=True) if start < offset + size and end > offset]
    first = held[0][1] if held else 0
    rows = index.table.where(F.col("rango").isin([r for r, _ in held])).drop("rango")
    shown = rows.orderBy(*index.order).offset(offset - first if held else 0).limit(size)
    # a page of ``size`` rows at most
    return shown.withColumn("lugar", F.row_number().over(W.orderBy(*index.order)) + offset)


def checked_size(limit: int, cap: int | None = PAGE_CAP) -> int:
    """A page size of at least 1 and at most ``cap`` (None: no cap); others are refused, never shortened."""
    if limit < 1 or (cap is not None and limit > cap):
        raise ValueError(f"page size {limit} is not between 1 and {cap}")
    return limit


def page_size(requested: Column) -> Column:
    return clamp(requested, 1, PAGE_CAP)


def pending_first(df: DataFrame, limit: int = PAGE_SIZE, offset: int = 0, cap: int | None = PAGE_CAP) -> DataFrame:
    """Accounts with a pending claim first, then by e-mail."""
    return (
        df.orderBy(F.col("reclamacion").isNull(), "correo", "id_usuario")
        .offset(max(0, offset))
        .limit(checked_size(limit, cap))
    )


def first_and_rest(df: DataFrame, order: Sequence[str], shown: int = 20) -> DataFrame:
    """The first rows of a report, each with how many more there are."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    head = df.orderBy(*order).limit(shown)
    return head.withColumn("y_mas", F.greatest(total.scalar() - F.lit(shown), F.lit(0).cast("bigint")))


def locale_order(df: DataFrame, column: str, locale: str = "es") -> DataFrame:
    return df.orderBy(F.collate(F.col(column), locale))


def natural_key(c: Column) -> Column:
    """Digit runs as numbers: leading text, first number, rest."""
    return F.struct(
        F.regexp_extract(c, r"^(\D*)", 1).alias("text"),
        F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint")).alias("number"),
        F.regexp_extract(c, r"^\D*\d+(.*)$", 1).alias("rest"),
    )


# ---------------------------------------------------------------------------
# Counts
# ---------------------------------------------------------------------------
def enum_frame(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, orden int")


def state_counts(df: DataFrame, states: Sequence[str] = tuple(STATES)) -> DataFrame:
    """Rows per state; known states appear at zero, unknown ones are counted."""
    counted = df.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))
    known = enum_frame(df.sparkSession, states, "estado").select("estado")
    return counted.join(known, "estado", "full").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def total_and_breakdown(df: DataFrame) -> DataFrame:
    """One row per state plus the grand total (null state, ``es_total``)."""
    return df.rollup("estado").agg(
        F.count(F.lit(1)).alias("n"), (F.grouping("estado") == 1).alias("es_total")
    )


def account_counts(users: DataFrame) -> DataFrame:
    """Live accounts and tombstoned ones."""
    return users.agg(
        F.count_if(F.col("eliminado_en").isNull()).alias("activos"),
        F.count_if(F.col("eliminado_en").isNotNull()).alias("dados_de_baja"),
    )


def owner_counts(documents: DataFrame, states: Sequence[str]) -> DataFrame:
    """Total and one filtered count per state for each owner."""
    return documents.groupBy("id_usuario").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("estado") == s).alias(s) for s in states]
    )


def users_with_counts(users: DataFrame, documents: DataFrame, states: Sequence[str]) -> DataFrame:
    """Every account with its counts; owners are counted before the join."""
    counts = owner_counts(documents, states)
    return users.join(counts, "id_usuario", "left").fillna(0, ["total", *states])


def users_by_role(users: DataFrame, roles: DataFrame, role: str | None = None) -> DataFrame:
    """Accounts with their role name, tombstoned ones marked."""
    wanted = roles if role is None else roles.where(F.col("nombre_rol") == role)
    return users.join(wanted, ["id_rol"], "inner").withColumn(
        "de_baja", F.col("eliminado_en").isNotNull()
    )


def guard_counts(users: DataFrame, documents: DataFrame) -> DataFrame:
    """Active administrators and running documents, with their two guards."""
    admins = users.agg(
        F.count_if(F.col("es_administrador") & F.col("eliminado_en").isNull()).alias("admins_activos")
    )
    running_docs = documents.agg(F.count_if(F.col("estado") == "generando").alias("en_curso"))
    return admins.withColumn("en_curso", running_docs.scalar()).withColumns({
        "puede_quitar_admin": F.col("admins_activos") > 1,
        "puede_relanzar": F.col("en_curso") == 0,
    })


def error_report(documents: DataFrame, shown: int = PAGE_CAP) -> DataFrame:
    """Counts of running and failed documents and whether failure is final.

    One scalar row; ``failed_documents`` lists the ids as rows, so a report on
    a large table never gathers them in one value.
    """
    return documents.agg(
        F.count_if(F.col("estado") == "generando").alias("generando"),
        F.count_if(F.col("estado") == "error_generacion").alias("error"),
        F.count(F.lit(1)).alias("total"),
    ).withColumns({
        "veredicto": F.when(F.col("error") == 0, "sin_errores")
        .when(F.col("generando") > 0, "provisional")
        .otherwise(F.lit("definitivo")),
        "resumen": F.format_string(
            "RESUMEN generando=%d error=%d total=%d", F.col("generando"), F.col("error"), F.col("total")
        ),
    })


def failed_documents(documents: DataFrame) -> DataFrame:
    """Ids in error, each with the verdict of the whole table."""
    verdict = error_report(documents).select("veredicto")
    failed = documents.where(F.col("estado") == "error_generacion").select("id_situacion")
    return failed.withColumn("veredicto", verdict.scalar())


def relaunch_schedule(documents: DataFrame, spacing: int) -> DataFrame:
    """Failed documents with a start delay of position times spacing seconds.

    Positions run over the whole table, counted by ranges of the id, so no
    single task ranks all rows however the ids are spread.
    """
    failed = documents.where(F.col("estado") == "error_generacion").select("id_situacion")
    ranked = numbered(failed, [], ["id_situacion"], None, "posicion")
    return ranked.select("id_situacion", ((F.col("posicion") - 1) * spacing).alias("retraso"))


# ---------------------------------------------------------------------------
# Adaptations and history
# ---------------------------------------------------------------------------
def with_origin(documents: DataFrame, origins: DataFrame) -> DataFrame:
    """Adaptations with title and content of their origin; nulls once deleted."""
    origin = origins.select(
        F.col("id_situacion").alias("id_situacion_origen"),
        F.col("titulo").alias("titulo_origen"),
        F.col("contenido").alias("contenido_origen"),
    )
    adapted = documents.where(F.col("tipo_adaptacion").isNotNull())
    return adapted.join(origin, ["id_situacion_origen"], "left")


def next_versions(batch: DataFrame, history: DataFrame, order: Sequence[str], bucket: Column) -> DataFrame:
    """Number a batch of versions after the highest number kept per document."""
    last = history.groupBy("id_situacion").agg(F.max("numero_version").cast("bigint").alias("ultima"))
    ranked = numbered(batch, ["id_situacion"], order, bucket, "n")
    out = ranked.join(last, ["id_situacion"], "left")
    return out.withColumn(
        "numero_version", F.coalesce("ultima", F.lit(0).cast("bigint")) + F.col("n")
    ).drop("ultima", "n")


def version_history(versions: DataFrame) -> DataFrame:
    """Versions of each document, newest first."""
    return versions.orderBy("id_situacion", F.col("numero_version").desc())


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, column: str) -> DataFrame:
    """Previous and next value of a column along a sequence."""
    return running(
        df, keys, order, bucket,
        previous={f"{column}_anterior": F.col(column)}, following={f"{column}_siguiente": F.col(column)},
    )
