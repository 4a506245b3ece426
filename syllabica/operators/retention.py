"""Tombstones, purges with their cascade, orphans and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import grace_expired



def tombstone(users: DataFrame, leaving: DataFrame, now: Column) -> DataFrame:
    """Accounts with a tombstone set on those leaving; older ones are kept."""
    marked = leaving.select("id_usuario").distinct().withColumn("sale", F.lit(True))
    joined = users.join(marked, "id_usuario", "left")
    return joined.withColumn(
        "eliminado_en",
        F.when(F.col("sale") & F.col("eliminado_en").isNull(), now).otherwise(F.col("eliminado_en")),
    ).drop("sale")


def purge(
    users: DataFrame, documents: DataFrame, children: dict[str, DataFrame], now: Column
) -> dict[str, DataFrame]:
    """Everything left after accounts past their grace period are gone.

    Documents go with their owner and each child table (versions, links) with
    its document. ``purged`` holds the accounts and how many documents go.
    """
    expired = users.where(grace_expired(F.col("eliminado_en"), now))
    gone_users = expired.select("id_usuario")
    gone_documents = documents.select("id_situacion", "id_usuario").join(gone_users, ["id_usuario"], "left_semi")
    per_user = gone_documents.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("situaciones"))
    out = {
        "users": users.where(~grace_expired(F.col("eliminado_en"), now)),
        "documents": documents.join(gone_users, ["id_usuario"], "left_anti"),
        "purged": expired.join(per_user, "id_usuario", "left").withColumn(
            "situaciones", F.coalesce("situaciones", F.lit(0).cast("bigint"))
        ),
        "gone_documents": gone_documents,
    }
    ids = gone_documents.select("id_situacion")
    for name, rows in children.items():
        out[name] = rows.join(ids, ["id_situacion"], "left_anti")
    return out


def purge_summary(purged: DataFrame, cut: Column) -> DataFrame:
    """Cut-off, accounts and documents of one purge."""
    return purged.agg(
        F.count(F.lit(1)).alias("cuentas_purgadas"),
        F.coalesce(F.sum("situaciones"), F.lit(0).cast("bigint")).alias("situaciones_borradas"),
    ).withColumn("corte", cut)


def delete_rows(rows: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows left after a hard delete by key."""
    return rows.join(gone.select(*on).distinct(), on, "left_anti")


def clear_reference(
    rows: DataFrame, gone: DataFrame, column: str, key: str
) -> DataFrame:
    """Rows kept, with a reference to a deleted row set to null."""
    lost = gone.select(F.col(key).alias(column)).distinct().withColumn("borrada", F.lit(True))
    joined = rows.join(lost, [column], "left")
    return joined.withColumn(column, F.when(F.col("borrada").isNull(), F.col(column))).drop("borrada")


def ghosts(parents: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parents no child table refers to; every child has the key column."""
    out = parents
    for rows in children:
        out = out.join(rows.select(key).distinct(), key, "left_anti")
    return out


def orphan_artefacts(artefacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored files whose document no longer exists."""
    ids = documents.select("id_situacion")
    return artefacts.join(ids, ["id_situacion"], "left_anti")


def apply_claims(users: DataFrame, decisions: DataFrame, roles: DataFrame) -> DataFrame:
    """Accounts after claims were applied or dropped.

    Applying copies the claimed fields, clears the former holder's
    preferences and backup address and lifts the tombstone. The role comes
    from the claim, never from the former account; an unknown role leaves the
    account as it was. Dropping only removes the claim.
    """
    claim = F.from_json("reclamacion", "map<string,string>")
    role = roles.select(F.col("nombre_rol").alias("rol_pedido"), F.col("id_rol").alias("rol_nuevo"))
    judged = users.join(decisions.select("id_usuario", "decision"), "id_usuario", "left").withColumn(
        "rol_pedido", F.coalesce(claim["rol"], F.lit("docente"))
    )
    judged = judged.join(role, ["rol_pedido"], "left")
    pending = F.col("reclamacion").isNotNull()
    applied = F.coalesce((F.col("decision") == "aplicar") & pending & F.col("rol_nuevo").isNotNull(), F.lit(False))
    dropped = F.coalesce((F.col("decision") == "descartar") & pending, F.lit(False))
    fields = {
        "id_rol": F.when(applied, F.col("rol_nuevo")).otherwise(F.col("id_rol")),
        "eliminado_en": F.when(~applied, F.col("eliminado_en")),
    }
    for name in ("nombre", "centro_educativo", "especialidad", "comunidad_autonoma"):
        if name in users.columns:
            fields[name] = F.when(applied, claim[name]).otherwise(F.col(name))
    for name in ("proveedor_ia", "modelo_ia", "idioma_interfaz", "correo_respaldo", "correo_respaldo_verificado_en"):
        if name in users.columns:
            fields[name] = F.when(~applied, F.col(name))
    outcome = (
        F.when(applied, "aplicada")
        .when(dropped, "descartada")
        .when((F.col("decision") == "aplicar") & ~pending, "sin_reclamacion")
        .when(F.col("decision") == "aplicar", "rol_inexistente")
    )
    kept_claim = F.when(~(applied | dropped), F.col("reclamacion"))
    out = judged.withColumn("resultado", outcome).withColumns(fields).withColumn("reclamacion", kept_claim)
    return out.drop("decision", "rol_pedido", "rol_nuevo")
