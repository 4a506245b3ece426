"""Which AI provider a document would use, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def model_list(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, id, etiqueta, pos) of comma lists of ``id|label``.

    The first occurrence of an id keeps its place. A later one may only bring
    the label the first one lacked.
    """
    parts = df.select(key, F.posexplode(F.split(column, ",")).alias("pos", "entrada"))
    bar = F.instr("entrada", "|")
    raw_id = strip(F.when(bar > 0, F.substring_index("entrada", "|", 1)).otherwise(F.col("entrada")))
    label = F.when(bar > 0, strip(F.expr("substring(entrada, instr(entrada, '|') + 1)")))
    named = parts.select(key, "pos", raw_id.alias("id"), label.alias("label")).where(F.col("id") != "")
    useful = F.when((F.col("label") != "") & (F.col("label") != F.col("id")), F.col("pos"))
    merged = named.groupBy(key, "id").agg(F.min("pos").alias("pos"), F.min_by("label", useful).alias("label"))
    return merged.select(key, "id", F.coalesce("label", "id").alias("etiqueta"), F.col("pos").cast("bigint").alias("pos"))


def effective_provider(
    documents: DataFrame, users: DataFrame, available: DataFrame, default_provider: str, default_model: str
) -> DataFrame:
    """Chosen against effective provider of each document, through its owner.

    ``available`` is the deployment's fixed list (proveedor, modelo,
    por_defecto). A choice that is not available falls back to the system's
    and is flagged as ignored; an unknown model to its provider's default.
    """
    models = available.select("proveedor", "modelo").distinct().withColumn("modelo_valido", F.lit(True))
    defaults = available.where("por_defecto").groupBy("proveedor").agg(F.min("modelo").alias("modelo_defecto"))
    choice = users.select(
        "id_usuario",
        F.lower(strip(F.col("proveedor_ia"))).alias("proveedor"),
        F.col("modelo_ia").alias("modelo"),
        F.coalesce(F.col("proveedor_ia") != "", F.lit(False)).alias("elegido"),
    )
    judged = choice.join(defaults, ["proveedor"], "left").join(models, ["proveedor", "modelo"], "left")
    usable = F.col("modelo_defecto").isNotNull()
    per_user = judged.select(
        "id_usuario",
        F.when(usable, F.col("proveedor")).otherwise(F.lit(default_provider)).alias("proveedor"),
        F.when(usable & F.coalesce("modelo_valido", F.lit(False)), F.col("modelo"))
        .when(usable, F.col("modelo_defecto"))
        .otherwise(F.lit(default_model))
        .alias("modelo"),
        (~usable & F.col("elegido")).alias("ignorada"),
    )
    return documents.join(per_user, ["id_usuario"], "inner")


def provider_totals(documents: DataFrame, users: DataFrame, available: DataFrame, provider: str, model: str) -> DataFrame:
    """Documents per effective provider and model, and ignored preferences.

    Owners are counted first, so the join sees one row per account.
    """
    owned = documents.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "id_situacion", F.col("id_usuario")
    )
    joined = effective_provider(owned, users, available, provider, model)
    return joined.groupBy("proveedor", "modelo").agg(
        F.sum("n").alias("situaciones"), F.sum(F.when(F.col("ignorada"), F.col("n")).otherwise(0)).alias("ignoradas")
    )
