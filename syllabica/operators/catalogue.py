"""Keyed upserts of the three catalogue tables.

Files cannot be merged in place, so every job computes the full new state from
the kept table and the listed rows in one aggregation; the caller writes it to
a new path. Running a job twice gives the same state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import sort_courses


COMPETENCE_KEY = ["comunidad", "codigo", "materia"]
CRITERION_KEY = ["comunidad", "codigo", "materia", "cursos_aplicables"]
ITEM_KEY = ["comunidad", "codigo", "materia", "descripcion", "cursos_aplicables"]


def stable_id(key: Sequence[str]) -> Column:
    """Surrogate id that depends on the key alone."""
    return F.xxhash64(*key)


def union_of_lists(column: str) -> Column:
    """Distinct members of all lists in a group.

    Equal lists collapse before they are gathered, so the group holds as many
    lists as there are distinct ones, not one per row.
    """
    return F.array_distinct(F.flatten(F.collect_set(column)))


def _stacked(old: DataFrame | None, new: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    listed = new.select(*columns, F.lit(None).cast("bigint").alias(id_column), "carga", F.lit(True).alias("es_nueva"))
    if old is None:
        return listed
    first = F.lit(None).cast(new.schema["carga"].dataType)
    return old.select(*columns, id_column, first.alias("carga"), F.lit(False).alias("es_nueva")).unionByName(listed)


def _order() -> Column:
    """Kept rows before every listed one, then load order."""
    return F.struct(F.col("es_nueva"), F.col("carga"))


def upsert_competences(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Years and descriptors united, description from the last row listed.

    ``new`` carries ``carga``, an orderable load position (file, place). The
    output says per key whether it is new and how often it was listed.
    """
    columns = [*COMPETENCE_KEY, "idioma", "cursos_aplicables", "descriptores", "descripcion"]
    rows = _stacked(old, new, columns, "id_competencia")
    merged = rows.groupBy(*COMPETENCE_KEY).agg(
        F.max("id_competencia").alias("id_competencia"),
        F.min_by("idioma", _order()).alias("idioma"),
        sort_courses(union_of_lists("cursos_aplicables")).alias("cursos_aplicables"),
        F.array_sort(union_of_lists("descriptores")).alias("descriptores"),
        F.max_by("descripcion", _order()).alias("descripcion"),
        F.bool_and("es_nueva").alias("creada"),
        F.count_if("es_nueva").alias("listada"),
    )
    return merged.withColumn("id_competencia", F.coalesce("id_competencia", stable_id(COMPETENCE_KEY)))


def upsert_latest(
    old: DataFrame | None, new: DataFrame, key: Sequence[str], replaced: Sequence[str], id_column: str
) -> DataFrame:
    """Rows by key with the listed values in place of the kept ones."""
    columns = [*key, "idioma", *replaced]
    rows = _stacked(old, new, columns, id_column)
    merged = rows.groupBy(*key).agg(
        F.max(id_column).alias(id_column),
        F.min_by("idioma", _order()).alias("idioma"),
        F.max_by(F.struct(*replaced), _order()).alias("ultimo"),
        F.bool_and("es_nueva").alias("creada"),
        F.count_if("es_nueva").alias("listada"),
    )
    return merged.select(
        *key, F.coalesce(id_column, stable_id(key)).alias(id_column), "idioma", "ultimo.*", "creada", "listada"
    )


def upsert_criteria(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Key on the sorted years; description and parent are replaced."""
    listed = new.withColumn("cursos_aplicables", F.array_sort("cursos_aplicables"))
    return upsert_latest(old, listed, CRITERION_KEY, ["descripcion", "id_competencia"], "id_criterio")


def upsert_items(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Key on code, text and sorted years; only the block is replaced."""
    listed = new.withColumn("cursos_aplicables", F.array_sort("cursos_aplicables"))
    return upsert_latest(old, listed, ITEM_KEY, ["bloque"], "id_saber")


def upsert_reference(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Small reference table by natural key, with what happened to each row."""
    fresh = new.select(*key, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(True).alias("en_nueva"))
    kept = old.select(*key, *values, F.lit(True).alias("en_vieja"))
    joined = kept.join(fresh, list(key), "full")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"n_{v}"))
    outcome = (
        F.when(F.col("en_nueva").isNull(), "conservada")
        .when(F.col("en_vieja").isNull(), "creada")
        .when(changed, "actualizada")
        .otherwise(F.lit("igual"))
    )
    return joined.select(
        *key,
        *[F.when(F.col("en_nueva").isNotNull(), F.col(f"n_{v}")).otherwise(F.col(v)).alias(v) for v in values],
        outcome.alias("resultado"),
    )


def load_counts(merged: DataFrame) -> DataFrame:
    """Created keys, and listings that updated a key already there."""
    return merged.agg(
        F.count_if(F.col("creada")).alias("nuevas"),
        F.coalesce(F.sum("listada") - F.count_if(F.col("creada")), F.lit(0).cast("bigint")).alias("actualizadas"),
    )


def link_parents(criteria: DataFrame, competences: DataFrame) -> DataFrame:
    """Criteria with the id of their competence, by code inside a subject."""
    parents = competences.select(
        "comunidad", "materia", F.col("codigo").alias("competencia"), "id_competencia"
    )
    return criteria.join(parents, ["comunidad", "materia", "competencia"], "inner")


def load_catalogue(
    flat: dict[str, DataFrame], old: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The three tables after loading flattened files onto the kept ones.

    Criteria whose competence is not in their own file were set apart when the
    files were flattened.
    """
    old = old or {}
    competences = upsert_competences(old.get("competencias"), flat["competencias"])
    criteria = upsert_criteria(old.get("criterios"), link_parents(flat["criterios"], competences))
    return {
        "competencias": competences,
        "criterios": criteria,
        "saberes": upsert_items(old.get("saberes"), flat["saberes"]),
    }


def extraction_summary(blocks: DataFrame) -> DataFrame:
    """Competences, criteria, blocks and items of each extracted record."""
    return blocks.select(
        "materia",
        "cursos_aplicables",
        F.size("competencias_especificas").cast("bigint").alias("competencias"),
        F.size("criterios_evaluacion").cast("bigint").alias("criterios"),
        F.size("saberes_basicos").cast("bigint").alias("bloques"),
        F.aggregate(
            "saberes_basicos", F.lit(0).cast("bigint"), lambda acc, b: acc + F.size(b["items"]).cast("bigint")
        ).alias("items"),
    )


def table_differences(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted."""
    return (
        declared.exceptAll(derived).withColumn("solo_en", F.lit("declarada"))
        .unionByName(derived.exceptAll(declared).withColumn("solo_en", F.lit("derivada")))
    )


def one_sided_pairs(criteria: DataFrame, items: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs with criteria but no items, and the reverse; one aggregation."""
    sides = criteria.select(*key, F.lit(1).alias("lado")).unionByName(items.select(*key, F.lit(2).alias("lado")))
    seen = sides.groupBy(*key).agg(F.bit_or("lado").alias("lado")).where(F.col("lado") != 3)
    return seen.select(*key, F.when(F.col("lado") == 1, "sin_saberes").otherwise(F.lit("sin_criterios")).alias("falta"))
