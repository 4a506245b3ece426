"""Which (region, subject, year) pairs the catalogue covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



PAIR = ["comunidad", "materia", "curso"]


def applies_to_year(years: Column, year: Column) -> Column:
    """Lookup rule: the list names the year."""
    return F.coalesce(F.array_contains(years, year), F.lit(False))


def applies_or_open(years: Column, year: Column) -> Column:
    """Resolution rule: an empty or missing list means every year."""
    return (F.size(F.coalesce(years, F.array().cast("array<string>"))) == 0) | applies_to_year(years, year)


def for_subject(rows: DataFrame, subject: str) -> DataFrame:
    """Rows of a subject and the rows valid for all subjects."""
    return rows.where((F.col("materia") == subject) | F.col("materia").isNull())


def subject_years(rows: DataFrame) -> DataFrame:
    """Exploded (region, subject, year); rows without subject drop out."""
    return rows.where(F.col("materia").isNotNull()).select(
        "comunidad", "materia", F.explode("cursos_aplicables").alias("curso")
    )


def pairs_in_all(tagged: DataFrame, tables: int = 3) -> DataFrame:
    """Pairs whose rows carry every table's number in ``tabla`` (0, 1, …).

    The intersection is a bit mask per pair, so the tables meet in a single
    shuffle of partially aggregated pairs instead of a join each.
    """
    mask = F.bit_or(F.expr("shiftleft(1, tabla)"))
    seen = tagged.groupBy(*PAIR).agg(mask.alias("vistas"))
    return seen.where(F.col("vistas") == (1 << tables) - 1).select(*PAIR)


def complete_pairs(competences: DataFrame, criteria: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs present in all three tables: one union and one aggregation."""
    tagged = None
    for number, rows in enumerate((competences, criteria, items)):
        part = subject_years(rows).withColumn("tabla", F.lit(number))
        tagged = part if tagged is None else tagged.unionByName(part)
    return pairs_in_all(tagged)


def coverage_by_subject(pairs: DataFrame) -> DataFrame:
    """Sorted years per subject; as many values as there are courses."""
    return pairs.groupBy("comunidad", "materia").agg(F.sort_array(F.collect_set("curso")).alias("cursos"))


def distinct_subjects(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("materia").isNotNull()).select("comunidad", "materia").distinct()


def distinct_regions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("comunidad").isNotNull()).select("comunidad").distinct()


def years_of(coverage: DataFrame, subject: str | None = None) -> DataFrame:
    """Years of one subject in a coverage table, or of all subjects."""
    rows = coverage if not subject else coverage.where(F.col("materia") == subject)
    return rows.select(F.explode("cursos").alias("curso")).distinct()


def subjects_of(coverage: DataFrame, year: str | None = None) -> DataFrame:
    """Subjects a coverage table offers in one year, or in any."""
    rows = coverage if not year else coverage.where(F.array_contains("cursos", year))
    return rows.select("materia").distinct()


def loaded_pairs(competences: DataFrame, criteria: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (region, subject, year) in any table; null year = every year."""
    out = None
    for rows in (competences, criteria, items):
        open_list = F.size(F.coalesce("cursos_aplicables", F.array().cast("array<string>"))) == 0
        part = rows.where(F.col("materia").isNotNull() & F.col("comunidad").isNotNull()).select(
            "comunidad",
            "materia",
            F.explode(
                F.when(open_list, F.array(F.lit(None).cast("string"))).otherwise(F.col("cursos_aplicables"))
            ).alias("curso"),
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def has_catalogue(scopes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (region, subject, year) scopes with a flag; null region: false.

    Two equi-joins, one for listed years and one for every-year rows, so no
    join condition is a disjunction.
    """
    wanted = scopes.select(*PAIR).distinct()
    listed = pairs.where(F.col("curso").isNotNull()).withColumn("by_year", F.lit(True))
    every = pairs.where(F.col("curso").isNull()).select("comunidad", "materia").distinct().withColumn(
        "by_subject", F.lit(True)
    )
    return (
        wanted.join(listed, PAIR, "left")
        .join(every, ["comunidad", "materia"], "left")
        .select(*PAIR, F.coalesce("by_year", "by_subject", F.lit(False)).alias("con_curriculo"))
    )


def flag_documents(documents: DataFrame, pairs: DataFrame, key: str = "id_situacion") -> DataFrame:
    """Documents with the catalogue flag of their scope."""
    flags = has_catalogue(documents, pairs)
    out = documents.join(flags, PAIR, "left")
    return out.withColumn("con_curriculo", F.coalesce("con_curriculo", F.lit(False)))


def provinces_with_catalogue(provinces: DataFrame, rows: DataFrame) -> DataFrame:
    """Provinces of each region, all kept, and whether the region is loaded."""
    loaded = distinct_regions(rows).withColumn("con_curriculo", F.lit(True))
    grouped = provinces.groupBy("comunidad").agg(F.array_sort(F.collect_set("provincia")).alias("provincias"))
    return grouped.join(loaded, "comunidad", "left").withColumn(
        "con_curriculo", F.coalesce("con_curriculo", F.lit(False))
    )


def alternatives(documents: DataFrame, complete: DataFrame, key: str = "id_situacion") -> DataFrame:
    """Documents on a missing pair with what their region and year do offer.

    ``motivo`` tells an unknown region from a pair that is not loaded. The
    list holds the subjects of one region and year.
    """
    offered = complete.groupBy("comunidad", "curso").agg(F.sort_array(F.collect_set("materia")).alias("alternativas"))
    known = complete.withColumn("completa", F.lit(True))
    scopes = documents.select(*PAIR).distinct()
    report = (
        scopes.join(known, PAIR, "left")
        .where(F.col("completa").isNull())
        .drop("completa")
        .join(offered, ["comunidad", "curso"], "left")
        .withColumn(
            "motivo", F.when(F.col("comunidad").isNull(), "sin_comunidad").otherwise(F.lit("sin_curriculo"))
        )
    )
    unknown = documents.where(F.col("comunidad").isNull()).select(
        key, *PAIR, F.lit(None).cast("array<string>").alias("alternativas"), F.lit("sin_comunidad").alias("motivo")
    )
    located = documents.where(F.col("comunidad").isNotNull()).select(key, *PAIR)
    found = located.join(report.where(F.col("comunidad").isNotNull()), PAIR, "inner")
    return (
        found.select(key, *PAIR, "alternativas", "motivo")
        .unionByName(unknown)
        .withColumn("alternativas", F.coalesce("alternativas", F.array().cast("array<string>")))
    )
