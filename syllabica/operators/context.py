"""The curriculum that applies to each document, assembled per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import summary_text
from .coverage import PAIR
from .documents import with_origin


UNKNOWN_CODE = "?"


def _in_scope(rows: DataFrame) -> DataFrame:
    """Rows exploded to the years they list; open lists apply to no lookup."""
    return rows.where(F.col("materia").isNotNull()).withColumn("curso", F.explode("cursos_aplicables"))


def _gather(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Rows of one scope as an array ordered by code.

    A scope is one subject and year of one region: the list is as long as
    that subject's curriculum, whatever the number of documents.
    """
    entry = F.struct("codigo", "__id", *[f for f in fields if f != "codigo"])
    ordered = F.array_sort(F.collect_list(entry))
    return rows.groupBy(*PAIR).agg(
        F.transform(ordered, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name)
    )


def scope_context(scopes: DataFrame, competences: DataFrame, criteria: DataFrame, items: DataFrame) -> DataFrame:
    """Competences, criteria and items of each distinct scope asked for.

    A criterion shows the code of its competence, or ``?`` if that competence
    is not among those of the scope. ``completa`` needs all three.
    """
    wanted = scopes.where(F.col("comunidad").isNotNull()).select(*PAIR).distinct()
    comp = _in_scope(competences).join(wanted, PAIR, "left_semi")
    crit = _in_scope(criteria).join(wanted, PAIR, "left_semi")
    item = _in_scope(items).join(wanted, PAIR, "left_semi")
    parent = comp.select(*PAIR, "id_competencia", F.col("codigo").alias("competencia"))
    crit = crit.join(parent, [*PAIR, "id_competencia"], "left").withColumn(
        "competencia", F.coalesce("competencia", F.lit(UNKNOWN_CODE))
    )
    lists = {
        "competencias": _gather(comp.withColumn("__id", F.col("id_competencia")), ["codigo", "descripcion", "descriptores"], "competencias"),
        "criterios": _gather(crit.withColumn("__id", F.col("id_criterio")), ["codigo", "competencia", "descripcion"], "criterios"),
        "saberes": _gather(item.withColumn("__id", F.col("id_saber")), ["codigo", "bloque", "descripcion"], "saberes"),
    }
    out = wanted
    for rows in lists.values():
        out = out.join(rows, PAIR, "left")
    complete = F.lit(True)
    for name in lists:
        complete = complete & F.col(name).isNotNull()
    return out.withColumn("completa", complete)


def scope_text(c: Column, k: Column, s: Column) -> Column:
    """The scope as the outline a prompt quotes."""
    def block(title: str, rows: Column, line, empty: str) -> Column:
        body = F.array_join(F.transform(rows, line), "\n")
        return F.concat(F.lit(title + "\n"), F.coalesce(body, F.lit(empty)))

    def described(e: Column) -> Column:
        listed = F.when(F.size(e["descriptores"]) > 0, F.array_join(e["descriptores"], ", ")).otherwise(F.lit("-"))
        return F.concat(F.lit("- "), e["codigo"], F.lit(" ["), listed, F.lit("]: "), e["descripcion"])

    return F.concat_ws(
        "\n\n",
        block("### Competencias específicas", c, described, "- (ninguna cargada)"),
        block(
            "### Criterios de evaluación", k,
            lambda e: F.concat(F.lit("- "), e["codigo"], F.lit(" (→"), e["competencia"], F.lit("): "), e["descripcion"]),
            "- (ninguno cargado)",
        ),
        block(
            "### Saberes básicos", s,
            lambda e: F.concat(F.lit("- "), e["codigo"], F.lit(" ["), e["bloque"], F.lit("]: "), e["descripcion"]),
            "- (ninguno cargado)",
        ),
    )


def document_context(documents: DataFrame, context: DataFrame) -> DataFrame:
    """Documents with the context of their scope; nulls where there is none."""
    out = documents.join(context, PAIR, "left")
    return out.withColumn("completa", F.coalesce("completa", F.lit(False)))


def adaptation_context(documents: DataFrame, origins: DataFrame) -> DataFrame:
    """Adaptations with their origin's title and a summary of its content."""
    joined = with_origin(documents, origins)
    known = F.col("titulo_origen").isNotNull()
    return joined.withColumn(
        "resumen_origen", F.when(known, summary_text(F.coalesce("contenido_origen", F.lit("{}"))))
    ).drop("contenido_origen")
