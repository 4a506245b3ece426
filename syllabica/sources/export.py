"""Authored documents flattened to the ordered rows an export prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import SECTIONS, bind

# Labels and the placeholder for a missing value.
MISSING = "—"
PARTS = {
    "competencias": "competencias específicas",
    "criterios": "criterios de evaluación",
    "saberes": "saberes básicos",
}
TITLES = {
    "competencias": "Competencias específicas",
    "criterios": "Criterios de evaluación",
    "saberes": "Saberes básicos",
}
LEVELS = {"excelente": "Excelente", "logrado": "Logrado", "en_proceso": "En proceso", "iniciado": "Iniciado"}
NOTICE = ("Esta conexión curricular está incompleta: falta ", ". Regenera la sección para completarla.")

_CITED = "ARRAY<STRUCT<codigo: STRING, competencia: STRING, justificacion: STRING>>"
SCHEMA = f"""STRUCT<
  descripcion: STRUCT<texto: STRING, pregunta_guia: STRING, producto_final: STRING>,
  objetivos: STRUCT<objetivos: ARRAY<STRUCT<texto: STRING, competencias: ARRAY<STRING>>>>,
  conexion_curricular: STRUCT<competencias: {_CITED}, criterios: {_CITED}, saberes: {_CITED}>,
  secuencia_sesiones: STRUCT<sesiones: ARRAY<STRUCT<numero: STRING, titulo: STRING, fase: STRING,
    duracion_minutos: STRING, actividades: ARRAY<STRING>, recursos: ARRAY<STRING>, criterios: ARRAY<STRING>>>>,
  evaluacion: STRUCT<instrumentos: ARRAY<STRUCT<nombre: STRING, momento: STRING, peso: STRING>>,
    rubricas: ARRAY<STRUCT<criterio: STRING, niveles: MAP<STRING, STRING>>>>,
  atencion_diversidad: STRUCT<principios_dua: ARRAY<STRING>, ajustes_no_significativos: ARRAY<STRING>,
    ajustes_significativos: ARRAY<STRING>>>"""
_ROW = "struct<etiqueta:string,valor:string,detalle:string>"


def _row(label, value, detail=None) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(col(label).alias("etiqueta"), col(value).alias("valor"), col(detail).alias("detalle"))


def _rows(*rows: Column) -> Column:
    """An array of the rows that apply (null rows drop out)."""
    return F.array_compact(F.array(*rows)).cast(f"array<{_ROW}>")


def _given(c: Column) -> Column:
    return F.coalesce(F.when(c == "", None).otherwise(c), F.lit(MISSING))


def _each(items: Column, make) -> Column:
    """Rows of every item, in order; a missing list has none."""
    return F.coalesce(F.flatten(F.transform(items, make)), F.array().cast(f"array<{_ROW}>"))


def _plain_list(items: Column, label: str) -> Column:
    return _each(items, lambda t: _rows(_row(label, t)))


def _cited_rows(section: Column, kind: str) -> Column:
    detail = (lambda e: F.coalesce(e["competencia"], F.lit(MISSING))) if kind == "criterios" else (lambda e: None)
    return _each(
        section[kind],
        lambda e: _rows(_row(
            F.concat(F.lit(TITLES[kind] + " · "), F.coalesce(e["codigo"], F.lit(MISSING))),
            F.coalesce(e["justificacion"], F.lit(MISSING)), detail(e),
        )),
    )


def section_rows(doc: Column, adaptation: Column) -> dict[str, Column]:
    """Rows of each section as arrays; sections come in canonical order."""
    about, links = doc["descripcion"], doc["conexion_curricular"]
    texts = _rows(
        F.when(about["texto"] != "", _row("Descripción", about["texto"])),
        F.when(about["pregunta_guia"] != "", _row("Pregunta guía", about["pregunta_guia"])),
        F.when(about["producto_final"] != "", _row("Producto final", about["producto_final"])),
    )
    aims = F.coalesce(
        F.transform(
            doc["objetivos"]["objetivos"],
            lambda o, i: _row(
                F.concat((i + 1).cast("string"), F.lit(".")), F.coalesce(o["texto"], F.lit("")),
                F.when(F.size(o["competencias"]) > 0, F.array_join(o["competencias"], ", ")),
            ),
        ),
        F.array().cast(f"array<{_ROW}>"),
    )
    absent = F.array_compact(F.array(*[
        F.when(F.coalesce(F.size(links[k]), F.lit(0)) <= 0, F.lit(name)) for k, name in PARTS.items()
    ]))
    notice = _rows(F.when(
        links.isNotNull() & (F.size(absent) > 0),
        _row("Aviso", F.concat(F.lit(NOTICE[0]), F.array_join(absent, ", "), F.lit(NOTICE[1]))),
    ))

    def activity(a: Column) -> Column:
        return F.when(a.startswith("{"), F.coalesce(F.get_json_object(a, "$.descripcion"), F.lit(""))).otherwise(a)

    def session(s: Column) -> Column:
        minutes = F.when(s["duracion_minutos"].isNotNull(), F.concat(s["duracion_minutos"], F.lit(" min")))
        head = _row(
            F.concat(F.lit("Sesión "), F.coalesce(s["numero"], F.lit("?"))), F.coalesce(s["titulo"], F.lit("")),
            F.concat_ws(" · ", s["fase"], minutes),
        )
        done = F.filter(F.transform(s["actividades"], activity), lambda a: a != "")
        worked = F.when(F.size(s["criterios"]) > 0, _row("Criterios trabajados", F.array_join(s["criterios"], ", ")))
        return F.concat(
            _rows(head), _plain_list(done, "Actividades"), _plain_list(s["recursos"], "Recursos"), _rows(worked)
        )

    tools = _each(doc["evaluacion"]["instrumentos"], lambda t: _rows(_row(
        F.concat(F.lit("Instrumento · "), F.coalesce(t["nombre"], F.lit(MISSING))),
        F.coalesce(t["momento"], F.lit(MISSING)), F.coalesce(F.concat(t["peso"], F.lit("%")), F.lit(MISSING)),
    )))
    rubrics = _each(doc["evaluacion"]["rubricas"], lambda r: _rows(*[
        _row(F.concat(F.lit("Criterio "), F.coalesce(r["criterio"], F.lit(MISSING))), _given(r["niveles"][k]), name)
        for k, name in LEVELS.items()
    ]))
    support = doc["atencion_diversidad"]
    kind = F.coalesce(adaptation, F.lit(""))
    none = F.array().cast(f"array<{_ROW}>")
    return {
        "descripcion": texts,
        "objetivos": aims,
        "conexion_curricular": F.concat(notice, *[_cited_rows(links, k) for k in PARTS]),
        "secuencia_sesiones": _each(doc["secuencia_sesiones"]["sesiones"], session),
        "evaluacion": F.concat(tools, rubrics),
        "atencion_diversidad": F.concat(
            _plain_list(support["principios_dua"], "Principios DUA aplicados"),
            F.when(kind == "significativa", none).otherwise(
                _plain_list(support["ajustes_no_significativos"], "Ajustes no significativos")
            ),
            F.when(kind == "no_significativa", none).otherwise(
                _plain_list(support["ajustes_significativos"], "Ajustes significativos")
            ),
        ),
    }


def _tagged(name: str, rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(F.lit(name).alias("seccion"), r.alias("r")))


def export_rows(documents: DataFrame) -> DataFrame:
    """(id_situacion, seccion, orden, etiqueta, valor, detalle) per printed row.

    Sections follow the canonical order; ``orden`` runs over the document. All
    of it happens inside the row of one document, without a shuffle.
    """
    def tagged(doc: Column) -> Column:
        by_section = section_rows(doc, F.col("tipo_adaptacion"))
        return F.concat(*[_tagged(name, by_section[name]) for name in SECTIONS])

    printed = bind(F.from_json("contenido", SCHEMA), tagged)
    rows = documents.select("id_situacion", F.posexplode(printed).alias("orden", "f"))
    return rows.select("id_situacion", F.col("f.seccion").alias("seccion"), F.col("orden").cast("bigint").alias("orden"), "f.r.*")
