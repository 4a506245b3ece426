"""Validation, contracts, drift and damage measured over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import bind, missing_parts
from ..functions.text import strip
from .documents import LANGUAGES, SERVER_STATES

# ---------------------------------------------------------------------------
# Row validation and patches
# ---------------------------------------------------------------------------
# Fixed values: (column, required, shortest, longest) and numeric ranges.
TEXT_LIMITS = [
    ("titulo", True, 2, 255), ("curso", True, 1, 20), ("materia", True, 1, 50),
    ("comunidad_autonoma", False, 0, 50), ("provincia", False, 0, 30), ("descripcion", False, 0, 4000),
    ("metodologia", False, 0, 100), ("perfil_aula", False, 0, 4000), ("materiales_contexto", False, 0, 10000),
]
NUMBER_RANGES = [("num_sesiones", 1, 200), ("duracion_sesion_minutos", 15, 240)]
SECTION_NAME = "^[a-z0-9_]{1,40}$"
SPOKEN_LIMIT = 20000


def validation_reasons(df: DataFrame) -> DataFrame:
    """Rows with ``motivos``: a code for every rule a row breaks.

    Only rules whose column is present are applied. Text is measured trimmed.
    """
    checks = []
    for name, required, low, high in TEXT_LIMITS:
        if name in df.columns:
            size = F.length(strip(F.col(name)))
            if required:
                checks.append(F.when(F.col(name).isNull(), F.lit(f"{name}:falta")))
            checks.append(F.when(size < low, F.lit(f"{name}:corto")))
            checks.append(F.when(size > high, F.lit(f"{name}:largo")))
    for name, low, high in NUMBER_RANGES:
        if name in df.columns:
            checks.append(F.when(~F.col(name).between(low, high), F.lit(f"{name}:rango")))
    if "idioma" in df.columns:
        checks.append(F.when(~F.col("idioma").isin(LANGUAGES), F.lit("idioma:valor")))
    if "seccion" in df.columns:
        checks.append(F.when(~F.col("seccion").rlike(SECTION_NAME), F.lit("seccion:formato")))
    if "texto" in df.columns:
        size = F.length(strip(F.col("texto")))
        checks.append(F.when(F.col("texto").isNull() | (size < 1), F.lit("texto:falta")))
        checks.append(F.when(size > SPOKEN_LIMIT, F.lit("texto:largo")))
    return df.withColumn("motivos", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    judged = validation_reasons(df)
    return judged.where(F.size("motivos") == 0).drop("motivos"), judged.where(F.size("motivos") > 0)


def apply_patches(documents: DataFrame, patches: DataFrame, fields: Sequence[str], order: str | None = None) -> DataFrame:
    """Documents after a partial update, one row each, with what became of it.

    ``patches`` holds (id_situacion, cambios MAP<STRING,STRING>); only keys
    present in the map change a field. States the server manages cannot be set
    by hand, and an empty map changes nothing. Of several patches of a document
    those that are allowed apply together, and for one field the last by
    ``order`` (without it the greatest value) wins.
    """
    allowed = ~F.coalesce(F.col("cambios")["estado"].isin(SERVER_STATES), F.lit(False))
    rank = F.col(order) if order else F.lit(0)
    parts = patches.select("id_situacion", allowed.alias("vale"), rank.alias("o"), F.explode_outer("cambios").alias("campo", "valor"))
    # one entry per field, so a document's map is as small as a patch
    last = parts.groupBy("id_situacion", "vale", "campo").agg(F.max(F.struct("o", "valor"))["valor"].alias("valor"))
    whole = last.groupBy("id_situacion", "vale").agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct("campo", "valor")), lambda e: e["campo"].isNotNull())).alias("cambios")
    )
    best = whole.groupBy("id_situacion").agg(F.max_by("cambios", "vale").alias("cambios"))
    joined = documents.join(best, ["id_situacion"], "left")
    changes = F.col("cambios")
    known = F.coalesce(F.size(F.array_intersect(F.map_keys(changes), F.array(*map(F.lit, fields)))), F.lit(0))
    forbidden = F.coalesce(changes["estado"].isin(SERVER_STATES), F.lit(False))
    outcome = (
        F.when(changes.isNull(), F.lit(None).cast("string"))
        .when(forbidden, "estado_no_editable")
        .when(known == 0, "sin_cambios")
        .otherwise(F.lit("aplicado"))
    )
    out = joined.withColumn("resultado", outcome)
    applied = F.coalesce(F.col("resultado") == "aplicado", F.lit(False))
    types = dict(documents.dtypes)
    return out.withColumns({
        f: F.when(applied & F.map_contains_key(changes, F.lit(f)), changes[f].cast(types[f])).otherwise(F.col(f))
        for f in fields
    }).drop("cambios")


def permissions(raw: Column) -> Column:
    """Permissions of a role stored as a JSON list or as an object of flags."""
    def granted(doc: Column) -> Column:
        listed = F.try_variant_get(doc, "$", "array<string>")
        flags = F.try_variant_get(doc, "$", "map<string,string>")
        on = F.map_keys(F.map_filter(flags, lambda _, v: ~F.coalesce(v, F.lit("")).isin("", "false", "0", "[]", "{}")))
        return F.coalesce(listed, on)

    return F.coalesce(bind(F.try_parse_json(raw), granted), F.array().cast("array<string>"))


def has_permissions(raw: Column, required: Sequence[str]) -> Column:
    """Whether a role grants every permission asked for."""
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), permissions(raw))) == 0


# ---------------------------------------------------------------------------
# Content contracts
# ---------------------------------------------------------------------------
# Fixed values of the content contracts.
PHASES = ["apertura", "desarrollo", "cierre"]
MOMENTS = ["inicial", "formativa", "sumativa"]
LEVELS = ["iniciado", "en_proceso", "logrado", "excelente"]
OBJECTIVES = (4, 7)
CODES_PER_LIST = {"competencias": (2, 4), "criterios": (3, 6), "saberes": (4, 8)}
ACTIVITIES = (2, 4)
_CONTRACT_SCHEMA = """
STRUCT<
  objetivos: STRUCT<objetivos: ARRAY<STRUCT<texto: STRING>>>,
  conexion_curricular: STRUCT<competencias: ARRAY<STRING>, criterios: ARRAY<STRING>, saberes: ARRAY<STRING>>,
  secuencia_sesiones: STRUCT<sesiones: ARRAY<STRUCT<fase: STRING, actividades: ARRAY<STRING>>>>,
  evaluacion: STRUCT<instrumentos: ARRAY<STRUCT<momento: STRING, peso: DOUBLE>>,
                     rubricas: ARRAY<STRUCT<niveles: MAP<STRING, STRING>>>>>
"""


def contract_breaches(content: Column) -> Column:
    """Sorted codes of the contracts a document's content breaks.

    A section that is absent breaks nothing; absence is measured elsewhere.
    """
    return bind(F.from_json(content, _CONTRACT_SCHEMA.strip()), _breaches)


def _breaches(doc: Column) -> Column:
    aims = doc["objetivos"]["objetivos"]
    sessions = doc["secuencia_sesiones"]["sesiones"]
    tools = doc["evaluacion"]["instrumentos"]
    rubrics = doc["evaluacion"]["rubricas"]
    total = F.aggregate(tools, F.lit(0.0), lambda acc, t: acc + F.coalesce(t["peso"], F.lit(0.0)))
    levels = F.array(*[F.lit(x) for x in LEVELS])
    checks = [
        F.when(~F.size(aims).between(*OBJECTIVES) & aims.isNotNull(), F.lit("objetivos:numero")),
        F.when(tools.isNotNull() & (total != 100), F.lit("instrumentos:peso")),
        F.when(F.exists(tools, lambda t: ~F.coalesce(t["momento"].isin(MOMENTS), F.lit(False))), F.lit("instrumentos:momento")),
        F.when(
            F.exists(rubrics, lambda r: F.size(F.array_except(levels, F.coalesce(F.map_keys(r["niveles"]), F.array().cast("array<string>")))) > 0),
            F.lit("rubricas:niveles"),
        ),
        F.when(F.exists(sessions, lambda s: ~F.coalesce(s["fase"].isin(PHASES), F.lit(False))), F.lit("sesiones:fase")),
        F.when(
            F.exists(sessions, lambda s: ~F.coalesce(F.size(s["actividades"]).between(*ACTIVITIES), F.lit(False))),
            F.lit("sesiones:actividades"),
        ),
    ]
    for kind, (low, high) in CODES_PER_LIST.items():
        codes = doc["conexion_curricular"][kind]
        checks.append(F.when(codes.isNotNull() & ~F.size(codes).between(low, high), F.lit(f"{kind}:numero")))
    return F.array_sort(F.array_compact(F.array(*checks)))


def incomplete_rate(sections: DataFrame, by: Sequence[str] = ("seccion", "idioma")) -> DataFrame:
    """Share of section events that came back incomplete.

    Every section event counts in the denominator, complete ones included.
    """
    gone = F.size(missing_parts(F.col("seccion"), F.col("payload"))) > 0
    return (
        sections.withColumn("incompleta", gone)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("secciones"),
            F.count_if("incompleta").alias("incompletas"),
            F.round(F.count_if("incompleta") / F.count(F.lit(1)), 6).alias("tasa"),
        )
    )


# ---------------------------------------------------------------------------
# Text damage and markers
# ---------------------------------------------------------------------------
DAMAGE = r"[\x00-\x08\x0B-\x1F\x{FFFD}]"


def damage_count(c: Column) -> Column:
    """Control characters and replacement signs; line feed and tab are fine."""
    return F.regexp_count(c, F.lit(DAMAGE)).cast("bigint")


def marker_counts(df: DataFrame, text: str, markers: Mapping[str, str]) -> DataFrame:
    """One count column per marker phrase, in whole texts, case ignored."""
    low = F.lower(F.col(text))
    return df.withColumns({
        name: F.regexp_count(low, F.lit(phrase.lower())).cast("bigint") for name, phrase in markers.items()
    })


def current_or_superseded(current: Column, superseded: Column) -> Column:
    """Text without current markers is superseded or unknown."""
    return (
        F.when((current > 0) & (superseded == 0), "vigente")
        .when((current == 0) & (superseded > 0), "derogado")
        .when(current > 0, "mezcla")
        .otherwise(F.lit("desconocido"))
    )


# ---------------------------------------------------------------------------
# Translations
# ---------------------------------------------------------------------------
def translation_report(translations: DataFrame, terms: DataFrame, misused: Mapping[str, str]) -> DataFrame:
    """Per language: messages, missing, fuzzy, term and separator errors.

    ``terms`` is the fixed list (lang, msgid, oficial); ``misused`` maps a
    language to the spelling it must not contain.
    """
    joined = translations.join(terms, ["lang", "msgid"], "left")
    bad = F.lit(False)
    for lang, spelling in misused.items():
        bad = bad | ((F.col("lang") == lang) & F.lower(F.coalesce("msgstr", F.lit(""))).contains(spelling))
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("mensajes"),
        F.count_if(F.coalesce("msgstr", F.lit("")) == "").alias("sin_traducir"),
        F.count_if(F.coalesce("fuzzy", F.lit(False))).alias("dudosas"),
        F.count_if(F.col("oficial").isNotNull() & (F.coalesce("msgstr", F.lit("")) != F.col("oficial"))).alias("terminos"),
        F.count_if(bad).alias("separador"),
    )


# ---------------------------------------------------------------------------
# Keys and references
# ---------------------------------------------------------------------------
def colliding_keys(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys that stand for more than one value."""
    return (
        df.select(*key, value).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dangling(children: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(*on).distinct(), on, "left_anti")


def subject_mismatches(
    children: DataFrame, parents: DataFrame, on: Sequence[str], column: str
) -> DataFrame:
    """Children whose column differs from their parent's."""
    other = parents.select(*on, F.col(column).alias("del_padre"))
    joined = children.join(other, on, "inner")
    return joined.where(F.col(column) != F.col("del_padre"))
