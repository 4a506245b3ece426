"""Version snapshots, section restore, proposals and state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import CITING_SECTION, as_map, bind, has_section, merge_section, merge_section_map, section_of
from .documents import next_versions
from .joins import fixed_lookup
from .resolve import relinked

# The fields a version keeps.
VERSIONED = [
    "titulo", "curso", "materia", "comunidad_autonoma", "provincia", "descripcion", "metodologia",
    "num_sesiones", "duracion_sesion_minutos", "idioma", "perfil_aula", "materiales_contexto",
    "contenido", "estado", "tipo_adaptacion", "perfil_alumnado",
]
COPY_SUFFIX = " (copia)"
ADAPTATION_LABELS = {"significativa": "ACS", "no_significativa": "ACNS"}

# Fixed values: (previous state, event) to next state; * is any other state.
TRANSITIONS = [
    ("*", "inicio", "generando"),
    ("*", "generada", "generada"),
    ("*", "error", "error_generacion"),
    ("*", "seccion_generada", "generada"),
    ("finalizada", "seccion_generada", "finalizada"),
]


def snapshots(
    documents: DataFrame, history: DataFrame, reason: Column, bucket: Column, *, extra: Sequence[str] = ()
) -> DataFrame:
    """New versions holding the listed fields as they are before a change.

    ``documents`` are the rows about to change, one per document. Only the
    fields present in the table are kept.
    """
    fields = [c for c in VERSIONED if c in documents.columns]
    batch = documents.select(
        "id_situacion",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("contenido"),
        reason.alias("descripcion_cambio"),
        *extra,
    )
    return next_versions(batch, history, ["id_situacion"], bucket)


def latest_with_section(versions: DataFrame, section: str, contents: str = "contenido") -> DataFrame:
    """Newest version of each document that holds a section, with it.

    ``contents`` is the document JSON of the version. Versions without the key
    are passed over, however new.
    """
    name = F.lit(section)
    holding = versions.where(has_section(F.col(contents), name))
    return holding.groupBy("id_situacion").agg(
        F.max("numero_version").alias("numero_version"),
        F.max_by(section_of(F.col(contents), name), "numero_version").alias("seccion_previa"),
    )


def restore_section(documents: DataFrame, versions: DataFrame, section: str) -> DataFrame:
    """Documents with one section taken back from their latest version.

    Documents with no earlier version of the section are reported, unchanged.
    """
    found = latest_with_section(versions, section)
    joined = documents.join(found, ["id_situacion"], "left")
    usable = F.col("numero_version").isNotNull()
    return joined.withColumn(
        "contenido",
        F.when(usable, merge_section(F.col("contenido"), F.lit(section), F.col("seccion_previa"))).otherwise(
            F.col("contenido")
        ),
    ).withColumn("resultado", F.when(usable, "restaurada").otherwise(F.lit("sin_version_previa"))).drop(
        "numero_version", "seccion_previa"
    )


def section_maps(sections: DataFrame, order: str | None = None) -> DataFrame:
    """(id_situacion, secciones): a document's sections as one map.

    Of several texts of one section the last by ``order`` wins (without it the
    greatest). A document has as many sections as there are kinds of them.
    """
    by = F.struct(F.col(order), F.col("payload")) if order else F.col("payload")
    last = sections.groupBy("id_situacion", "seccion").agg(F.max_by("payload", by).alias("payload"))
    return last.groupBy("id_situacion").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("seccion", "payload")))).alias("secciones")
    )


def merge_sections(documents: DataFrame, sections: DataFrame, order: str | None = None) -> DataFrame:
    """Documents with their generated sections (seccion, payload) merged in, one row each."""
    joined = documents.join(section_maps(sections, order), ["id_situacion"], "left")
    merged = merge_section_map(F.col("contenido"), F.col("secciones"))
    return joined.withColumn(
        "contenido", F.when(F.col("secciones").isNotNull(), merged).otherwise(F.col("contenido"))
    ).drop("secciones")


def copy_documents(documents: DataFrame, new_id: Column, owner: Column | None = None) -> DataFrame:
    """Independent copies: draft state, no origin, title suffix."""
    copies = documents.withColumns({
        "id_copiada": F.col("id_situacion"),
        "titulo": F.concat("titulo", F.lit(COPY_SUFFIX)),
        "estado": F.lit("borrador"),
        "id_situacion_origen": F.lit(None).cast("bigint"),
        "tipo_adaptacion": F.lit(None).cast("string"),
    })
    if owner is not None:
        copies = copies.withColumn("id_usuario", owner)
    return copies.withColumn("id_situacion", new_id)


def adapt_documents(documents: DataFrame, new_id: Column, kind: Column, profile: Column) -> DataFrame:
    """Adaptations: empty drafts that keep their origin and carry its label.

    The class profile of an adaptation is the profile of its pupil.
    """
    label = F.create_map(*[F.lit(x) for kv in ADAPTATION_LABELS.items() for x in kv])[kind]
    changes = {
        "id_situacion_origen": F.col("id_situacion"),
        "titulo": F.concat(F.lit("["), label, F.lit("] "), "titulo"),
        "estado": F.lit("borrador"),
        "tipo_adaptacion": kind,
        "perfil_alumnado": profile,
        "perfil_aula": profile,
        "contenido": F.lit("{}"),
    }
    return documents.withColumns(changes).withColumn("id_situacion", new_id)


def resolve_proposals(
    documents: DataFrame, decisions: DataFrame, history: DataFrame, bucket: Column, links: DataFrame | None = None,
    catalogue: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Decisions (id_situacion, seccion, cual) between a section's two texts.

    Returns each document once with all winners in place, one version per
    decision that still holds both texts of every section decided with it, and
    one choice row per decision with the provenance of winner and loser. A
    section decided twice at once is decided once, by the greater ``cual``. With ``links`` and ``catalogue``
    documents whose citing section was decided are linked anew, and ``links`` of the result is the whole table.
    """
    once = decisions.where(F.col("cual").isin("actual", "alternativa")).groupBy("id_situacion", "seccion").agg(F.max("cual").alias("cual"))
    joined = documents.join(once, ["id_situacion"], "inner")
    chosen = F.col("cual") == "alternativa"

    def judged(doc: Column) -> Column:
        def sides(block: Column) -> Column:
            other = F.map_filter(as_map(block["_alternativa"]), lambda k, _: k != "_alternativa")
            current = F.map_filter(block, lambda k, _: k != "_alternativa")
            winner = F.when(chosen, other).otherwise(current)
            return F.when(
                other.isNotNull(),
                F.struct(
                    F.to_json(winner).alias("payload"),
                    F.to_json(winner["_meta"]).alias("gana"),
                    F.to_json(F.when(chosen, current).otherwise(other)["_meta"]).alias("pierde"),
                ),
            )

        return bind(as_map(doc[F.col("seccion")]), sides)

    parsed = bind(F.from_json("contenido", "map<string,variant>"), judged)
    resolved = joined.withColumn("r", parsed).where(F.col("r").isNotNull())

    def variant(c: Column) -> Column:
        return F.coalesce(F.nullif(F.get_json_object(c, "$.version_prompt"), F.lit("")), F.lit("?"))

    choices = resolved.select(
        "id_situacion",
        "id_usuario",
        "seccion",
        variant(F.col("r.gana")).alias("variante_elegida"),
        variant(F.col("r.pierde")).alias("variante_descartada"),
        F.col("cual").alias("posicion_elegida"),
        F.coalesce("r.gana", F.lit("{}")).alias("meta_elegida"),
        F.coalesce("r.pierde", F.lit("{}")).alias("meta_descartada"),
    )
    reason = F.concat(F.lit("Elección en «"), "seccion", F.lit("»: se queda la "), "cual")
    decided = merge_sections(
        documents.join(resolved.select("id_situacion").distinct(), ["id_situacion"], "left_semi"),
        resolved.select("id_situacion", "seccion", F.col("r.payload").alias("payload")),
    )
    out = {"documents": decided, "versions": snapshots(resolved.drop("r"), history, reason, bucket), "choices": choices}
    if links is not None and catalogue is not None:
        citing = resolved.where(F.col("seccion") == CITING_SECTION).select("id_situacion").distinct()
        out["links"] = relinked(links, decided.join(citing, "id_situacion", "left_semi"), catalogue)
    return out


def win_rates(choices: DataFrame, by: Sequence[str] = ("seccion", "variante", "modelo")) -> DataFrame:
    """Win rate of each variant and model, from winner and loser rows."""
    sides = F.array(
        F.struct(
            F.col("variante_elegida").alias("variante"),
            F.get_json_object("meta_elegida", "$.modelo").alias("modelo"),
            F.lit(1).alias("gana"),
        ),
        F.struct(
            F.col("variante_descartada").alias("variante"),
            F.get_json_object("meta_descartada", "$.modelo").alias("modelo"),
            F.lit(0).alias("gana"),
        ),
    )
    rows = choices.select("seccion", "posicion_elegida", F.explode(sides).alias("s")).select(
        "seccion", "posicion_elegida", "s.*"
    )
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("comparaciones"),
        F.sum("gana").alias("victorias"),
        F.round(F.sum("gana") / F.count(F.lit(1)), 6).alias("tasa"),
    )


def position_rates(choices: DataFrame) -> DataFrame:
    """How often each position is the one chosen."""
    return choices.groupBy("seccion", "posicion_elegida").agg(F.count(F.lit(1)).alias("elecciones"))


def transition_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "previo string, evento string, siguiente string")


def next_states(rows: DataFrame) -> DataFrame:
    """State after an event (estado, evento, estado_previo).

    A failed block operation restores the state held before it started.
    """
    table = transition_frame(rows.sparkSession)
    exact = table.where(F.col("previo") != "*").select(
        F.col("previo").alias("estado_previo"), "evento", F.col("siguiente").alias("por_estado")
    )
    general = table.where(F.col("previo") == "*").select("evento", F.col("siguiente").alias("por_evento"))
    joined = fixed_lookup(fixed_lookup(rows, exact, ["estado_previo", "evento"]), general, ["evento"])
    restored = F.when(F.col("evento") == "operacion_fallida", F.col("estado_previo"))
    return joined.withColumn(
        "estado_nuevo", F.coalesce(restored, "por_estado", "por_evento", "estado_previo")
    ).drop("por_estado", "por_evento")
