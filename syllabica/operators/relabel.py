"""Rule-table reassignment, subject splits and column backfills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import stable_id
from .joins import fixed_lookup
from .resolve import relinked
from .retention import ghosts
from .versions import snapshots

# Pairs with a single right destination, and the one pair whose
# destination is a choice.
REASSIGNMENTS = [
    ("Lengua Castellana y Literatura", "1º ESO", "Lengua", "1º ESO"),
    ("Lengua Castellana y Literatura", "2º ESO", "Lengua", "2º ESO"),
    ("Lengua Castellana y Literatura", "3º ESO", "Lengua", "3º ESO"),
    ("Lengua Castellana y Literatura", "4º ESO", "Lengua", "4º ESO"),
    ("Tecnología y Digitalización", "4º ESO", "Tecnología", "4º ESO"),
]
AMBIGUOUS = ("Matemáticas", "4º ESO")
TRACKS = ("A", "B")


def reassign(
    documents: DataFrame,
    rules: Sequence[tuple[str, str, str, str]] = tuple(REASSIGNMENTS),
    ambiguous: tuple[str, str] = AMBIGUOUS,
    track: str | None = None,
) -> dict[str, DataFrame]:
    """Documents on pairs without catalogue, by what the rules say.

    ``reassigned`` carries the old and the new pair; ``unmatched`` the rows no
    rule covers, among them the ambiguous pair unless a track is given. The
    caller passes documents flagged with ``con_curriculo``.
    """
    rows = list(rules)
    if track in TRACKS:
        rows.append((*ambiguous, f"{ambiguous[0]} {track}", ambiguous[1]))
    table = documents.sparkSession.createDataFrame(
        rows, "materia string, curso string, materia_nueva string, curso_nuevo string"
    )
    judged = fixed_lookup(documents, table, ["materia", "curso"])
    lost = judged.where(~F.col("con_curriculo"))
    return {
        "unchanged": documents.where("con_curriculo"),
        "reassigned": lost.where(F.col("materia_nueva").isNotNull()),
        "unmatched": lost.where(F.col("materia_nueva").isNull()).drop("materia_nueva", "curso_nuevo"),
    }


def reassignment_job(
    documents: DataFrame, history: DataFrame, bucket: Column, track: str | None = None,
    rules: Sequence[tuple[str, str, str, str]] = tuple(REASSIGNMENTS),
    ambiguous: tuple[str, str] = AMBIGUOUS, links: DataFrame | None = None, catalogue: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Documents with their new pair and a version of the old state each.

    With ``links`` and ``catalogue`` the moved documents are linked anew: ``links`` of the result is the whole table.
    """
    parts = reassign(documents, rules, ambiguous, track)
    moved = parts["reassigned"]
    reason = F.concat(
        F.lit("Reasignación curricular: "), "materia", F.lit(" · "), "curso", F.lit(" no existe en el catálogo.")
    )
    versions = snapshots(moved, history, reason, bucket)
    after = moved.withColumns({"materia": F.col("materia_nueva"), "curso": F.col("curso_nuevo")})
    kept = parts["unchanged"].unionByName(parts["unmatched"])
    moved_now = after.drop("materia_nueva", "curso_nuevo")
    out = {"documents": moved_now.unionByName(kept), "versions": versions, "unmatched": parts["unmatched"]}
    if links is not None and catalogue is not None:
        out["links"] = relinked(links, moved_now, catalogue)
    return out


def relink_children(children: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Children moved from an old parent to the new one with the same code."""
    pairs = old.select(F.col("id_competencia"), "comunidad", "codigo").join(
        new.select("comunidad", "codigo", F.col("id_competencia").alias("id_nuevo")), ["comunidad", "codigo"]
    )
    joined = children.join(pairs.select("id_competencia", "id_nuevo"), ["id_competencia"], "left")
    return joined.withColumn("id_competencia", F.coalesce("id_nuevo", "id_competencia")).drop("id_nuevo")


def split_subject(
    tables: Mapping[str, DataFrame],
    old: str, new: str, kept_year: str, new_years: Sequence[str],
) -> dict[str, DataFrame]:
    """One subject label split in two by year.

    Criteria and items outside ``kept_year`` take the new label. Competences
    had been merged over years, so they are copied to it; criteria are
    relinked to the copy; the old set is narrowed to ``kept_year`` and rows
    nothing refers to any more are dropped. Documents follow their year.
    Tables: competencias, criterios, saberes, enlaces (id_situacion,
    id_competencia), situaciones.
    """
    label = F.col("materia") == old
    moves = label & ~F.coalesce(F.array_contains("cursos_aplicables", kept_year), F.lit(False))

    def relabelled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("materia", F.when(moves, F.lit(new)).otherwise(F.col("materia")))

    competences = tables["competencias"]
    subject = competences.where(label)
    copies = subject.withColumns({
        "materia": F.lit(new),
        "cursos_aplicables": F.array(*[F.lit(y) for y in new_years]),
    }).withColumn("id_competencia", stable_id(["comunidad", "codigo", "materia"]))
    criteria = relabelled(tables["criterios"])
    moved = criteria.where(F.col("materia") == new)
    staying = criteria.where(~F.col("materia").eqNullSafe(F.lit(new)))
    criteria = relink_children(moved, subject, copies).unionByName(staying)
    narrowed = subject.withColumn("cursos_aplicables", F.array(F.lit(kept_year)))
    used = ghosts(narrowed, "id_competencia", criteria, tables["enlaces"])
    narrowed = narrowed.join(used.select("id_competencia"), "id_competencia", "left_anti")
    documents = tables["situaciones"].withColumn(
        "materia",
        F.when(label & (F.col("curso") != kept_year), F.lit(new)).otherwise(F.col("materia")),
    )
    others = competences.where(~F.coalesce(label, F.lit(False)))
    columns = competences.columns
    return {
        "competencias": others.unionByName(narrowed.select(*columns)).unionByName(copies.select(*columns)),
        "criterios": criteria,
        "saberes": relabelled(tables["saberes"]),
        "enlaces": tables["enlaces"],
        "situaciones": documents,
    }


def merge_subjects(tables: Mapping[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    """The reverse of a split: everything back under the old label.

    Copies whose criteria return to the originals and that no document links
    are dropped; years narrowed by the split stay narrowed.
    """
    competences = tables["competencias"]
    originals, copies = competences.where(F.col("materia") == old), competences.where(F.col("materia") == new)

    def relabelled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("materia", F.when(F.col("materia") == new, F.lit(old)).otherwise(F.col("materia")))

    criteria = relabelled(relink_children(tables["criterios"], copies, originals))
    unused = ghosts(copies, "id_competencia", criteria, tables["enlaces"])
    left = competences.join(unused.select("id_competencia"), "id_competencia", "left_anti")
    return {
        "competencias": relabelled(left.select(*competences.columns)),
        "criterios": criteria,
        "saberes": relabelled(tables["saberes"]),
        "enlaces": tables["enlaces"],
        "situaciones": relabelled(tables["situaciones"]),
    }


def backfill(df: DataFrame, lookup: DataFrame, on: Sequence[str], column: str, default: str | None = None) -> DataFrame:
    """A column filled from an unambiguous fixed dictionary, then a default."""
    found = df.join(lookup.select(*on, F.col(column).alias("hallado")), on, "left")
    values = [F.col("hallado")]
    if column in df.columns:
        values.insert(0, F.col(column))
    if default is not None:
        values.append(F.lit(default))
    return found.withColumn(column, F.coalesce(*values)).drop("hallado")


def still_null(df: DataFrame, column: str) -> DataFrame:
    """How many rows a backfill left empty: the not-null check."""
    return df.agg(F.count_if(F.col(column).isNull()).alias("vacias"), F.count(F.lit(1)).alias("filas"))
