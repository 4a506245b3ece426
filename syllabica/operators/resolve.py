"""Codes cited in documents matched to catalogue rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import code_variants
from ..functions.content import KINDS, cited_lists, normalised_codes, rewritable_codes, rewrite_codes
from ..sources.tables import cut_lineage
from .coverage import PAIR, flag_documents, loaded_pairs


CITED = ["id_situacion", "kind", "codigo"]


def citations_of(documents: DataFrame) -> DataFrame:
    """(id_situacion, kind, codigo, pos) cited in the ``contenido`` of documents."""
    by_kind = documents.select("id_situacion", F.explode(cited_lists(F.col("contenido"))).alias("l"))
    return by_kind.select(
        "id_situacion", "l.kind", F.posexplode("l.codes").alias("pos", "codigo")
    ).select("id_situacion", "kind", "codigo", F.col("pos").cast("bigint").alias("pos"))


def owned_variants(citations: DataFrame) -> DataFrame:
    """Variants of each citation that no earlier citation of the document claims.

    The citations of a document are brought together before they are spelled: hardly two of
    its spellings are equal, so there is nothing to combine, and a task of the reading side, which
    may hold any number of citations in few compressed bytes, sorts none.
    """
    spelled = citations.repartition("id_situacion").select(
        *CITED, "pos", F.posexplode(code_variants(F.col("codigo"))).alias("rank", "variante")
    )
    first = F.min_by(F.struct("codigo", "pos", "rank"), F.struct("pos", "rank")).alias("o")
    return spelled.groupBy("id_situacion", "kind", "variante").agg(first).select("id_situacion", "kind", "variante", "o.*")


def best_rows(scopes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Lowest catalogue id for each distinct (scope, kind, spelling).

    Subject-bound rows and rows for every subject, listed years and every
    year are keyed apart, so the match is a plain equi-join with no residual
    disjunction and no pair is produced that does not match.
    """
    blank = F.lit("")
    rows = catalogue.select(
        "comunidad",
        "kind",
        F.col("codigo").alias("variante"),
        F.coalesce("materia", blank).alias("por_materia"),
        F.explode(
            F.when(F.size(F.coalesce("cursos_aplicables", F.array().cast("array<string>"))) == 0, F.array(blank)).otherwise(
                F.array_distinct("cursos_aplicables")
            )
        ).alias("por_curso"),
        "id",
    )
    best = rows.groupBy("comunidad", "kind", "variante", "por_materia", "por_curso").agg(F.min("id").alias("id"))
    keys = F.array(*[
        F.struct(m.alias("por_materia"), c.alias("por_curso"))
        for m in (F.col("materia"), blank)
        for c in (F.col("curso"), blank)
    ])
    wanted = scopes.withColumn("k", F.explode(keys)).select("*", "k.por_materia", "k.por_curso").drop("k")
    on = ["comunidad", "kind", "variante", "por_materia", "por_curso"]
    hit = wanted.join(best, on, "inner")
    return hit.groupBy(*PAIR, "kind", "variante").agg(F.min("id").alias("id"))


def resolve_codes(citations: DataFrame, documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One best catalogue row per cited code: (id_situacion, kind, codigo, rank, id).

    The earliest spelling wins, then the lowest id. Spellings are resolved once
    per distinct scope, not per document, before the citations meet them.
    Documents without a region resolve nothing.
    """
    owned = owned_variants(citations)
    scopes = documents.where(F.col("comunidad").isNotNull()).select("id_situacion", *PAIR)
    placed = owned.join(scopes, ["id_situacion"], "inner")
    wanted = placed.select(*PAIR, "kind", "variante").distinct()
    found = best_rows(wanted, catalogue)
    hits = placed.join(found, [*PAIR, "kind", "variante"], "inner")
    return (
        hits.groupBy(*CITED)
        .agg(F.min(F.struct("rank", "id", "variante")).alias("b"))
        .select(*CITED, "b.rank", "b.id", F.col("b.variante").alias("codigo_catalogo"))
    )


def orphan_codes(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cited codes with no resolved row."""
    return citations.select(*CITED).join(resolved.select(*CITED), CITED, "left_anti")


def orphan_causes(documents: DataFrame, orphans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every document as ``sin_curriculo``, ``inventados`` or ``limpio``.

    A document on a pair that is not loaded cannot match anything; its codes
    are not invented, so the two causes never mix.
    """
    counts = orphans.groupBy("id_situacion").agg(F.count(F.lit(1)).alias("huerfanos"))
    flagged = flag_documents(documents, pairs)
    return (
        flagged.join(counts, "id_situacion", "left")
        .withColumn("huerfanos", F.coalesce("huerfanos", F.lit(0).cast("bigint")))
        .withColumn(
            "causa",
            F.when(F.col("huerfanos") == 0, "limpio")
            .when(~F.col("con_curriculo"), "sin_curriculo")
            .otherwise(F.lit("inventados")),
        )
    )


def missing_pair_counts(causes: DataFrame) -> DataFrame:
    """Documents per missing (subject, year) pair."""
    return (
        causes.where(F.col("causa") == "sin_curriculo")
        .groupBy("materia", "curso")
        .agg(F.count(F.lit(1)).alias("situaciones"))
    )


def link_totals(resolved: DataFrame) -> DataFrame:
    """Distinct links per catalogue table."""
    return resolved.select("id_situacion", "kind", "id").distinct().groupBy("kind").agg(
        F.count(F.lit(1)).alias("enlaces")
    )


def links(resolved: DataFrame) -> DataFrame:
    """The rebuilt link table; it replaces the old one whole."""
    return resolved.select("id_situacion", "kind", F.col("id").alias("id_target")).distinct()


def relinked(
    old: DataFrame, changed: DataFrame, catalogue: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = cut_lineage
) -> DataFrame:
    """The link table after some documents changed: their links are found anew and take the place of the old ones.

    No other document is read. ``changed`` holds each touched document once, as it is now; one that cites
    nothing any more loses its links.
    """
    now = stage(changed.select("id_situacion", "contenido", *PAIR), "cambiados")
    fresh = links(resolve_codes(stage(citations_of(now), "citas"), now, catalogue))
    return old.join(now.select("id_situacion"), "id_situacion", "left_anti").select(fresh.columns).unionByName(fresh)


def link_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links a rebuild adds and drops, for the dry run."""
    on = ["id_situacion", "kind", "id_target"]
    added = new.join(old, on, "left_anti").withColumn("cambio", F.lit("nuevo"))
    dropped = old.join(new, on, "left_anti").withColumn("cambio", F.lit("retirado"))
    return added.unionByName(dropped)


def canonical_maps(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per document, cited code to catalogue code; shared by the three lists.

    Every cited code that can be spelled like a linked row takes its code, also
    one whose spelling an earlier citation had claimed. One entry per distinct
    code of one document's content.
    """
    linked = resolved.select("id_situacion", "kind", F.col("codigo_catalogo").alias("variante")).distinct()
    spelled = citations.select(*CITED, F.posexplode(code_variants(F.col("codigo"))).alias("rank", "variante"))
    hits = spelled.join(linked, ["id_situacion", "kind", "variante"])
    per_code = hits.groupBy("id_situacion", "codigo").agg(F.min_by("variante", F.struct("rank", "kind")).alias("canonico"))
    entry = F.struct("codigo", "canonico")
    return per_code.groupBy("id_situacion").agg(F.map_from_entries(F.collect_list(entry)).alias("canonicos"))


def rewrite_documents(documents: DataFrame, citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Documents with resolved codes in place, a change flag and the list."""
    maps = canonical_maps(citations, resolved)
    none = F.array().cast("array<string>")
    joined = documents.join(maps, "id_situacion", "left").withColumn("n", F.coalesce(normalised_codes(F.col("canonicos")), none))
    # a document changes where a field holds a code whose catalogue form differs
    overlap = F.when(F.size("n") > 0, F.arrays_overlap(rewritable_codes(F.col("contenido")), F.col("n")))
    judged = joined.withColumn("cambiado", F.coalesce(overlap, F.lit(False)))
    kept = [c for c in documents.columns if c != "contenido"]
    return judged.select(
        *kept,
        F.when(F.col("cambiado"), rewrite_codes(F.col("contenido"), F.col("canonicos"))).otherwise(F.col("contenido")).alias("contenido"),
        "cambiado",
        F.when(F.col("cambiado"), F.col("n")).otherwise(none).alias("codigos_normalizados"),
    )


def rebuild_links(
    documents: DataFrame, catalogue: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = cut_lineage
) -> dict[str, DataFrame]:
    """All documents relinked: links, per-document summary and new contents.

    Content that cannot be parsed gives no citations, so one bad document
    never stops the others. Callers write the frames, or not (dry run). What
    several outputs read is staged in the shared folder and computed once.
    """
    cited = stage(citations_of(documents), "citas")
    resolved = stage(resolve_codes(cited, documents, catalogue), "resueltas")
    by_kind = [catalogue.where(F.col("kind") == k) for k in KINDS]
    causes = orphan_causes(documents.select("id_situacion", *PAIR), orphan_codes(cited, resolved), loaded_pairs(*by_kind))
    counts = resolved.groupBy("id_situacion").pivot("kind", KINDS).agg(F.count_distinct("id"))
    summary = causes.join(counts, "id_situacion", "left").fillna(0, KINDS)
    return {"links": links(resolved), "summary": summary, "documents": rewrite_documents(documents, cited, resolved)}
