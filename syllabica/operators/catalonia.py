"""The Catalan bulletin: positioned lines to catalogue records, one document per curriculum.

A document names one or more subjects on its cover that share what follows. Milestones
(a competence's heading, the criteria heading, the knowledge heading) cut it
into sections. In a criteria section the first row of year headings is found by
clustering heights, and each line below falls into the column whose interval holds it; without any heading in the
document the years come from the cover. Criteria are gathered by year group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.text import strip
from ..sources.tables import cut_lineage
from . import paragraphs as P
from .ordered import running, width_bucket

SECTION = ["doc_id", "hito"]
# The milestones of a document, and a criterion's code.
COMPETENCE_MARK = r"(?U)^Compet[èe]ncia espec[íi]fica\s+(\d+)\s*$"
CRITERIA_MARK = r"(?U)^Criteris d[’']avaluaci[óo]\s*$"
ITEMS_MARK = r"(?U)^Sabers\s*$"
CRITERION_CA = r"(?Us)^(\d+)\.(\d+)\.?\s+(.*)$"
TITLE_TAIL = r"(?iU)\s+(?:de|d[’'])\s+(?:primer|segon|tercer|quart)\b.*$"
#: Heights that differ by less than this are one row, and the least size of the knowledge heading.
SAME_ROW, MIN_HEADING_SIZE = 5.0, 11.5

Stage = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Layout:
    """What is particular to one bulletin."""

    noise: str = P.NOISE_CA
    labels: Mapping[str, str] = field(default_factory=dict)
    no_years: str = "Únic"
    stage_name: str = "ESO"


def clean_title(c: Column) -> Column:
    """A subject's name without what its title says about years."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?Us)\s*\(.*", ""), TITLE_TAIL, "")
    return F.regexp_replace(bare, r"^[ .,]+|[ .,]+$", "")


def milestones(lines: DataFrame) -> DataFrame:
    """Every line with the section it lies in: number of the milestone above, its kind, and the competence last named there.

    ``es_hito`` marks the milestones themselves. Lines before the first have section 0.
    """
    text = F.col("text")
    code = F.regexp_extract(text, COMPETENCE_MARK, 1)
    kind = (
        F.when(code != "", "competencia").when(text.rlike(CRITERIA_MARK), "criterios")
        .when(text.rlike(ITEMS_MARK) & (F.col("size") >= MIN_HEADING_SIZE), "saberes")
    )
    marked = lines.withColumns({"__k": kind, "es_hito": kind.isNotNull()})
    return running(
        marked, ["doc_id"], ["seq"], width_bucket("seq"), counts={"hito": F.col("es_hito")},
        carries={"tipo": F.col("__k"), "competencia": F.when(code != "", code)},
    ).drop("__k")


def competences(placed: DataFrame) -> DataFrame:
    """(doc_id, hito, codigo, descripcion): each heading with the lines below it."""
    rows = placed.where("tipo = 'competencia'")
    pieces = F.array_sort(F.collect_list(F.when(~F.col("es_hito"), F.struct("seq", "text"))))
    return rows.groupBy(*SECTION).agg(F.first("competencia").alias("codigo"), pieces.alias("p")).select(
        *SECTION, "codigo", strip(F.array_join(F.transform("p", lambda s: s["text"]), " ")).alias("descripcion")
    )


def heading_rows(section: DataFrame, keys: list[str], slack: float = SAME_ROW) -> DataFrame:
    """Headings of years numbered by row: rows of a section are heights with a gap of ``slack`` or more between them.

    Islands of a running count over heights, by page, since heights begin anew there.
    """
    heads = section.withColumn("cursos", C.header_years_ca(strip(F.col("text")))).where(F.col("cursos").isNotNull())
    order = ["page", "y", "x", "seq"]
    bucket = F.floor(F.col("page") / 64).cast("bigint")
    above = running(heads, keys, order, bucket, previous={"antes": F.struct("page", "y")})
    new = F.col("antes").isNull() | (F.col("antes.page") != F.col("page")) | (F.col("y") - F.col("antes.y") >= slack)
    return running(above, keys, order, bucket, counts={"fila": new}).drop("antes")


def columns(section: DataFrame) -> DataFrame:
    """(doc_id, hito, columna, desde, hasta, cursos, y): the intervals of a section's columns.

    They come from the headings that share the height of the first one read; further rows of
    headings are lines of the body. The headings of one row stand on one page and are few.
    """
    heads = heading_rows(section, SECTION)
    first = heads.groupBy(*SECTION).agg(F.min_by(F.struct("fila", "y"), "seq").alias("f"))
    row = heads.join(first, SECTION).where(F.col("fila") == F.col("f.fila"))
    return P.column_ranges(row.select(*SECTION, "x", "cursos", F.col("f.y").alias("y0")), SECTION)


def criteria_in_columns(section: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, hito, grupo, cursos, codigo, competencia, seq, descripcion) of the lines below the headings.

    A line belongs to the column whose interval holds its x; one without a code continues the criterion open in
    its column, one before any is left out.
    """
    heights = found.groupBy(*SECTION).agg(F.min("y0").alias("y0"))
    body = section.join(heights, SECTION).where(F.col("y") > F.col("y0") + SAME_ROW)
    placed = P.into_columns(body, found, SECTION)
    glued = _glued(placed, [*SECTION, "columna"])
    years = found.select(*SECTION, "columna", "cursos")
    return glued.join(years, [*SECTION, "columna"]).select(*SECTION, "cursos", "codigo", "competencia", "seq", "descripcion")


def _glued(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that begin with a code, each with those that continue it: (keys, codigo, competencia, seq, descripcion)."""
    code = F.col("text").rlike(CRITERION_CA)
    pieces = P.glue_lines(lines, code, keys).where("record > 0")
    named = lines.where(code).select(*keys, "seq", "competencia")
    part = [F.regexp_extract("text", CRITERION_CA, i) for i in (1, 2, 3)]
    return pieces.join(named.hint("merge"), [*keys, "seq"]).select(
        *keys, F.concat_ws(".", *part[:2]).alias("codigo"), F.coalesce("competencia", F.lit("1")).alias("competencia"), "seq",
        strip(part[2]).alias("descripcion"),
    )


def title_years(lines: DataFrame) -> DataFrame:
    """(doc_id, del_titulo): the years that the cover of an optional subject names; a cover is one page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    cover = lines.where("page = 1").groupBy("doc_id").agg(text.alias("portada"))
    return cover.select("doc_id", C.title_years_ca(F.col("portada")).alias("del_titulo"))


def knowledge(placed: DataFrame) -> DataFrame:
    """(doc_id, codigo, titulo, items): blocks of the last knowledge section of each document, numbered from 1.

    Both forms of indent are read: items under sub-blocks, or right under blocks.
    """
    rows = placed.where("tipo = 'saberes' AND NOT es_hito")
    last = placed.where("tipo = 'saberes'").groupBy("doc_id").agg(F.max("hito").alias("hito"))
    found = P.knowledge_blocks(rows.join(last, SECTION), SECTION)
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    blocks = found.groupBy("doc_id", "bloque_n", "bloque").agg(F.min("seq").alias("seq"), items.alias("items"))
    return blocks.select("doc_id", F.col("bloque_n").cast("string").alias("codigo"), F.col("bloque").alias("titulo"), "seq", "items")


def _listed(rows: DataFrame, keys: list[str], entry: list[Column | str], name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("seq", F.struct(*entry).alias("e"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["e"]).alias(name))


def extract(
    lines: DataFrame, articles: DataFrame | None = None, layout: Layout | None = None, stage: Stage = cut_lineage,
) -> dict[str, DataFrame]:
    """``records``, one per (document, subject, year group), and ``avisos``: documents and subjects that lack something.

    ``lines``: doc_id, seq, page (from 1), x, y, size, bold, text, in reading order. ``articles`` (materia, cursos) are the
    years that the decree's articles give to subjects; they fill in where neither columns nor cover
    name any, by the name without accents and signs. Subjects still without years keep an empty list and are reported
    as ``sin_cursos``; so are documents without a title (``sin_titulo``) or without criteria (``sin_criterios``).
    """
    layout = layout or Layout()
    shown = lines.where((strip(F.col("text")) != "") & ~P.is_noise(F.col("text"), layout.noise)).withColumn("text", strip(F.col("text")))
    shown = stage(shown, "lineas")
    placed = stage(milestones(shown), "hitos")
    section = placed.where("tipo = 'criterios' AND NOT es_hito")
    found = stage(columns(section), "columnas")
    by_column = criteria_in_columns(section, found)
    headed = found.select("doc_id").distinct()
    alone = section.join(headed, "doc_id", "left_anti")
    glued = _glued(alone, ["doc_id"]).join(title_years(shown), "doc_id", "left")
    none = F.array().cast("array<string>")
    plain = glued.select("doc_id", F.coalesce("del_titulo", none).alias("cursos"), "codigo", "competencia", "seq", "descripcion")
    every = stage(by_column.drop("hito").unionByName(plain), "criterios")

    listed = _listed(every, ["doc_id", "cursos"], ["codigo", "competencia", "descripcion"], "criterios_evaluacion")
    # a document without any criterion has one group all the same
    groups = found.select("doc_id", "cursos").distinct().unionByName(
        shown.select("doc_id").distinct().join(headed, "doc_id", "left_anti").join(title_years(shown), "doc_id", "left")
        .select("doc_id", F.coalesce("del_titulo", none).alias("cursos")))
    comps = competences(placed).select("doc_id", F.col("hito").alias("seq"), "codigo", "descripcion", none.alias("descriptores"))
    comps = _listed(comps, ["doc_id"], ["codigo", "descripcion", "descriptores"], "competencias_especificas")
    blocks = _listed(knowledge(placed), ["doc_id"], [
        "codigo", F.concat_ws(". ", "codigo", "titulo").alias("bloque"), "titulo", "items"], "saberes_basicos")
    titles = P.cover_titles(shown).select("doc_id", clean_title(F.col("text")).alias("materia_oficial")).where("materia_oficial <> ''").distinct()

    # titles and year groups meet only here, where the output has a row for each pair
    pairs = groups.join(titles.hint("merge"), "doc_id")
    if articles is not None:
        pairs = P.missing_years_by_name(pairs.withColumnRenamed("materia_oficial", "materia").withColumn("grupo", F.col("cursos")), articles)
        pairs = pairs.withColumnRenamed("materia", "materia_oficial")
    else:
        pairs = pairs.withColumn("grupo", F.col("cursos"))
    lists = listed.withColumnRenamed("cursos", "grupo")
    joined = pairs.join(lists, ["doc_id", "grupo"], "left").join(comps, "doc_id", "left").join(blocks, "doc_id", "left")
    short = F.create_map(*[F.lit(x) for kv in layout.labels.items() for x in kv])[F.col("materia_oficial")] if layout.labels else F.lit(None)
    types = {f.name: f.dataType for f in joined.schema.fields}
    full = [F.coalesce(n, F.array().cast(types[n])).alias(n) for n in ("competencias_especificas", "criterios_evaluacion", "saberes_basicos")]
    records = joined.select(
        "doc_id", "materia_oficial", F.coalesce(short.cast("string"), "materia_oficial").alias("materia"), F.lit(layout.stage_name).alias("etapa"),
        F.when(F.size("cursos") > 0, F.array_join("cursos", " i ")).otherwise(F.lit(layout.no_years)).alias("ciclo"),
        F.lit(None).cast("string").alias("itinerario"), F.col("cursos").alias("cursos_aplicables"), *full,
    )
    subject = lambda df, why: df.select("doc_id", F.col("materia_oficial").alias("materia"), F.lit(why).alias("motivo"))
    nameless = shown.select("doc_id").distinct().join(titles, "doc_id", "left_anti").withColumn("materia_oficial", F.lit(None).cast("string"))
    warned = subject(records.where(F.size("cursos_aplicables") == 0).select("doc_id", "materia_oficial").distinct(), "sin_cursos")
    lacking = records.where(F.size("criterios_evaluacion") == 0).select("doc_id", "materia_oficial").distinct()
    return {"records": records, "avisos": warned.unionByName(subject(lacking, "sin_criterios")).unionByName(subject(nameless, "sin_titulo"))}
