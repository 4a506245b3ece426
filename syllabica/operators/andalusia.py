"""The Andalusian bulletin: positioned lines and table cells to catalogue records.

A subject is what lies between two titles. Its competences stand in running
text, or else in the first column of its criteria tables; its knowledge items
carry official codes with their year; its criteria stand in tables whose cells
cut sentences between rows and pages. The year of a criterion is that of the
items cited beside it.

Sequences are never one task: titles, open records and years already seen are
carried through ``ordered.running`` by pages. A page belongs to every subject
whose range holds it, so the page where the next one begins is read for both.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.text import fold_words, join_lines, strip
from ..sources.tables import cut_lineage
from . import paragraphs as P
from .ordered import numbered, running

KEYS = ["doc_id", "tramo"]
PLACE = ["page", "table_no", "row", "col", "k"]
PAGES_PER_BUCKET = 64
# The headings of a subject's sections.
COMPETENCES_MARK = r"^Competencias espec[íi]ficas\.?\s*$"
ITEMS_MARK = r"(?U)^Saberes b[áa]sicos\b.*$"

Stage = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Layout:
    """What is particular to one bulletin."""

    noise: str = P.NOISE_BOJA
    tracks: Mapping[str, str] = field(default_factory=lambda: {"MAA": "A", "MAB": "B"})
    stage_name: str = "ESO"
    max_block_title: int = P.MAX_BLOCK_TITLE
    max_title: int = P.MAX_TITLE


def _bucket() -> Column:
    return F.floor(F.col("page") / PAGES_PER_BUCKET).cast("bigint")


def subjects(lines: DataFrame, layout: Layout) -> DataFrame:
    """(doc_id, tramo, materia, seq, page, fin, pagina_fin): one row per title outside tables, repeats left out."""
    titles = lines.where(P.is_subject_title(max_title=layout.max_title)).select(
        "doc_id", "seq", "page", strip(F.regexp_replace(strip(F.col("text")), r"\.+$", "")).alias("text")
    )
    kept = P.collapse_repeats(titles)
    return running(
        kept, ["doc_id"], ["seq"], P.width_bucket("seq"), counts={"tramo": F.lit(1)},
        following={"fin": F.col("seq"), "pagina_fin": F.col("page")},
    ).withColumnRenamed("text", "materia")


def in_subjects(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines from the first title on, with the subject they lie in."""
    marked = lines.join(found.select("doc_id", "seq", "tramo"), ["doc_id", "seq"], "left")
    return P.carry_forward(marked, {"tramo": F.col("tramo")}).where(F.col("tramo").isNotNull())


def sections(inside: DataFrame, found: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Each subject with ``desde``, where its text begins, and its pages ``pagina_ini`` to ``pagina_fin``.

    The text begins at the competences' heading, if there is one, and the pages with
    those of the knowledge section after it.
    """
    text = F.col("text")
    heading = text.rlike(COMPETENCES_MARK) & F.col("bold") & ~F.col("in_table")
    marks = inside.where(text.rlike(COMPETENCES_MARK) | text.rlike(ITEMS_MARK)).select(
        *KEYS, F.col("seq").alias("lugar"), F.col("page").alias("hoja"), heading.alias("abre"), text.rlike(ITEMS_MARK).alias("saberes")
    )
    first = marks.where("abre").groupBy(*KEYS).agg(F.min(F.struct("lugar", "hoja")).alias("m"))
    begun = found.join(first, KEYS, "left").select(
        *found.columns, F.coalesce("m.lugar", "seq").alias("desde"), F.coalesce("m.hoja", "page").alias("hoja_desde")
    )
    items = marks.where("saberes").join(begun.select(*KEYS, "desde"), KEYS).where("lugar >= desde")
    start = items.groupBy(*KEYS).agg(F.min_by("hoja", "lugar").alias("hoja_saberes"))
    return begun.join(start.hint("merge"), KEYS, "left").join(last_pages, "doc_id").select(
        *KEYS, "materia", "desde", F.coalesce("hoja_saberes", "hoja_desde").alias("pagina_ini"),
        F.coalesce("pagina_fin", "ultima").alias("pagina_fin"),
    )


def pages_of(found: DataFrame) -> DataFrame:
    """(doc_id, tramo, page): the pages each subject is read from."""
    return found.where("pagina_ini <= pagina_fin").select(*KEYS, F.explode(F.sequence("pagina_ini", "pagina_fin")).alias("page"))


def item_lines(lines: DataFrame, cells: DataFrame, pages: DataFrame, layout: Layout) -> DataFrame:
    """(doc_id, tramo, seq, text): what the knowledge items are read from, in reading order.

    On a page first the lines outside tables from top to bottom, then each table column by column, so that an
    item cut between two rows is whole again.
    """
    none = F.lit(None).cast("string")
    loose = lines.where(~F.col("in_table")).select(
        "doc_id", "page", F.lit(0).alias("clase"), F.col("y").cast("double").alias("a"), strip(F.col("text")).alias("b"),
        F.lit(0).alias("c"), F.lit(0).alias("d"), F.col("seq").cast("bigint").alias("e"), strip(F.col("text")).alias("text"),
    )
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("e", "linea")
    tabled = cells.select("doc_id", "page", "table_no", "row", "col", split).select(
        "doc_id", "page", F.lit(1).alias("clase"), F.col("table_no").cast("double").alias("a"), none.alias("b"),
        F.col("col").alias("c"), F.col("row").alias("d"), F.col("e").cast("bigint").alias("e"), strip(F.col("linea")).alias("text"),
    )
    shown = loose.unionByName(tabled).where((F.col("text") != "") & ~P.is_noise(F.col("text"), layout.noise))
    read = shown.join(pages, ["doc_id", "page"])
    return numbered(read, KEYS, ["page", "clase", "a", "b", "c", "d", "e"], _bucket(), "seq").select(*KEYS, "seq", "text")


def widths(tables: DataFrame) -> DataFrame:
    """Criteria tables with ``ancho``, which grows by one where the number of columns changes: columns mean other years there."""
    order = ["page", "table_no"]
    before = running(tables, KEYS, order, _bucket(), previous={"antes": F.col("columnas")})
    changed = F.col("antes").isNull() | (F.col("antes") != F.col("columnas"))
    return running(before, KEYS, order, _bucket(), counts={"ancho": changed}).drop("antes")


def cell_pieces(cells: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pieces of criteria cells: ``k`` 0 is the prelude, later ones begin with a code; ``cursos`` are those cited beside the cell.

    A cell and its neighbour meet by one aggregation over the row.
    """
    odd = F.col("col") % 2 == 1
    pairs = cells.where("col > 0").withColumn("par", F.floor((F.col("col") - 1) / 2)).groupBy(*KEYS, "ancho", "page", "table_no", "row", "par").agg(
        F.max(F.when(odd, F.col("text"))).alias("celda"), F.max(F.when(~odd, F.col("text"))).alias("citas")
    )
    taken = C.criteria_of_cell(F.coalesce("celda", F.lit("")), F.coalesce("prefix", F.lit("")))
    read = pairs.join(prefixes, KEYS, "left").withColumn("p", taken).withColumn("cursos", C.cited_years(F.col("citas")))
    prelude = F.when(F.col("p.preludio") != "", F.struct(F.lit(None).cast("string").alias("codigo"), F.col("p.preludio").alias("texto")))
    every = F.concat(F.array(prelude), F.col("p.criterios"))
    out = read.select(
        *KEYS, "ancho", "page", "table_no", "row", (F.col("par") * 2 + 1).cast("int").alias("col"), "cursos", F.posexplode(every).alias("k", "x")
    )
    return out.where(F.col("x").isNotNull()).select(*KEYS, "ancho", *PLACE, "cursos", "x.codigo", "x.texto")


def dated(pieces: DataFrame) -> DataFrame:
    """Coded pieces with their years: those cited, else all that their code was seen with before; empty without any."""
    coded = pieces.where(F.col("codigo").isNotNull())
    seen = running(
        coded, [*KEYS, "codigo"], PLACE, _bucket(),
        carries={f"__{y}": F.when(F.array_contains("cursos", y), F.lit(y)) for y in range(10)},
    )
    before = F.array_compact(F.array(*[F.col(f"__{y}") for y in range(10)]))
    return seen.withColumn("cursos", F.when(F.size("cursos") > 0, F.col("cursos")).otherwise(before)).select(pieces.columns)


def continued(pieces: DataFrame, coded: DataFrame) -> DataFrame:
    """Preludes with the code and year of the criterion open in their column: the last one above, across pages.

    Nothing is open where the number of columns has just changed. Of a criterion of several years the last one is continued.
    """
    opens = F.when(F.col("codigo").isNotNull(), F.struct("codigo", F.array_max("cursos").alias("curso")))
    both = coded.where(F.size("cursos") > 0).unionByName(pieces.where(F.col("codigo").isNull()))
    order = [c for c in PLACE if c != "col"]
    opened = running(both, [*KEYS, "ancho", "col"], order, _bucket(), carries={"abierto": opens})
    return opened.where(F.col("codigo").isNull() & F.col("abierto").isNotNull()).select(
        *KEYS, *PLACE, F.col("abierto.codigo").alias("codigo"), F.col("abierto.curso").alias("curso"), "texto"
    )


def criteria(pieces: DataFrame, coded: DataFrame) -> DataFrame:
    """(doc_id, tramo, curso, codigo, competencia, descripcion): a criterion's text is one output value."""
    rows = coded.select(*KEYS, *PLACE, "codigo", F.explode("cursos").alias("curso"), "texto")
    every = rows.unionByName(continued(pieces, coded).select(rows.columns))
    text = F.transform(F.array_sort(F.collect_list(F.struct(*PLACE, "texto"))), lambda s: s["texto"])
    return every.groupBy(*KEYS, "curso", "codigo").agg(join_lines(F.array_join(text, " ")).alias("descripcion")).withColumn(
        "competencia", F.substring_index("codigo", ".", 1)
    )


def competences_in_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, tramo, codigo, descripcion) from the first column of criteria tables; a table is a part of a page."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "linea")
    rows = cells.where("col = 0").select(*KEYS, "page", "table_no", "row", split).withColumn("linea", strip(F.col("linea")))
    rows = rows.where((F.col("linea") != "") & ~P.is_table_heading(F.col("linea")))
    here = W.partitionBy(*KEYS, "page", "table_no").orderBy("row", "i")
    code = F.regexp_extract("linea", C.COMPETENCE_LINE, 1)
    opened = rows.withColumn("codigo", F.last(F.when(code != "", code), ignorenulls=True).over(here)).where(F.col("codigo").isNotNull())
    said = F.when(code != "", F.regexp_extract("linea", C.COMPETENCE_LINE, 2)).otherwise(F.col("linea"))
    pieces = F.array_sort(F.collect_list(F.struct("page", "table_no", "row", "i", said.alias("t"))))
    return opened.groupBy(*KEYS, "codigo").agg(join_lines(F.array_join(F.transform(pieces, lambda s: s["t"]), " ")).alias("descripcion"))


def _listed(rows: DataFrame, keys: list[str], order: list[Column], entry: list[Column | str], name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*entry).alias("e"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["e"]).alias(name))


def _blocks(items: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("seq", "text", "codigo")))
    return items.groupBy(*KEYS, "curso", "bloque").agg(F.first("titulo").alias("titulo"), pairs.alias("p")).select(
        *KEYS, "curso", "bloque", "titulo", F.transform("p", lambda s: s["text"]).alias("items"),
        F.transform("p", lambda s: s["codigo"]).alias("codigos_items"),
    )


def extract(lines: DataFrame, cells: DataFrame, layout: Layout | None = None, stage: Stage = cut_lineage) -> dict[str, DataFrame]:
    """``records``, one per subject and year, and ``avisos``, what is missing or left out.

    ``lines``: doc_id, seq, page, x, y, bold, in_table, text, in reading order; ``cells``: doc_id, page,
    table_no, row, col (from 0), n_cols, text. ``avisos`` has doc_id, tramo, materia, curso, codigo and ``motivo``:
    ``sin_contenido`` for a subject without years, which gives no record, ``sin_saberes`` and
    ``sin_criterios`` for a year that lacks one side, ``sin_curso`` for a criterion without a year.

    Pages are read whole: a line of the page where the next subject begins, its title too, continues
    an item that is still open there; items of another code prefix are dropped.
    What several branches read is written to the shared folder (``stage``).
    """
    layout = layout or Layout()
    last = lines.select("doc_id", "page").unionByName(cells.select("doc_id", "page")).groupBy("doc_id").agg(F.max("page").alias("ultima")).hint("merge")
    shown = stage(lines.where((strip(F.col("text")) != "") & ~P.is_noise(F.col("text"), layout.noise)), "vistas")
    cells = stage(cells, "tablas")
    found = stage(subjects(shown, layout), "materias")
    inside = stage(in_subjects(shown, found), "lineas")
    known = stage(sections(inside, found, last), "secciones")
    pages = pages_of(known)

    body = inside.join(known.select(*KEYS, "desde"), KEYS).where("seq >= desde")
    in_text = P.competences_in_text(body.select(*KEYS, "seq", "bold", "text"), KEYS).select(*KEYS, "codigo", "descripcion", "descriptores")

    kinds = P.table_kinds(cells)
    judged = cells.join(kinds.select("doc_id", "page", "table_no", "columnas", "es_de_criterios"), ["doc_id", "page", "table_no"])
    read = item_lines(shown, judged.where(~F.col("es_de_criterios")), pages, layout)
    items = stage(P.majority_prefix(P.official_items(read, KEYS, max_title=layout.max_block_title), KEYS), "saberes")
    prefixes = items.groupBy(*KEYS).agg(F.first("prefix").alias("prefix"))

    # a join's result has no size that Spark knows: of cells it would be sent whole to the driver and every executor
    tables = kinds.where("es_de_criterios").join(pages, ["doc_id", "page"]).select(*KEYS, "page", "table_no", "columnas")
    placed = judged.where("es_de_criterios").drop("columnas", "es_de_criterios").join(widths(tables).hint("merge"), ["doc_id", "page", "table_no"])
    placed = stage(placed, "celdas")
    pieces = stage(cell_pieces(placed, prefixes), "trozos")
    coded = stage(dated(pieces), "fechados")
    judged_criteria = stage(criteria(pieces, coded), "criterios")

    in_tables = competences_in_tables(placed).withColumn("descriptores", F.array().cast("array<string>"))
    competences = P.fallback_rows(in_text, in_tables, KEYS)
    return {
        "records": _records(known, competences, judged_criteria, items, layout),
        "avisos": _warnings(known, coded, judged_criteria, items),
    }


def _sides(judged: DataFrame, items: DataFrame) -> DataFrame:
    sides = judged.select(*KEYS, "curso", F.lit(True).alias("c"), F.lit(False).alias("s")).unionByName(
        items.select(*KEYS, "curso", F.lit(False).alias("c"), F.lit(True).alias("s")))
    return sides.groupBy(*KEYS, "curso").agg(F.bool_or("c").alias("con_criterios"), F.bool_or("s").alias("con_saberes"))


def _records(known: DataFrame, competences: DataFrame, judged: DataFrame, items: DataFrame, layout: Layout) -> DataFrame:
    by_year = [*KEYS, "curso"]
    number = F.col("codigo").cast("int")
    listed = _listed(competences, KEYS, [number], ["codigo", "descripcion", "descriptores"], "competencias_especificas")
    parts = [F.split_part("codigo", F.lit("."), F.lit(i)).cast("int") for i in (1, 2)]
    by_criteria = _listed(judged, by_year, parts, ["codigo", "competencia", "descripcion"], "criterios_evaluacion")
    block = [F.col("bloque").alias("codigo"), F.concat_ws(". ", "bloque", "titulo").alias("bloque"), "titulo", "items", "codigos_items"]
    by_blocks = _listed(_blocks(items), by_year, [F.col("bloque")], block, "saberes_basicos")
    track = F.create_map(*[F.lit(x) for kv in layout.tracks.items() for x in kv])[F.col("prefix")] if layout.tracks else F.lit(None).cast("string")
    joined = (
        _sides(judged, items).join(known.select(*KEYS, "materia"), KEYS).join(items.groupBy(*KEYS).agg(F.first("prefix").alias("prefix")), KEYS, "left")
        .join(listed.hint("merge"), KEYS, "left").join(by_criteria, by_year, "left").join(by_blocks, by_year, "left")
        .withColumn("itinerario", track)
    )
    ends = F.col("itinerario").isNotNull() & F.col("materia").endswith(F.concat(F.lit(" "), "itinerario"))
    name = F.when(ends, strip(F.substr("materia", F.lit(1), F.length("materia") - 2))).otherwise(F.col("materia"))
    year = F.concat(F.col("curso").cast("string"), F.lit("º ESO"))
    types = {f.name: f.dataType for f in joined.schema.fields}
    lists = [F.coalesce(n, F.array().cast(types[n])).alias(n) for n in ("competencias_especificas", "criterios_evaluacion", "saberes_basicos")]
    return joined.select(
        *by_year, name.alias("materia_oficial"), F.concat_ws(" ", name, "itinerario").alias("materia"), F.lit(layout.stage_name).alias("etapa"),
        year.alias("ciclo"), "itinerario", F.array(year).alias("cursos_aplicables"), *lists,
    )


def _warnings(known: DataFrame, coded: DataFrame, judged: DataFrame, items: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    sides = _sides(judged, items)
    lacking = sides.withColumn("motivo", F.when(~F.col("con_saberes"), "sin_saberes").when(~F.col("con_criterios"), "sin_criterios"))
    lacking = lacking.where(F.col("motivo").isNotNull()).select(*KEYS, "curso", none.alias("codigo"), "motivo")
    undated = coded.where(F.size("cursos") == 0).select(*KEYS, F.lit(None).cast("int").alias("curso"), "codigo", F.lit("sin_curso").alias("motivo")).distinct()
    empty = known.join(sides.select(*KEYS).distinct(), KEYS, "left_anti").select(
        *KEYS, F.lit(None).cast("int").alias("curso"), none.alias("codigo"), F.lit("sin_contenido").alias("motivo"))
    return lacking.unionByName(undated).unionByName(empty).join(known.select(*KEYS, "materia"), KEYS)


def year_mismatches(records: DataFrame) -> DataFrame:
    """Official item codes whose year is none of their record's years: the columns were read wrongly."""
    codes = records.select("materia", "cursos_aplicables", F.explode("saberes_basicos").alias("b")).select(
        "materia", "cursos_aplicables", F.explode("b.codigos_items").alias("codigo"))
    year = F.regexp_extract("codigo", r"^[A-Z]{2,4}\.(\d)\.", 1)
    declared = F.transform("cursos_aplicables", lambda c: F.substring(c, 1, 1))
    return codes.where((year != "") & ~F.array_contains(declared, year)).select("materia", "codigo", "cursos_aplicables")
