"""Bulletins as ordered paragraphs: labels carried down, lines glued, columns.

Paragraph tables hold (doc_id, seq, cls, text); positioned lines add page, x,
y, size, bold and in_table; table cells are (doc_id, page, table_no, row, col,
n_cols, text). Order-dependent state goes through ``ordered.running``, so a
very long document is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.text import fold_words, is_bullet_only, join_lines, name_key, norm_heading, strip
from .ordered import running, width_bucket

# Page noise and headings that are not content.
NOISE_BOJA = (
    r"^(N[úu]mero \d+ -|p[áa]gina \d+/|\d{8}$|BOJA$|Bolet[íi]n Oficial|"
    r"Dep[óo]sito Legal|https?://|#CODIGO)"
)
NOISE_CA = r"^Decret 175/2022|^\d+/\d+$"
TABLE_HEADINGS = C.TABLE_HEADINGS
NOT_SUBJECTS = ["materias comunes obligatorias y optativas", "anexo ii", "anexo iii"]
MIN_COLUMN_GAP, MIN_TITLE_X, MAX_TITLE = 100, 150, 70
MAX_BLOCK_TITLE, MIN_COVER_TITLE = 90, 4
INDENT_STEP, TITLE_SIZE_SLACK = 6, 0.1


# ---------------------------------------------------------------------------
# Predicates
# ---------------------------------------------------------------------------
def is_noise(c: Column, pattern: str = NOISE_BOJA) -> Column:
    return c.rlike(pattern)


def is_table_heading(c: Column) -> Column:
    return fold_words(c).isin(TABLE_HEADINGS)


def without_noise(lines: DataFrame, pattern: str = NOISE_BOJA) -> DataFrame:
    """Lines that are neither page furniture nor table headings."""
    return lines.where(~is_noise(F.col("text"), pattern) & ~is_table_heading(F.col("text")))


def is_subject_title(lines_have: str = "text", min_x: float = MIN_TITLE_X, max_title: int = MAX_TITLE) -> Column:
    """Bold, centred, short, outside tables, and no code, block or year."""
    c = F.col(lines_have)
    words = fold_words(c)
    return (
        F.col("bold")
        & (F.col("x") >= min_x)
        & (F.length(c) <= max_title)
        & ~F.col("in_table")
        & ~c.rlike(C.OFFICIAL_ITEM)
        & ~c.rlike(C.BLOCK)
        & ~words.isin(C.COURSE_HEADINGS + NOT_SUBJECTS + TABLE_HEADINGS)
    )


# ---------------------------------------------------------------------------
# Carrying and gluing
# ---------------------------------------------------------------------------
def carry_forward(
    rows: DataFrame, labels: dict[str, Column], keys: Sequence[str] = ("doc_id",), order: str = "seq",
    width: int = 65536,
) -> DataFrame:
    """Each label's last marker value on every row; null before the first."""
    return running(rows, keys, [order], width_bucket(order, width), carries=labels)


def glue_lines(
    lines: DataFrame, starts: Column, keys: Sequence[str] = ("doc_id",), order: str = "seq", width: int = 65536,
) -> DataFrame:
    """Records of a start line and its continuations: (keys, record, seq, text).

    ``record`` 0 is the prelude, the lines before the first start. A record is
    one output value, so its text is held whole by one row and no more.
    """
    marked = running(lines, keys, [order], width_bucket(order, width), counts={"record": starts})
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return (
        marked.groupBy(*keys, "record")
        .agg(F.min(order).alias(order), F.count(F.lit(1)).alias("lineas"), pieces.alias("p"))
        .select(*keys, "record", order, "lineas", F.array_join(F.transform("p", lambda s: s["t"]), " ").alias("text"))
    )


def glue_to_open_record(preludes: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Preludes of cells joined to the record open in the same column.

    Both frames carry ``orden`` (page, table, row order of the column) and
    ``text``; a prelude belongs to the last record that started before it.
    """
    both = records.select(*keys, "orden", "codigo", "text").unionByName(
        preludes.select(*keys, "orden", F.lit(None).cast("string").alias("codigo"), "text")
    )
    start = F.when(F.col("codigo").isNotNull(), F.struct("codigo", F.col("orden").alias("inicio")))
    opened = running(both, keys, ["orden"], width_bucket("orden"), carries={"abierto": start})
    pieces = F.array_sort(F.collect_list(F.struct("orden", "text")))
    return (
        opened.where(F.col("abierto").isNotNull())
        .groupBy(*keys, F.col("abierto.codigo").alias("codigo"), F.col("abierto.inicio").alias("orden"))
        .agg(pieces.alias("p"))
        .select(*keys, "codigo", "orden", join_lines(F.array_join(F.transform("p", lambda s: s["text"]), " ")).alias("text"))
    )


def competences_in_text(lines: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """(keys, seq, codigo, descripcion, descriptores) from bold running text.

    A number may stand alone on its line. Bold lines continue a statement until
    its descriptors, set in plain type, have come; nothing counts after the
    heading of the knowledge section.
    """
    text = F.col("text")
    starts = F.col("bold") & (text.rlike(C.COMPETENCE_LINE) | text.rlike(C.COMPETENCE_ALONE))
    listed = F.when(~F.col("bold"), C.descriptor_list(text))
    marked = running(
        lines, keys, [order], width_bucket(order),
        counts={"n": starts, "fin": text.rlike(r"(?U)^Saberes b[áa]sicos\b.*$")},
    )
    inside = marked.where((F.col("fin") == 0) & (F.col("n") > 0)).withColumns({
        "d": listed, "p": F.when(F.col("bold"), F.struct(F.col(order).alias("o"), text.alias("t"))),
    })
    seen = F.when(F.col("d").isNotNull(), F.col(order))
    grouped = inside.groupBy(*keys, "n").agg(
        F.min(order).alias(order), F.array_sort(F.collect_list("p")).alias("p"),
        F.min(seen).alias("lista"), F.max_by("d", seen).alias("d"),
    )
    first = F.get("p", F.lit(0))["t"]
    statement = F.when(first.rlike(C.COMPETENCE_LINE), F.regexp_extract(first, C.COMPETENCE_LINE, 2)).otherwise(F.lit(""))
    rest = F.filter(_after_first("p"), lambda s: F.col("lista").isNull() | (s["o"] < F.col("lista")))
    whole = F.concat_ws(" ", statement, F.array_join(F.transform(rest, lambda s: s["t"]), " "))
    return grouped.select(
        *keys, order, F.regexp_extract(first, r"^(\d{1,2})\.", 1).alias("codigo"), join_lines(whole).alias("descripcion"),
        F.coalesce("d", F.array().cast("array<string>")).alias("descriptores"),
    )


def _after_first(name: str) -> Column:
    """An array without its first element."""
    return F.filter(F.col(name), lambda _, i: i > 0)


def official_items(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq", max_title: int = MAX_BLOCK_TITLE,
) -> DataFrame:
    """(keys, codigo, prefix, curso, bloque, titulo, seq, text) of coded items.

    The year comes from the code, not from the column the line was read in. A
    block heading ends the item above it; a code read twice keeps its longest
    text, and a code without text is dropped.
    """
    text = F.col("text")
    usable = lines.where(~is_table_heading(text) & ~fold_words(text).isin(C.COURSE_HEADINGS))
    code = text.rlike(C.OFFICIAL_ITEM)
    first = F.substring(text, 1, 1)
    lower = (first == F.lower(first)) & (first != F.upper(first))
    heading = ~code & text.rlike(C.BLOCK) & (F.length(text) < max_title) & ~lower
    marked = running(
        usable, keys, [order], width_bucket(order), counts={"n": code | heading},
        carries={"abre": F.when(code | heading, code)},
    )
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    glued = marked.where("abre").groupBy(*keys, "n").agg(F.min(order).alias(order), parts.alias("p"))
    head = C.parse_official_item(F.get("p", F.lit(0))["t"])
    rest = F.array_join(F.transform(_after_first("p"), lambda s: s["t"]), " ")
    read = glued.withColumn("c", head).select(
        *keys, order, F.col("c.code").alias("codigo"), F.col("c.prefix").alias("prefix"), F.col("c.year").alias("curso"),
        F.col("c.block").alias("bloque"), join_lines(F.concat_ws(" ", "c.text", rest)).alias("text"),
    )
    best = longest_reading(read, [*keys, "codigo", "prefix", "curso", "bloque"], "text", order)
    titles = marked.withColumn("b", F.when(heading, C.parse_block(text))).where(F.col("b").isNotNull()).groupBy(
        *keys, F.col("b.code").alias("bloque")
    ).agg(F.max_by("b.title", order).alias("titulo"))
    out = best.join(titles.hint("merge"), [*keys, "bloque"], "left")
    return out.withColumn("titulo", F.coalesce("titulo", F.concat(F.lit("Bloque "), "bloque")))


def longest_reading(rows: DataFrame, key: Sequence[str], text: str = "text", order: str = "seq") -> DataFrame:
    """The longest text read for each code; the earliest of equals.

    Codes without text are dropped. ``order`` of the output is the first place
    the code was seen.
    """
    filled = rows.where(F.length(strip(F.col(text))) > 0)
    best = F.max_by(F.col(text), F.struct(F.length(text), -F.col(order)))
    return filled.groupBy(*key).agg(best.alias(text), F.min(order).alias(order))


def collapse_repeats(titles: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """Titles without those repeating the one right before, folded alike."""
    folded = titles.withColumn("__f", fold_words(F.col("text")))
    seen = running(folded, keys, [order], width_bucket(order), previous={"__p": F.col("__f")})
    return seen.where(~F.coalesce(F.col("__p") == F.col("__f"), F.lit(False))).drop("__f", "__p")


def spans(milestones: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """Each milestone with the place where the next one begins (null: end)."""
    return running(milestones, keys, [order], width_bucket(order), following={"fin": F.col(order)})


# ---------------------------------------------------------------------------
# Positions
# ---------------------------------------------------------------------------
def indent_levels(lines: DataFrame, keys: Sequence[str] = ("doc_id",), step: int = INDENT_STEP) -> DataFrame:
    """Accepted indents per document: beyond the last accepted one by a step.

    Whole-point x positions on a page are few, so the sorted distinct list is
    short however many lines there are.
    """
    usable = lines.where(~is_bullet_only(F.col("text")))
    xs = F.array_sort(F.collect_set(F.round("x").cast("int")))

    def accept(levels: Column, x: Column) -> Column:
        fits = (F.size(levels) == 0) | (x - F.element_at(levels, -1) > step)
        return F.when(fits, F.concat(levels, F.array(x))).otherwise(levels)

    return usable.groupBy(*keys).agg(
        F.aggregate(xs, F.array().cast("array<int>"), accept).alias("niveles")
    )


def line_roles(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Block, sub-block, item or continuation, from indent and weight.

    With three levels the middle one is a sub-block; with two, items hang
    straight from the block. A continuation starts with neither a capital nor
    a digit.
    """
    levels = indent_levels(lines, keys)
    rows = lines.where(~is_bullet_only(F.col("text"))).join(levels, list(keys), "inner")
    n = F.size("niveles")
    margin = F.col("niveles")[0]
    has_sub = n >= 3
    item_x = F.when(has_sub, F.get("niveles", F.lit(2))).when(n == 2, F.get("niveles", F.lit(1))).otherwise(margin)
    block = (F.col("x") <= margin + INDENT_STEP) & F.col("bold")
    item = F.col("x") >= item_x - 4
    role = (
        F.when(block, "bloque")
        .when(has_sub & ~item, "subbloque")
        .when(item & ~F.col("text").rlike("^[A-ZÀ-Ú¡¿0-9]"), "continuacion")
        .when(item, "item")
    )
    return rows.withColumns({"rol": role, "hay_subbloque": has_sub}).drop("niveles")


def knowledge_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """Items under their block, continuations joined: one row per item.

    Blocks are numbered in order; a block without items has no rows. With
    sub-blocks the title is ``block · sub-block``.
    """
    rows = line_roles(lines, keys)
    title = F.regexp_replace("text", r"\.+$", "")
    opens = F.when(F.col("hay_subbloque"), F.col("rol") == "subbloque").otherwise(F.col("rol") == "bloque")
    # A block heading closes the sub-block before it; what follows needs a new one.
    closes = F.col("hay_subbloque") & (F.col("rol") == "bloque")
    marked = running(
        rows.where(F.col("rol").isNotNull()), keys, [order], width_bucket(order),
        counts={"bloque_n": opens, "tramo": opens | closes, "i": F.col("rol") == "item"},
        carries={
            "titulo_bloque": F.when(F.col("rol") == "bloque", title),
            "abierto": F.when(opens, F.struct(title.alias("t"), F.lit(True).alias("si"))).when(
                closes, F.struct(title.alias("t"), F.lit(False).alias("si"))
            ),
        },
    )
    inside = marked.where(F.coalesce(F.col("abierto.si"), F.lit(False)) & F.col("rol").isin("item", "continuacion"))
    name = F.when(
        F.col("hay_subbloque") & F.col("titulo_bloque").isNotNull(),
        F.concat("titulo_bloque", F.lit(" · "), "abierto.t"),
    ).otherwise(F.col("abierto.t"))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return (
        inside.groupBy(*keys, "bloque_n", "tramo", name.alias("bloque"), "i")
        .agg(F.min(order).alias(order), pieces.alias("p"))
        .select(
            *keys, "bloque_n", "bloque", order,
            F.array_join(F.transform("p", lambda s: s["t"]), " ").alias("text"),
        )
    )


def column_boundary(lines: DataFrame, keys: Sequence[str] = ("doc_id",), gap: int = MIN_COLUMN_GAP) -> DataFrame:
    """Midpoint of the widest gap between x positions, the first of equal ones, or null: one column.

    Values in one bucket of ``gap`` points lie nearer than that, so only the least and the
    greatest x of each bucket matter. They are combined before they are shuffled; a document's
    list has an entry per bucket of its page's width, however many lines there are.
    """
    ends = lines.where(F.col("x").isNotNull()).groupBy(*keys, F.floor(F.col("x") / gap).alias("cubo")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    buckets = F.array_sort(F.collect_list(F.struct("cubo", "a", "b")))
    near = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda one, other: F.struct(
        (other["a"] - one["b"]).alias("hueco"), (-other["a"]).alias("antes"), ((one["b"] + other["a"]) / 2).alias("corte")))
    widest = ends.groupBy(*keys).agg(buckets.alias("p")).select(*keys, F.array_max(F.when(F.size("p") > 1, near)).alias("g"))
    every = lines.select(*keys).distinct()
    return every.join(widest, list(keys), "left").select(*keys, F.when(F.col("g.hueco") >= gap, F.col("g.corte")).alias("frontera"))


def column_ranges(headings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals of columns, split at the midpoints between their headings."""
    near = W.partitionBy(*keys).orderBy("x")
    return headings.withColumns({
        "desde": (F.lag("x").over(near) + F.col("x")) / 2,
        "hasta": (F.lead("x").over(near) + F.col("x")) / 2,
        "columna": F.row_number().over(near),
    })


def into_columns(lines: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines with the column whose interval holds their x.

    The intervals of one page are gathered into one short array, so the range
    condition is a search inside the row and each line is matched once; no
    pair of line and wrong column is produced.
    """
    member = F.struct(
        F.coalesce("desde", F.lit(float("-inf"))).alias("desde"),
        F.coalesce("hasta", F.lit(float("inf"))).alias("hasta"),
        "columna",
    )
    per_page = ranges.groupBy(*keys).agg(F.collect_set(member).alias("tramos"))
    joined = lines.join(per_page, list(keys), "left")
    hit = F.filter("tramos", lambda t: (F.col("x") >= t["desde"]) & (F.col("x") < t["hasta"]))
    return joined.withColumn("columna", F.get(hit, F.lit(0))["columna"]).drop("tramos")


def in_boxes(lines: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag lines whose centre lies in a table's box on their page."""
    box = F.struct("x0", "y0", "x1", "y1")
    per_page = boxes.groupBy(*keys).agg(F.collect_set(box).alias("cajas"))
    joined = lines.join(per_page, list(keys), "left")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = F.exists("cajas", lambda b: cx.between(b["x0"], b["x1"]) & cy.between(b["y0"], b["y1"]))
    return joined.withColumn("in_table", F.coalesce(inside, F.lit(False))).drop("cajas")


def cover_titles(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), slack: float = TITLE_SIZE_SLACK, least: int = MIN_COVER_TITLE,
) -> DataFrame:
    """Lines of the largest type size on each document's first page."""
    first = lines.where(F.col("page") == 1)
    largest = first.groupBy(*keys).agg(F.max("size").alias("mayor"))
    joined = first.join(largest, list(keys), "inner")
    return joined.where((F.col("size") >= F.col("mayor") - slack) & (F.length("text") >= least)).drop("mayor")


def mixed_columns(items: DataFrame, keys: Sequence[str] = ("doc_id", "columna"), year: str = "curso") -> DataFrame:
    """Columns holding more than one year: the layout was read wrongly."""
    seen = items.select(*keys, year).distinct()
    return seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("cursos")).where(F.col("cursos") > 1)


# ---------------------------------------------------------------------------
# Cells, years and codes
# ---------------------------------------------------------------------------
def table_kinds(cells: DataFrame, keys: Sequence[str] = ("doc_id", "page", "table_no")) -> DataFrame:
    """Whether a table holds criteria: odd width of 3 or more, and a criterion.

    Shape alone would take in three-column item tables.
    """
    shaped = F.exists(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: strip(t).rlike(C.CRITERION_CELL))
    return (
        cells.groupBy(*keys)
        .agg(F.max("n_cols").alias("columnas"), F.bool_or(shaped).alias("con_criterio"))
        .withColumn("es_de_criterios", (F.col("columnas") >= 3) & (F.col("columnas") % 2 == 1) & F.col("con_criterio"))
    )


def neighbour_years(cells: DataFrame, keys: Sequence[str] = ("doc_id", "page", "table_no", "row")) -> DataFrame:
    """Criterion cells with the years cited in the cell to their right."""
    odd = F.col("col") % 2 == 1
    criteria = cells.where(odd)
    cited = cells.where(~odd).select(*keys, (F.col("col") - 1).alias("col"), C.cited_years(F.col("text")).alias("cursos"))
    return criteria.join(cited, [*keys, "col"], "left").withColumn(
        "cursos", F.coalesce("cursos", F.array().cast("array<int>"))
    )


def criteria_by_year(
    criteria: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq"
) -> DataFrame:
    """One row per criterion and year: (keys, codigo, curso, text).

    The years cited beside a criterion win; without any it goes to every year
    its code was already seen with; one citing two years is copied to both.
    Pieces of one code and year are joined in order. A year is one digit of an
    item's code, so ten carries hold all that were seen.
    """
    placed = running(
        criteria, [*keys, "codigo"], [order], width_bucket(order),
        carries={f"__{y}": F.when(F.array_contains("cursos", y), F.lit(y)) for y in range(10)},
    )
    seen = F.array_compact(F.array(*[F.col(f"__{y}") for y in range(10)]))
    years = F.when(F.size("cursos") > 0, F.col("cursos")).otherwise(seen)
    rows = placed.select(*keys, "codigo", F.explode(years).alias("curso"), order, "text")
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return (
        rows.groupBy(*keys, "codigo", "curso")
        .agg(F.min(order).alias(order), pieces.alias("p"))
        .select(*keys, "codigo", "curso", order, join_lines(F.array_join(F.transform("p", lambda s: s["t"]), " ")).alias("text"))
    )


def majority_prefix(items: DataFrame, keys: Sequence[str] = ("doc_id",), prefix: str = "prefix") -> DataFrame:
    """Rows whose code has their group's commonest prefix; ties by name."""
    counts = items.groupBy(*keys, prefix).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col(prefix))).alias("b")).select(
        *keys, F.col(f"b.{prefix}").alias(prefix)
    )
    return items.join(best.hint("merge"), [*keys, prefix], "left_semi")


def gather_by_years(criteria: DataFrame, title_years: DataFrame, keys: Sequence[str] = ("doc_id",)) -> dict[str, DataFrame]:
    """Criteria under a joined key of their years, with a title fallback.

    Rows that get no years even from the title are kept apart and reported,
    never given all years.
    """
    fallback = title_years.select(*keys, F.col("cursos").alias("del_titulo"))
    joined = criteria.join(fallback, list(keys), "left")
    own = F.when(F.size("cursos") > 0, F.col("cursos"))
    placed = joined.withColumn(
        "cursos", F.coalesce(own, "del_titulo", F.array().cast("array<string>"))
    ).drop("del_titulo").withColumn("grupo", F.array_join(F.array_sort("cursos"), ","))
    return {"rows": placed.where(F.col("grupo") != ""), "sin_cursos": placed.where(F.col("grupo") == "")}


def missing_years_by_name(blocks: DataFrame, articles: DataFrame) -> DataFrame:
    """Blocks without years take those of the subject with the same name key."""
    known = articles.select(name_key(F.col("materia")).alias("__k"), F.col("cursos").alias("__c"))
    known = known.groupBy("__k").agg(F.min_by("__c", F.array_join("__c", ",")).alias("__c"))
    keyed = blocks.withColumn("__k", name_key(F.col("materia")))
    joined = keyed.join(known, ["__k"], "left")
    none = F.array().cast("array<string>")
    empty = F.size(F.coalesce("cursos", none)) == 0
    return joined.withColumn("cursos", F.when(empty, F.coalesce("__c", none)).otherwise(F.col("cursos"))).drop("__k", "__c")


def shared_curriculum(titles: DataFrame, year_groups: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every title on a cover with every year group of the same document.

    Both sides are a handful per document by nature: cover lines of the
    largest size, and the distinct year groups of its criteria.
    """
    names = titles.groupBy(*keys).agg(F.collect_set("titulo").alias("titulos"))
    groups = year_groups.select(*keys, "grupo").distinct()
    return groups.join(names, list(keys)).select(*keys, F.explode("titulos").alias("titulo"), "grupo")


def fallback_rows(sections: DataFrame, tables: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the section, and table rows only where no section exists."""
    lacking = tables.join(sections.select(*key).distinct().hint("merge"), key, "left_anti")
    return sections.withColumn("origen", F.lit("seccion")).unionByName(lacking.withColumn("origen", F.lit("tabla")))


def concatenate_parts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Page ranges of several documents as one: new ``seq`` over the whole.

    ``parts`` is the fixed list (doc_id, parte, desde, hasta); the order is
    part, then page, then place. Numbering counts by ranges of that order.
    """
    chosen = lines.join(parts, ["doc_id"], "inner").where(
        (F.col("page") >= F.col("desde")) & (F.col("hasta").isNull() | (F.col("page") < F.col("hasta")))
    )
    numbered = running(
        chosen.withColumnRenamed("seq", "seq_origen"), [], ["parte", "page", "seq_origen"], None, counts={"seq": F.lit(1)},
    )
    return numbered.withColumn("seq", F.col("seq") - 1)


# ---------------------------------------------------------------------------
# Names inside items
# ---------------------------------------------------------------------------
def longest_matches(items: DataFrame, names: Sequence[str], text: str = "text") -> DataFrame:
    """Every name found in an item, the longest first and struck out.

    A name inside a longer one that matched does not count again. The list of
    names is a fixed vocabulary, so it is applied inside the row, longest
    name first, and items are never paired with names.
    """
    ordered = sorted(set(names), key=lambda n: (-len(n), n))
    rest = F.upper(norm_heading(F.col(text)))
    vocabulary = F.array(*[F.lit(n) for n in ordered])

    def step(acc: Column, name: Column) -> Column:
        hit = F.contains(acc["rest"], F.upper(name))
        return F.struct(
            F.when(hit, F.replace(acc["rest"], F.upper(name), F.lit(" "))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.concat(acc["found"], F.array(name))).otherwise(acc["found"]).alias("found"),
        )

    zero = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(vocabulary, zero, step, lambda acc: acc["found"])
    # outer: Spark would test the array of a plain explode in two filters first and so find the names three times
    return items.withColumn("materia", F.explode_outer(found)).where(F.col("materia").isNotNull())


def item_years(text: Column, otherwise: Column) -> Column:
    """Years of an item: the one it names, else its section's."""
    word = F.lower(F.regexp_extract(text, r"(?iU)\ben\s+(primer|segundo|tercer|cuarto)\s+curso\b", 1))
    pairs = [F.lit(x) for kv in {"primer": "1º ESO", "segundo": "2º ESO", "tercer": "3º ESO", "cuarto": "4º ESO"}.items() for x in kv]
    return F.when(word != "", F.array(F.create_map(*pairs)[word])).otherwise(otherwise)


def article_counters(paragraphs: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "seq") -> DataFrame:
    """Article and clause number carried down; a new article resets the clause."""
    text = strip(F.col("text"))
    article = F.regexp_extract(text, r"^Art[íi]culo\s+(\d+)\.\s*(.*)$", 1).try_cast("int")
    clause = F.regexp_extract("text", r"^(\d+)\.\s", 1).try_cast("int")
    marks = F.when(article.isNotNull(), F.struct(F.lit(None).cast("int").alias("c"))).when(
        clause.isNotNull(), F.struct(clause.alias("c"))
    )
    carried = carry_forward(paragraphs, {"articulo": article, "__c": marks}, keys, order)
    return carried.withColumn("apartado", F.col("__c.c")).drop("__c")


def subject_years(
    paragraphs: DataFrame, names: Sequence[str], sections: Sequence[tuple[int, int | None, Sequence[str]]]
) -> DataFrame:
    """Years of each subject, read from the lettered items of articles.

    ``sections`` is the fixed list (article, clause or None, years): which
    clause gives which years. Without a clause the article's body counts.
    """
    placed = article_counters(paragraphs).where(F.col("articulo").isNotNull())
    spark = paragraphs.sparkSession
    rule = spark.createDataFrame(
        [(a, -1 if c is None else c, list(y)) for a, c, y in sections], "articulo int, regla int, cursos array<string>"
    )
    item = F.regexp_extract(strip(F.col("text")), r"(?U)^[a-z]\)\s+(.+)$", 1)
    is_item = item != ""
    header = strip(F.col("text")).rlike(r"^Art[íi]culo\s+\d+\.") | F.col("text").rlike(r"^\d+\.\s")
    bodies = placed.where(~header).withColumns({
        "regla": F.when(is_item, F.coalesce("apartado", F.lit(-1))).otherwise(F.lit(-1)),
        "cuerpo": F.when(is_item, item).otherwise(F.col("text")),
        "__item": is_item,
    })
    ruled = bodies.join(rule, ["articulo", "regla"], "inner")
    years = F.when(F.col("__item"), item_years(F.col("cuerpo"), F.col("cursos"))).otherwise(F.col("cursos"))
    found = longest_matches(ruled.withColumn("cursos", years), names, "cuerpo")
    return found.groupBy("doc_id", "materia").agg(
        C.sort_courses(F.array_distinct(F.flatten(F.collect_set("cursos")))).alias("cursos")
    )


def merge_blocks(items: DataFrame, keys: Sequence[str], order: str = "seq", width: int = 65536) -> DataFrame:
    """Blocks sharing a code inside a subject become one, items renumbered.

    Items stay rows, in order of reading; ``titulo`` is the first block's.
    """
    by = [*keys, "bloque"]
    numbered = running(items, by, [order], width_bucket(order, width), counts={"n": F.lit(1)})
    first = items.groupBy(*by).agg(F.min_by("titulo", order).alias("titulo"))
    return numbered.drop("titulo").join(first, by, "left")
