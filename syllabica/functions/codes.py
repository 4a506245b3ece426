"""Curricular codes: variants, parsing, year markers, descriptors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compare_heading, fold_words, ordered_distinct, strip

# ---------------------------------------------------------------------------
# Patterns and word lists the bulletins use.
# ---------------------------------------------------------------------------
COMPETENCE_PREFIX = r"(?iU)^C\.?\s*E\.?\s*[-–.]?\s*(?=\d)"
CRITERION = r"(?Us)^\s*(\d+)\.(\d+)\.?\s+(.+)$"
CRITERION_CELL = r"(?U)^(\d{1,2})\.(\d{1,2})\.?\s+(.*)$"
COMPETENCE_START = r"(?Us)^(\d+)\.\s+(.+)$"
COMPETENCE_LINE = r"(?U)^(\d{1,2})\.\s+([A-ZÁÉÍÓÚÑ].*)$"
COMPETENCE_ALONE = r"^(\d{1,2})\.$"
COMPETENCE_HEADING = r"(?U)^Competencia específica\s+(\d+)\.?\s*$"
BLOCK = r"(?U)^([A-Z])\.\s+(.+?)\.?\s*$"
SUBHEADING = r"(?U)^\d+\.\s+[A-ZÁÉÍÓÚÑa-záéíóúñü][^.]{0,40}\.?\s*$"
OFFICIAL_ITEM = r"(?U)^([A-Z]{2,4})\.(\d)\.([A-Z])\.(\d+)\.?\s*(.*)$"
LOOSE_ITEM_YEAR = r"\b[A-Z]{0,4}\.?(\d)\.[A-Z]\.\d+\.?"
DESCRIPTOR_PHRASE = r"(?iU)descriptores\s+del\s+Perfil\s+de\s+salida\s*:\s*([^.]+)"
DESCRIPTOR_LINE = r"^(?:(?:CCL|CP|STEM|CD|CPSAA|CC|CE|CCEC)\d[, ]*)+\.?\s*$"
YEAR_HEADER_CA = r"(?U)^(?:1r|2n|3r|4t)(?:[\s,i]+(?:1r|2n|3r|4t))*$"
OPTIONAL_TITLE_CA = r"(?iU)optativa de\s+(primer|segon|tercer|quart)(?:\s+a\s+(primer|segon|tercer|quart))?"
TRACK = r"(?iU)matem[áa]ticas\s+([ab])\b"

# Headings of table columns.
TABLE_HEADINGS = [
    "competencias especificas", "criterios de evaluacion", "criterios evaluacion",
    "saberes basicos", "saberes", "basicos",
]

# The descriptors of the exit profile.
DESCRIPTORS = [
    "CCL1", "CCL2", "CCL3", "CCL4", "CCL5",
    "CP1", "CP2", "CP3",
    "STEM1", "STEM2", "STEM3", "STEM4", "STEM5",
    "CD1", "CD2", "CD3", "CD4", "CD5",
    "CPSAA1", "CPSAA2", "CPSAA3", "CPSAA4", "CPSAA5",
    "CC1", "CC2", "CC3", "CC4",
    "CE1", "CE2", "CE3",
    "CCEC1", "CCEC2", "CCEC3", "CCEC4",
]

# Ordinals of years, and Catalan column headings.
ORDINALS_ES = {
    "primero": 1, "segundo": 2, "tercero": 3, "cuarto": 4,
    "primer": 1, "segund": 2, "tercer": 3, "cuart": 4,
}
ORDINALS_CA = {"primer": 1, "segon": 2, "tercer": 3, "quart": 4}
HEADER_CA = {"1r": 1, "2n": 2, "3r": 3, "4t": 4}
COURSES = ["1º ESO", "2º ESO", "3º ESO", "4º ESO"]
COURSE_HEADINGS = ["primer curso", "segundo curso", "tercer curso", "cuarto curso"]


def _course(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("º ESO"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def _years_between(low: Column, high: Column) -> Column:
    return F.when(high < low, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(low, high), _course)
    )


def code_variants(c: Column) -> Column:
    """Equivalent spellings of a cited code, the literal one first."""
    code = strip(c)
    bare = F.regexp_replace(code, COMPETENCE_PREFIX, "")
    prefixed = F.when(code.rlike(r"(?U)^\d"), F.concat(F.lit("CE"), code))
    compact = F.regexp_replace(code, r"(?U)\s+", "")
    return F.coalesce(ordered_distinct(F.array(code, bare, prefixed, compact)), F.array().cast("array<string>"))


def descriptors(c: Column) -> Column:
    """Codes after the fixed phrase, kept only if they are on the list."""
    listed = F.regexp_extract_all(F.regexp_extract(c, DESCRIPTOR_PHRASE, 1), F.lit(r"\b[A-Z]+\d+\b"), F.lit(0))
    known = F.array(*[F.lit(d) for d in DESCRIPTORS])
    return F.filter(listed, lambda d: F.array_contains(known, d))


def descriptor_list(c: Column) -> Column:
    """The same codes when they stand alone on their line."""
    codes = F.filter(F.split(F.regexp_replace(c, r"\.+$", ""), r"[,\s]+"), lambda d: d != "")
    return F.when(c.rlike(DESCRIPTOR_LINE), codes)


def parse_years(c: Column) -> Column:
    """Struct(label, years, track) of a year marker, or null.

    The word gate comes first: most paragraphs never reach the patterns.
    """
    word = "(" + "|".join(ORDINALS_ES) + ")"
    forms = [
        (rf"^cursos?\s+de\s+{word}\s+a\s+{word}$", "range"),
        (rf"^cursos?\s+{word}\s+y\s+{word}$", "pair"),
        (rf"^{word}\s+curso\s*:\s*(.+)$", "track"),
        (rf"^curso\s+{word}\s*:\s*(.+)$", "track"),
        (rf"^{word}\s+curso$", "one"),
        (rf"^cursos?\s+(?:de\s+)?{word}$", "one"),
    ]
    label = F.regexp_replace(strip(c), r"\.+$", "")

    def parsed(norm: Column) -> Column:
        out = None
        for pattern, kind in forms:
            first = _lookup(ORDINALS_ES, F.regexp_extract(norm, pattern, 1))
            track = F.lit(None).cast("string")
            if kind == "range":
                years = _years_between(first, _lookup(ORDINALS_ES, F.regexp_extract(norm, pattern, 2)))
            elif kind == "pair":
                years = F.array(_course(first), _course(_lookup(ORDINALS_ES, F.regexp_extract(norm, pattern, 2))))
            else:
                years = F.array(_course(first))
            if kind == "track":
                letter = F.upper(F.regexp_extract(F.regexp_extract(norm, pattern, 2), TRACK, 1))
                track = F.when(letter != "", letter)
            value = F.struct(label.alias("label"), years.alias("years"), track.alias("track"))
            hit = norm.rlike(pattern)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    # the heading form is found once, though every pattern reads it
    out = F.get(F.transform(F.array(compare_heading(c)), parsed), F.lit(0))
    return F.when(F.lower(c).contains("curso"), out)


def header_years_ca(c: Column) -> Column:
    """Years of a Catalan column heading such as ``1r, 2n i 3r``."""
    found = F.regexp_extract_all(c, F.lit("1r|2n|3r|4t"), F.lit(0))
    return F.when(c.rlike(YEAR_HEADER_CA), F.transform(found, lambda o: _course(_lookup(HEADER_CA, o))))


def title_years_ca(c: Column) -> Column:
    """Years an optional subject declares in its own title, or null."""
    low = F.lower(F.regexp_extract(c, OPTIONAL_TITLE_CA, 1))
    high = F.lower(F.regexp_extract(c, OPTIONAL_TITLE_CA, 2))
    first = _lookup(ORDINALS_CA, low)
    last = F.coalesce(_lookup(ORDINALS_CA, high), first)
    return F.when(low != "", _years_between(first, last))


def parse_criterion(c: Column, pattern: str = CRITERION) -> Column:
    """Struct(code, competence, text) of ``1.2 Some text``, or null."""
    a, b = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(
        c.rlike(pattern),
        F.struct(
            F.concat(a, F.lit("."), b).alias("code"),
            a.alias("competence"),
            strip(F.regexp_extract(c, pattern, 3)).alias("text"),
        ),
    )


def parse_competence(c: Column, pattern: str = COMPETENCE_START) -> Column:
    """Struct(code, text) of ``3. Some text``, or null."""
    return F.when(
        c.rlike(pattern),
        F.struct(F.regexp_extract(c, pattern, 1).alias("code"), strip(F.regexp_extract(c, pattern, 2)).alias("text")),
    )


def parse_block(c: Column) -> Column:
    """Struct(code, title) of ``A. Some title.``, or null."""
    return F.when(
        c.rlike(BLOCK),
        F.struct(F.regexp_extract(c, BLOCK, 1).alias("code"), strip(F.regexp_extract(c, BLOCK, 2)).alias("title")),
    )


def parse_official_item(c: Column) -> Column:
    """Struct(code, prefix, year, block, number, text) of ``ABC.1.A.8 …``."""
    part = [F.regexp_extract(c, OFFICIAL_ITEM, i) for i in range(6)]
    return F.when(
        c.rlike(OFFICIAL_ITEM),
        F.struct(
            F.concat_ws(".", part[1], part[2], part[3], part[4]).alias("code"),
            part[1].alias("prefix"),
            part[2].cast("int").alias("year"),
            part[3].alias("block"),
            part[4].cast("int").alias("number"),
            part[5].alias("text"),
        ),
    )


def cited_years(c: Column) -> Column:
    """Sorted distinct year digits of the item codes cited in a cell."""
    digits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LOOSE_ITEM_YEAR), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: d.cast("int"))))


def drop_code_residue(line: Column, prefix: Column) -> Column:
    """Remove the fragment of this subject's prefix left at a line end.

    The longest fragment wins; other capitals at the line end are text.
    """
    out = line
    for n in range(1, 5):
        piece = F.substring(prefix, 1, n)
        fits = (F.length(prefix) >= n) & line.endswith(F.concat(F.lit(" "), piece))
        out = F.when(fits, F.rtrim(F.substr(line, F.lit(1), F.length(line) - n))).otherwise(out)
    return out


def criteria_of_cell(cell: Column, prefix: Column) -> Column:
    """Struct(preludio, criterios) of a cell: text before its first code, and (codigo, texto) of each code at a line's start.

    Lines after a code continue it. What is left of the subject's code prefix at a line's end and headings go.
    """
    lines = F.transform(F.split(cell, "\n"), lambda t: drop_code_residue(strip(t), prefix))
    said = F.filter(lines, lambda t: (t != "") & ~fold_words(t).isin(TABLE_HEADINGS))
    piece = "struct<codigo:string,texto:string>"
    start = F.struct(F.lit("").alias("preludio"), F.array().cast(f"array<{piece}>").alias("criterios"))

    def step(acc: Column, t: Column) -> Column:
        done, n = acc["criterios"], F.size(acc["criterios"])
        code = F.concat_ws(".", F.regexp_extract(t, CRITERION_CELL, 1), F.regexp_extract(t, CRITERION_CELL, 2))
        opened = F.concat(done, F.array(F.struct(code.alias("codigo"), F.regexp_extract(t, CRITERION_CELL, 3).alias("texto"))))
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, n - 1), F.array(F.struct(last["codigo"].alias("codigo"), F.concat_ws(" ", last["texto"], t).alias("texto"))))
        before = F.ltrim(F.concat_ws(" ", acc["preludio"], t))
        return (
            F.when(t.rlike(CRITERION_CELL), F.struct(acc["preludio"].alias("preludio"), opened.alias("criterios")))
            .when(n > 0, F.struct(acc["preludio"].alias("preludio"), longer.alias("criterios")))
            .otherwise(F.struct(before.alias("preludio"), done.alias("criterios")))
        )

    return F.aggregate(said, start, step)


def dotted_order(c: Column) -> Column:
    """Numeric sort key of a dotted code, so 1.2 comes before 1.10. A part that is no number of up to 38 digits is null and so comes first."""
    return F.transform(F.split(c, r"\."), lambda p: F.when(p.rlike(r"^\s*\d{1,38}\s*$"), p.try_cast("decimal(38,0)")))


def course_order(c: Column) -> Column:
    """Rank of a course label; unknown labels last."""
    rank = F.lit(99)
    for i, course in reversed(list(enumerate(COURSES, 1))):
        rank = F.when(c == course, i).otherwise(rank)
    return rank


def sort_courses(c: Column) -> Column:
    """Distinct courses in teaching order, unknown ones last by name."""
    keyed = F.transform(F.array_distinct(c), lambda x: F.struct(course_order(x).alias("r"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])
