"""From the paragraphs of a bulletin to catalogue records.

Which subject, year group and section a paragraph belongs to is carried down
in layers. The year marker rule depends on the state that the markers before leave. Markers are cut
into short ranges; each range becomes a map from any state to the one it ends in, the maps are
composed along a subject, and every range is then run from the state it begins with.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.text import compare_heading, norm_heading, strip_bullet
from ..sources.tables import cut_lineage
from .ordered import running, width_bucket

WHOLE_STAGE = C.COURSES
# Capitals that head a section, not a subject, and the phrase
# after which a subject's curricular content is over.
SECTION_CAPITALS = ["CRITERIOS DE EVALUACIÓN", "SABERES BÁSICOS", "COMPETENCIAS ESPECÍFICAS"]
END_PHRASE = "orientaciones metodológicas"
SINGLE_GROUP = "Único"

_MARK = "struct<seq:bigint,tipo:string,cursos:array<string>,ciclo:string,itinerario:string>"
_GROUP = "struct<cursos:array<string>,ciclo:string,itinerario:string>"
#: Paragraphs of a range of markers, and the sections a state may be in.
MARK_RANGE = 1024
SECTIONS = ["fuera", "competencias", "criterios", "saberes"]
_STATE = "struct<seq:bigint,grupo:int,seccion:string,cursos:array<string>,ciclo:string,itinerario:string>"


@dataclass(frozen=True)
class Profile:
    """What differs between bulletins: classes, subject names and markers."""

    subjects: Mapping[str, str]
    header_class: str = "centro_negrita"
    capitals: bool = False
    default_years: Mapping[str, Sequence[str]] = field(default_factory=dict)
    competences: str = "competencias específicas"
    criteria: str = "criterios de evaluación"
    items: str = "saberes básicos"


def _by_key(pairs: Mapping[str, Column | str], key: Column) -> Column:
    flat = []
    for k, v in pairs.items():
        flat += [F.lit(k), v if isinstance(v, Column) else F.lit(v)]
    return F.create_map(*flat)[key]


def _may_be(text: Column, marker: str) -> Column:
    """Cheap word test, so that most paragraphs never reach the patterns."""
    return F.lower(text).contains(marker.split()[0])


def label_subjects(paragraphs: DataFrame, profile: Profile) -> DataFrame:
    """Paragraphs inside a subject, with its official name and run number."""
    names = {" ".join(n.split()): n for n in profile.subjects}
    text = F.col("text")
    header = F.col("cls") == profile.header_class
    official = F.when(header, _by_key(names, norm_heading(text)))
    if profile.capitals:
        other = (text == F.upper(text)) & (text != F.lower(text)) & ~text.isin(SECTION_CAPITALS)
    else:
        first = F.substring(text, 1, 1)
        other = (first == F.upper(first)) & (first != F.lower(first))
    closes = (header & other & (F.length(text) > 4)) | (
        _may_be(text, END_PHRASE) & compare_heading(text).startswith(END_PHRASE)
    )
    mark = F.when(official.isNotNull(), F.struct(official.alias("oficial"))).when(
        closes, F.struct(F.lit(None).cast("string").alias("oficial"))
    )
    carried = running(
        paragraphs.withColumn("__m", mark), ["doc_id"], ["seq"], width_bucket("seq"),
        counts={"tramo": F.col("__m.oficial").isNotNull()}, carries={"materia": F.col("__m")},
    )
    return carried.where(F.col("materia.oficial").isNotNull()).select(
        "doc_id", "tramo", "seq", "text", F.col("materia.oficial").alias("materia_oficial"),
        F.col("__m").isNotNull().alias("es_cabecera"),
    )


def _mask(years: Column) -> Column:
    """Years as bits; only those of the stage count."""
    bits = F.lit(0)
    for i, course in enumerate(WHOLE_STAGE):
        bits = bits + F.when(F.array_contains(years, course), 1 << i).otherwise(0)
    return bits


def _state(section: Column, group: Column, mask: Column, last: Column) -> Column:
    return F.struct(section.alias("seccion"), group.alias("grupo"), mask.alias("mascara"), last.alias("ultimo"))


def _after(acc: Column, m: Column) -> Column:
    """The state after a marker.

    A year marker inside the items section that names fewer of the open years
    and no track only subdivides them, and is passed over.
    """
    years = _mask(m["cursos"])
    inside = years.bitwiseAND(F.bitwise_not(acc["mascara"])) == 0
    fewer = acc["mascara"].bitwiseAND(F.bitwise_not(years)) != 0
    subdivides = (acc["seccion"] == "saberes") & m["itinerario"].isNull() & inside & fewer
    group = F.struct(m["cursos"].alias("cursos"), m["ciclo"].alias("ciclo"), m["itinerario"].alias("itinerario"))
    return (
        F.when(m["tipo"] != "curso", _state(m["tipo"], acc["grupo"], acc["mascara"], acc["ultimo"]))
        .when(subdivides, acc).otherwise(_state(F.lit("fuera"), acc["grupo"] + 1, years, group))
    )


def _effects(marks: Column) -> Column:
    """For every section and set of years, in order, the state that a range of markers leads to: groups opened, and the last of them."""
    starts = F.array(*[
        _state(F.lit(section), F.lit(0), F.lit(mask), F.lit(None).cast(_GROUP)) for section in SECTIONS for mask in range(1 << len(WHOLE_STAGE))])
    return F.transform(starts, lambda start: F.aggregate(marks, start, _after))


def _composed(ranges: Column) -> Column:
    """The state each range of a subject begins in, from the end of its first range and the effects of the others."""
    none = F.lit(None)

    def step(acc: Column, r: Column) -> Column:
        now = acc["estado"]
        place = (F.array_position(F.array(*map(F.lit, SECTIONS)), now["seccion"]).cast("int") - 1) * (1 << len(WHOLE_STAGE)) + now["mascara"]
        led = F.get(r["efectos"], place)
        then = _state(led["seccion"], now["grupo"] + led["grupo"], led["mascara"], F.coalesce(led["ultimo"], now["ultimo"]))
        entry = F.struct(r["rango"].alias("rango"), now.alias("inicio"))
        return F.struct(F.coalesce(r["fin"], then).alias("estado"), F.concat(acc["salida"], F.array(entry)).alias("salida"))

    state = f"struct<seccion:string,grupo:int,mascara:int,ultimo:{_GROUP}>"
    start = F.struct(none.cast(state).alias("estado"), F.array().cast(f"array<struct<rango:bigint,inicio:{state}>>").alias("salida"))
    return F.aggregate(ranges, start, step, lambda acc: acc["salida"])


def _fold_marks(marks: Column, start: Column) -> Column:
    """States after each accepted marker of one range of markers."""

    def step(acc: Column, m: Column) -> Column:
        now = _after(acc["estado"], m)
        accepted = (m["tipo"] != "curso") | (now["grupo"] > acc["estado"]["grupo"])
        row = F.struct(m["seq"].alias("seq"), now["grupo"].alias("grupo"), now["seccion"].alias("seccion"), now["ultimo"]["cursos"].alias("cursos"),
                       now["ultimo"]["ciclo"].alias("ciclo"), now["ultimo"]["itinerario"].alias("itinerario"))
        out = F.when(accepted, F.concat(acc["salida"], F.array(row))).otherwise(acc["salida"])
        return F.struct(now.alias("estado"), out.alias("salida"))

    zero = F.struct(start.alias("estado"), F.array().cast(f"array<{_STATE}>").alias("salida"))
    return F.aggregate(marks, zero, step, lambda acc: acc["salida"])


def _ranges_from(ranges: DataFrame, first_years: Column) -> DataFrame:
    """Ranges of markers with the state each begins in, ``inicio``; a subject of one range needs no composition."""
    key = ["doc_id", "tramo"]
    group = F.struct(first_years.alias("cursos"), F.lit(SINGLE_GROUP).alias("ciclo"), F.lit(None).cast("string").alias("itinerario"))
    first = ranges.where("primero").withColumn("inicio", _state(F.lit("fuera"), F.lit(0), _mask(first_years), group))
    later = ranges.where(~F.col("primero"))
    ends = first.join(later.select(*key).distinct(), key, "left_semi").select(
        *key, F.struct("rango", F.aggregate("marcas", F.col("inicio"), _after).alias("fin"), F.lit(None).alias("efectos")).alias("r"))
    effects = later.select(*key, F.struct("rango", F.lit(None).alias("fin"), _effects(F.col("marcas")).alias("efectos")).alias("r"))
    types = {f.name: f.dataType for f in effects.schema["r"].dataType.fields}
    fin = ends.schema["r"].dataType["fin"].dataType
    shape = lambda df: df.select(*key, F.struct(
        F.col("r.rango").cast("bigint").alias("rango"), F.col("r.fin").cast(fin).alias("fin"), F.col("r.efectos").cast(types["efectos"]).alias("efectos")).alias("r"))
    along = F.array_sort(F.collect_list("r"), lambda a, b: F.signum(a["rango"] - b["rango"]).cast("int"))
    starts = shape(ends).unionByName(shape(effects)).groupBy(*key).agg(along.alias("p")).select(*key, F.explode(_composed(F.col("p"))).alias("s"))
    begun = later.join(starts.select(*key, "s.rango", "s.inicio"), [*key, "rango"])
    return first.unionByName(begun.select(first.columns))


def label_groups(
    inside: DataFrame, profile: Profile, stage: Callable[[DataFrame, str], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(content rows with their year group and section, year groups).

    Paragraphs are staged with what they mark, so that several branches read it and none parses them
    again; the folded markers are staged once for both. A list holds the markers of ``MARK_RANGE`` paragraphs at most.
    """
    text = F.col("text")
    norm = compare_heading(text)
    section = (
        F.when(_may_be(text, profile.competences) & (norm == profile.competences), "competencias")
        .when(_may_be(text, profile.criteria) & (norm == profile.criteria), "criterios")
        .when(_may_be(text, profile.items) & (norm == profile.items), "saberes")
    )
    parsed = inside.withColumn("y", C.parse_years(text)).withColumn(
        "tipo", F.when(F.col("es_cabecera"), "cabecera").when(F.col("y").isNotNull(), "curso").otherwise(section)
    )
    rows = stage(parsed, "materias")
    default = F.lit(None).cast("array<string>")
    if profile.default_years:
        years = {n: F.array(*[F.lit(y) for y in ys]) for n, ys in profile.default_years.items()}
        default = _by_key(years, F.col("materia_oficial"))
    first_years = F.coalesce(default, F.array(*[F.lit(y) for y in WHOLE_STAGE]))
    mark = F.struct(
        "seq", "tipo", F.col("y.years").alias("cursos"), F.col("y.label").alias("ciclo"), F.col("y.track").alias("itinerario")
    ).cast(_MARK)
    ranges = rows.where(F.col("tipo").isNotNull()).groupBy("doc_id", "tramo", "materia_oficial", width_bucket("seq", MARK_RANGE).alias("rango")).agg(
        F.array_sort(F.collect_list(F.when(F.col("tipo") != "cabecera", mark))).alias("marcas"), F.bool_or(F.col("tipo") == "cabecera").alias("primero")
    )
    begun = _ranges_from(stage(ranges, "rangos"), first_years)
    folded = begun.select("doc_id", "tramo", "materia_oficial", "primero", _fold_marks(F.col("marcas"), F.col("inicio")).alias("s"))
    runs = stage(folded, "marcas")
    opening = runs.where("primero").select(
        "doc_id", "tramo", "materia_oficial",
        F.struct(
            F.lit(0).alias("grupo"), first_years.alias("cursos"), F.lit(SINGLE_GROUP).alias("ciclo"),
            F.lit(None).cast("string").alias("itinerario"),
        ).alias("g"),
    ).select("doc_id", "tramo", "materia_oficial", "g.*")
    exploded = runs.select("doc_id", "tramo", "materia_oficial", F.explode("s").alias("s"))
    opened = exploded.select(
        "doc_id", "tramo", "materia_oficial", "s.grupo", "s.cursos", "s.ciclo", "s.itinerario"
    ).where(F.col("grupo") > 0).distinct()
    content = rows.where(F.col("tipo").isNull()).select("doc_id", "tramo", "seq", "text", F.lit(None).cast(_STATE).alias("s"))
    stacked = content.unionByName(
        exploded.select("doc_id", "tramo", F.col("s.seq").alias("seq"), F.lit(None).cast("string").alias("text"), "s")
    )
    carried = running(stacked, ["doc_id", "tramo"], ["seq"], width_bucket("seq"), carries={"s": F.col("s")})
    placed = carried.where(F.col("text").isNotNull() & F.col("s").isNotNull()).select(
        "doc_id", "tramo", F.col("s.grupo").alias("grupo"), F.col("s.seccion").alias("seccion"),
        F.col("s.seq").alias("marca"), "seq", "text",
    )
    return placed, opening.unionByName(opened)


def competence_rows(placed: DataFrame) -> DataFrame:
    """(doc_id, tramo, grupo, seq, codigo, descripcion, descriptores).

    A line of descriptors belongs to the open competence; the first numbered
    line of a section opens one even if it lists descriptors itself.
    """
    rows = placed.where(F.col("seccion") == "competencias").withColumns({
        "c": C.parse_competence(F.col("text")), "d": C.descriptors(F.col("text")),
    })
    keys = ["doc_id", "tramo", "marca"]
    opens = F.col("c").isNotNull()
    seen = running(rows, keys, ["seq"], width_bucket("seq"), counts={"abiertas": opens})
    earlier = F.col("abiertas") - F.when(opens, 1).otherwise(0) > 0
    starts = opens & ((F.size("d") == 0) | ~earlier)
    numbered = running(seen.withColumn("inicia", starts), keys, ["seq"], width_bucket("seq"), counts={"n": F.col("inicia")})
    lists = F.when(~F.col("inicia") & (F.size("d") > 0), F.col("seq"))
    grouped = numbered.where(F.col("n") > 0).groupBy("doc_id", "tramo", "grupo", "marca", "n").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.col("c"), F.when(F.col("inicia"), F.col("seq"))).alias("c"),
        F.max_by("d", lists).alias("d"),
    )
    return grouped.select(
        "doc_id", "tramo", "grupo", "seq",
        F.concat(F.lit("CE"), "c.code").alias("codigo"), F.col("c.text").alias("descripcion"),
        F.coalesce("d", F.array().cast("array<string>")).alias("descriptores"),
    )


def criterion_rows(placed: DataFrame) -> DataFrame:
    """(doc_id, tramo, grupo, seq, codigo, competencia, descripcion)."""
    rows = placed.where((F.col("seccion") == "criterios") & ~F.col("text").rlike(C.COMPETENCE_HEADING))
    parsed = rows.withColumn("c", C.parse_criterion(F.col("text"))).where(F.col("c").isNotNull())
    return parsed.select(
        "doc_id", "tramo", "grupo", "seq", F.col("c.code").alias("codigo"),
        F.concat(F.lit("CE"), "c.competence").alias("competencia"), F.col("c.text").alias("descripcion"),
    )


def item_rows(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, items): blocks sharing a code in a year group are one."""
    rows = placed.where(F.col("seccion") == "saberes").withColumn("b", C.parse_block(F.col("text")))
    opened = running(
        rows, ["doc_id", "tramo", "marca"], ["seq"], width_bucket("seq"), carries={"abierto": F.col("b.code")}
    )
    blocks = rows.where(F.col("b").isNotNull()).groupBy("doc_id", "tramo", "grupo", F.col("b.code").alias("bloque")).agg(
        F.min("seq").alias("seq"), F.min_by("b.title", "seq").alias("titulo")
    )
    items = (
        opened.where(F.col("b").isNull() & ~F.col("text").rlike(C.SUBHEADING) & F.col("abierto").isNotNull())
        .select("doc_id", "tramo", "grupo", F.col("abierto").alias("bloque"), "seq", strip_bullet(F.col("text")).alias("item"))
        .where(F.col("item") != "")
    )
    return blocks, items


def _listed(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    entry = F.struct("seq", *fields)
    out = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return rows.groupBy(*keys).agg(out.alias(name))


def extract_blocks(
    paragraphs: DataFrame, profile: Profile, stage: Callable[[DataFrame, str], DataFrame] = cut_lineage
) -> DataFrame:
    """One catalogue record per (bulletin, subject, year group).

    A record is one output file, so its lists are held together; nothing
    larger than a record is. Competences pass on to the later year groups of
    their subject. The opening group is dropped when it only held them.

    The labelled paragraphs are read by several branches, so each layer is
    written to the shared folder and read back (``stage``): a lost executor
    rereads files, and no layer is computed more than once.
    """
    placed, groups = label_groups(label_subjects(paragraphs, profile), profile, stage)
    placed = stage(placed, "parrafos")
    keys = ["doc_id", "tramo", "grupo"]
    competences = competence_rows(placed)
    own = groups.select(*keys)
    inherited = competences.withColumnRenamed("grupo", "desde").join(own, ["doc_id", "tramo"]).where(
        F.col("desde") <= F.col("grupo")
    )
    blocks, items = item_rows(placed)
    per_block = items.groupBy(*keys, "bloque").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda e: e["item"]).alias("items")
    )
    filled = blocks.join(per_block, [*keys, "bloque"], "left").select(
        *keys, "seq", F.col("bloque").alias("codigo"), F.concat_ws(". ", "bloque", "titulo").alias("bloque"), "titulo",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    last = groups.groupBy("doc_id", "tramo").agg(F.max("grupo").alias("ultimo"))
    joined = (
        groups.join(last, ["doc_id", "tramo"])
        .join(_listed(inherited, keys, ["codigo", "descripcion", "descriptores"], "competencias_especificas"), keys, "left")
        .join(_listed(criterion_rows(placed), keys, ["codigo", "competencia", "descripcion"], "criterios_evaluacion"), keys, "left")
        .join(_listed(filled, keys, ["codigo", "bloque", "titulo", "items"], "saberes_basicos"), keys, "left")
    )
    only_container = (
        (F.col("grupo") == 0) & (F.col("ultimo") > 0)
        & F.col("criterios_evaluacion").isNull() & F.col("saberes_basicos").isNull()
    )
    short = _by_key(profile.subjects, F.col("materia_oficial"))
    types = {f.name: f.dataType for f in joined.schema.fields}
    lists = {
        n: F.coalesce(n, F.array().cast(types[n]))
        for n in ("competencias_especificas", "criterios_evaluacion", "saberes_basicos")
    }
    return joined.where(~only_container).select(
        *keys, "materia_oficial",
        F.concat_ws(" ", short, F.col("itinerario")).alias("materia"),
        F.lit("ESO").alias("etapa"), "ciclo", "itinerario",
        F.col("cursos").alias("cursos_aplicables"),
        *[c.alias(n) for n, c in lists.items()],
    )
