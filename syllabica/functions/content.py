"""Authored-document JSON: cited codes, rewriting, metadata, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values of the document format.
SECTIONS = [
    "descripcion", "objetivos", "conexion_curricular",
    "secuencia_sesiones", "evaluacion", "atencion_diversidad",
]
CITING_SECTION = "conexion_curricular"
KINDS = ["competencias", "criterios", "saberes"]
REQUIRED_PARTS = {
    "conexion_curricular": ["competencias", "criterios", "saberes"],
    "objetivos": ["objetivos"],
    "secuencia_sesiones": ["sesiones"],
}
CONTROL_KEYS = ["_meta", "_alternativa"]
SUGGESTION_KEYS = ["propuestas", "sugerencias", "items", "resultados"]
OPERATIONS = ["resumir", "expandir", "traducir", "alternativa"]
OPERABLE_SECTIONS = [s for s in SECTIONS if s != CITING_SECTION]



def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    Parsing JSON dominates these functions and a repeated expression inside a
    conditional is evaluated each time it appears.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(_type(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(_type(v).startswith("ARRAY"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(_type(v) == "STRING", F.lit(False))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _cited(doc: Column, kind: str) -> Column:
    def code(e: Column) -> Column:
        inner = F.try_variant_get(e, "$.codigo", "variant")
        return F.when(is_text(e), strip(as_text(e))).when(is_object(e) & is_text(inner), strip(as_text(inner)))

    def listed(items: Column) -> Column:
        codes = F.transform(F.when(is_list(items), as_list(items)), code)
        return F.array_distinct(F.filter(codes, lambda x: x.isNotNull() & (x != "")))

    found = bind(F.try_variant_get(doc, f"$.{CITING_SECTION}.{kind}", "variant"), listed)
    return F.coalesce(found, F.array().cast("array<string>"))


def cited_codes(content: Column, kind: str) -> Column:
    """Trimmed distinct codes of one list, in order; anything odd is skipped.

    Elements may be objects with ``codigo`` or bare strings. A missing list, a
    string where a list belongs or a section that is no object give no codes.
    """
    return bind(F.try_parse_json(content), lambda doc: _cited(doc, kind))


def cited_lists(content: Column) -> Column:
    """Array of (kind, codes) for the three lists, from one parse."""
    return bind(
        F.try_parse_json(content),
        lambda doc: F.array(*[F.struct(F.lit(k).alias("kind"), _cited(doc, k).alias("codes")) for k in KINDS]),
    )


def rewritable_codes(content: Column) -> Column:
    """What ``rewrite_codes`` looks up: ``codigo`` and ``competencia`` of objects in the three lists, as written."""
    def text(e: Column, name: str) -> Column:
        return bind(F.try_variant_get(e, f"$.{name}", "variant"), lambda v: F.when(is_text(v), as_text(v)))

    def listed(items: Column) -> Column:
        objects = F.filter(F.when(is_list(items), as_list(items)), is_object)
        return F.flatten(F.transform(objects, lambda e: F.array(text(e, "codigo"), text(e, "competencia"))))

    def found(doc: Column) -> Column:
        none = F.array().cast("array<string>")
        lists = [bind(F.try_variant_get(doc, f"$.{CITING_SECTION}.{kind}", "variant"), listed) for kind in KINDS]
        return F.array_compact(F.flatten(F.array(*[F.coalesce(x, none) for x in lists])))

    return bind(F.try_parse_json(content), found)


def rewrite_codes(content: Column, canonical: Column) -> Column:
    """Content with the resolved codes put in place of the cited ones.

    Only ``codigo`` and ``competencia`` of objects in the three lists change;
    codes without a canonical form stay, so orphans remain visible. Returns
    the input unchanged when nothing is to be replaced.
    """
    def fields(k: Column, v: Column) -> Column:
        new = canonical[as_text(v)]
        swap = k.isin("codigo", "competencia") & is_text(v) & new.isNotNull()
        return F.when(swap, new.cast("variant")).otherwise(v)

    def element(e: Column) -> Column:
        return F.when(is_object(e), F.parse_json(F.to_json(F.transform_values(as_map(e), fields)))).otherwise(e)

    def lists(k: Column, v: Column) -> Column:
        swap = k.isin(*KINDS) & is_list(v)
        return F.when(swap, F.parse_json(F.to_json(F.transform(as_list(v), element)))).otherwise(v)

    def rebuilt(doc: Column) -> Column:
        def sections(k: Column, v: Column) -> Column:
            rewritten = F.parse_json(F.to_json(F.transform_values(as_map(v), lists)))
            return F.when((k == CITING_SECTION) & is_object(v), rewritten).otherwise(v)

        usable = is_object(doc[CITING_SECTION])
        return F.when(usable, F.to_json(F.transform_values(doc, sections)))

    replaceable = F.size(F.coalesce(canonical, F.create_map().cast("map<string,string>"))) > 0
    new = F.when(replaceable, bind(F.from_json(content, "map<string,variant>"), rebuilt))
    return F.coalesce(new, content)


def normalised_codes(canonical: Column) -> Column:
    """Sorted cited codes whose canonical form differs."""
    return F.array_sort(F.map_keys(F.map_filter(canonical, lambda k, v: k != v)))


def parse_failure(raw: Column) -> Column:
    """Struct(ok, raw): a reply that is no JSON is kept as text and flagged."""
    return bind(
        F.try_parse_json(raw).isNull(),
        lambda failed: F.struct((~failed).alias("parsed"), F.when(failed, raw).alias("raw_text")),
    )


def _present(v: Column) -> Column:
    """Whether a JSON value counts as present: not null, empty, zero or false."""
    kind = _type(v)
    text = as_text(v)
    return F.coalesce(
        F.when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), F.size(as_list(v)) > 0)
        .when(kind.startswith("OBJECT"), F.size(as_map(v)) > 0)
        .when(kind == "BOOLEAN", text == "true")
        .otherwise(F.try_variant_get(v, "$", "double") != 0),
        F.lit(False),
    )


def _has(doc: Column, key: str) -> Column:
    return bind(F.try_variant_get(doc, f"$.{key}", "variant"), _present)


def missing_parts(section: Column, payload: Column) -> Column:
    """Required keys absent or empty; none for text that is no JSON, which counts as a parse failure."""
    none = F.array().cast("array<string>")

    def judged(doc: Column) -> Column:
        out = none
        for name, parts in REQUIRED_PARTS.items():
            gone = F.array_compact(F.array(*[F.when(~_has(doc, p), F.lit(p)) for p in parts]))
            out = F.when(section == name, gone).otherwise(out)
        return F.when(doc.isNull() | _has(doc, "_error_parseo"), none).otherwise(out)

    return F.when(section.isin(*REQUIRED_PARTS), bind(F.try_parse_json(payload), judged)).otherwise(none)


def section_meta(payload: Column) -> Column:
    """Struct of the trace fields kept under ``_meta``."""
    def fields(doc: Column) -> Column:
        def field(name: str, type_: str) -> Column:
            return F.try_variant_get(doc, f"$._meta.{name}", type_).alias(name)

        return F.struct(
            field("version_prompt", "string"), field("proveedor", "string"), field("modelo", "string"),
            field("tokens_prompt", "bigint"), field("tokens_respuesta", "bigint"), field("generada_en", "string"),
        )

    return bind(F.try_parse_json(payload), fields)


def without_keys(payload: Column, keys: list[str] | None = None) -> Column:
    """JSON object without the given keys (the control keys by default)."""
    drop = keys or CONTROL_KEYS
    return F.to_json(F.map_filter(F.from_json(payload, "map<string,variant>"), lambda k, _: ~k.isin(*drop)))


def merge_section_map(content: Column, sections: Column) -> Column:
    """Content with the sections of a map (name to JSON) replaced or added."""
    doc = F.coalesce(F.from_json(content, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    rest = F.map_filter(doc, lambda k, _: ~F.map_contains_key(sections, k))
    return F.to_json(F.map_concat(rest, F.transform_values(sections, lambda _, v: F.parse_json(v))))


def merge_section(content: Column, name: Column, payload: Column) -> Column:
    """Content with one section replaced or added, the others untouched."""
    doc = F.coalesce(F.from_json(content, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    rest = F.map_filter(doc, lambda k, _: k != name)
    return F.to_json(F.map_concat(rest, F.create_map(name, F.parse_json(payload))))


def section_of(content: Column, name: Column) -> Column:
    """One section as JSON text, or null when the key is absent."""
    doc = F.from_json(content, "map<string,variant>")
    return F.to_json(doc[name])


def has_section(content: Column, name: Column) -> Column:
    keys = F.json_object_keys(content)
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def schema_drift(expected: Column, received: Column) -> Column:
    """Struct of key sets missing from and added to a reply, control keys out."""
    want = F.filter(F.json_object_keys(expected), lambda k: ~k.isin(*CONTROL_KEYS))
    got = F.json_object_keys(received)
    none = F.array().cast("array<string>")
    return F.struct(
        F.array_sort(F.array_except(F.coalesce(want, none), F.coalesce(got, none))).alias("missing"),
        F.array_sort(F.array_except(F.coalesce(got, none), F.coalesce(want, none))).alias("added"),
        (got.isNotNull() & F.coalesce(F.array_sort(want) == F.array_sort(got), F.lit(False))).alias("accepted"),
    )


def suggestions(raw: Column) -> Column:
    """Items of a reply: the list at the root or under one of four keys.

    Items without a title are dropped; four fields are kept, as trimmed text.
    """
    def field(e: Column, name: str) -> Column:
        return strip(F.coalesce(F.try_variant_get(e, f"$.{name}", "string"), F.lit(""))).alias(name)

    def listed(doc: Column) -> Column:
        items = F.when(is_list(doc), as_list(doc))
        for key in SUGGESTION_KEYS:
            inner = F.try_variant_get(doc, f"$.{key}", "variant")
            items = F.coalesce(items, F.when(is_list(inner), as_list(inner)))
        return items

    objects = F.filter(bind(F.try_parse_json(raw), listed), is_object)
    shaped = F.transform(objects, lambda e: F.struct(*[field(e, n) for n in SUGGESTION_FIELDS]))
    return F.filter(shaped, lambda s: s["titulo"] != "")


# The fields kept of a suggestion.
SUGGESTION_FIELDS = ["titulo", "resumen", "producto_final", "pregunta_guia"]


def summary_text(content: Column, cut: int | None = None, items: int | None = None) -> Column:
    """Readable outline of a document: a heading per section, a line per key.

    Keys keep their order in the document. Nested values are shown as compact
    JSON, plain lists by their items: whole, or the first ``cut`` characters and
    ``items`` entries where the caller asks for fewer.
    """
    def shown(v: Column, text: Column) -> Column:
        return (
            F.when(_type(v) == "BOOLEAN", F.initcap(text)).when(_type(v) == "VOID", F.lit("None")).otherwise(text)
        )

    def pairs(raw: Column, typed: Column) -> Column:
        def line(e: Column) -> Column:
            v = typed[e["key"]]
            body = F.when(is_list(v) | is_object(v), e["value"] if cut is None else F.substring(e["value"], 1, cut)).otherwise(
                F.coalesce(shown(v, e["value"]), F.lit("None"))
            )
            return F.concat(F.lit("- "), e["key"], F.lit(": "), body)

        return F.transform(F.filter(F.map_entries(raw), lambda e: e["key"] != "_meta"), line)

    def both(text: Column, body: Callable[[Column, Column], Column]) -> Column:
        raw, typed = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
        return bind(F.struct(raw.alias("r"), typed.alias("t")), lambda d: body(d["r"], d["t"]))

    def outline(raw: Column, typed: Column) -> Column:
        def section(entry: Column) -> Column:
            key, text = entry["key"], entry["value"]
            value = typed[key]
            bullets = F.transform(
                as_list(value) if items is None else F.slice(as_list(value), 1, items), lambda v: F.concat(F.lit("- "), shown(v, as_text(v)))
            )
            body = (
                F.when(is_object(value), both(text, pairs))
                .when(is_list(value), bullets)
                .otherwise(F.array(F.coalesce(shown(value, text), F.lit("None"))))
            )
            return F.concat(F.array(F.concat(F.lit("### "), key)), body)

        sections = F.filter(F.map_entries(raw), lambda e: ~e["key"].startswith("_"))
        return F.array_join(F.flatten(F.transform(sections, section)), "\n")

    text = F.coalesce(both(content, outline), F.lit(""))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(sin contenido previo)"))
