"""Catalogue JSON files: reading, flattening and writing."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..functions.regions import DEFAULT_REGION, REGION_ALIASES, REGIONS
from ..functions.text import slug

from ..operators.quality import dangling
from ..schemas import CATALOGUE_FILE
from .json_values import cut_up

#: Records of a written file: readers hold a file whole.
RECORDS_PER_FILE = 1000


def checked_region(region: str | None) -> str:
    """Code of a region argument; an unknown one is an error before any write."""
    if region is None:
        return DEFAULT_REGION
    parts = unicodedata.normalize("NFD", region.strip().lower())
    key = "".join(p for p in parts if unicodedata.category(p) != "Mn")
    for candidate in (key, key.replace(" ", "-")):
        code = candidate if candidate in REGIONS else REGION_ALIASES.get(candidate)
        if code:
            return code
    raise ValueError(f"unknown region {region!r}; known: {', '.join(sorted(REGIONS))}")


def read_catalogue(
    spark: SparkSession, path: str, region: str | None = None, language: str | None = None
) -> DataFrame:
    """All records of the JSON files of a folder, with their path.

    A file holds one object, an array of objects, an object per line or objects one after the other, with
    broken ones between. Region and language inside a record win over the arguments. Text
    that is no object is left out; ``unreadable_records`` lists it.
    """
    fallback, lang = checked_region(region), (language or "es").strip().lower()
    return with_defaults(parsed_records(pieces(whole_files(spark.read, path))), fallback, lang)


def whole_files(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """(value, ruta): each JSON file of a folder as one text; a catalogue file is a subject's size."""
    texts = reader.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path)
    return texts.select("value", F.col("_metadata.file_path").alias("ruta"))


def pieces(files: DataFrame) -> DataFrame:
    """(fichero, texto, bueno): each top-level object of the files, and all text that is none; later ones of a file are numbered."""
    number = F.when(F.col("n") > 0, F.concat(F.lit("#"), F.col("n"))).otherwise(F.lit(""))
    return cut_up(files).select(F.concat("ruta", number).alias("fichero"), "texto", "bueno")


def parsed_records(found: DataFrame) -> DataFrame:
    """Records of the good pieces."""
    return found.where("bueno").withColumn("r", F.from_json("texto", CATALOGUE_FILE)).select("r.*", "fichero")


def rejected_pieces(found: DataFrame) -> DataFrame:
    """(fichero, texto) of what is no object."""
    return found.where(~F.col("bueno")).select("fichero", "texto")


def unreadable_records(spark: SparkSession, path: str) -> DataFrame:
    """(fichero, texto) of what is no object in the files ``read_catalogue`` reads."""
    return rejected_pieces(pieces(whole_files(spark.read, path)))


def with_defaults(records: DataFrame, region: str, language: str) -> DataFrame:
    empty = F.lit("")
    return records.withColumns({
        "comunidad": F.coalesce(F.nullif(F.col("comunidad"), empty), F.lit(region)),
        "idioma": F.coalesce(F.nullif(F.col("idioma"), empty), F.lit(language)),
    })


def flatten_catalogue(records: DataFrame) -> dict[str, DataFrame]:
    """Competence, criterion and item rows, and the criteria set apart.

    ``carga`` keeps path and place order for last-wins rules. An item
    takes its official code if the file gives one at its place, else a number
    inside its block. Criteria citing a competence their own file lacks are
    rejected.
    """
    base = ["fichero", "comunidad", "idioma", "materia", "cursos_aplicables"]
    load = F.struct(F.col("fichero"), F.col("pos"), F.lit(0).alias("item")).alias("carga")
    competences = records.select(*base, F.posexplode("competencias_especificas").alias("pos", "c")).select(
        *base, load, "c.codigo", "c.descripcion",
        F.coalesce("c.descriptores", F.array().cast("array<string>")).alias("descriptores"),
    )
    criteria = records.select(*base, F.posexplode("criterios_evaluacion").alias("pos", "c")).select(
        *base, load, "c.codigo", "c.competencia", "c.descripcion"
    )
    known = competences.select("fichero", "comunidad", F.col("codigo").alias("competencia"))
    on = ["fichero", "comunidad", "competencia"]
    rejected = dangling(criteria, known, on)
    accepted = criteria.join(known.distinct(), on, "left_semi")
    blocks = records.select(*base, F.posexplode("saberes_basicos").alias("pos", "b"))
    items = blocks.select(*base, "pos", "b", F.posexplode("b.items").alias("item", "descripcion")).select(
        *base,
        F.struct("fichero", "pos", "item").alias("carga"),
        F.coalesce(
            F.get(F.col("b.codigos_items"), F.col("item")), F.concat_ws(".", "b.codigo", F.col("item") + 1)
        ).alias("codigo"),
        F.col("b.titulo").alias("bloque"),
        "descripcion",
    )
    return {"competencias": competences, "criterios": accepted, "saberes": items, "rechazados": rejected}


def split_writable(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks to write, blocks without criteria, which are only reported)."""
    has = F.size(F.coalesce("criterios_evaluacion", F.array().cast(blocks.schema["criterios_evaluacion"].dataType))) > 0
    return blocks.where(has), blocks.where(~has).select("materia", "cursos_aplicables")


def file_stem(style: str = "underscore"):
    """``subject__years`` name of a block's file."""
    digits = F.array_join(F.filter(F.transform("cursos_aplicables", lambda c: F.regexp_extract(c, r"(\d)", 1)), lambda d: d != ""), "_")
    return F.concat(slug(F.col("materia"), style), F.lit("__"), F.when(digits == "", "unico").otherwise(digits))


def write_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Write one folder of JSON per region and subject; returns the skipped blocks.

    Region and language stay inside the records, where the loader looks. A folder that many records
    share gets many files, as a file is read whole.
    """
    good, skipped = split_writable(blocks)
    named = good.withColumns({"region": F.col("comunidad"), "fichero": file_stem()})
    named.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy("region", "fichero").json(path)
    return skipped
