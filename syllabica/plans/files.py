"""Catalogue files written from the parts table, read back and loaded."""

import uuid

from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..session import shared_dir
from ..sources import catalogue_files as files
from ..sources.json_values import cut_up
from ..streaming import jobs
from .registry import query, read, spread

_FILES_SQL = """
p AS (SELECT DISTINCT p_brand AS comunidad, p_type AS materia, p_size AS n FROM part),
comp AS (SELECT comunidad, materia, 'CE' || n AS codigo FROM p WHERE n <= 10),
crit AS (SELECT comunidad, materia, n || '.1' AS codigo, 'CE' || (n - 10) AS competencia FROM p WHERE n BETWEEN 11 AND 20),
acc AS (SELECT crit.*, EXISTS (SELECT 1 FROM comp WHERE comp.comunidad = crit.comunidad AND comp.materia = crit.materia AND comp.codigo = crit.competencia) AS valido FROM crit),
item AS (SELECT comunidad, materia, 'A.' || row_number() OVER (PARTITION BY comunidad, materia ORDER BY n) AS codigo, 'saber ' || n AS descripcion FROM p WHERE n > 20)
"""


def _written(spark, sf_dir):
    """A folder with one JSON record per (brand, type).

    Sizes are 1 to 50, so a record is bounded however many parts there are.
    """
    rows = read(spark, sf_dir, "part", "p_brand", "p_type", "p_size").distinct()
    record = rows.groupBy(F.col("p_brand").alias("comunidad"), F.col("p_type").alias("materia")).agg(
        F.array_sort(F.collect_set("p_size")).alias("n")
    )

    def pick(low, high):
        return F.filter("n", lambda x: x.between(low, high))

    blocks = record.select(
        "comunidad", "materia", F.lit("ca").alias("idioma"), F.array(F.lit("1º ESO")).alias("cursos_aplicables"),
        F.transform(pick(1, 10), lambda x: F.struct(
            F.concat(F.lit("CE"), x).alias("codigo"), F.concat(F.lit("texto "), x).alias("descripcion"), F.array(F.lit("STEM1")).alias("descriptores")
        )).alias("competencias_especificas"),
        F.transform(pick(11, 20), lambda x: F.struct(
            F.concat(x, F.lit(".1")).alias("codigo"), F.concat(F.lit("CE"), x - 10).alias("competencia"), F.concat(F.lit("criterio "), x).alias("descripcion")
        )).alias("criterios_evaluacion"),
        F.array(F.struct(
            F.lit("A").alias("codigo"), F.lit("Bloque").alias("titulo"),
            F.transform(pick(21, 50), lambda x: F.concat(F.lit("saber "), x)).alias("items"),
        )).alias("saberes_basicos"),
    )
    folder = f"{shared_dir(spark)}/catalogo-{uuid.uuid4().hex}"
    files.write_blocks(blocks, f"{folder}/json")
    return folder


def _one_stem(spark, sf_dir):
    """A folder whose records share one region and one file stem, a record per part."""
    blocks = spread(read(spark, sf_dir, "part", "p_partkey", "p_name")).select(
        F.lit("galicia").alias("comunidad"), F.element_at(F.array(*map(F.lit, ("Música", "MÚSICA", "Musica"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("materia"),
        F.lit("gl").alias("idioma"), F.array(F.lit("1º ESO")).alias("cursos_aplicables"),
        F.array(F.struct(F.lit("CE1").alias("codigo"), F.lit("texto").alias("descripcion"), F.array(F.lit("STEM1")).alias("descriptores"))).alias("competencias_especificas"),
        F.array(F.struct(F.concat(F.col("p_partkey"), F.lit(".1")).alias("codigo"), F.lit("CE1").alias("competencia"), F.col("p_name").alias("descripcion"))).alias("criterios_evaluacion"),
        F.array(F.struct(F.lit("A").alias("codigo"), F.lit("Bloque").alias("titulo"), F.array("p_name").alias("items"))).alias("saberes_basicos"),
    )
    folder = f"{shared_dir(spark)}/catalogo-{uuid.uuid4().hex}"
    files.write_blocks(blocks, f"{folder}/json")
    return folder


_ONE_STEM_SQL = """SELECT ['Música', 'MÚSICA', 'Musica'][p_partkey % 3 + 1] AS materia, p_partkey || '.1' AS codigo, p_name AS descripcion FROM part"""


@query("catalogue_one_stem", _ONE_STEM_SQL)
def catalogue_one_stem(spark, sf_dir):
    """Many records in one folder by region and stem: all are read back."""
    records = files.read_catalogue(spark, f"{_one_stem(spark, sf_dir)}/json")
    return files.flatten_catalogue(records)["criterios"].select("materia", "codigo", "descripcion")


@query("catalogue_one_stem_stream", _ONE_STEM_SQL)
def catalogue_one_stem_stream(spark, sf_dir):
    """The same as a stream of files."""
    folder = _one_stem(spark, sf_dir)
    stream = jobs.catalogue_stream(spark, f"{folder}/json")
    flat = stream.select("materia", F.explode("criterios_evaluacion").alias("c")).select("materia", "c.codigo", "c.descripcion")
    jobs.run_append(flat, f"{folder}/filas", f"{folder}/control").awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{folder}/filas")


_WRITTEN = "(SELECT DISTINCT comunidad, materia FROM crit)"


@query(
    "catalogue_files",
    f"""WITH {_FILES_SQL} SELECT 'competencias' AS tabla, comunidad, materia, codigo, '' AS texto FROM comp SEMI JOIN {_WRITTEN} w USING (comunidad, materia)
    UNION ALL SELECT CASE WHEN valido THEN 'criterios' ELSE 'rechazados' END, comunidad, materia, codigo, competencia FROM acc
    UNION ALL SELECT 'saberes', comunidad, materia, codigo, descripcion FROM item SEMI JOIN {_WRITTEN} w USING (comunidad, materia)""",
)
def catalogue_files(spark, sf_dir):
    """Records written, read back and flattened; rejected criteria apart."""
    flat = files.flatten_catalogue(files.read_catalogue(spark, f"{_written(spark, sf_dir)}/json"))
    texts = {"competencias": F.lit(""), "criterios": F.col("competencia"), "saberes": F.col("descripcion"), "rechazados": F.col("competencia")}
    out = None
    for name, text in texts.items():
        part = flat[name].select(F.lit(name).alias("tabla"), "comunidad", "materia", "codigo", text.alias("texto"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "catalogue_stream",
    f"""WITH {_FILES_SQL} SELECT comunidad, materia, codigo, 'ca' AS idioma FROM acc WHERE valido""",
)
def catalogue_stream(spark, sf_dir):
    """Files loaded as they arrive: the criteria table after the last batch."""
    folder = _written(spark, sf_dir)
    jobs.load_files(jobs.catalogue_pieces(spark, f"{folder}/json"), f"{folder}/tablas", f"{folder}/control", buckets=8).awaitTermination()
    return jobs.loaded(spark, f"{folder}/tablas", "criterios").select("comunidad", "materia", "codigo", "idioma")


_MIXED_SQL = """SELECT 'leido' AS resultado, 'M' || p_partkey AS materia, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS lugar FROM part
UNION ALL SELECT 'leido', 'N' || p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END FROM part WHERE p_partkey % 4 < 2
UNION ALL SELECT 'rechazado', 'R' || p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END FROM part
UNION ALL SELECT 'rechazado', '7', 0 FROM part WHERE p_partkey % 4 > 1
UNION ALL SELECT 'rechazado', 'suelto', 0 FROM part WHERE p_partkey % 4 = 1"""


def _mixed(spark, sf_dir):
    """A text per part: lines with a bad one, objects one after the other, an array, trailing text."""
    k = F.col("p_partkey")
    good, other = F.concat(F.lit('{"materia": "M'), k, F.lit('", "etapa": "} \\" ["}')), F.concat(F.lit('{\n  "materia": "N'), k, F.lit('"\n}'))
    bad = F.concat(F.lit('{"materia": "R'), k, F.lit('", '))
    text = (
        F.when(k % 4 == 0, F.concat(other, F.lit(" "), good, F.lit("\n"), bad))
        .when(k % 4 == 1, F.concat(F.lit("suelto\n"), other, F.lit("\n"), bad, F.lit("\n"), good))
        .otherwise(F.concat(F.lit("[7, "), F.concat(F.lit('"R'), k, F.lit('", ')), good, F.lit("]\n")))
    )
    return spread(read(spark, sf_dir, "part", "p_partkey")).select(text.alias("value"), k.cast("string").alias("ruta"))


@query("catalogue_mixed", _MIXED_SQL)
def catalogue_mixed(spark, sf_dir):
    """Texts of every shape cut into values; what is no object is reported with its place."""
    found = cut_up(_mixed(spark, sf_dir))
    name = F.regexp_extract("texto", '"materia": "([A-Z][0-9]+)"', 1)
    bad = F.coalesce(F.nullif(F.regexp_extract("texto", "R[0-9]+", 0), F.lit("")), F.col("texto"))
    return found.select(F.when(F.col("bueno"), "leido").otherwise("rechazado").alias("resultado"), F.when(F.col("bueno"), name).otherwise(bad).alias("materia"), F.col("n").alias("lugar"))


@query(
    "catalogue_load",
    f"""WITH {_FILES_SQL} SELECT comunidad, materia, codigo, '1º ESO' AS cursos, count(*) OVER (PARTITION BY comunidad, materia) AS criterios
        FROM acc WHERE valido""",
)
def catalogue_load(spark, sf_dir):
    """Files loaded twice: the second load changes no key."""
    flat = files.flatten_catalogue(files.read_catalogue(spark, f"{_written(spark, sf_dir)}/json"))
    loaded = cat.load_catalogue(flat, cat.load_catalogue(flat))["criterios"]
    per_subject = loaded.groupBy("comunidad", "materia").agg(F.count(F.lit(1)).alias("criterios"))
    return loaded.join(per_subject, ["comunidad", "materia"]).select(
        "comunidad", "materia", "codigo", F.array_join("cursos_aplicables", ",").alias("cursos"), "criterios"
    )
