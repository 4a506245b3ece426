"""Coverage of the catalogue: pairs, subjects, years, alternatives."""

from pyspark.sql import functions as F

from ..functions.codes import sort_courses
from ..operators import coverage as ops
from ..operators import documents as docs
from .frames import CATALOGUE_SQL, PLACES_SQL, catalogue, citing_documents, order_catalogue
from .registry import query, read

_PAIRS_SQL = f"""
WITH {PLACES_SQL},
pairs AS (
  SELECT comunidad, materia, curso FROM places WHERE estado = 'F'
  INTERSECT SELECT comunidad, materia, curso FROM places WHERE estado = 'O'
  INTERSECT SELECT comunidad, materia, curso FROM places WHERE estado = 'P')
"""


def _pairs(spark, sf_dir):
    return ops.pairs_in_all(order_catalogue(spark, sf_dir))


@query("coverage_pairs", _PAIRS_SQL + "SELECT comunidad, materia, curso FROM pairs")
def coverage_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(
    "coverage_by_subject",
    _PAIRS_SQL
    + "SELECT comunidad, materia, string_agg(curso, ',' ORDER BY curso) AS cursos FROM pairs GROUP BY comunidad, materia",
)
def coverage_by_subject(spark, sf_dir):
    rows = ops.coverage_by_subject(_pairs(spark, sf_dir))
    return rows.select("comunidad", "materia", F.array_join("cursos", ",").alias("cursos"))


@query(
    "subjects_of_a_year",
    _PAIRS_SQL + "SELECT DISTINCT materia FROM pairs WHERE curso = '2-HIGH'",
)
def subjects_of_a_year(spark, sf_dir):
    return ops.subjects_of(ops.coverage_by_subject(_pairs(spark, sf_dir)), "2-HIGH").orderBy("materia")


@query(
    "years_of_a_subject",
    _PAIRS_SQL + "SELECT DISTINCT curso FROM pairs WHERE materia = 'BUILDING'",
)
def years_of_a_subject(spark, sf_dir):
    return ops.years_of(ops.coverage_by_subject(_pairs(spark, sf_dir)), "BUILDING").orderBy("curso")


@query(
    "distinct_subjects",
    f"WITH {CATALOGUE_SQL} SELECT DISTINCT comunidad, materia FROM cat WHERE materia IS NOT NULL",
)
def distinct_subjects(spark, sf_dir):
    return ops.distinct_subjects(catalogue(spark, sf_dir))


@query(
    "rows_for_subject",
    f"""WITH {CATALOGUE_SQL} SELECT id, comunidad, codigo, materia FROM cat
        WHERE materia = 'PROMO' OR materia IS NULL""",
)
def rows_for_subject(spark, sf_dir):
    return ops.for_subject(catalogue(spark, sf_dir), "PROMO").select("id", "comunidad", "codigo", "materia")


@query(
    "rows_for_year",
    f"""WITH {CATALOGUE_SQL} SELECT id, coalesce(curso = '2º ESO', false) AS lookup_rule,
        coalesce(curso = '2º ESO', true) AS resolution_rule FROM cat""",
)
def rows_for_year(spark, sf_dir):
    years, wanted = F.col("cursos_aplicables"), F.lit("2º ESO")
    return catalogue(spark, sf_dir).select(
        "id",
        ops.applies_to_year(years, wanted).alias("lookup_rule"),
        ops.applies_or_open(years, wanted).alias("resolution_rule"),
    )


_SCOPES_SQL = """
scopes AS (
  SELECT DISTINCT user_id AS id_situacion,
         CASE WHEN user_id % 25 > 0 THEN 'Brand#' || (1 + user_id % 27) END AS comunidad,
         (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])[1 + user_id % 6] AS materia,
         (['1º ESO', '2º ESO', '3º ESO'])[1 + user_id % 3] AS curso
  FROM events)
"""


def _scopes(spark, sf_dir):
    owner = F.col("id_situacion")
    courses = F.array(F.lit("1º ESO"), F.lit("2º ESO"), F.lit("3º ESO"))
    return citing_documents(spark, sf_dir).select(
        "id_situacion",
        F.when(owner % 25 > 0, F.col("comunidad")).alias("comunidad"),
        "materia",
        F.element_at(courses, (owner % 3 + 1).cast("int")).alias("curso"),
    )


def _split(spark, sf_dir):
    rows = catalogue(spark, sf_dir)
    return [rows.where(F.col("kind") == k) for k in ("competencias", "criterios", "saberes")]


@query(
    "has_catalogue",
    f"""WITH {CATALOGUE_SQL}, {_SCOPES_SQL}
    SELECT s.id_situacion, EXISTS (
      SELECT 1 FROM cat c WHERE c.comunidad = s.comunidad AND c.materia = s.materia
        AND (c.curso IS NULL OR c.curso = s.curso)) AS con_curriculo
    FROM scopes s""",
)
def has_catalogue(spark, sf_dir):
    flagged = ops.flag_documents(_scopes(spark, sf_dir), ops.loaded_pairs(*_split(spark, sf_dir)))
    return flagged.select("id_situacion", "con_curriculo")


@query(
    "catalogue_alternatives",
    f"""WITH {CATALOGUE_SQL}, {_SCOPES_SQL},
    pairs AS (
      SELECT comunidad, materia, curso FROM cat WHERE kind = 'competencias' AND curso IS NOT NULL AND materia IS NOT NULL
      INTERSECT SELECT comunidad, materia, curso FROM cat WHERE kind = 'criterios' AND materia IS NOT NULL
      INTERSECT SELECT comunidad, materia, curso FROM cat WHERE kind = 'saberes' AND materia IS NOT NULL),
    both_years AS (SELECT * FROM pairs),
    offered AS (SELECT comunidad, curso, string_agg(materia, ',' ORDER BY materia) AS alternativas
                FROM both_years GROUP BY comunidad, curso)
    SELECT s.id_situacion, CASE WHEN s.comunidad IS NULL THEN 'sin_comunidad' ELSE 'sin_curriculo' END AS motivo,
           coalesce(o.alternativas, '') AS alternativas
    FROM scopes s LEFT JOIN offered o ON o.comunidad = s.comunidad AND o.curso = s.curso
    WHERE NOT EXISTS (SELECT 1 FROM both_years p WHERE p.comunidad = s.comunidad AND p.materia = s.materia
                      AND p.curso = s.curso)""",
)
def catalogue_alternatives(spark, sf_dir):
    complete = ops.complete_pairs(*_split(spark, sf_dir))
    rows = ops.alternatives(_scopes(spark, sf_dir), complete)
    return rows.select("id_situacion", "motivo", F.array_join("alternativas", ",").alias("alternativas"))


@query(
    "provinces_with_catalogue",
    """SELECT r_name AS comunidad, count(s_nationkey) > 0 AS con_curriculo,
              string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS provincias
       FROM region JOIN nation ON n_regionkey = r_regionkey
       LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0) ON s_nationkey = n_nationkey
       GROUP BY r_name""",
)
def provinces_with_catalogue(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    provinces = named.select(F.col("r_name").alias("comunidad"), F.col("n_name").alias("provincia"))
    sellers = read(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal").where(F.col("s_acctbal") > 0)
    active = sellers.select("s_nationkey").distinct()
    loaded = active.join(named, active.s_nationkey == named.n_nationkey).select(F.col("r_name").alias("comunidad"))
    rows = ops.provinces_with_catalogue(provinces, loaded)
    return rows.select("comunidad", "con_curriculo", F.array_join("provincias", ",").alias("provincias"))


@query(
    "regions_union",
    """SELECT 'part' AS origen, p_brand AS comunidad, p_type AS materia, CAST(NULL AS VARCHAR) AS idioma,
              count(*) AS filas FROM part GROUP BY ALL
       UNION ALL
       SELECT 'documents', source, CAST(NULL AS VARCHAR), lang, count(*) FROM documents GROUP BY ALL""",
)
def regions_union(spark, sf_dir):
    """Regional catalogues with differing columns, united by name."""
    a = read(spark, sf_dir, "part").groupBy(
        F.lit("part").alias("origen"), F.col("p_brand").alias("comunidad"), F.col("p_type").alias("materia")
    ).agg(F.count(F.lit(1)).alias("filas"))
    b = read(spark, sf_dir, "documents").groupBy(
        F.lit("documents").alias("origen"), F.col("source").alias("comunidad"), F.col("lang").alias("idioma")
    ).agg(F.count(F.lit(1)).alias("filas"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "course_order",
    """SELECT c_mktsegment AS materia, string_agg(curso, ',' ORDER BY rango, curso) AS cursos FROM (
         SELECT DISTINCT c_mktsegment, CASE c_nationkey % 5 WHEN 0 THEN 'otro' ELSE (c_nationkey % 5) || 'º ESO' END AS curso,
                CASE c_nationkey % 5 WHEN 0 THEN 99 ELSE c_nationkey % 5 END AS rango FROM customer)
       GROUP BY c_mktsegment""",
)
def course_order(spark, sf_dir):
    n = F.col("c_nationkey") % 5
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("materia"),
        F.when(n == 0, "otro").otherwise(F.concat(n, F.lit("º ESO"))).alias("curso"),
    )
    return rows.groupBy("materia").agg(
        F.array_join(sort_courses(F.collect_set("curso")), ",").alias("cursos")
    )


@query(
    "natural_order",
    """SELECT DISTINCT p_brand AS etiqueta, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS numero FROM part""",
)
def natural_order(spark, sf_dir):
    """Labels in natural order: Brand#2 before Brand#10."""
    key = docs.natural_key(F.col("etiqueta"))
    labels = read(spark, sf_dir, "part", "p_brand").distinct().select(F.col("p_brand").alias("etiqueta"))
    return labels.orderBy(key).select("etiqueta", key["number"].alias("numero"))


@query("locale_order", "SELECT DISTINCT lower(p_name) AS nombre FROM part")
def locale_order(spark, sf_dir):
    names = read(spark, sf_dir, "part", "p_name").select(F.lower("p_name").alias("nombre")).distinct()
    return docs.locale_order(names, "nombre")
