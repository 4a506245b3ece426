"""Cited codes resolved against the catalogue, orphans and their causes."""

from pyspark.sql import functions as F

from ..functions.codes import code_variants
from ..operators import resolve as ops
from ..operators.coverage import loaded_pairs
from ..operators.ordered import width_bucket
from ..operators.relabel import reassignment_job
from ..operators.versions import resolve_proposals
from ..sources.tables import cut_lineage
from .frames import CATALOGUE_SQL, CITATIONS_SQL, catalogue, citations, citing_documents
from .registry import query, read, spread_by_values

_RESOLVED_SQL = f"""
WITH {CATALOGUE_SQL}, {CITATIONS_SQL},
spelled AS (
  SELECT c.*, r.rank, r.variante FROM cited c, LATERAL (
    SELECT 0 AS rank, codigo AS variante
    UNION ALL SELECT 1, regexp_replace(codigo, '^C\\.?E\\.? ?', '') WHERE codigo LIKE 'C%'
    UNION ALL SELECT 1, 'CE' || codigo WHERE codigo NOT LIKE 'C%'
    UNION ALL SELECT 2, replace(codigo, ' ', '') WHERE codigo LIKE '% %') r),
owned AS (
  SELECT * FROM spelled QUALIFY pos = min(pos) OVER (PARTITION BY id_situacion, kind, variante)),
hits AS (
  SELECT o.id_situacion, o.kind, o.codigo, o.rank, cat.id, cat.codigo AS codigo_catalogo
  FROM owned o JOIN scopes s ON s.id_situacion = o.id_situacion
  JOIN cat ON cat.comunidad = s.comunidad AND cat.kind = o.kind AND cat.codigo = o.variante
   AND (cat.materia = s.materia OR cat.materia IS NULL) AND (cat.curso = s.curso OR cat.curso IS NULL)),
resolved AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id_situacion, kind, codigo ORDER BY rank, id) = 1),
orphans AS (
  SELECT id_situacion, kind, codigo FROM cited c WHERE NOT EXISTS (
    SELECT 1 FROM resolved r WHERE r.id_situacion = c.id_situacion AND r.kind = c.kind AND r.codigo = c.codigo)),
causes AS (
  SELECT s.id_situacion, s.materia, s.curso, coalesce(n, 0) AS huerfanos,
    CASE WHEN coalesce(n, 0) = 0 THEN 'limpio'
         WHEN NOT EXISTS (SELECT 1 FROM cat WHERE cat.comunidad = s.comunidad AND cat.materia = s.materia
                          AND (cat.curso IS NULL OR cat.curso = s.curso)) THEN 'sin_curriculo'
         ELSE 'inventados' END AS causa
  FROM scopes s LEFT JOIN (SELECT id_situacion, count(*) AS n FROM orphans GROUP BY id_situacion) o
    ON o.id_situacion = s.id_situacion)
"""


def _resolved(spark, sf_dir, stage=cut_lineage):
    """Citations and their resolution; staged where several branches read them."""
    cited = stage(citations(spark, sf_dir), "citas")
    resolved = ops.resolve_codes(cited, citing_documents(spark, sf_dir), catalogue(spark, sf_dir))
    return cited, stage(resolved, "resueltas")


def _as_is(df, _name):
    return df


def _causes(spark, sf_dir):
    cited, resolved = _resolved(spark, sf_dir)
    rows = catalogue(spark, sf_dir)
    pairs = loaded_pairs(*[rows.where(F.col("kind") == k) for k in ("competencias", "criterios", "saberes")])
    return ops.orphan_causes(citing_documents(spark, sf_dir), ops.orphan_codes(cited, resolved), pairs)


@query("resolve_codes", _RESOLVED_SQL + "SELECT id_situacion, kind, codigo, rank, id, codigo_catalogo FROM resolved")
def resolve_codes(spark, sf_dir):
    return _resolved(spark, sf_dir, _as_is)[1]


@query("orphan_codes", _RESOLVED_SQL + "SELECT id_situacion, kind, codigo FROM orphans")
def orphan_codes(spark, sf_dir):
    return ops.orphan_codes(*_resolved(spark, sf_dir))


@query("orphan_causes", _RESOLVED_SQL + "SELECT id_situacion, huerfanos, causa FROM causes")
def orphan_causes(spark, sf_dir):
    return _causes(spark, sf_dir).select("id_situacion", "huerfanos", "causa")


@query(
    "missing_pair_counts",
    _RESOLVED_SQL
    + """SELECT materia, curso, count(*) AS situaciones FROM causes WHERE causa = 'sin_curriculo' GROUP BY ALL""",
)
def missing_pair_counts(spark, sf_dir):
    return ops.missing_pair_counts(_causes(spark, sf_dir))


@query(
    "link_totals",
    _RESOLVED_SQL + "SELECT kind, count(*) AS enlaces FROM (SELECT DISTINCT id_situacion, kind, id FROM resolved) GROUP BY kind",
)
def link_totals(spark, sf_dir):
    return ops.link_totals(_resolved(spark, sf_dir, _as_is)[1])


@query(
    "link_changes",
    _RESOLVED_SQL
    + """, new_links AS (SELECT DISTINCT id_situacion, kind, id AS id_target FROM resolved),
    old_links AS (SELECT DISTINCT id_situacion, kind, id AS id_target FROM hits WHERE rank = 0)
    SELECT *, 'nuevo' AS cambio FROM (SELECT * FROM new_links EXCEPT SELECT * FROM old_links)
    UNION ALL SELECT *, 'retirado' FROM (SELECT * FROM old_links EXCEPT SELECT * FROM new_links)""",
)
def link_changes(spark, sf_dir):
    """Dry run of a rebuild: the old links had matched literal codes only."""
    cited, resolved = _resolved(spark, sf_dir)
    docs, rows = citing_documents(spark, sf_dir), catalogue(spark, sf_dir)
    blank = F.lit("")
    literal = cited.join(docs, "id_situacion").select(
        "id_situacion", "kind", "comunidad", F.col("codigo"), "materia", "curso"
    )
    owned = ops.owned_variants(cited).where(F.col("rank") == 0).select("id_situacion", "kind", "codigo")
    listed = rows.select(
        "comunidad", "kind", "codigo", F.col("materia").alias("m"),
        F.explode_outer("cursos_aplicables").alias("c"), F.col("id").alias("id_target"),
    )
    old = (
        literal.join(owned, ["id_situacion", "kind", "codigo"])
        .join(listed, ["comunidad", "kind", "codigo"])
        .where((F.coalesce("m", blank).isin("")) | (F.col("m") == F.col("materia")))
        .where(F.col("c").isNull() | (F.col("c") == F.col("curso")))
        .select("id_situacion", "kind", "id_target")
        .distinct()
    )
    return ops.link_changes(old, ops.links(resolved))


@query(
    "code_variants",
    """WITH codes AS (
      SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'CE' || k WHEN hour(ts) < 12 THEN 'c.e. ' || k
             WHEN hour(ts) < 18 THEN ' ' || k || ' ' ELSE k || '. ' || k END AS code
      FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))
    SELECT event_id, CASE WHEN regexp_matches(code, '^CE') THEN code || '|' || substr(code, 3)
      WHEN regexp_matches(code, '^c') THEN code || '|' || substr(code, 6) || '|' || replace(code, ' ', '')
      WHEN regexp_matches(code, '^ ') THEN trim(code) || '|CE' || trim(code)
      ELSE code || '|CE' || code || '|' || replace(code, ' ', '') END AS variantes FROM codes""",
)
def code_variants_of_events(spark, sf_dir):
    k, hour = F.get_json_object("props", "$.k"), F.hour("ts")
    code = (
        F.when(hour < 6, F.concat(F.lit("CE"), k))
        .when(hour < 12, F.concat(F.lit("c.e. "), k))
        .when(hour < 18, F.concat(F.lit(" "), k, F.lit(" ")))
        .otherwise(F.concat(k, F.lit(". "), k))
    )
    rows = read(spark, sf_dir, "events", "event_id", "ts", "props")
    return rows.select("event_id", F.array_join(code_variants(code), "|").alias("variantes"))


@query(
    "criterion_competence",
    f"""WITH {CATALOGUE_SQL},
    criteria AS (SELECT id, comunidad, materia, CAST(CAST(codigo AS INTEGER) - 15 AS VARCHAR) AS padre FROM cat WHERE kind = 'criterios')
    SELECT k.id, coalesce(min(c.codigo), '?') AS competencia FROM criteria k LEFT JOIN cat c
      ON c.kind = 'competencias' AND c.comunidad = k.comunidad AND c.codigo = k.padre AND c.materia = k.materia
    GROUP BY k.id""",
)
def criterion_competence(spark, sf_dir):
    """Competence code of each criterion, ``?`` when the filtered set lacks it."""
    rows = catalogue(spark, sf_dir)
    competences = rows.where(F.col("kind") == "competencias").select(
        "comunidad", "materia", F.col("codigo").alias("padre")
    ).where(F.col("materia").isNotNull()).distinct().withColumn("competencia", F.col("padre"))
    criteria = rows.where(F.col("kind") == "criterios").select(
        "id", "comunidad", "materia", (F.col("codigo").cast("int") - 15).cast("string").alias("padre")
    )
    return criteria.join(competences, ["comunidad", "materia", "padre"], "left").select(
        "id", F.coalesce("competencia", F.lit("?")).alias("competencia")
    )


# Every event as a document whose content is JSON citing codes in mixed forms.
_CONTENT_SQL = """
content AS (
  SELECT event_id AS id_situacion, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events)
"""


def event_contents(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = spread_by_values(read(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props"))
    content = F.concat(
        F.lit('{"descripcion":{"texto":"'), "event_type", F.lit('"},"conexion_curricular":{"competencias":['),
        F.lit('{"codigo":"CE'), k, F.lit('","justificacion":"'), "event_type", F.lit('"},"'), k,
        F.lit('",{"codigo":null},7],"criterios":[{"codigo":"'), k, F.lit('.1","competencia":"CE'), k,
        F.lit('"}],"saberes":"A.1"}}'),
    )
    return rows.select(
        F.col("event_id").alias("id_situacion"), "event_type", "user_id", k.alias("k"), content.alias("contenido")
    )


@query(
    "cited_codes",
    f"""WITH {_CONTENT_SQL}
    SELECT id_situacion, 'competencias' AS kind, 'CE' || k AS codigo, CAST(0 AS BIGINT) AS pos FROM content
    UNION ALL SELECT id_situacion, 'competencias', k, 1 FROM content
    UNION ALL SELECT id_situacion, 'criterios', k || '.1', 0 FROM content""",
)
def cited_codes(spark, sf_dir):
    return ops.citations_of(event_contents(spark, sf_dir))


def _linked(spark, sf_dir):
    docs = event_contents(spark, sf_dir).select(
        "id_situacion", "contenido",
        F.concat(F.lit("Brand#"), F.col("user_id") % 25 + 1).alias("comunidad"),
        F.lit("PROMO").alias("materia"), F.lit("1º ESO").alias("curso"),
    )
    return ops.rebuild_links(docs, catalogue(spark, sf_dir))


_LINKED_SQL = f"""
WITH {CATALOGUE_SQL}, {_CONTENT_SQL},
found AS (
  SELECT c.id_situacion, c.k, c.event_type, (SELECT min(id) FROM cat WHERE cat.kind = 'competencias'
    AND cat.comunidad = 'Brand#' || (1 + c.user_id % 25) AND cat.codigo = c.k
    AND (cat.materia = 'PROMO' OR cat.materia IS NULL) AND (cat.curso = '1º ESO' OR cat.curso IS NULL)) AS id
  FROM content c)
"""


@query(
    "rebuild_links",
    _LINKED_SQL
    + """SELECT id_situacion, 'competencias' AS kind, id AS id_target FROM found WHERE id IS NOT NULL""",
)
def rebuild_links(spark, sf_dir):
    return _linked(spark, sf_dir)["links"]


@query(
    "link_summary",
    _LINKED_SQL
    + """SELECT f.id_situacion, CASE WHEN id IS NULL THEN CAST(0 AS BIGINT) ELSE 1 END AS competencias,
      CASE WHEN id IS NULL THEN CAST(3 AS BIGINT) ELSE 2 END AS huerfanos,
      CASE WHEN EXISTS (SELECT 1 FROM cat WHERE cat.materia = 'PROMO' AND (cat.curso IS NULL OR cat.curso = '1º ESO')
                        AND cat.comunidad = 'Brand#' || (1 + c.user_id % 25))
           THEN 'inventados' ELSE 'sin_curriculo' END AS causa
    FROM found f JOIN content c ON c.id_situacion = f.id_situacion""",
)
def link_summary(spark, sf_dir):
    return _linked(spark, sf_dir)["summary"].select("id_situacion", "competencias", "huerfanos", "causa")


@query(
    "rewrite_codes",
    _LINKED_SQL
    + """SELECT id_situacion, id IS NOT NULL AS cambiado, CASE WHEN id IS NULL THEN '' ELSE 'CE' || k END AS codigos_normalizados,
      CASE WHEN id IS NULL THEN 'CE' || k ELSE k END AS primera, CASE WHEN id IS NULL THEN 'CE' || k ELSE k END AS padre,
      event_type AS justificacion, event_type AS texto FROM found""",
)
def rewrite_codes(spark, sf_dir):
    out = _linked(spark, sf_dir)["documents"]
    return out.select(
        "id_situacion", "cambiado",
        F.array_join("codigos_normalizados", ",").alias("codigos_normalizados"),
        F.get_json_object("contenido", "$.conexion_curricular.competencias[0].codigo").alias("primera"),
        F.get_json_object("contenido", "$.conexion_curricular.criterios[0].competencia").alias("padre"),
        F.get_json_object("contenido", "$.conexion_curricular.competencias[0].justificacion").alias("justificacion"),
        F.get_json_object("contenido", "$.descripcion.texto").alias("texto"),
    )


def _event_documents(spark, sf_dir):
    return event_contents(spark, sf_dir).select(
        "id_situacion", F.col("user_id").alias("id_usuario"), "contenido", "k", F.concat(F.lit("Brand#"), F.col("user_id") % 25 + 1).alias("comunidad"),
        F.when(F.col("id_situacion") % 3 == 0, "VIEJA").otherwise("PROMO").alias("materia"), F.lit("1º ESO").alias("curso"),
        (F.col("id_situacion") % 3 != 0).alias("con_curriculo"),
    )


@query(
    "relinked_after_reassignment",
    _LINKED_SQL + """SELECT id_situacion, 'competencias' AS kind, id AS id_target FROM found WHERE id IS NOT NULL""",
)
def relinked_after_reassignment(spark, sf_dir):
    """A third of all documents moved to another subject; their links alone are found anew, and equal a full rebuild."""
    docs, rows = _event_documents(spark, sf_dir), catalogue(spark, sf_dir)
    old = ops.rebuild_links(docs.drop("k"), rows)["links"]
    none = docs.select("id_situacion", F.lit(1).alias("numero_version")).where(F.lit(False))
    rules = [("VIEJA", "1º ESO", "PROMO", "1º ESO")]
    return reassignment_job(docs.drop("k"), none, width_bucket("id_situacion"), rules=rules, links=old, catalogue=rows)["links"]


@query(
    "relinked_after_proposals",
    f"""WITH {CATALOGUE_SQL}, {_CONTENT_SQL}, n AS (SELECT id_situacion, user_id, CAST(CAST(k AS INTEGER) + CASE WHEN id_situacion % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS k FROM content),
    l AS (SELECT id_situacion, (SELECT min(id) FROM cat WHERE cat.kind = 'competencias' AND cat.comunidad = 'Brand#' || (1 + n.user_id % 25) AND cat.codigo = n.k
      AND (cat.materia = 'PROMO' OR cat.materia IS NULL) AND (cat.curso = '1º ESO' OR cat.curso IS NULL)) AS id FROM n)
    SELECT id_situacion, 'competencias' AS kind, id AS id_target FROM l WHERE id IS NOT NULL""",
)
def relinked_after_proposals(spark, sf_dir):
    """Half of all documents take the other text of their citing section, and its links with it."""
    rows = catalogue(spark, sf_dir)
    code = lambda n: F.concat(F.lit('{"competencias":["CE'), (F.col("k").cast("int") + n).cast("string"), F.lit('"]'))
    text = F.concat(F.lit('{"conexion_curricular":'), code(0), F.lit(',"_alternativa":'), code(1), F.lit("}}}"))
    docs = _event_documents(spark, sf_dir).withColumns({"contenido": text, "materia": F.lit("PROMO")}).drop("k", "con_curriculo")
    old = ops.rebuild_links(docs, rows)["links"]
    picks = docs.select("id_situacion", F.lit("conexion_curricular").alias("seccion"), F.when(F.col("id_situacion") % 2 == 0, "alternativa").otherwise("actual").alias("cual"))
    none = docs.select("id_situacion", F.lit(1).alias("numero_version")).where(F.lit(False))
    return resolve_proposals(docs, picks, none, width_bucket("id_situacion"), old, rows)["links"]
