"""Regions, reassignment, subject splits and provider choices."""

from pyspark.sql import functions as F

from ..functions import regions as geo
from ..operators import providers as prov
from ..operators import relabel as ops

from ..operators.ordered import width_bucket
from ..sources.tables import cut_lineage
from .registry import query, read


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_PROVINCES = geo.PROVINCES
_GEO_SQL = f"""
prov(codigo, nombre, region) AS (VALUES {_values(_PROVINCES)}),
prov_alias(texto, codigo) AS (VALUES {_values(geo.PROVINCE_ALIASES.items())}),
reg(codigo, nombre) AS (VALUES {_values(geo.REGIONS.items())}),
reg_alias(texto, codigo) AS (VALUES {_values(geo.REGION_ALIASES.items())})
"""

# Customers write a province or a region in one of five ways.
_PLACES_SQL = """
p AS (SELECT nombre, codigo, row_number() OVER (ORDER BY codigo) - 1 AS i FROM prov),
r AS (SELECT nombre, codigo, row_number() OVER (ORDER BY codigo) - 1 AS i FROM reg),
w AS (SELECT c_custkey AS id_usuario, CASE c_mktsegment WHEN 'BUILDING' THEN upper(p.nombre) WHEN 'MACHINERY' THEN '  ' || p.codigo || ' '
        WHEN 'FURNITURE' THEN strip_accents(p.nombre) WHEN 'HOUSEHOLD' THEN NULL ELSE 'Provincia ' || c_custkey END AS provincia_texto,
        CASE WHEN c_acctbal < 0 THEN 'Atlántida' WHEN c_acctbal < 3000 THEN lower(r.nombre) WHEN c_acctbal < 6000 THEN replace(r.codigo, '-', ' ')
             ELSE 'Comunidad de Madrid' END AS region_texto
      FROM customer JOIN p ON p.i = c_custkey % 52 JOIN r ON r.i = c_custkey % 19),
k AS (SELECT *, strip_accents(lower(trim(provincia_texto))) AS pk, strip_accents(lower(trim(region_texto))) AS rk FROM w),
s AS (SELECT k.*, coalesce(p1.codigo, a1.codigo, p2.codigo, a2.codigo, p3.codigo) AS provincia,
        coalesce(r1.codigo, b1.codigo, r2.codigo, b2.codigo, r3.codigo) AS region
      FROM k LEFT JOIN prov p1 ON p1.codigo = pk LEFT JOIN prov_alias a1 ON a1.texto = pk
      LEFT JOIN prov p2 ON p2.codigo = replace(replace(pk, ' ', '-'), '/', '-') LEFT JOIN prov_alias a2 ON a2.texto = replace(replace(pk, ' ', '-'), '/', '-')
      LEFT JOIN prov p3 ON strip_accents(lower(p3.nombre)) = pk
      LEFT JOIN reg r1 ON r1.codigo = rk LEFT JOIN reg_alias b1 ON b1.texto = rk LEFT JOIN reg r2 ON r2.codigo = replace(rk, ' ', '-')
      LEFT JOIN reg_alias b2 ON b2.texto = replace(rk, ' ', '-') LEFT JOIN reg r3 ON strip_accents(lower(r3.nombre)) = rk)
"""


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def _written(spark, sf_dir):
    provinces = sorted((c, n) for c, n, _ in _PROVINCES)
    regions = sorted(geo.REGIONS.items())
    c = read(spark, sf_dir, "customer")
    key, seg, bal = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    name = _pick([n for _, n in provinces], key % 52)
    code = _pick([x for x, _ in provinces], key % 52)
    plain = F.translate(name, "áéíóúèòÁÉÍÓÚÑñ", "aeioueoAEIOUNn")
    return c.select(
        key.alias("id_usuario"),
        F.when(seg == "BUILDING", F.upper(name)).when(seg == "MACHINERY", F.concat(F.lit("  "), code, F.lit(" ")))
        .when(seg == "FURNITURE", plain).when(seg == "HOUSEHOLD", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Provincia "), key)).alias("provincia"),
        F.when(bal < 0, "Atlántida").when(bal < 3000, F.lower(_pick([n for _, n in regions], key % 19)))
        .when(bal < 6000, F.translate(_pick([x for x, _ in regions], key % 19), "-", " "))
        .otherwise(F.lit("Comunidad de Madrid")).alias("comunidad_autonoma"),
    )


@query("normalise_region", f"WITH {_GEO_SQL}, {_PLACES_SQL} SELECT id_usuario, provincia AS codigo_provincia, region AS codigo_region FROM s")
def normalise_region(spark, sf_dir):
    rows = geo.region_code(geo.province_code(_written(spark, sf_dir), "provincia"), "comunidad_autonoma", "codigo_region")
    return rows.select("id_usuario", "codigo_provincia", "codigo_region")


@query(
    "row_region",
    f"""WITH {_GEO_SQL}, {_PLACES_SQL} SELECT id_usuario, coalesce(p.region, s.region) AS comunidad FROM s LEFT JOIN prov p ON p.codigo = s.provincia""",
)
def row_region(spark, sf_dir):
    return geo.row_region(_written(spark, sf_dir)).select("id_usuario", "comunidad")


@query(
    "set_province",
    f"""WITH {_GEO_SQL}, {_PLACES_SQL} SELECT id_usuario, s.provincia, reg.nombre AS comunidad_autonoma FROM s
        LEFT JOIN prov p ON p.codigo = s.provincia LEFT JOIN reg ON reg.codigo = p.region""",
)
def set_province(spark, sf_dir):
    rows = _written(spark, sf_dir).withColumnRenamed("provincia", "escrita")
    return geo.set_province(rows, "escrita").select("id_usuario", "provincia", "comunidad_autonoma")


@query(
    "backfill_region",
    f"""WITH {_GEO_SQL}, {_PLACES_SQL} SELECT id_usuario, coalesce(p.region, 'ceuta') AS comunidad FROM s LEFT JOIN prov p ON p.codigo = s.provincia""",
)
def backfill_region(spark, sf_dir):
    rows = geo.province_code(_written(spark, sf_dir), "provincia", "codigo")
    lookup = geo.province_frame(spark).select(F.col("provincia").alias("codigo"), "comunidad")
    return ops.backfill(rows, lookup, ["codigo"], "comunidad", geo.DEFAULT_REGION).select("id_usuario", "comunidad")


@query(
    "backfill_check",
    f"""WITH {_GEO_SQL}, {_PLACES_SQL} SELECT count(*) FILTER (provincia IS NULL) AS vacias, count(*) AS filas FROM s""",
)
def backfill_check(spark, sf_dir):
    return ops.still_null(geo.province_code(_written(spark, sf_dir), "provincia"), "codigo_provincia")


@query(
    "regional_provinces",
    f"""WITH {_GEO_SQL}, {_PLACES_SQL}, l AS (SELECT DISTINCT region FROM s)
    SELECT r.codigo AS comunidad, EXISTS (SELECT 1 FROM l WHERE l.region = r.codigo) AS con_curriculo, string_agg(p.codigo, ',' ORDER BY p.codigo) AS provincias
    FROM reg r JOIN prov p ON p.region = r.codigo GROUP BY r.codigo""",
)
def regional_provinces(spark, sf_dir):
    from ..operators.coverage import provinces_with_catalogue

    loaded = geo.region_code(_written(spark, sf_dir), "comunidad_autonoma").select("comunidad")
    rows = provinces_with_catalogue(geo.province_frame(spark).select("comunidad", "provincia"), loaded)
    return rows.select("comunidad", "con_curriculo", F.array_join("provincias", ",").alias("provincias"))


# ---------------------------------------------------------------------------
# Reassignment: years and subjects by priority and status.
# ---------------------------------------------------------------------------
_OLD_SQL = """
o AS (SELECT o_orderkey AS id_situacion, CASE o_orderstatus WHEN 'F' THEN 'Lengua Castellana y Literatura' WHEN 'O' THEN 'Matemáticas' ELSE 'Tecnología y Digitalización' END AS materia,
        CASE WHEN o_orderpriority = '5-LOW' THEN '5º' ELSE left(o_orderpriority, 1) || 'º ESO' END AS curso, o_totalprice > 300000 AS con_curriculo FROM orders),
m AS (SELECT *, CASE WHEN con_curriculo OR curso = '5º' THEN NULL WHEN materia LIKE 'Lengua%' THEN 'Lengua' WHEN curso <> '4º ESO' THEN NULL
        WHEN materia = 'Matemáticas' THEN 'Matemáticas B' ELSE 'Tecnología' END AS nueva FROM o)
"""


def _old_pairs(spark, sf_dir):
    status, level = F.col("o_orderstatus"), F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_situacion"),
        F.when(status == "F", "Lengua Castellana y Literatura").when(status == "O", "Matemáticas").otherwise(F.lit("Tecnología y Digitalización")).alias("materia"),
        F.when(level == "5-LOW", "5º").otherwise(F.concat(F.substring(level, 1, 1), F.lit("º ESO"))).alias("curso"),
        (F.col("o_totalprice") > 300000).alias("con_curriculo"),
    )


@query("reassign_pairs", f"WITH {_OLD_SQL} SELECT id_situacion, coalesce(nueva, materia) AS materia, curso FROM m")
def reassign_pairs(spark, sf_dir):
    none = _old_pairs(spark, sf_dir).select("id_situacion", F.lit(1).alias("numero_version")).where(F.lit(False))
    out = ops.reassignment_job(_old_pairs(spark, sf_dir), none, width_bucket("id_situacion"), "B")
    return out["documents"].select("id_situacion", "materia", "curso")


@query("reassign_versions", f"WITH {_OLD_SQL} SELECT id_situacion, CAST(1 AS BIGINT) AS numero_version, materia AS antes FROM m WHERE nueva IS NOT NULL")
def reassign_versions(spark, sf_dir):
    none = _old_pairs(spark, sf_dir).select("id_situacion", F.lit(1).alias("numero_version")).where(F.lit(False))
    out = ops.reassignment_job(_old_pairs(spark, sf_dir), none, width_bucket("id_situacion"), "B")["versions"]
    return out.select("id_situacion", "numero_version", F.get_json_object("contenido", "$.materia").alias("antes"))


@query("reassign_unmatched", f"WITH {_OLD_SQL} SELECT id_situacion, materia, curso FROM m WHERE nueva IS NULL AND NOT con_curriculo")
def reassign_unmatched(spark, sf_dir):
    out = ops.reassign(_old_pairs(spark, sf_dir), track="B")["unmatched"]
    return out.select("id_situacion", "materia", "curso")


# ---------------------------------------------------------------------------
# Split: suppliers as competences, parts as criteria, customers as links.
# ---------------------------------------------------------------------------
_SPLIT_SQL = """
comp AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey < 20 THEN 'Tecnología' ELSE 'Otra' END AS materia, s_name AS codigo FROM supplier),
crit AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN '4º ESO' ELSE '2º ESO' END AS curso FROM lineitem),
placed AS (SELECT crit.*, CASE WHEN comp.materia = 'Tecnología' AND curso <> '4º ESO' THEN 'Tecnología y Digitalización' ELSE comp.materia END AS materia, comp.materia AS vieja
           FROM crit JOIN comp ON comp.id = crit.id),
linked AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
"""


def _split_tables(spark, sf_dir):
    sup = read(spark, sf_dir, "supplier")
    label = F.when(F.col("s_nationkey") < 20, "Tecnología").otherwise(F.lit("Otra"))
    years = F.array(F.lit("2º ESO"), F.lit("3º ESO"), F.lit("4º ESO"))
    comp = sup.select(
        F.col("s_suppkey").alias("id_competencia"), F.col("s_name").alias("codigo"), F.lit("ceuta").alias("comunidad"),
        label.alias("materia"), years.alias("cursos_aplicables"),
    )
    owner = sup.select(F.col("s_suppkey").alias("id_competencia"), label.alias("materia"))
    crit = (read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id_criterio"), F.col("l_suppkey").alias("id_competencia"),
            F.array(F.when(F.col("l_returnflag") == "A", "4º ESO").otherwise(F.lit("2º ESO"))).alias("cursos_aplicables"),
        )).join(owner, ["id_competencia"], "inner")
    linked = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("id_competencia"), F.col("c_custkey").alias("id_situacion")
    )
    documents = _old_pairs(spark, sf_dir).select(
        "id_situacion", F.when(F.col("materia") == "Matemáticas", "Tecnología").otherwise(F.col("materia")).alias("materia"), "curso"
    )
    items = crit.select("id_criterio", "materia", "cursos_aplicables")
    return {"competencias": comp, "criterios": crit, "saberes": items, "enlaces": linked, "situaciones": documents}


def _split(spark, sf_dir):
    return ops.split_subject(
        _split_tables(spark, sf_dir), "Tecnología", "Tecnología y Digitalización", "4º ESO", ["2º ESO", "3º ESO"]
    )


@query(
    "split_subject",
    f"""WITH {_SPLIT_SQL} SELECT codigo, 'Tecnología y Digitalización' AS materia, '2º ESO,3º ESO' AS cursos FROM comp WHERE materia = 'Tecnología'
    UNION ALL SELECT codigo, materia, '2º ESO,3º ESO,4º ESO' FROM comp WHERE materia <> 'Tecnología'
    UNION ALL SELECT codigo, materia, '4º ESO' FROM comp WHERE materia = 'Tecnología'
      AND (EXISTS (SELECT 1 FROM placed p WHERE p.id = comp.id AND p.materia = 'Tecnología') OR comp.id IN (SELECT id FROM linked))""",
)
def split_subject(spark, sf_dir):
    out = _split(spark, sf_dir)["competencias"]
    return out.select("codigo", "materia", F.array_join("cursos_aplicables", ",").alias("cursos"))


@query(
    "split_children",
    f"""WITH {_SPLIT_SQL} SELECT p.materia, count(*) AS criterios, CAST(0 AS BIGINT) AS cruzados FROM placed p GROUP BY p.materia""",
)
def split_children(spark, sf_dir):
    """Criteria per subject after a split, and those under another subject."""
    out = _split(spark, sf_dir)
    parents = out["competencias"].select("id_competencia", F.col("materia").alias("del_padre"))
    rows = out["criterios"].join(parents, ["id_competencia"], "left")
    return rows.groupBy("materia").agg(
        F.count(F.lit(1)).alias("criterios"),
        F.count_if(~F.col("materia").eqNullSafe(F.col("del_padre"))).alias("cruzados"),
    )


@query(
    "split_documents",
    f"""WITH {_OLD_SQL}, d AS (SELECT id_situacion, CASE materia WHEN 'Matemáticas' THEN 'Tecnología' ELSE materia END AS materia, curso FROM o)
    SELECT id_situacion, CASE WHEN materia = 'Tecnología' AND curso <> '4º ESO' THEN 'Tecnología y Digitalización' ELSE materia END AS materia FROM d""",
)
def split_documents(spark, sf_dir):
    return _split(spark, sf_dir)["situaciones"].select("id_situacion", "materia")


@query(
    "merge_subjects",
    f"""WITH {_SPLIT_SQL} SELECT codigo, 'Tecnología' AS materia, CASE WHEN EXISTS (SELECT 1 FROM placed p WHERE p.id = comp.id AND p.materia = 'Tecnología')
        OR comp.id IN (SELECT id FROM linked) THEN '4º ESO' ELSE '2º ESO,3º ESO' END AS cursos FROM comp WHERE materia = 'Tecnología'
        AND (EXISTS (SELECT 1 FROM placed p WHERE p.id = comp.id) OR comp.id IN (SELECT id FROM linked))
    UNION ALL SELECT codigo, materia, '2º ESO,3º ESO,4º ESO' FROM comp WHERE materia <> 'Tecnología'""",
)
def merge_subjects(spark, sf_dir):
    split = {name: cut_lineage(rows, name) for name, rows in _split(spark, sf_dir).items()}
    out = ops.merge_subjects(split, "Tecnología", "Tecnología y Digitalización")["competencias"]
    return out.select("codigo", "materia", F.array_join("cursos_aplicables", ",").alias("cursos"))


# ---------------------------------------------------------------------------
# Providers
# ---------------------------------------------------------------------------
_AVAILABLE = [("openai", "m0", True), ("openai", "m1", False), ("gemini", "m2", True)]
_PROVIDER_SQL = """
u AS (SELECT c_custkey AS id_usuario, CASE c_mktsegment WHEN 'BUILDING' THEN ' OpenAI' WHEN 'MACHINERY' THEN 'gemini' WHEN 'FURNITURE' THEN 'otro' END AS proveedor_ia,
        'm' || c_nationkey AS modelo_ia FROM customer),
x AS (SELECT id_usuario, CASE WHEN proveedor_ia = ' OpenAI' THEN 'openai' WHEN proveedor_ia = 'gemini' THEN 'gemini' ELSE 'fake' END AS proveedor,
        CASE WHEN proveedor_ia = ' OpenAI' THEN CASE WHEN modelo_ia IN ('m0', 'm1') THEN modelo_ia ELSE 'm0' END WHEN proveedor_ia = 'gemini' THEN 'm2' ELSE 'fake' END AS modelo,
        coalesce(proveedor_ia = 'otro', false) AS ignorada FROM u)
"""


def _choices(spark, sf_dir):
    seg = F.col("c_mktsegment")
    users = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id_usuario"),
        F.when(seg == "BUILDING", " OpenAI").when(seg == "MACHINERY", "gemini").when(seg == "FURNITURE", "otro").alias("proveedor_ia"),
        F.concat(F.lit("m"), "c_nationkey").alias("modelo_ia"),
    )
    available = spark.createDataFrame(_AVAILABLE, "proveedor string, modelo string, por_defecto boolean")
    documents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id_situacion"), F.col("o_custkey").alias("id_usuario"))
    return documents, users, available


@query(
    "effective_provider",
    f"""WITH {_PROVIDER_SQL} SELECT o_orderkey AS id_situacion, proveedor, modelo, ignorada FROM orders JOIN x ON id_usuario = o_custkey""",
)
def effective_provider(spark, sf_dir):
    out = prov.effective_provider(*_choices(spark, sf_dir), "fake", "fake")
    return out.select("id_situacion", "proveedor", "modelo", "ignorada")


@query(
    "provider_totals",
    f"""WITH {_PROVIDER_SQL} SELECT proveedor, modelo, count(*) AS situaciones, count(*) FILTER (ignorada) AS ignoradas
        FROM orders JOIN x ON id_usuario = o_custkey GROUP BY ALL""",
)
def provider_totals(spark, sf_dir):
    return prov.provider_totals(*_choices(spark, sf_dir), "fake", "fake")
