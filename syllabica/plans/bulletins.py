"""Ordered paragraphs, positioned lines and whole bulletins."""

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import bulletin as B
from ..operators import paragraphs as ops
from ..sources.catalogue_files import file_stem, split_writable
from .frames import LINES_SQL, lines
from .registry import query, read

_SPACE = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{1680}]"


def _joined(c: str) -> str:
    """SQL form of line joining."""
    return (
        f"trim(regexp_replace(regexp_replace({c}, '([\\p{{L}}\\p{{N}}\\p{{M}}_])-{_SPACE}+([\\p{{L}}\\p{{N}}\\p{{M}}_])', "
        f"'\\1\\2', 'g'), '{_SPACE}+', ' ', 'g'))"
    )


@query(
    "carry_forward",
    f"""WITH {LINES_SQL} SELECT doc_id, seq,
        last_value(CASE WHEN size < 60 THEN text END IGNORE NULLS) OVER w AS apartado,
        last_value(CASE WHEN text LIKE '%.' THEN seq END IGNORE NULLS) OVER w AS marca
        FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""",
)
def carry_forward(spark, sf_dir):
    labels = {
        "apartado": F.when(F.col("size") < 60, F.col("text")),
        "marca": F.when(F.col("text").endswith("."), F.col("seq")),
    }
    return ops.carry_forward(lines(spark, sf_dir), labels).select("doc_id", "seq", "apartado", "marca")


@query(
    "glue_lines",
    f"""WITH {LINES_SQL}, m AS (SELECT *, CAST(sum(CAST(size < 60 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS record FROM lines)
    SELECT doc_id, record, min(seq) AS seq, count(*) AS lineas, md5(string_agg(text, ' ' ORDER BY seq)) AS texto FROM m GROUP BY doc_id, record""",
)
def glue_lines(spark, sf_dir):
    out = ops.glue_lines(lines(spark, sf_dir), F.col("size") < 60)
    return out.select("doc_id", "record", "seq", "lineas", F.md5("text").alias("texto"))


@query(
    "glue_to_open_record",
    f"""WITH {LINES_SQL}, m AS (SELECT *, last_value(CASE WHEN size >= 100 THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS orden FROM lines)
    SELECT doc_id, orden, md5({_joined("string_agg(text, ' ' ORDER BY seq)")}) AS texto FROM m WHERE orden IS NOT NULL GROUP BY doc_id, orden""",
)
def glue_to_open_record(spark, sf_dir):
    """Cell preludes glued to the record above them, across cells and pages."""
    rows = lines(spark, sf_dir).withColumnRenamed("seq", "orden")
    records = rows.where("size >= 100").withColumn("codigo", F.col("orden").cast("string"))
    out = ops.glue_to_open_record(rows.where("size < 100"), records, ["doc_id"])
    return out.select("doc_id", "orden", F.md5("text").alias("texto"))


@query(
    "longest_duplicate",
    f"""WITH {LINES_SQL}, k AS (SELECT *, split_part(text, ' ', 1) AS clave, doc_id * 1000000 + seq AS orden FROM lines)
    SELECT clave, md5(arg_max(text, (length(text), -orden))) AS texto, min(orden) AS orden FROM k
        WHERE length(regexp_replace(text, '{_SPACE}+', '', 'g')) > 0 GROUP BY clave""",
)
def longest_duplicate(spark, sf_dir):
    """The longest of the lines that begin with one word."""
    rows = lines(spark, sf_dir).select(
        F.substring_index("text", " ", 1).alias("clave"), "text", (F.col("doc_id") * 1_000_000 + F.col("seq")).alias("orden")
    )
    out = ops.longest_reading(rows, ["clave"], "text", "orden")
    return out.select("clave", F.md5("text").alias("texto"), "orden")


@query(
    "official_items",
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, seq, size % 4 AS m, size, CASE size % 4 WHEN 0 THEN 'BYG.' || (1 + size % 3) || '.A.' || (size % 7) || '. ' || text
          WHEN 1 THEN 'A. Bloque ' || seq ELSE 'x' || text END AS text, text AS resto FROM lines),
    g AS (SELECT *, sum(CAST(m < 2 AS INTEGER)) OVER w AS n, last_value(CASE WHEN m < 2 THEN m END IGNORE NULLS) OVER w AS abre FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    r AS (SELECT doc_id, min(seq) AS seq, arg_min(size, seq) AS size, {_joined("string_agg(CASE WHEN m = 0 THEN resto ELSE text END, ' ' ORDER BY seq)")} AS text FROM g WHERE abre = 0 GROUP BY doc_id, n),
    b AS (SELECT doc_id, 'BYG.' || (1 + size % 3) || '.A.' || (size % 7) AS codigo, CAST(1 + size % 3 AS INTEGER) AS curso, arg_max(text, (length(text), -seq)) AS text, min(seq) AS seq
          FROM r WHERE text <> '' GROUP BY ALL),
    h AS (SELECT doc_id, arg_max('Bloque ' || seq, seq) AS titulo FROM t WHERE m = 1 GROUP BY doc_id)
    SELECT b.doc_id, codigo, curso, coalesce(titulo, 'Bloque A') AS titulo, md5(text) AS texto, seq FROM b LEFT JOIN h ON h.doc_id = b.doc_id""",
)
def official_items(spark, sf_dir):
    """Coded items with their continuations, the longest reading of each."""
    n, text = F.col("size"), F.col("text")
    shown = (
        F.when(n % 4 == 0, F.concat(F.lit("BYG."), n % 3 + 1, F.lit(".A."), n % 7, F.lit(". "), text))
        .when(n % 4 == 1, F.concat(F.lit("A. Bloque "), "seq"))
        .otherwise(F.concat(F.lit("x"), text))
    )
    out = ops.official_items(lines(spark, sf_dir).withColumn("text", shown))
    return out.select("doc_id", "codigo", "curso", "titulo", F.md5("text").alias("texto"), "seq")


@query(
    "collapse_repeats",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
       WHERE p IS NULL OR p <> event_type""",
)
def collapse_repeats(spark, sf_dir):
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("text", F.col("event_type"))
    return ops.collapse_repeats(rows, ["user_id"], "event_id").select("event_id", "user_id", "event_type")


@query(
    "milestone_spans",
    """SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS fin FROM conversations WHERE role = 'user'""",
)
def milestone_spans(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role").where("role = 'user'")
    return ops.spans(rows, ["conv_id"], "turn").select("conv_id", "turn", "fin")


_HEADINGS_SQL = """
heads AS (SELECT DISTINCT event_type, floor(value / 10) * 10 AS x FROM events),
ranges AS (SELECT event_type, (lag(x) OVER w + x) / 2 AS desde, (lead(x) OVER w + x) / 2 AS hasta,
             CAST(row_number() OVER w AS INTEGER) AS columna FROM heads WINDOW w AS (PARTITION BY event_type ORDER BY x))
"""


@query(
    "range_bucket",
    f"""WITH {_HEADINGS_SQL} SELECT e.event_id, r.columna FROM events e JOIN ranges r ON r.event_type = e.event_type
        AND (r.desde IS NULL OR e.value >= r.desde) AND (r.hasta IS NULL OR e.value < r.hasta)""",
)
def range_bucket(spark, sf_dir):
    """Events in the column whose interval holds their value."""
    rows = read(spark, sf_dir, "events", "event_id", "event_type", "value").withColumnRenamed("value", "x")
    heads = rows.select("event_type", (F.floor(F.col("x") / 10) * 10).cast("double").alias("x")).distinct()
    ranges = ops.column_ranges(heads, ["event_type"])
    out = ops.into_columns(rows, ranges, ["event_type"])
    return out.select("event_id", "columna")


@query(
    "lines_in_tables",
    """SELECT l_orderkey, l_linenumber, l_partkey, EXISTS (SELECT 1 FROM region WHERE r_regionkey + 1 = l_linenumber
         AND l_quantity + 1 BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 10 AND l_tax * 100 + 0.5 BETWEEN 0 AND 6) AS en_tabla FROM lineitem""",
)
def lines_in_tables(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("page"),
        q.alias("x0"), (q + 2).alias("x1"), t.alias("y0"), (t + 1).alias("y1"),
    )
    left = F.col("r_regionkey") * 5.0
    boxes = read(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).alias("page"), left.alias("x0"), (left + 10).alias("x1"), F.lit(0.0).alias("y0"), F.lit(6.0).alias("y1")
    )
    out = ops.in_boxes(rows, boxes, ["page"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("in_table").alias("en_tabla"))


def _positioned(spark, sf_dir):
    """Lines with an indent, weight and size read off their length."""
    n = F.col("size")
    return lines(spark, sf_dir).select(
        "doc_id", "seq", "text", (F.lit(60.0) + n % 4 * 5).alias("x"), (n % 3 == 0).alias("bold"),
        (n % 7 + 8).cast("double").alias("size"), (F.floor(F.col("seq") / 5) + 1).cast("int").alias("page"),
        (n % 2 == 0).alias("in_table"), n.alias("largo"),
    )


_POSITIONED_SQL = f"""
{LINES_SQL},
pos AS (SELECT doc_id, seq, text, 60 + size % 4 * 5 AS x, size % 3 = 0 AS bold, size % 7 + 8 AS tam, seq // 5 + 1 AS page,
          size % 2 = 0 AS in_table, size AS largo FROM lines)
"""
_BULLETS = "^[-\\x{2013}\\x{2014}\\x{2212}\\x{00B7}\\x{2022}*\\x{E000}-\\x{F8FF}\\s\\x{00A0}]*$"
_ROLES_SQL = f"""
u AS (SELECT * FROM pos WHERE NOT regexp_matches(text, '{_BULLETS}')),
l1 AS (SELECT doc_id, min(x) AS l1 FROM u GROUP BY doc_id),
l2 AS (SELECT u.doc_id, min(x) AS l2 FROM u JOIN l1 ON l1.doc_id = u.doc_id AND x > l1 + 6 GROUP BY u.doc_id),
l3 AS (SELECT u.doc_id, min(x) AS l3 FROM u JOIN l2 ON l2.doc_id = u.doc_id AND x > l2 + 6 GROUP BY u.doc_id),
r AS (SELECT u.*, l1, l3 IS NOT NULL AS sub, coalesce(l3, l2, l1) AS xi FROM u JOIN l1 USING (doc_id) LEFT JOIN l2 USING (doc_id) LEFT JOIN l3 USING (doc_id)),
roles AS (SELECT *, CASE WHEN x <= l1 + 6 AND bold THEN 'bloque' WHEN sub AND x < xi - 4 THEN 'subbloque'
  WHEN x >= xi - 4 AND NOT regexp_matches(text, '^[A-ZÀ-Ú¡¿0-9]') THEN 'continuacion' WHEN x >= xi - 4 THEN 'item' END AS rol FROM r)
"""


@query(
    "line_roles",
    f"""WITH {_POSITIONED_SQL}, {_ROLES_SQL} SELECT doc_id, seq, rol FROM roles""",
)
def line_roles(spark, sf_dir):
    return ops.line_roles(_positioned(spark, sf_dir)).select("doc_id", "seq", "rol")


@query(
    "knowledge_blocks",
    f"""WITH {_POSITIONED_SQL}, {_ROLES_SQL},
    m AS (SELECT *, regexp_replace(text, '\\.+$', '') AS titulo, CASE WHEN sub THEN rol = 'subbloque' ELSE rol = 'bloque' END AS abre,
            sub AND rol = 'bloque' AS cierra FROM roles WHERE rol IS NOT NULL),
    c AS (SELECT *, sum(CAST(abre AS INTEGER)) OVER w AS bloque_n, sum(CAST(abre OR cierra AS INTEGER)) OVER w AS tramo,
            sum(CAST(rol = 'item' AS INTEGER)) OVER w AS i, last_value(CASE WHEN rol = 'bloque' THEN titulo END IGNORE NULLS) OVER w AS titulo_bloque,
            last_value(CASE WHEN abre OR cierra THEN titulo END IGNORE NULLS) OVER w AS abierto,
            last_value(CASE WHEN abre THEN true WHEN cierra THEN false END IGNORE NULLS) OVER w AS si
          FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
    SELECT doc_id, CAST(bloque_n AS BIGINT) AS bloque_n, CASE WHEN sub AND titulo_bloque IS NOT NULL THEN titulo_bloque || ' · ' || abierto ELSE abierto END AS bloque,
      min(seq) AS seq, string_agg(text, ' ' ORDER BY seq) AS text
    FROM c WHERE si AND rol IN ('item', 'continuacion') GROUP BY doc_id, bloque_n, tramo, 3, i""",
)
def knowledge_blocks(spark, sf_dir):
    return ops.knowledge_blocks(_positioned(spark, sf_dir)).select("doc_id", "bloque_n", "bloque", "seq", "text")


@query(
    "column_boundary",
    f"""WITH {_POSITIONED_SQL}, xs AS (SELECT DISTINCT doc_id, CAST(largo AS DOUBLE) AS x FROM pos),
    g AS (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS p FROM xs),
    b AS (SELECT doc_id, max(x - p) AS hueco, arg_max((x + p) / 2, (x - p, -x)) AS corte FROM g WHERE p IS NOT NULL GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN hueco >= 100 THEN corte END AS frontera FROM (SELECT DISTINCT doc_id FROM pos) d LEFT JOIN b ON b.doc_id = d.doc_id""",
)
def column_boundary(spark, sf_dir):
    rows = _positioned(spark, sf_dir).withColumn("x", F.col("largo").cast("double"))
    return ops.column_boundary(rows)


@query(
    "cover_titles",
    f"""WITH {_POSITIONED_SQL}, f AS (SELECT * FROM pos WHERE page = 1)
    SELECT doc_id, seq FROM f WHERE tam >= (SELECT max(tam) FROM f g WHERE g.doc_id = f.doc_id) - 0.1 AND length(text) > 3""",
)
def cover_titles(spark, sf_dir):
    return ops.cover_titles(_positioned(spark, sf_dir)).select("doc_id", "seq")


@query(
    "subject_titles",
    f"""WITH {_POSITIONED_SQL} SELECT doc_id, seq FROM pos WHERE bold AND x + 90 >= 150 AND largo <= 70 AND NOT in_table
      AND NOT regexp_matches(text, '^[A-Z]{{2,4}}\\.\\d\\.[A-Z]\\.\\d+\\.?\\s*') AND NOT regexp_matches(text, '^[A-Z]\\.\\s+.+')
      AND trim(regexp_replace(strip_accents(lower(trim(text))), '[^a-z0-9 ]+', '', 'g')) NOT IN ('primer curso', 'segundo curso', 'tercer curso',
        'cuarto curso', 'anexo ii', 'anexo iii', 'saberes', 'basicos')""",
)
def subject_titles(spark, sf_dir):
    rows = _positioned(spark, sf_dir).withColumn("x", F.col("x") + 90)
    return rows.where(ops.is_subject_title()).select("doc_id", "seq")


@query(
    "noise_filter",
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, seq, CASE WHEN size % 11 = 0 THEN 'página 3/9' WHEN size % 11 = 1 THEN 'Saberes básicos.'
         WHEN size % 11 = 2 THEN 'BOJA' ELSE text END AS text, size % 11 AS m FROM lines)
    SELECT doc_id, seq FROM t WHERE m > 2 AND NOT regexp_matches(text, '^([0-9]{{8}}$|https?://)')""",
)
def noise_filter(spark, sf_dir):
    m = F.col("size") % 11
    shown = (
        F.when(m == 0, "página 3/9").when(m == 1, "Saberes básicos.").when(m == 2, "BOJA").otherwise(F.col("text"))
    )
    return ops.without_noise(lines(spark, sf_dir).withColumn("text", shown)).select("doc_id", "seq")


@query(
    "mixed_columns",
    """SELECT source AS doc_id, lang AS columna, count(DISTINCT n_chars % 2) AS cursos FROM documents GROUP BY source, lang
       HAVING count(DISTINCT n_chars % 2) > 1""",
)
def mixed_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "source", "lang", "n_chars").select(
        F.col("source").alias("doc_id"), F.col("lang").alias("columna"), (F.col("n_chars") % 2).alias("curso")
    )
    return ops.mixed_columns(rows)


@query(
    "table_kinds",
    """SELECT conv_id AS doc_id, CAST(max(turn % 6 + 1) AS INTEGER) AS columnas, bool_or(role = 'assistant') AS con_criterio,
        max(turn % 6 + 1) >= 3 AND max(turn % 6 + 1) % 2 = 1 AND bool_or(role = 'assistant') AS es_de_criterios FROM conversations GROUP BY conv_id""",
)
def table_kinds(spark, sf_dir):
    """Tables told apart by width and by holding a criterion-shaped line."""
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("Cabecera\n1.1. "), "text")).otherwise(F.regexp_replace("text", "[0-9]", ""))
    cells = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"),
        (F.col("turn") % 6 + 1).cast("int").alias("n_cols"), text.alias("text"),
    )
    return ops.table_kinds(cells).select("doc_id", "columnas", "con_criterio", "es_de_criterios")


@query(
    "criteria_by_year",
    f"""WITH {LINES_SQL}, c AS (SELECT *, (size % 3 + 1) || '.1' AS codigo, CASE size % 5 WHEN 0 THEN [] WHEN 1 THEN [1, 3] ELSE [2] END AS cursos FROM lines),
    p AS (SELECT *, list_distinct(flatten(list(cursos) OVER (PARTITION BY doc_id, codigo ORDER BY seq))) AS vistos FROM c),
    r AS (SELECT doc_id, codigo, unnest(CASE WHEN len(cursos) > 0 THEN cursos ELSE vistos END) AS curso, seq, text FROM p)
    SELECT doc_id, codigo, curso, min(seq) AS seq, md5({_joined("string_agg(text, ' ' ORDER BY seq)")}) AS texto FROM r GROUP BY doc_id, codigo, curso""",
)
def criteria_by_year(spark, sf_dir):
    """Years from the codes cited beside a criterion, else those seen before."""
    n = F.col("size") % 5
    cited = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, "GE\nH.3.A.2. BYG.1.A.8").otherwise(F.lit("MAT.2.D.6."))
    rows = lines(spark, sf_dir)
    cells = rows.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.col("seq").alias("row"), F.lit(1).alias("col"), "text", "size")
    beside = rows.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.col("seq").alias("row"), F.lit(2).alias("col"), cited.alias("text"), "size")
    criteria = ops.neighbour_years(cells.unionByName(beside)).select(
        "doc_id", F.col("row").alias("seq"), F.concat(F.col("size") % 3 + 1, F.lit(".1")).alias("codigo"), "cursos", "text"
    )
    out = ops.criteria_by_year(criteria)
    return out.select("doc_id", "codigo", "curso", "seq", F.md5("text").alias("texto"))


@query(
    "majority_prefix",
    """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_partkey, l_returnflag || l_linestatus || 'X' AS prefix FROM lineitem),
    n AS (SELECT doc_id, prefix, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT doc_id, arg_min(prefix, (-n, prefix)) AS prefix FROM n GROUP BY doc_id)
    SELECT c.doc_id, c.seq, c.prefix || '.' || c.seq || '.A.' || c.l_partkey AS codigo, c.prefix FROM c JOIN b ON b.doc_id = c.doc_id AND b.prefix = c.prefix""",
)
def majority_prefix(spark, sf_dir):
    """Item codes of an order whose prefix is the order's commonest."""
    code = F.concat("l_returnflag", "l_linestatus", F.lit("X."), "l_linenumber", F.lit(".A."), "l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), code.alias("codigo"))
    coded = rows.withColumn("prefix", C.parse_official_item(F.col("codigo"))["prefix"])
    return ops.majority_prefix(coded).select("doc_id", "seq", "codigo", "prefix")


@query(
    "gather_by_years",
    f"""WITH {LINES_SQL}, p AS (SELECT l.doc_id, l.seq, CASE WHEN size % 4 = 0 THEN '1º ESO,3º ESO' WHEN size % 4 = 1 THEN '2º ESO'
          WHEN lang = 'fr' THEN '4º ESO' ELSE '' END AS grupo FROM lines l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT doc_id, grupo, count(*) AS criterios, grupo = '' AS sin_cursos FROM p GROUP BY doc_id, grupo""",
)
def gather_by_years(spark, sf_dir):
    none = F.array().cast("array<string>")
    m = F.col("size") % 4
    cursos = F.when(m == 0, F.array(F.lit("3º ESO"), F.lit("1º ESO"))).when(m == 1, F.array(F.lit("2º ESO"))).otherwise(none)
    title = F.concat(F.lit("Matèria optativa de "), F.when(F.col("lang") == "fr", "quart").otherwise(F.lit("ningú")))
    titles = read(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", C.title_years_ca(title).alias("cursos"))
    parts = ops.gather_by_years(lines(spark, sf_dir).withColumn("cursos", cursos), titles)
    both = parts["rows"].withColumn("sin_cursos", F.lit(False)).unionByName(parts["sin_cursos"].withColumn("sin_cursos", F.lit(True)))
    return both.groupBy("doc_id", "grupo", "sin_cursos").agg(F.count(F.lit(1)).alias("criterios"))


@query(
    "missing_years_by_name",
    """WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size > 25)
    SELECT p_partkey, CASE WHEN p_size <= 10 THEN '1º ESO' WHEN p_name IN (SELECT p_name FROM a) THEN '2º ESO,3º ESO' ELSE '' END AS cursos FROM part""",
)
def missing_years_by_name(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    none = F.array().cast("array<string>")
    blocks = part.select(
        "p_partkey", F.upper("p_name").alias("materia"), F.when(F.col("p_size") <= 10, F.array(F.lit("1º ESO"))).otherwise(none).alias("cursos")
    )
    articles = part.where("p_size > 25").select(
        F.concat(F.regexp_replace("p_name", "i", "í"), F.lit(".")).alias("materia"), F.array(F.lit("2º ESO"), F.lit("3º ESO")).alias("cursos")
    ).distinct()
    return ops.missing_years_by_name(blocks, articles).select("p_partkey", F.array_join("cursos", ",").alias("cursos"))


@query(
    "shared_curriculum",
    """SELECT a.p_brand AS doc_id, titulo, grupo FROM (SELECT DISTINCT p_brand, p_type AS titulo FROM part) a
       JOIN (SELECT DISTINCT p_brand, p_size AS grupo FROM part) b ON a.p_brand = b.p_brand""",
)
def shared_curriculum(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_brand", "p_type", "p_size").withColumnRenamed("p_brand", "doc_id")
    return ops.shared_curriculum(part.withColumnRenamed("p_type", "titulo"), part.withColumnRenamed("p_size", "grupo"))


@query(
    "fallback_rows",
    """SELECT o_orderkey AS seq, o_custkey AS materia, 'seccion' AS origen FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'
       UNION ALL SELECT o_orderkey, o_custkey, 'tabla' FROM orders WHERE o_orderstatus = 'O'
         AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH')""",
)
def fallback_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("materia"), "o_orderstatus", "o_orderpriority"
    )
    sections = o.where("o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'").select("seq", "materia")
    return ops.fallback_rows(sections, o.where("o_orderstatus = 'O'").select("seq", "materia"), ["materia"])


@query(
    "concatenate_parts",
    """WITH p(lang, parte, desde, hasta) AS (VALUES ('fr', 1, 0, NULL), ('es', 2, 1, NULL), ('de', 3, 0, 5))
    SELECT doc_id AS seq_origen, d.lang AS doc_id, row_number() OVER (ORDER BY parte, doc_id // 100, doc_id) - 1 AS seq
    FROM documents d JOIN p ON p.lang = d.lang AND doc_id // 100 >= desde AND (hasta IS NULL OR doc_id // 100 < hasta)""",
)
def concatenate_parts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "doc_id", "lang").select(
        F.col("lang").alias("doc_id"), F.floor(F.col("doc_id") / 100).cast("int").alias("page"), F.col("doc_id").alias("seq")
    )
    parts = spark.createDataFrame(
        [("fr", 1, 0, None), ("es", 2, 1, None), ("de", 3, 0, 5)], "doc_id string, parte int, desde int, hasta int"
    )
    return ops.concatenate_parts(rows, parts).select("seq_origen", "doc_id", "seq")


@query(
    "longest_match",
    """WITH r AS (SELECT p_partkey, upper(p_name) AS r0 FROM part), a AS (SELECT *, replace(r0, 'RED WIDGET', ' ') AS r1 FROM r),
    b AS (SELECT *, replace(r1, 'SMALL RING', ' ') AS r2 FROM a), c AS (SELECT *, replace(r2, 'WIDGET', ' ') AS r3 FROM b),
    d AS (SELECT *, replace(r3, 'BOLT', ' ') AS r4 FROM c), e AS (SELECT *, replace(r4, 'RING', ' ') AS r5 FROM d)
    SELECT p_partkey, 'red widget' AS materia FROM e WHERE contains(r0, 'RED WIDGET')
    UNION ALL SELECT p_partkey, 'small ring' FROM e WHERE contains(r1, 'SMALL RING') UNION ALL SELECT p_partkey, 'widget' FROM e WHERE contains(r2, 'WIDGET')
    UNION ALL SELECT p_partkey, 'bolt' FROM e WHERE contains(r3, 'BOLT') UNION ALL SELECT p_partkey, 'ring' FROM e WHERE contains(r4, 'RING')
    UNION ALL SELECT p_partkey, 'red' FROM e WHERE contains(r5, 'RED')""",
)
def longest_match(spark, sf_dir):
    names = ["red", "ring", "bolt", "widget", "small ring", "red widget"]
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name")
    return ops.longest_matches(rows, names, "p_name").select("p_partkey", "materia")


@query(
    "article_counters",
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, seq, CASE WHEN size % 7 = 0 THEN 'Artículo ' || (size % 9) || '. Título'
          WHEN size % 5 = 0 THEN (size % 4) || '. Apartado' ELSE 'texto' END AS text FROM lines),
    m AS (SELECT *, CAST(nullif(regexp_extract(text, '^Artículo ([0-9]+)', 1), '') AS INTEGER) AS a, CAST(nullif(regexp_extract(text, '^([0-9]+)\\. ', 1), '') AS INTEGER) AS c FROM t)
    SELECT doc_id, seq, last_value(a IGNORE NULLS) OVER w AS articulo,
      nullif(last_value(CASE WHEN a IS NOT NULL THEN -1 ELSE c END IGNORE NULLS) OVER w, -1) AS apartado
    FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""",
)
def article_counters(spark, sf_dir):
    n = F.col("size")
    text = (
        F.when(n % 7 == 0, F.concat(F.lit("Artículo "), n % 9, F.lit(". Título")))
        .when(n % 5 == 0, F.concat(n % 4, F.lit(". Apartado")))
        .otherwise(F.lit("texto"))
    )
    out = ops.article_counters(lines(spark, sf_dir).withColumn("text", text))
    return out.select("doc_id", "seq", "articulo", "apartado")


@query(
    "subject_years",
    """SELECT o_orderkey AS doc_id, 'Música' AS materia, CASE WHEN o_orderpriority = '1-URGENT' THEN '1º ESO,4º ESO' ELSE '2º ESO,4º ESO' END AS cursos FROM orders
       UNION ALL SELECT o_orderkey, 'Tecnología y Digitalización', '1º ESO,2º ESO,3º ESO' FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, 'Tecnología', '1º ESO,2º ESO,3º ESO' FROM orders WHERE o_orderstatus <> 'F'""",
)
def subject_years(spark, sf_dir):
    """Years of each subject from the articles of one bulletin per order."""
    year = F.when(F.col("o_orderpriority") == "1-URGENT", "primer").otherwise(F.lit("segundo"))
    tech = F.when(F.col("o_orderstatus") == "F", "a) Tecnología y Digitalización.").otherwise(F.lit("a) Tecnología."))
    texts = F.array(
        F.lit("Artículo 8. Organización"), F.lit("1. Las materias son:"), tech,
        F.concat(F.lit("b) Música en "), year, F.lit(" curso.")), F.lit("3. Otras:"), F.lit("a) Música."),
        F.lit("Artículo 9. Cuarto"), F.lit("1. Las materias son:"), F.lit("c) Música."), F.lit("Artículo 20. Tecnología"),
    )
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(texts).alias("seq", "text"))
    three, fourth = C.COURSES[:3], C.COURSES[3:]
    rules = [(8, 1, three), (8, 2, three), (9, 1, fourth), (9, 2, fourth)]
    names = ["Tecnología", "Tecnología y Digitalización", "Música"]
    out = ops.subject_years(rows.withColumn("seq", F.col("seq").cast("bigint")), names, rules)
    return out.select("doc_id", "materia", F.array_join("cursos", ",").alias("cursos"))


@query(
    "merge_blocks",
    """SELECT conv_id, turn, role AS bloque, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n,
        first_value(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS titulo FROM conversations""",
)
def merge_blocks(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("bloque"), F.col("text").alias("titulo")
    )
    return ops.merge_blocks(rows, ["conv_id"], "turn").select("conv_id", "turn", "bloque", "n", "titulo")


def _bulletins(spark, sf_dir):
    """One small bulletin per order: two subjects, five kinds of year marker."""
    status, level = F.col("o_orderstatus"), F.col("o_orderpriority")
    subject = F.when(status == "F", "Física y Química").when(status == "O", "Música").otherwise(F.lit("Otra Materia"))
    marker = (
        F.when(level == "1-URGENT", "Cursos de primero a tercero").when(level == "2-HIGH", "Cuarto curso: Matemáticas A")
        .when(level == "3-MEDIUM", "Texto suelto").when(level == "5-LOW", "Cursos primero y segundo")
        .otherwise(F.lit("Primer curso"))
    )

    def p(text, cls="parrafo"):
        return F.struct(F.lit(cls).alias("cls"), (text if not isinstance(text, str) else F.lit(text)).alias("text"))

    parts = F.array(
        p(subject, "centro_negrita"), p("Competencias específicas."), p(F.concat(F.lit("1. Resolver "), "o_custkey")),
        p("Descriptores del Perfil de salida: STEM1, CD2."), p("2. Otra"), p(marker), p("Criterios de evaluación."),
        p("Competencia específica 1."), p(F.concat(F.lit("1.1 Identificar "), "o_orderkey")), p("2.1. Medir"),
        p("Saberes básicos."), p("Primer curso"), p("A. Bloque uno."), p("− Item a"), p("1. Conteo."), p("B. Bloque dos."),
        p("- Item b"), p("A. Bloque uno."), p("Item c"), p("Otra cosa", "centro_negrita"), p("1.9 Nada"),
    )
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(parts).alias("seq", "p"))
    return rows.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "p.cls", "p.text")


_PROFILE = B.Profile({"Física y Química": "Física y Química", "Música": "Música"})

_RECORDS_SQL = """
rec AS (
  SELECT o_orderkey AS doc_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'Física y Química' ELSE 'Música' END AS oficial, g, o_orderpriority AS p
  FROM orders, (VALUES (0), (1), (2)) v(g)
  WHERE o_orderstatus <> 'P' AND CASE WHEN o_orderpriority = '3-MEDIUM' THEN g = 0 WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN g > 0 ELSE g = 1 END)
"""


@query(
    "bulletin_records",
    f"""WITH {_RECORDS_SQL} SELECT doc_id, CAST(g AS INTEGER) AS grupo, oficial || CASE WHEN p = '2-HIGH' AND g = 1 THEN ' A' ELSE '' END AS materia,
      CASE WHEN g = 2 OR p = '4-NOT SPECIFIED' THEN '1º ESO' WHEN p = '1-URGENT' THEN '1º ESO,2º ESO,3º ESO' WHEN p = '2-HIGH' THEN '4º ESO'
           WHEN p = '5-LOW' THEN '1º ESO,2º ESO' ELSE '1º ESO,2º ESO,3º ESO,4º ESO' END AS cursos,
      'CE1 Resolver ' || o_custkey || ' [STEM1 CD2]|CE2 Otra []' AS competencias,
      CASE WHEN g = 2 THEN '' ELSE '1.1 CE1 Identificar ' || doc_id || '|2.1 CE2 Medir' END AS criterios,
      CASE WHEN g = 2 OR p IN ('2-HIGH', '4-NOT SPECIFIED') THEN '' ELSE 'A. Bloque uno: Item a, Item c|B. Bloque dos: Item b' END AS saberes FROM rec""",
)
def bulletin_records(spark, sf_dir):
    """Whole extraction: paragraphs to records with inherited competences."""
    out = B.extract_blocks(_bulletins(spark, sf_dir), _PROFILE)
    comp = F.transform("competencias_especificas", lambda c: F.concat(
        c["codigo"], F.lit(" "), c["descripcion"], F.lit(" ["), F.array_join(c["descriptores"], " "), F.lit("]")))
    crit = F.transform("criterios_evaluacion", lambda c: F.concat_ws(" ", c["codigo"], c["competencia"], c["descripcion"]))
    items = F.transform("saberes_basicos", lambda b: F.concat(b["bloque"], F.lit(": "), F.array_join(b["items"], ", ")))
    return out.select(
        "doc_id", "grupo", "materia", F.array_join("cursos_aplicables", ",").alias("cursos"),
        F.array_join(comp, "|").alias("competencias"), F.array_join(crit, "|").alias("criterios"), F.array_join(items, "|").alias("saberes"),
    )


@query(
    "writable_records",
    f"""WITH {_RECORDS_SQL} SELECT doc_id, CASE WHEN g = 2 THEN NULL ELSE CASE oficial WHEN 'Música' THEN 'musica' ELSE 'fisica_y_quimica' END
        || CASE WHEN p = '2-HIGH' THEN '_a' ELSE '' END || '__' || CASE p WHEN '1-URGENT' THEN '1_2_3' WHEN '2-HIGH' THEN '4' WHEN '4-NOT SPECIFIED' THEN '1'
           WHEN '5-LOW' THEN '1_2' ELSE '1_2_3_4' END END AS fichero FROM rec""",
)
def writable_records(spark, sf_dir):
    """File names of records with criteria; records without are reported."""
    out = B.extract_blocks(_bulletins(spark, sf_dir), _PROFILE)
    good, _ = split_writable(out)
    skipped = out.where(F.size("criterios_evaluacion") == 0).select("doc_id", F.lit(None).cast("string").alias("fichero"))
    return good.select("doc_id", file_stem().alias("fichero")).unionByName(skipped)
