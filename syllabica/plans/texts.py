"""Text functions over whole texts, damage and marker counts."""

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import text as T
from ..operators import quality as ops
from ..operators.providers import model_list
from .registry import query, read

_SPACE = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{1680}]"
_STRIP = f"regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


@query(
    "fold_names",
    f"""SELECT doc_id, md5(strip_accents(lower({_STRIP}))) AS plegado,
        md5(regexp_replace(strip_accents(lower({_STRIP})), '[^a-z0-9]+', '', 'g')) AS clave FROM documents""",
)
def fold_names(spark, sf_dir):
    c = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.fold(c)).alias("plegado"), F.md5(T.name_key(c)).alias("clave"))


@query(
    "slugs",
    """SELECT doc_id,
        md5(regexp_replace(regexp_replace(translate(lower(text), 'áéíóúñü', 'aeiounu'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS guion_bajo,
        md5(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS guion,
        coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'situacion') AS fichero
       FROM documents""",
)
def slugs(spark, sf_dir):
    c = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.md5(T.slug(c)).alias("guion_bajo"),
        F.md5(T.slug(c, "dash")).alias("guion"),
        T.slug(c, "file").alias("fichero"),
    )


@query(
    "headings",
    f"""SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))) AS cabecera,
        md5(lower(trim(regexp_replace(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')), '[.]+$', '')))) AS comparable,
        md5(trim(regexp_replace(regexp_replace(text, '([\\p{{L}}\\p{{N}}\\p{{M}}_])-{_SPACE}+([\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1\\2', 'g'), '{_SPACE}+', ' ', 'g'))) AS unido
       FROM documents""",
)
def headings(spark, sf_dir):
    c = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.md5(T.norm_heading(c)).alias("cabecera"),
        F.md5(T.compare_heading(c)).alias("comparable"),
        F.md5(T.join_lines(c)).alias("unido"),
    )


@query(
    "fingerprints",
    "SELECT doc_id, left(sha256(lang || chr(0) || text), 16) AS huella FROM documents",
)
def fingerprints(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("lang"), F.col("text")).alias("huella"))


@query(
    "mask_ids",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 1000 THEN c_name
         WHEN c_acctbal < 2000 THEN 'ab@' || lower(c_mktsegment) || '.es' ELSE ' ' || c_name || '@' || c_mktsegment || '.ES ' END AS correo FROM customer),
    n AS (SELECT c_custkey, correo, lower(trim(correo)) AS normal, instr(correo, '@') AS at FROM c)
    SELECT c_custkey AS id, normal,
      CASE WHEN normal IS NULL THEN NULL WHEN instr(normal, '@') = 0 THEN repeat('*', length(normal))
           WHEN instr(normal, '@') <= 3 THEN left(normal, 1) || '*' || substr(normal, instr(normal, '@'))
           ELSE left(normal, 1) || repeat('*', instr(normal, '@') - 3) || substr(normal, instr(normal, '@') - 1) END AS oculto FROM n""",
)
def mask_ids(spark, sf_dir):
    b = F.col("c_acctbal")
    address = (
        F.when(b < 0, F.lit(None).cast("string"))
        .when(b < 1000, F.col("c_name"))
        .when(b < 2000, F.concat(F.lit("ab@"), F.lower("c_mktsegment"), F.lit(".es")))
        .otherwise(F.concat(F.lit(" "), "c_name", F.lit("@"), "c_mktsegment", F.lit(".ES ")))
    )
    normal = T.normalise_email(address)
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), normal.alias("normal"), T.mask_email(normal).alias("oculto")
    )


@query(
    "encoding_damage",
    """SELECT doc_id, CAST(len(regexp_extract_all(text || CASE WHEN lang = 'fr' THEN chr(65533) || chr(7) || chr(10) || chr(9) ELSE '' END,
         '[\\x00-\\x08\\x0B-\\x1F\\x{FFFD}]')) AS BIGINT) AS roturas FROM documents""",
)
def encoding_damage(spark, sf_dir):
    hurt = F.when(F.col("lang") == "fr", F.lit("�\x07\n\t")).otherwise(F.lit(""))
    return _documents(spark, sf_dir).select("doc_id", ops.damage_count(F.concat("text", hurt)).alias("roturas"))


@query(
    "marker_counts",
    """WITH m AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the ')) AS BIGINT) AS vigentes,
         CAST(len(regexp_extract_all(lower(text), 'que ')) AS BIGINT) AS derogados FROM documents)
    SELECT doc_id, vigentes, derogados, CASE WHEN vigentes > 0 AND derogados = 0 THEN 'vigente'
      WHEN vigentes = 0 AND derogados > 0 THEN 'derogado' WHEN vigentes > 0 THEN 'mezcla' ELSE 'desconocido' END AS estado FROM m""",
)
def marker_counts(spark, sf_dir):
    rows = ops.marker_counts(_documents(spark, sf_dir), "text", {"vigentes": "the ", "derogados": "que "})
    verdict = ops.current_or_superseded(F.col("vigentes"), F.col("derogados"))
    return rows.select("doc_id", "vigentes", "derogados", verdict.alias("estado"))


@query(
    "spoken_text",
    """WITH s AS (SELECT doc_id, replace(replace(replace(replace(translate(text, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8226) || chr(183) || chr(160) || chr(8239) || chr(8201),
           chr(39) || chr(39) || chr(34) || chr(34) || ',,   '), chr(8230), '...'), chr(8594), ' a '), chr(8804), ' menor o igual que '), chr(8805), ' mayor o igual que ') AS t FROM documents),
    d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(\\s)[-\\x{2010}-\\x{2015}](\\s|$)', '\\1,\\2', 'g'),
           '(\\s)[-\\x{2010}-\\x{2015}](\\s|$)', '\\1,\\2', 'g'), '^[-\\x{2010}-\\x{2015}](\\s)', ',\\1') AS t FROM s)
    SELECT doc_id, md5(CASE WHEN regexp_matches(t, '[^\\x{00}-\\x{FF}]') THEN regexp_replace(strip_accents(t), '[^\\x{00}-\\x{FF}]', '', 'g') ELSE t END) AS dicho,
           regexp_matches(t, '[^\\x{00}-\\x{FF}]') AS con_perdida FROM d""",
)
def spoken_text(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", T.encode_spoken(F.col("text")).alias("v"))
    return rows.select("doc_id", F.md5("v.text").alias("dicho"), (F.col("v.lost") > 0).alias("con_perdida"))


@query(
    "reading_text",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x{{00A0}}]+', ' ', 'g'),
          '{_SPACE}*\\n{_SPACE}*', chr(10), 'g'), '[.]{_SPACE}*[.]', '.', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS lectura FROM documents""",
)
def reading_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.reading_text(F.col("text"))).alias("lectura"))


@query(
    "iso_timestamps",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || strftime(ts, '.%f') || '+00:00' AS iso FROM events",
)
def iso_timestamps(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "ts").select("event_id", T.iso_timestamp(F.col("ts")).alias("iso"))


@query(
    "ordered_distinct",
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w,
          generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
    f AS (SELECT conv_id, turn, w, min(i) AS i FROM w WHERE w <> '' GROUP BY ALL)
    SELECT conv_id, turn, md5(string_agg(w, ' ' ORDER BY i)) AS palabras, count(*) AS n FROM f GROUP BY conv_id, turn""",
)
def ordered_distinct(spark, sf_dir):
    words = T.ordered_distinct(F.split("text", " "))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    return rows.where(F.size("w") > 0).select(
        "conv_id", "turn", F.md5(F.array_join("w", " ")).alias("palabras"), F.size("w").cast("bigint").alias("n")
    )


@query(
    "official_codes",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, upper(left(l_returnflag || l_linestatus || 'X', 3)) || '.' || l_linenumber || '.' ||
           l_returnflag || '.' || l_partkey || '. Texto ' || l_suppkey AS linea FROM lineitem),
    d AS (SELECT DISTINCT * FROM c)
    SELECT linea, l_linenumber AS curso, left(linea, 3) AS prefijo, substr(linea, 7, 1) AS bloque, CAST(l_partkey AS INTEGER) AS numero,
           split_part(linea, '. ', 2) AS texto FROM (SELECT DISTINCT linea, l_linenumber, l_partkey FROM d)""",
)
def official_codes(spark, sf_dir):
    """Official item codes taken apart: prefix, year, block, number, text."""
    line = F.concat(
        F.upper(F.concat("l_returnflag", "l_linestatus", F.lit("X"))), F.lit("."), "l_linenumber", F.lit("."),
        "l_returnflag", F.lit("."), "l_partkey", F.lit(". Texto "), "l_suppkey",
    )
    rows = read(spark, sf_dir, "lineitem").select(line.alias("linea")).distinct()
    parsed = rows.select("linea", C.parse_official_item(F.col("linea")).alias("p"))
    return parsed.select(
        "linea", F.col("p.year").alias("curso"), F.col("p.prefix").alias("prefijo"), F.col("p.block").alias("bloque"),
        F.col("p.number").alias("numero"), F.col("p.text").alias("texto"),
    )


@query(
    "dotted_order",
    """SELECT DISTINCT l_linenumber || '.' || CAST(l_quantity AS INTEGER) AS codigo, l_linenumber AS mayor,
              CAST(l_quantity AS INTEGER) AS menor FROM lineitem""",
)
def dotted_order(spark, sf_dir):
    code = F.concat_ws(".", "l_linenumber", F.col("l_quantity").cast("int"))
    rows = read(spark, sf_dir, "lineitem", "l_linenumber", "l_quantity").select(code.alias("codigo")).distinct()
    key = C.dotted_order(F.col("codigo"))
    return rows.orderBy(key).select("codigo", key[0].cast("int").alias("mayor"), key[1].cast("int").alias("menor"))


@query(
    "year_markers",
    """WITH m AS (SELECT event_id, CASE event_type
         WHEN 'click' THEN 'Cursos de primero a tercero.' WHEN 'view' THEN 'Cursos primero y segundo'
         WHEN 'error' THEN 'Cuarto curso: Matemáticas ' || CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END
         WHEN 'purchase' THEN 'Curso de cuarto' ELSE 'Nada que ver ' || user_id END AS marca, event_type, user_id FROM events)
    SELECT event_id, CASE event_type WHEN 'click' THEN '1º ESO,2º ESO,3º ESO' WHEN 'view' THEN '1º ESO,2º ESO'
         WHEN 'error' THEN '4º ESO' WHEN 'purchase' THEN '4º ESO' END AS cursos,
         CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END END AS itinerario FROM m""",
)
def year_markers(spark, sf_dir):
    kind, track = F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "A").otherwise(F.lit("B"))
    mark = (
        F.when(kind == "click", "Cursos de primero a tercero.")
        .when(kind == "view", "Cursos primero y segundo")
        .when(kind == "error", F.concat(F.lit("Cuarto curso: Matemáticas "), track))
        .when(kind == "purchase", "Curso de cuarto")
        .otherwise(F.concat(F.lit("Nada que ver "), "user_id"))
    )
    rows = read(spark, sf_dir, "events", "event_id", "event_type", "user_id").select("event_id", C.parse_years(mark).alias("y"))
    return rows.select("event_id", F.array_join("y.years", ",").alias("cursos"), F.col("y.track").alias("itinerario"))


@query(
    "descriptor_codes",
    """SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 1 AND 5
         THEN 'STEM' || json_extract_string(props, '$.k') || ',CD2' ELSE 'CD2' END AS descriptores FROM events""",
)
def descriptor_codes(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit("Descriptores del Perfil de salida: STEM"), k, F.lit(", CD2, XYZ3. CE1"))
    rows = read(spark, sf_dir, "events", "event_id", "props")
    return rows.select("event_id", F.array_join(C.descriptors(line), ",").alias("descriptores"))


@query(
    "clean_lines",
    """SELECT p_partkey, p_name || ' ' || p_type AS titulo, p_name AS portada, p_name AS vineta, p_name AS celda FROM part""",
)
def clean_lines(spark, sf_dir):
    """Titles, cover titles, bullets and code residue cleaned."""
    name = F.col("p_name")
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select(
        "p_partkey",
        T.clean_title(F.concat(F.lit(" "), name, F.lit(" "), "p_type", F.lit(". "))).alias("titulo"),
        T.clean_cover_title(F.concat(name, F.lit(" de primer a tercer (matèria optativa)"))).alias("portada"),
        T.strip_bullet(F.concat(F.lit("− "), name)).alias("vineta"),
        C.drop_code_residue(F.concat(name, F.lit(" GE")), F.lit("GEH")).alias("celda"),
    )


@query(
    "model_lists",
    """SELECT c_custkey AS config, lower(c_mktsegment) AS id, 'Nombre ' || c_mktsegment AS etiqueta, CAST(0 AS BIGINT) AS pos FROM customer
       UNION ALL SELECT c_custkey, 'm' || c_nationkey, 'm' || c_nationkey, 1 FROM customer""",
)
def model_lists(spark, sf_dir):
    """Comma lists of ``id|label``: first position kept, later label adopted."""
    name, extra = F.lower("c_mktsegment"), F.concat(F.lit("m"), "c_nationkey")
    raw = F.concat(name, F.lit(", "), extra, F.lit(",, "), name, F.lit("|Nombre "), "c_mktsegment")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("config"), raw.alias("lista"))
    return model_list(rows, "config", "lista")
