"""The registered queries of this package, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bit_sliced, byte_bpe, conversation_repair, conversation_sql, fill_middle, language_zstd, license_scan, line_dedup, ngram_join, packing,
               quality_knn, suffix_dedup, toxicity_kn, vp_trees)
from .frames import remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                        removed.alias("n_removed"), F.size("__spans").cast("long").alias("n_spans"),
                        F.sha2("__kept", 256).alias("kept_sha256"))


@query("op2_bit_sliced", """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5""")
def op2_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def marked(scores: DataFrame, held_out: Column) -> DataFrame:
    """Scores with the fold and the decision at one half."""
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_quality_knn")
def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 3) == 1
    return marked(quality_knn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


@query("op4_vp_trees")
def op4_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_trees.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op5_toxicity_kn")
def op5_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents")
    model = toxicity_kn.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return marked(toxicity_kn.add_score(docs.select("doc_id", "text"), model), held_out)


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines WHERE trim(line, ' ') <> ''
), runs AS (
  SELECT doc_id, j, line, lead(line) OVER (PARTITION BY doc_id ORDER BY j) AS next FROM filled
), later AS (
  SELECT doc_id, j FROM runs WHERE next IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY line, next ORDER BY doc_id, j) > 1
), long_later AS (
  SELECT doc_id, j FROM filled
  WHERE length(line) >= 99 AND len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) >= 50
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, j) > 1
), removed AS (
  SELECT DISTINCT doc_id, i FROM filled
  JOIN (SELECT * FROM later UNION SELECT doc_id, j + 1 FROM later UNION SELECT doc_id, j FROM long_later) USING (doc_id, j)
)
SELECT doc_id, count(*) AS n_lines, count(r.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN r.i IS NULL THEN line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN removed r USING (doc_id, i) GROUP BY doc_id"""


@query("op9_line_dedup", LINE_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    text = F.coalesce("text", F.lit(""))
    return marked.select("doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
                         F.size("__removed").cast("long").alias("n_removed"),
                         F.sha2(line_dedup.kept_text(text, F.col("__removed")), 256).alias("kept_sha256"))


@query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", conversation_sql.SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query("op12_fill_middle", """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cuts AS (
  SELECT doc_id, text, l, len(l) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(l) + 1) AS one,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(l) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(l[1:least(one, two)], '') AS p,
         array_to_string(l[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(l[greatest(one, two) + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts""")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_language_zstd")
def op13_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    found = language_zstd.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
