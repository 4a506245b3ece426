"""The corpus pipeline: toxicity, line dedup, n-gram join, suffix-array dedup, packing.

Each stage gets what its predecessor kept, written as Parquet and read again.
The first four keep the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabica.llm import line_dedup, ngram_join, suffix_dedup, toxicity_kn
from syllabica.llm.frames import remainder, staged
from syllabica.llm.queries import packed


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` anew, where there is one."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels of one fold in five are never learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity_kn.fit_toxicity(docs, labels, remainder("doc_id", 5) != 0)
    return toxicity_kn.add_score(docs, model, "__score").where("__score < 0.5").drop("__score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of two or more lines, or of a line of 50 words or more, go; every document stays."""
    return counted(line_dedup.drop_repeated_lines(docs, min_words=50))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, also by way of others, the one with the smallest id stays.

    Rows without an id stay; of rows with an id that are alike in all columns one stays.
    """
    others = ngram_join.similar(docs).where("doc_id <> class_id").select("doc_id").distinct()
    left = docs.join(others.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    return left.where("doc_id IS NULL").union(left.where("doc_id IS NOT NULL").dropDuplicates())


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a string of 100 bytes covers which starts earlier go; every document stays."""
    return counted(suffix_dedup.drop_repeats(docs))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    return packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram join", one_of_each_group),
    ("suffix dedup", without_repeats),
    ("packing", into_sequences),
]
#: Models and token ids can't be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
