"""Table files: reading, safe replacement, inventories and translations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_new_state(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a full new state beside the old one and return its path.

    A new folder per run: readers of the old state are not disturbed and a
    failed or repeated run leaves nothing half-written in place.
    """
    target = f"{path.rstrip('/')}/estado-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def apply_or_report(df: DataFrame, path: str | None) -> DataFrame:
    """Dry run when no path is given; otherwise the written state, read back."""
    if path is None:
        return df
    return df.sparkSession.read.parquet(write_new_state(df, path))


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """The frame written to and read back from the cluster's shared folder.

    Spark takes the size of compressed files for that of their rows, which may be a hundredth
    of it, and would send such a table whole to the driver and every executor. So it is joined by sorting.
    """
    return df.sparkSession.read.parquet(write_new_state(df, f"{shared_dir(df.sparkSession)}/{name}")).hint("merge")


# Artefact file names.
ARTEFACT = r"(\d+)/([a-z0-9_]{1,40})-([0-9a-f]{16})\.([a-z0-9]+)$"


def parse_artefacts(paths: DataFrame, column: str = "path") -> DataFrame:
    """Columns of file names ``<document>/<section>-<fingerprint>.<ext>``."""
    c = F.col(column)
    return paths.where(c.rlike(ARTEFACT)).select(
        column,
        F.regexp_extract(c, ARTEFACT, 1).cast("bigint").alias("id_situacion"),
        F.regexp_extract(c, ARTEFACT, 2).alias("seccion"),
        F.regexp_extract(c, ARTEFACT, 3).alias("huella"),
        F.regexp_extract(c, ARTEFACT, 4).alias("extension"),
    )


def unnamed_artefacts(paths: DataFrame, column: str = "path") -> DataFrame:
    """File names that ``parse_artefacts`` leaves out, to be reported."""
    return paths.where(~F.coalesce(F.col(column).rlike(ARTEFACT), F.lit(False))).select(column)


def artefact_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Stored artefacts under a folder; only names are read, never contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_artefacts(files.select("path", "modificationTime"))


# Gettext entries.
_ENTRY_FUZZY = r"(?m)^#,.*\bfuzzy\b"
_MSGID = r"(?s)msgid\s+((?:\"(?:[^\"\\]|\\.)*\"\s*)+)"
_FORMS = r"(?s)msgstr(?:\[\d+\])?\s+((?:\"(?:[^\"\\]|\\.)*\"\s*)+)"
_MSGSTR = r"(?s)msgstr(?:\[0\])?\s+((?:\"(?:[^\"\\]|\\.)*\"\s*)+)"


def _unquote(c):
    """Quoted pieces of a gettext string joined and unescaped."""
    pieces = F.regexp_extract_all(c, F.lit(r"\"((?:[^\"\\]|\\.)*)\""), F.lit(1))
    joined = F.array_join(pieces, "")
    out = F.replace(joined, F.lit('\\"'), F.lit('"'))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(lang, msgid, msgstr, formas, fuzzy) from gettext files under ``<lang>/…``.

    ``msgstr`` is the only or first form of an entry, ``formas`` holds all of
    them. A language folder may carry a script or region (``zh_Hant``, ``pt-BR``).

    Entries are separated by blank lines, so the line reader splits files on
    them and no file is held whole. Obsolete entries and the header drop out.
    """
    entries = (
        spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.po").text(path)
    )
    body = F.regexp_replace("value", r"(?m)^#~.*$", "")
    rows = entries.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/([a-z]{2,3}(?:[_-][A-Za-z0-9]+)*)/(?:LC_MESSAGES/)?[^/]*\.po$", 1).alias("lang"),
        _unquote(F.regexp_extract(body, _MSGID, 1)).alias("msgid"),
        _unquote(F.regexp_extract(body, _MSGSTR, 1)).alias("msgstr"),
        F.transform(F.regexp_extract_all(body, F.lit(_FORMS), F.lit(1)), _unquote).alias("formas"),
        body.rlike(_ENTRY_FUZZY).alias("fuzzy"),
    )
    return rows.where(F.col("msgid") != "")
