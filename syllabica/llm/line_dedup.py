"""Line dedup: later copies of repeated runs of lines, by prefix doubling.

A position is a line's place in its document. Its rank names the run of lines
that begins there by the first position with the same run. Ranks of one line come
from a grouping of the lines; ranks of twice as many come from pairs of ranks at
an offset, and so on up to the threshold. A rank that occurs once drops out at
every round, so only repeated runs are carried on. What is left at the threshold
are the positions inside the common prefixes of the suffix array's intervals;
all but the first of each begin a later copy. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import staged

_PLACE = ["__d", "__t", "__j"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(text: Column) -> Column:
    """Indexes of the lines that aren't blank."""
    return F.filter(F.transform(_lines(text), lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under their id and a hash of the text: rows that repeat an id stay apart."""
    return docs.withColumns({"__d": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))),
                             "__t": F.xxhash64(F.col(f"`{text_col}`"))})


def _repeated(pairs: DataFrame, key: list[str], *kept: str) -> DataFrame:
    """Positions whose key occurs more than once, with the first such position as their rank.

    The grouping is combined before its shuffle, and the side joined back has one
    row per key, so that Spark can split a key which a third of all rows hold.
    """
    first = pairs.groupBy(*key).agg(F.min(F.struct(*_PLACE)).alias("__first"), F.count("*").alias("__n"))
    return pairs.join(first.where("__n > 1").drop("__n"), key).select(*_PLACE, F.col("__first").alias("__rank"), *kept)


def _line_ranks(docs: DataFrame, min_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """Ranks of the lines that occur more than once, and whether a line has ``min_words`` words (``__long``)."""
    def line(x: Column) -> Column:
        long = F.lit(False)
        if min_words is not None:
            # so many words have as many characters, and a blank between any two
            long = F.when(F.length(x) >= 2 * min_words - 1, F.regexp_count(x, F.lit("[^ \\t\\n\\x0B\\f\\r]+")) >= min_words).otherwise(False)
        return F.struct(F.xxhash64(x).alias("__a"), F.xxhash64(F.lit(1), x).alias("__b"), long.alias("__long"))

    lines = F.transform(F.filter(_lines(F.col(f"`{text_col}`")), lambda x: F.trim(x) != ""), line)
    rows = (_keyed(docs, id_col, text_col).select("__d", "__t", F.posexplode(lines).alias("__j", "__line"))
            .select(*_PLACE, "__line.__a", "__line.__b", "__line.__long"))
    # a row that is there twice is one set of positions
    return staged(_repeated(rows.distinct(), ["__a", "__b"], "__long"), "line-ranks")


def _doubled(ranked: DataFrame, min_lines: int) -> DataFrame:
    """Ranks of runs of ``min_lines`` lines from those of one line."""
    length = 1
    while length < min_lines:
        offset = min(length, min_lines - length)
        later = ranked.select("__d", "__t", (F.col("__j") - offset).alias("__j"), F.col("__rank").alias("__next"))
        ranked = staged(_repeated(ranked.join(later, _PLACE), ["__rank", "__next"]), "line-ranks")
        length += offset
    return ranked


def repeated_runs(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__d, __t, __j, __rank``: where runs of ``min_lines`` lines begin that occur more than once.

    ``__j`` counts lines that aren't blank; ``__rank`` is the first position of the run.
    """
    return _doubled(_line_ranks(docs, None, id_col, text_col), min_lines).select(*_PLACE, "__rank")


def repeated_intervals(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal later copies: ``doc_id, first_line, n_lines, of_doc_id, of_line``.

    Positions that follow each other, and whose runs also begin one after the other at the
    place copied from, share a longest common prefix with it: they are one interval. Lines
    count from 0 and leave out blank ones. A null id is null; empty tables give no rows.
    """
    later = repeated_runs(docs, min_lines, id_col, text_col).where(F.col("__rank") != F.struct(*_PLACE))
    # numbered within one document's positions of one place copied from
    same = ["__d", "__t", F.col("__rank.__d"), F.col("__rank.__t"), F.col("__rank.__j") - F.col("__j")]
    numbered = later.withColumn("__island", F.col("__j") - F.row_number().over(Window.partitionBy(*same).orderBy("__j")))
    shift = (F.col("__rank.__j") - F.col("__j")).alias("__shift")
    spans = numbered.groupBy("__d", "__t", F.col("__rank.__d").alias("__of"), F.col("__rank.__t").alias("__of_t"), shift, "__island").agg(
        F.min("__j").alias("first_line"), (F.count("*") + (min_lines - 1)).alias("n_lines"))
    an_id = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return spans.select(an_id("__d").alias("doc_id"), "first_line", "n_lines", an_id("__of").alias("of_doc_id"),
                        (F.col("first_line") + F.col("__shift")).alias("of_line"))


def mark_repeated_lines(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int | None = None) -> DataFrame:
    """``docs`` with ``__removed``: the indexes of the lines that later copies of repeated runs cover.

    Documents are ordered by id and lines by place; a run of ``min_lines`` or more
    lines that also begins earlier is a later copy, overlaps included. With
    ``min_words`` so is a single line of that many words or more. Blank lines
    are neither counted nor removed. A null text stays null; a null id comes before
    all others; rows that repeat an id with another text are ordered by a hash of
    the text, and a row that is there twice is handled alike.
    """
    lines = _line_ranks(docs, min_words, id_col, text_col)
    copied = F.col("__rank") != F.struct(*_PLACE)
    later = _doubled(lines, min_lines).where(copied)
    covered = later.select("__d", "__t", F.explode(F.sequence("__j", F.col("__j") + (min_lines - 1))).alias("__j"))
    if min_words is not None:
        covered = covered.union(lines.where(F.col("__long") & copied).select(*_PLACE))
    # at most the lines of one document
    places = covered.groupBy("__d", "__t").agg(F.collect_set("__j").alias("__places"))
    filled = _filled(F.col(f"`{text_col}`"))
    removed = F.transform(F.col("__places"), lambda j: F.get(F.col("__filled"), j))
    return (_keyed(docs, id_col, text_col).join(places.hint("merge"), ["__d", "__t"], "left").withColumn("__filled", filled)
            .withColumn("__removed", F.coalesce(removed, F.array().cast("array<int>")))
            .drop("__d", "__t", "__places", "__filled"))


def kept_text(text: Column, removed: Column) -> Column:
    """The text without the lines at the given indexes."""
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.when(text.isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int | None = None) -> DataFrame:
    """``docs`` with the same columns and rows, without the lines that ``mark_repeated_lines`` finds."""
    text = F.col(f"`{text_col}`")
    marked = mark_repeated_lines(docs, min_lines, id_col, text_col, min_words)
    new = F.when(F.size("__removed") > 0, kept_text(text, F.col("__removed"))).otherwise(text)
    return marked.withColumn(text_col, new).select(*(F.col(f"`{c}`") for c in docs.columns))
