"""Language by compression: the dictionary that makes a text smallest names its language.

For each language passages of a bounded sample of labelled documents become one
raw-content dictionary of zstandard. Every text is compressed whole with each of
them, in blocks, so that a long text meets the dictionary again and again and doesn't only
learn from itself. The smallest sum of block sizes wins; a narrow lead over the
second is reported as a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import documents, slices

#: Language of a text without letters.
UNDETERMINED = "und"
#: Bytes of all dictionaries together, which each worker holds.
ALL_BYTES = 32_000_000
_NO_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def lowered(text: str) -> bytes:
    """The words of a whole text in lower case, with single spaces between: what is compressed.

    A word that follows itself is there once, since its copies say nothing about the language.
    """
    words = text.lower().encode().translate(_NO_LETTERS).split()
    return b" ".join(word for word, before in zip(words, [b"", *words], strict=False) if word != before)


def passages(raw: bytes, most: int, length: int) -> list[bytes]:
    """At most ``most`` passages of about ``length`` bytes, evenly spread over a whole text and cut at spaces."""
    if len(raw) <= most * length:
        return [raw] if raw else []
    found = []
    for i in range(most):
        start = (len(raw) - length) * i // (most - 1) if most > 1 else 0
        part = raw[start: start + length]
        a, b = part.find(b" ") if start else -1, part.rfind(b" ")
        found.append(part[a + 1: b] if b > a + 1 else part)
    return found


def sampled(texts: DataFrame, per_language: int) -> DataFrame:
    """``lang`` and ``text`` of at most ``per_language`` ids of each language, the same ones in every run.

    Of rows with one id and language the least text counts. Every task keeps its
    own first ids of a language before any are shuffled.
    """
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (texts.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(first))
           .where(F.col("k") <= per_language).drop("k"))
    # bounded by languages and ``per_language``
    return texts.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def dictionaries(texts: DataFrame, per_language: int, most: int, length: int, dict_bytes: int) -> dict[str, bytes]:
    """One dictionary per language, by name. What comes to the driver is bounded by languages, ``per_language``, ``most`` and ``length``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                joined = [b" ".join(passages(lowered(text), most, length)) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(joined, pa.binary())],
                                                 names=["doc_id", "lang", "raw"])

    found = sampled(texts, per_language).mapInArrow(cut, "doc_id long, lang string, raw binary")
    gathered: dict[str, list[bytes]] = {}
    for row in found.orderBy("lang", F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        gathered.setdefault(row["lang"], []).append(bytes(row["raw"]))
    room = min(dict_bytes, ALL_BYTES // max(len(gathered), 1))
    return {lang: whole for lang, rows in gathered.items() if (whole := b" ".join(rows)[:room].strip())}


def commonest_first(known: DataFrame, languages: list[str]) -> list[str]:
    """Languages by their number of rows, most first, then by name."""
    n = {row["lang"]: row["count"] for row in known.where(F.col("lang").isin(languages)).groupBy("lang").count().toLocalIterator()}
    return sorted(languages, key=lambda lang: (-n[lang], lang))


class Compressors:
    """A compressor per language; sizes of texts under each."""

    def __init__(self, languages: list[str], by_language: dict[str, bytes], level: int, block: int) -> None:
        import zstandard

        self.languages, self.block, self.compress = languages, block, []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(by_language[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False,
                                                          write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        raw = lowered(text)
        blocks = [raw[i: i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(map(len, map(compress, blocks))) for compress in self.compress]

    def verdict(self, text: str) -> tuple[str, float]:
        """The language of the smallest size, the commonest if several are, and its lead over the second as a share."""
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((size for i, size in enumerate(sizes) if i != best), default=None)
        return self.languages[best], 1.0 if second is None else (second - sizes[best]) / second if second else 0.0


def identify(docs: DataFrame, learn: Column, per_language: int = 400, most: int = 4, length: int = 256, dict_bytes: int = 262_144,
             level: int = 6, block: int = 4096, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` of every document.

    ``learn`` is a condition on ``doc_id`` that says which rows may be learnt from, those
    with a language; at most ``per_language`` of each language are, by at most ``most`` passages of
    ``length`` bytes, and a dictionary has at most ``dict_bytes``. ``score`` is 0 to 1: the share by which the
    best compressed text is smaller than the second best, through a square root; it is 1
    where only one language was learnt. Of equal sizes the language with most rows wins. ``rejected``
    says that the lead is below ``margin``, as ties are, or that there is no language: ``und`` with score 0 for texts that are null or
    have no letter, and for all if nothing was learnt. Texts are compressed whole; repeated rows
    are judged alike; other columns are ignored. Letters are compared in lower case, ASCII signs and digits as spaces.
    """
    rows = documents(docs, id_col, text_col)
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").cast("string").alias("lang")).where(learn)
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    learnt = dictionaries(known, per_language, most, length, dict_bytes)
    nothing = [F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")]
    if not learnt:
        return rows.select("doc_id", *nothing)
    languages = commonest_first(known, list(learnt))
    sent = docs.sparkSession.sparkContext.broadcast(learnt)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = Compressors(languages, sent.value, level, block)
        for batch in batches:
            for part in slices(batch):
                found = [judges.verdict(text) if letter else (UNDETERMINED, 0.0)
                         for text, letter in zip(part.column("text").to_pylist(), part.column("letter").to_pylist(), strict=True)]
                lang, lead = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(lead, pa.float64())],
                                                 names=["doc_id", "lang_pred", "lead"])

    judged = rows.withColumn("letter", F.col("text").rlike(r"\p{L}")).mapInArrow(judge, "doc_id long, lang_pred string, lead double")
    return judged.select("doc_id", "lang_pred", F.sqrt(F.greatest("lead", F.lit(0.0))).alias("score"), (F.col("lead") < margin).alias("rejected"))
