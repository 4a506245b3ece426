"""Fill-in-the-middle: lines of a text regrouped as prefix, suffix and middle.

The JVM counts a text's lines by a regular expression and draws the two cuts from
a hash of the id. One pattern per row then takes all three parts in one match: a
counted possessive group for the lines before the first cut, one for those before
the second, and the rest. Python's engine runs counted possessive groups in a
loop, so a text of millions of lines is matched as a short one is; the JVM's
calls itself per repetition and ends with a stack overflow.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents, slices

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or what follows the last line end.
UNIT = r"[^\n]*\n|[^\n]+"
_POSSESSIVE = r"(?:[^\n]*+\n|[^\n]++)"
_TYPE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                   ("middle_chars", pa.int64()), ("output", pa.string())])
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@functools.lru_cache(maxsize=4096)
def pattern(first: int, between: int) -> re.Pattern[str]:
    """Groups of ``first`` lines, of the ``between`` next ones and of the rest."""
    return re.compile(rf"({_POSSESSIVE}{{{first}}}+)({_POSSESSIVE}{{{between}}}+)([\s\S]*+)")


def parts(text: str, first: int, second: int) -> tuple[str, str, str]:
    """Prefix, middle and suffix of a text cut after ``first`` and ``second`` lines."""
    return pattern(first, second - first).fullmatch(text).groups()


def _draw(hashed: Column, group: int) -> Column:
    """An 8-digit group of a hexadecimal hash as a number."""
    return F.conv(F.substring(hashed, 8 * group + 1, 8), 16, 10).cast("long")


def planned(docs: DataFrame, seed: str, fim_percent: int, spm_percent: int) -> DataFrame:
    """``doc_id``, ``text``, its number of lines ``n``, the ``form`` and both cuts."""
    text = F.col("text")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", "text", F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), hashed.alias("h"))
    h1, h2, h3, h4 = (_draw(F.col("h"), i) for i in range(4))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def _row(text: str, form: str, first: int, second: int) -> tuple[int | None, int | None, str]:
    if form == "plain":
        return None, None, text
    prefix, middle, suffix = parts(text, first, second)
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return len(prefix), len(middle), output


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            columns = [part.column(name).to_pylist() for name in ("text", "form", "first", "second")]
            before, within, output = zip(*map(_row, *columns), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n"), part.column("form"), pa.array(before, pa.int64()),
                                              pa.array(within, pa.int64()), pa.array(output, pa.string())], schema=_TYPE)


def fill_in_middle(docs: DataFrame, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` or ``plain``. Plain rows keep
    their text and have null lengths: empty and null texts (both are the empty text),
    texts that hold a mark, and what ``fim_percent`` leaves over. The cuts depend on
    ``seed`` and the id alone, so rows of one id are cut by the same draw; a null
    id is drawn as no digits. Texts are matched whole; repeated rows give repeated
    rows; other columns are ignored. A row's memory is a few times its text.
    """
    return planned(documents(docs, id_col, text_col), seed, fim_percent, spm_percent).mapInArrow(_arranged, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No mark can begin inside a part, so the first one found is the right one."""
    opening, closing = (F.when(form == "spm", a).otherwise(b) for a, b in ((SUFFIX, PREFIX), (PREFIX, SUFFIX)))
    head = F.substr(output, F.lit(len(PREFIX) + 1))
    one, rest = F.split_part(head, closing, F.lit(1)), F.split_part(head, closing, F.lit(2))
    two, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    whole = F.when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
    return F.when(form == "plain", output).when(F.startswith(output, opening), whole)
