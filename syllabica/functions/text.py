"""Text clean-up and normal forms, as built-in column expressions.

Java regular expressions are ASCII by default, so every class that has to see
accented letters or hard spaces carries ``(?U)``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

_SURROGATES, _HANGUL = range(0xD800, 0xE000), range(0xAC00, 0xD7A4)


@lru_cache(maxsize=None)
def _taken_apart(form: str, words: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """What each character is without its marks, read off the Unicode tables.

    ``form`` is NFD or NFKD. One table holds characters that become one
    character or none (marks), the other those that become several. Hangul
    syllables carry no marks and stay whole. With ``words`` only characters that give
    an ASCII letter, digit or space are listed, for forms that drop all others.
    """
    single, several = {}, {}
    for cp in range(0x80, 0x30000):
        if cp in _SURROGATES or cp in _HANGUL:
            continue
        letter = chr(cp)
        bare = "".join(p for p in unicodedata.normalize(form, letter) if unicodedata.category(p) != "Mn")
        if words:
            bare = "".join(p for p in bare if p.isascii() and (p.isalnum() or p == " "))
        if bare != letter and (bare or not words):
            (single if len(bare) < 2 else several)[letter] = bare
    return single, several


def _class(letters: Iterable[str]) -> str:
    """Regular-expression ranges that hold exactly these characters."""
    ranges: list[list[int]] = []
    for cp in sorted(map(ord, letters)):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _expand(c: Column, several: dict[str, str]) -> Column:
    """Replace characters that become several."""
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    letters = _class(several)
    runs = F.regexp_extract_all(c, F.lit(f"[{letters}]|[^{letters}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def strip(c: Column) -> Column:
    """Trim every kind of white space, hard spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bare_letters(c: Column, form: str = "NFD", words: bool = False) -> Column:
    """Drop diacritics of every script, keep case.

    NFKD also takes compatibility characters apart: ordinal signs, ligatures,
    fractions, full-width forms. With ``words`` characters that give no ASCII letter, digit or
    space are left for the caller to drop. ASCII texts are left as they are, and
    only texts that hold a character which becomes several are cut up.
    """
    single, several = _taken_apart(form, words)
    kept = [x for x in single if single[x]] + [x for x in single if not single[x]]
    plain = lambda x: F.translate(x, "".join(kept), "".join(single[k] for k in kept))
    out = F.when(c.rlike(r"^\p{ASCII}*$"), c)
    if several:
        holds = F.length(F.translate(c, "".join(several), "")) < F.length(c)
        out = out.when(holds, plain(_expand(c, several)))
    return out.otherwise(plain(c))


def fold(c: Column, form: str = "NFD") -> Column:
    """Trimmed, lower case, without diacritics."""
    return bare_letters(F.lower(strip(c)), form)


def fold_words(c: Column) -> Column:
    """Folded text reduced to letters, digits and single-byte spaces."""
    return F.trim(F.regexp_replace(bare_letters(F.lower(strip(c)), "NFKD", words=True), "[^a-z0-9 ]+", ""))


def name_key(c: Column) -> Column:
    """Folded text reduced to ``[a-z0-9]``: the key names are compared on."""
    return F.regexp_replace(F.lower(bare_letters(F.lower(strip(c)), "NFKD", words=True)), "[^a-z0-9]+", "")


# The only letters the underscore slug replaces; others separate.
_SLUG_LETTERS = ("áéíóúñü", "aeiounu")


def slug(c: Column, style: str = "underscore", longest: int | None = None) -> Column:
    """File-name form of a title.

    ``underscore`` replaces a short list of letters; ``dash`` folds every
    letter; ``ascii`` drops what is not ASCII; ``file`` keeps all letters and
    never comes out empty. ``longest`` shortens a ``file`` name on request.
    """
    if style == "underscore":
        return F.regexp_replace(
            F.regexp_replace(F.translate(F.lower(c), *_SLUG_LETTERS), "[^a-z0-9]+", "_"), "^_+|_+$", ""
        )
    if style == "dash":
        return F.regexp_replace(F.regexp_replace(F.lower(bare_letters(F.lower(c), "NFKD")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if style == "ascii":
        plain = F.regexp_replace(F.lower(bare_letters(c, "NFKD")), r"[^\x00-\x7F]", "")
        return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if style == "file":
        dashed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "-")
        whole = F.regexp_replace(dashed, "^-+|-+$", "")
        cut = whole if longest is None else F.substring(whole, 1, longest)
        return F.when(cut == "", F.lit("situacion")).otherwise(cut)
    raise ValueError(f"unknown slug style {style!r}")


def norm_heading(c: Column) -> Column:
    """Odd spaces to plain ones, runs collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compare_heading(c: Column) -> Column:
    """``norm_heading`` without final dots, lower case; for comparing only."""
    return F.lower(F.trim(F.regexp_replace(norm_heading(c), r"\.+$", "")))


def join_lines(c: Column) -> Column:
    """Undo end-of-line hyphens and collapse spaces."""
    return norm_heading(F.regexp_replace(c, r"(?U)(\w)-\s+(\w)", "$1$2"))


def strip_bullet(c: Column) -> Column:
    """Remove one leading dash of any kind."""
    return strip(F.regexp_replace(c, r"(?U)^[−–—-]\s*", ""))


def is_bullet_only(c: Column) -> Column:
    """A line made of bullets, private-use glyphs and spaces alone."""
    return c.rlike(r"(?U)^[-–—−·•*\x{E000}-\x{F8FF}\s]*$")


def clean_title(c: Column) -> Column:
    """A bulletin title without its final dots."""
    return strip(F.regexp_replace(strip(c), r"\.+$", ""))


def clean_cover_title(c: Column) -> Column:
    """A cover title without the bracketed note or the year suffix."""
    no_note = F.regexp_replace(c, r"(?Us)\s*\(.*", "")
    no_year = F.regexp_replace(no_note, r"(?iU)\s+(?:de|d[’'])\s+(?:primer|segon|tercer|quart)\b.*$", "")
    return F.regexp_replace(no_year, "^[ .,]+|[ .,]+$", "")


def normalise_email(c: Column) -> Column:
    return F.lower(strip(c))


def mask_email(c: Column) -> Column:
    """First and last letter of the local part, stars between, domain kept."""
    at = F.instr(c, "@")
    local = F.substring_index(c, "@", 1)
    domain = F.substr(c, at + 1)
    size = F.length(local)
    short = F.concat(F.substring(local, 1, 1), F.lit("*"))
    long = F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), size - 2), F.substring(local, -1, 1))
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(at == 0, F.repeat(F.lit("*"), F.length(c)))
        .otherwise(F.concat(F.when(size <= 2, short).otherwise(long), F.lit("@"), domain))
    )


def fingerprint(lang: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 over language, NUL, text."""
    return F.substring(F.sha2(F.concat(lang, F.lit("\x00"), text), 256), 1, 16)


# How typographic signs are spoken.
_SPOKEN_SINGLE = {
    "‘": "'", "’": "'", "“": '"', "”": '"', "•": ",", "·": ",",
    "\u00a0": " ", "\u202f": " ", "\u2009": " ",
}
_SPOKEN_WORDS = {"…": "...", "→": " a ", "≤": " menor o igual que ", "≥": " mayor o igual que "}
_DASH = r"[-\x{2010}-\x{2015}]"

# Code points each target encoding can hold, as a negated character class.
_ENCODABLE = {"iso-8859-1": r"[^\x00-\x{FF}]", "ascii": r"[^\x00-\x7F]"}


def spoken_text(c: Column) -> Column:
    """Typographic signs to plain ones; a dash standing alone is a pause."""
    out = F.translate(c, "".join(_SPOKEN_SINGLE), "".join(_SPOKEN_SINGLE.values()))
    for sign, words in _SPOKEN_WORDS.items():
        out = F.replace(out, F.lit(sign), F.lit(words))
    return F.regexp_replace(out, rf"(?U)(?<=\s){_DASH}(?=\s|$)|^{_DASH}(?=\s)", ",")


def _marks(c: Column) -> Column:
    """How many marks a text holds once it is taken apart by NFKD."""
    by_number: dict[int, str] = {}
    for table in _taken_apart("NFKD"):
        for letter in table:
            n = sum(unicodedata.category(p) == "Mn" for p in unicodedata.normalize("NFKD", letter))
            by_number[n] = by_number.get(n, "") + letter
    parts = [n * (F.length(c) - F.length(F.translate(c, letters, ""))) for n, letters in by_number.items() if n]
    return reduce(add, parts)


def encode_spoken(c: Column, encoding: str = "iso-8859-1") -> Column:
    """Struct(text, lost): the text an encoding can hold and what it dropped.

    Text that fits is left alone. Otherwise every letter is taken apart, so
    marks count as lost too, and what still does not fit is dropped.
    """
    outside = _ENCODABLE[encoding]
    spoken = spoken_text(c)
    bare = bare_letters(spoken, "NFKD")
    kept = F.regexp_replace(bare, outside, "")
    lost = (_marks(spoken) + F.length(bare) - F.length(kept)).cast("bigint")
    fits = ~spoken.rlike(outside)
    return F.struct(
        F.when(fits, spoken).otherwise(kept).alias("text"),
        F.when(fits, F.lit(0).cast("bigint")).otherwise(lost).alias("lost"),
    )


def reading_text(c: Column) -> Column:
    """Collapse blanks, line breaks and doubled dots of text to be read aloud."""
    out = F.regexp_replace(c, r"[ \t\x{00A0}]+", " ")
    out = F.regexp_replace(out, r"(?U)\s*\n\s*", "\n")
    return strip(F.regexp_replace(out, r"(?U)\.\s*\.", "."))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 in UTC with microseconds only where there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def ordered_distinct(c: Column) -> Column:
    """Order-preserving distinct of an array, nulls and blanks out."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def same_members(a: Column, b: Column) -> Column:
    """Sorted equality of two arrays."""
    return F.array_sort(a) == F.array_sort(b)
