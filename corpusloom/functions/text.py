"""Scalar text functions: Column in, Column out, built-in expressions only (inside whole-stage code generation where
Spark generates code for them). Nulls give nulls.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import regexes as R
from corpusloom.functions.arrays import let


def replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(R.java(pattern)), F.lit(by))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(R.java(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(R.java(pattern)))


#: Unicode's White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def utrim(text: Column) -> Column:
    """Without Unicode white space at either end (``trim`` takes U+0020 only)."""
    return F.btrim(text, F.lit(_WHITE))


def length_of(text: Column, pattern: str) -> Column:
    """Characters in the matches of ``pattern``: for a class with ``+`` what ``count`` of the class gives, without a string each."""
    return F.length(text) - F.length(replace(text, pattern))


# --- decoding and cleaning


def to_utf8(content: Column, charset: Column | None = None) -> Column:
    """Bytes to text: valid UTF-8 as it is; else by ``charset`` (windows-1251, koi8-r, iso-8859-1), by default windows-1251.

    Needs ``spark.sql.legacy.javaCharsets`` for the Cyrillic charsets (``sources.readers`` sets it).
    """
    named = F.lower(charset) if charset is not None else F.lit("")
    legacy = (
        F.when(named == "koi8-r", F.decode(content, "KOI8-R"))
        .when(named.isin("iso-8859-1", "latin1"), F.decode(content, "ISO-8859-1"))
        .otherwise(F.decode(content, "windows-1251"))
    )
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(legacy)


def normalize(text: Column) -> Column:
    """Byte-order marks off, line ends to ``\\n``, each line trimmed."""
    t = F.regexp_replace(text, "^﻿?￾?", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    return F.array_join(F.transform(F.split(t, "\n", -1), utrim), "\n")


def join_hyphenated(text: Column) -> Column:
    return F.when(matches(text, R.HYPHEN_HINT), F.regexp_replace(text, R.HYPHEN_BREAK_JAVA, "$1$2")).otherwise(text)


def blank_metadata_lines(text: Column) -> Column:
    held = reduce(or_, [F.contains(text, F.lit(mark)) for mark in R.METADATA_HINT.split("|")])
    return F.when(held, replace(text, R.METADATA_LINE)).otherwise(text)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _letters(line: Column) -> Column:
    return length_of(line, r"\p{L}+") / F.greatest(F.length(line), F.lit(1))


def is_table_line(line: Column) -> Column:
    """20 bytes or more, over half of the characters digits or punctuation."""
    return (F.octet_length(line) >= 20) & (length_of(line, r"[\p{Nd}\p{P}]+") / F.greatest(F.length(line), F.lit(1)) > 0.5)


def is_bibliographic_line(line: Column) -> Column:
    return line.rlike(R.BIBLIOGRAPHIC_JAVA)


def is_garbage_line(line: Column) -> Column:
    """10 bytes or more, under three tenths of the characters letters."""
    return (F.octet_length(line) >= 10) & (_letters(line) < 0.3)


def _is_dropped_line(line: Column) -> Column:
    """A table, garbage or bibliographic line. Where half is letters, no more than half is digits or punctuation."""
    by_letters = let(_letters(line), lambda share: (share < 0.3) | ((share < 0.5) & is_table_line(line)))
    return ((F.octet_length(line) >= 10) & by_letters) | is_bibliographic_line(line)


def clean(text: Column) -> Column:
    """Ten steps against scanning artefacts, in order. Java's own forms of the patterns (``regexes``) give what these give."""
    t = let(let(F.regexp_replace(text, R.CONTROL_JAVA, ""), join_hyphenated), blank_metadata_lines)
    t = F.regexp_replace(t, R.NUMBER_LINE_JAVA, "$1")
    t = F.regexp_replace(t, R.CONTENTS_NUMBER_JAVA, "")
    t = F.array_join(F.filter(F.split(t, "\n", -1), lambda s: ~_is_dropped_line(s)), "\n")
    t = F.regexp_replace(t, R.SHAPES_JAVA, "")
    t = replace(t, R.RULER_LINE)
    t = F.regexp_replace(t, R.BLANKS_JAVA, " ")
    return utrim(F.regexp_replace(t, R.SPACE_BEFORE_MARK_JAVA, "$1"))


def clean_light(text: Column) -> Column:
    """Catalogue lines blanked (here the Cyrillic marks are found as words), page numbers after words off, digit lines dropped."""
    t = F.regexp_replace(text, r"(?dmU)^.*\b(?:ISBN|УДК|ББК|ISSN|DOI)\b.*$", "")
    t = F.regexp_replace(t, r"(?dU)([А-Яа-яЁё])(\d+)(?:\s|$)", "$1")
    keep = F.filter(F.split(t, "\n", -1), lambda s: (F.length(s) == 0) | (F.regexp_count(s, F.lit(r"\p{Nd}")) / F.greatest(F.length(s), F.lit(1)) <= 0.5))
    return F.array_join(keep, "\n")


def filter_characters(text: Column) -> Column:
    """Only ASCII, Cyrillic, supplemental punctuation, dashes and the ellipsis stay."""
    return replace(text, R.NOT_ACCEPTABLE)


def strip_cjk_thai(text: Column) -> Column:
    return replace(text, R.CJK_THAI)


def has_cjk_thai(text: Column) -> Column:
    return matches(text, R.CJK_THAI)


# --- file names


def base_name(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.txt\.gz\z", ""), r"\.txt\z", "")


def filename_metadata(filename: Column, strip_year: bool = False) -> Column:
    """struct(genre, author, title) of ``genre_author — title.txt[.gz]``; without the dash the author is Unknown.

    ``strip_year``: a closing ``, 1999`` of the title goes.
    """
    base, mark = base_name(filename), " — "
    at = F.instr(base, mark)
    left, title = F.substring_index(base, mark, 1), F.substr(base, at + len(mark))
    if strip_year:
        title = F.regexp_replace(title, r",\s*\d{4}\z", "")
    under = F.instr(left, "_")
    return F.struct(
        F.when((at > 0) & (under > 0), F.substring_index(left, "_", 1)).otherwise("").alias("genre"),
        F.when(at == 0, F.lit("Unknown")).when(under > 0, F.substr(left, under + 1)).otherwise(left).alias("author"),
        F.when(at == 0, base).otherwise(title).alias("title"),
    )


def title_or_name(title: Column, filename: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", base_name(filename)).otherwise(title)


# --- measures and classes


def approx_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?]"))


def has_script(text: Column, script: str = "cyrillic") -> Column:
    return matches(text, R.SCRIPTS[script])


def language_class(text: Column) -> Column:
    """russian, english, mixed or other, by the scripts in the text."""
    ru, en = has_script(text, "cyrillic"), has_script(text, "latin")
    return F.when(ru & en, "mixed").when(ru, "russian").when(en, "english").otherwise("other")


def size(text: Column, unit: str = "chars") -> Column:
    """Length in code points (``chars``) or UTF-8 bytes (``bytes``)."""
    return F.octet_length(text) if unit == "bytes" else F.length(text)


def digit_ratio(text: Column, unit: str = "chars") -> Column:
    return share(F.regexp_count(text, F.lit("[0-9]")), size(text, unit))


def punct_ratio(text: Column, unit: str = "chars") -> Column:
    return share(F.regexp_count(text, F.lit(r"\p{P}")), size(text, unit))


def uppercase_ratio(text: Column) -> Column:
    return share(F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}")))


def is_list_item(text: Column) -> Column:
    return matches(text, R.LIST_MARKER)


def garbage_flags(text: Column) -> dict[str, Column]:
    return {name: F.contains(text, F.lit(R.GARBAGE_HINTS[name])) & matches(text, p) for name, p in R.GARBAGE.items()}


def rolling_hash(text: Column, modulus: int = 100) -> Column:
    """h = (31 h + code point) mod ``modulus`` over the characters."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % modulus)


# --- words


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(R.LOWER_WORD_JAVA), F.lit(0))


def cyrillic_words(text: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[А-Яа-яЁё]{{{least},}}"), F.lit(0))


def fields(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def preview(text: Column, n: int = 500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def segment(text: Column) -> Column:
    """Sentences: a break after ``.``, ``!`` or ``?`` with white space behind, and at line ends; trimmed, none empty."""
    marked = F.regexp_replace(text, R.SENTENCE_END, "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), utrim), lambda s: s != "")
