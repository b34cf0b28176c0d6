"""Text column expressions. All native except the rare rows that need NFKC."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Python's str.split() / str.strip() see it.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _listed(chars: str) -> str:
    """A Java character class of single characters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


_ASCII_SPACE = _listed("".join(c for c in SPACES if c.isascii()))
_ANY_SPACE = _listed(SPACES)
_WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}-\\x{3000}]"

# Above U+0130, or one of the special characters of Latin-1 (accented letters are not among them).
_WIDE = "[\\x{a0}\\x{a8}\\x{aa}\\x{af}\\x{b2}\\x{b3}\\x{b4}\\x{b5}\\x{b8}\\x{b9}\\x{ba}\\x{bc}\\x{bd}\\x{be}\\x{131}-\\x{10ffff}]"
_NOT_ASCII = "[^\\x00-\\x7f]"

# No code point from here on folds to a letter or decomposes.
LAST_DECOMPOSED = 0x30000


def _folded(char: str) -> str:
    """One character after NFKD, removal of combining marks and case folding."""
    kept = (c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    return "".join(kept).casefold()


def _regex_class(points: list[int]) -> str:
    """A Java character class of the given code points, as ranges."""
    ranges: list[list[int]] = []
    for point in points:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """(matching, replacement, expansions) for every code point that is not plain ASCII.

    Characters folding to one letter or digit are paired in the first two strings,
    those folding to nothing trail `matching` unpaired (so they are deleted), and
    those folding to several characters with a letter or digit are expansions.
    """
    single, gone, several = [], [], {}
    for point in range(0x80, LAST_DECOMPOSED):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = _folded(char)
        useful = [c for c in folded if c.isascii() and c.isalnum()]
        if not folded:
            gone.append(char)
        elif len(folded) == 1 and useful:
            single.append((char, folded))
        elif useful:
            several[char] = "".join(c if c.isascii() and c.isalnum() else " " for c in folded)
    matching = "".join(c for c, _ in single) + "".join(gone)
    return matching, "".join(f for _, f in single), several


def normalize_text(c: Column) -> Column:
    """Match key of a text: accents dropped, case folded, other runs one space, trimmed.

    Null becomes ''. Every step acts on single characters, so one `translate`
    covers all accented letters; the few characters that expand to several
    (ligatures, fractions) are looked up only in rows that hold one.
    """
    matching, replacement, several = _fold_tables()
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("ß"), F.lit("ss"))
    expansions = F.map_from_arrays(
        F.split(F.lit("\x01".join(several)), "\x01"), F.split(F.lit("\x01".join(several.values())), "\x01")
    )
    expanded = F.array_join(F.transform(F.split(text, ""), lambda x: F.when(x < "\x80", x).otherwise(
        F.coalesce(F.element_at(expansions, x), x))), "")
    wide = F.when(_holds(text, sorted(ord(k) for k in several)), expanded).otherwise(text)
    text = F.when(text.rlike(_NOT_ASCII), F.translate(wide, matching, replacement)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _holds(c: Column, points: list[int]) -> Column:
    """Does the text hold one of the code points? Cheap tests first: the class has many ranges."""
    return F.when(c.rlike(_WIDE), c.rlike(f"(?={_NOT_ASCII}){_regex_class(points)}"))


@lru_cache(maxsize=1)
def _nfkc_points() -> list[int]:
    """Characters whose presence may make NFKC differ from the text itself."""
    points = []
    seconds = set()
    for point in range(0x80, LAST_DECOMPOSED):
        if 0xD800 <= point <= 0xDFFF:
            continue
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
    for point in range(0x80, LAST_DECOMPOSED):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        changes = unicodedata.normalize("NFKC", char) != char
        jamo = 0x1161 <= point <= 0x1175 or 0x11A8 <= point <= 0x11C2
        if changes or unicodedata.combining(char) or point in seconds or jamo:
            points.append(point)
    return points


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def clean_text(c: Column) -> Column:
    """NFKC text with white space collapsed and trimmed; blank becomes null.

    Spark has no Unicode normalization, so the rows that hold a character NFKC
    can change go through an Arrow UDF; all other rows reach it as null.
    """
    normal = F.coalesce(_nfkc(F.when(_holds(c, _nfkc_points()), c)), c)
    return squeeze(normal)


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed; blank becomes null."""
    wide = F.regexp_replace(c, _ANY_SPACE + "+", " ")
    flat = F.when(c.rlike(_WIDE_SPACE), wide).otherwise(F.regexp_replace(c, _ASCII_SPACE + "+", " "))
    return F.nullif(F.trim(flat), F.lit(""))


def strip(c: Column) -> Column:
    """White space removed from both ends."""
    return F.btrim(c, F.lit(SPACES))


def nonblank(c: Column) -> Column:
    """Stripped text, null when blank."""
    return F.nullif(strip(c), F.lit(""))


def clip_text(c: Column, n: int) -> Column:
    """First `n` characters, then trailing white space removed; shorter text is untouched."""
    return F.when(F.length(c) <= n, c).otherwise(F.rtrim(F.substring(c, 1, n), F.lit(SPACES)))


def first_nonblank(*cols: Column) -> Column:
    """First column with a non-blank text, stripped."""
    return F.coalesce(*[nonblank(c) for c in cols])


def first_in_array(c: Column) -> Column:
    """First non-blank element of a text array, stripped."""
    return F.try_element_at(F.filter(F.transform(c, nonblank), lambda x: x.isNotNull()), F.lit(1))


def publication_label(title: Column) -> Column:
    """Title on one line; above 120 characters the first 117 and '...'."""
    flat = F.coalesce(squeeze(title), F.when(title.isNotNull(), F.lit("")))
    return F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 117), F.lit("..."))).otherwise(flat)


def display_label(display_name: Column, full_name: Column) -> Column:
    """Display name, or the full name when it is missing or empty."""
    return F.coalesce(F.nullif(display_name, F.lit("")), full_name)


def token_count(c: Column) -> Column:
    """Number of space-separated non-empty tokens."""
    return F.size(F.filter(F.split(c, " "), lambda x: x != ""))
