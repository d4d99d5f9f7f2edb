"""Text expressions shared by every operator. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when splitting words,
# and as line ends when splitting lines. Java's \s covers only the ASCII ones.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The same characters as plain text, for trimming.
SPACE_CHARACTERS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
TERM = "[a-z0-9]+"

# A word with the space before it: ``[SPACE]*[^SPACE]+``. Testing a character for SPACE is slow, so plain words
# go first, by ASCII alone.
PIECE = rf"[ \n]*+[!-~]++(?=[ \n]|\z)|[{SPACE}]*+[^{SPACE}]++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A plain column reference inside a lambda can be inlined by the optimizer and
    then recomputed per element; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def fold(x: Column) -> Column:
    """Case folding: lower case plus the letters that lower case leaves apart."""
    out = F.lower(x)
    for letter, folded in (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("µ", "μ")):
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE_CHARACTERS))


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"[{SPACE}]+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    """Number of words; 0 for null. Splitting is several times faster than
    matching words; the empty pieces at blank ends are taken off again."""
    blank = f"^[{SPACE}]?$"
    open_end = F.left(x, F.lit(1)).rlike(blank).cast("int")
    tail = F.right(x, F.lit(1)).rlike(f"^[{SPACE}]$").cast("int")
    return F.coalesce(F.size(F.split(x, f"[{SPACE}]+")) - open_end - tail, F.lit(0))


def collapse(x: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return strip(F.regexp_replace(x, f"(?![!-~])[{SPACE}]+", " "))


def normalized(x: Column) -> Column:
    return collapse(fold(x))


def terms(x: Column) -> Column:
    """Search terms: ASCII letter and digit runs of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit(TERM), F.lit(0))


def non_empty(x: Column) -> Column:
    return F.when(x != "", x)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over newline-joined parts; a null part counts as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def round_to(x: Column, digits: int) -> Column:
    """Round half up, first dropping float noise so that ties do not depend on
    the order in which terms were added."""
    return F.round(F.round(x, 10), digits)
