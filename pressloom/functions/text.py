"""Column expressions on text. All lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Java character class, equal to the characters str.split() splits on.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
#: The same for DuckDB's regular expressions.
SPACE_RE2 = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Text without white space at both ends, in linear time."""
    head = F.regexp_replace(text, rf"\A{SPACE}+", "")
    return F.reverse(F.regexp_replace(F.reverse(head), rf"\A{SPACE}+", ""))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def content_hash(text: Column) -> Column:
    """sha1 of the text with white space collapsed; null stays null."""
    return F.sha1(squeeze(text))
