"""Column functions with the text semantics of the analyses: Unicode white space, UTF-16 lengths and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")


def collapse_white_space(x: Column) -> Column:
    """Stripped, with single spaces for runs of white space."""
    return F.regexp_replace(strip(x), rf"{WHITE}+", " ")


def is_blank(x: Column) -> Column:
    return x.isNull() | x.rlike(rf"^{WHITE}*$")


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def ordinal_key(x: Column) -> Column:
    """Sorts as UTF-16 code units do; plain order is that of code points and differs only above U+FFFF."""
    return F.encode(x, "UTF-16BE")


def fold(x: Column) -> Column:
    """Lower case without regard to neighbours: a capital sigma never becomes the final one."""
    return F.lower(F.replace(x, F.lit("\u03a3"), F.lit("\u03c3")))


def quote(literal: str) -> str:
    """A Java regular expression for the literal."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
