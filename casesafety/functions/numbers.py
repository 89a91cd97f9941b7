"""Rounding and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


#: A number as people write it: no hexadecimal digits, no suffix for a type.
NUMBER = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"


#: Types whose cells are numbers as they are, and those whose cells are whole numbers.
WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMERIC = (*WHOLE, "float", "double")


def rating(c: Column, kind: str = "string") -> Column:
    """A cell of type ``kind`` as a double; null if it is missing or isn't a number ('2d' and '0x1p0' are none)."""
    if kind in NUMERIC:
        return c.cast("double")
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def count_or_none(c: Column, kind: str = "string") -> Column:
    """A cell of type ``kind`` as a whole number; null if blank, missing or anything else ('2.0' is no whole number)."""
    if kind in WHOLE:
        return c.try_cast("int")
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
