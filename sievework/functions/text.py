"""Text expressions whose notion of white space is Unicode's, as in Python's ``str``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that ``str.isspace`` knows, as a regular expression's class.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(text: Column) -> Column:
    """Most texts have no white space at their ends, which two characters tell; only the others are searched."""
    padded = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike("[" + SPACE + "]")
    return F.when(padded, F.regexp_replace(text, r"\A[" + SPACE + r"]+|[" + SPACE + r"]+\z", "")).otherwise(text)


def near_text(text: Column) -> Column:
    """Lower case, with runs of white space as one blank and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[" + SPACE + "]+", " "))


def display(text: Column, longest: int = 120) -> Column:
    """A value for a report: null by name, long ones cut."""
    cut = F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest - 1), F.lit("\u2026"))).otherwise(text)
    return F.coalesce(cut, F.lit("null"))
