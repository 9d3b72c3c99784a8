"""Words of texts, as the operators of this subpackage agree on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def word_list(text: Column) -> Column:
    """Maximal runs of non-separators; null and blank texts have none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def word_count(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RUN))).cast("long")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once for a row, however often the body names x."""
    return F.transform(F.array(value), body)[0]
