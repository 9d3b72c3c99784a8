"""Numbers drawn by values, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts: Column | str) -> Column:
    """A whole number below 2**32 drawn by the given values."""
    text = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
