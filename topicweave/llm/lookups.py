"""Joins of many rows with one row a key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; keys and values are some 100 bytes each.
BROADCAST_ROWS = 500_000
#: Parts into which the rows of a key are dealt where the table is not broadcast.
SALTS = 16


def look_up(rows: DataFrame, table: DataFrame, key: str, most: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key; null is a key as any other.

    ``table`` should be written, as it is counted: up to ``most`` rows are
    broadcast. A larger one is repeated ``salts`` times, and each row of
    ``rows`` meets one of the repeats, so that no task gets all rows of a key.
    Rows whose key is not in ``table`` get nulls.
    """
    known = table.withColumnRenamed(key, "_key")
    if table.count() <= most:
        return rows.join(F.broadcast(known), rows[key].eqNullSafe(known["_key"]), "left").drop("_key")
    salted = rows.withColumn("_salt", F.floor(F.rand(1) * salts).cast("int"))
    many = known.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(many, salted[key].eqNullSafe(many["_key"]) & (F.col("_salt") == F.col("_repeat")), "left").drop("_key", "_salt", "_repeat")
