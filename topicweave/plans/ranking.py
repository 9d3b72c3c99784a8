"""Ranks over a whole table without a task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .durable import Scratch, shuffle_width


def global_rank(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """Add ``name``, the gapless rank from 0 under ``order``; also the row count.

    Rows go to ranges of the order and are sorted there; each range's place is
    the sum of the counts before it, one number for each partition. ``order``
    should end with a unique column, else tied rows are ranked as they come.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = scratch.keep(placed)
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at"), 0
    table = F.broadcast(spark.createDataFrame(offsets, "_p long, _before long"))  # a row for each shuffle partition
    ranked = placed.withColumn("_p", part).join(table, "_p")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_before"), total


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, scratch: Scratch) -> DataFrame:
    """Add ``name``, the sum of ``value`` over the rows before a row under ``order``, whose last column should be unique.

    Rows go to ranges of the order; a row's sum is that of its range, plus one number for each range before it.
    """
    spark = df.sparkSession
    placed = scratch.keep(df.repartitionByRange(shuffle_width(spark), *order).withColumn("_p", F.spark_partition_id()))
    total, offsets = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy("_p").agg(F.sum(value).alias("n")).collect()):
        offsets.append((p, total))
        total += n or 0
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_p")
    inside = F.coalesce(F.sum(value).over(W.Window.partitionBy("_p").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    table = F.broadcast(spark.createDataFrame(offsets, "_p int, _before long"))  # a row for each shuffle partition
    return placed.withColumn(name, inside).join(table, "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")
