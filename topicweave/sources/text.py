"""Lines of text files with their numbers, whatever the number of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value. Files of a folder go by name; a split's place is the sum of the counts before it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    blocks = raw.groupBy("_f", "_b").agg(F.min("_i").alias("_lo"), F.count("*").alias("_n")).collect()  # a row for each split
    before, table = 0, []
    for r in sorted(blocks, key=lambda r: (r._f, r._b)):
        table.append((r._f, r._b, r._lo, before))
        before += r._n
    if not table:
        return spark.createDataFrame([], "line long, value string")
    places = F.broadcast(spark.createDataFrame(table, "_f string, _b long, _lo long, _before long"))
    return raw.join(places, ["_f", "_b"]).select((F.col("_before") + F.col("_i") - F.col("_lo")).alias("line"), "value")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbers(value):
    """The whole numbers of a line."""
    return F.transform(F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
