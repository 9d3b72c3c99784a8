"""Sharding by a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from ..plans.ranking import global_rank

SHARDS = 24
#: Bits to which each dimension is quantised.
BITS = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve for rows of coordinates below 2**bits; neighbours on the curve differ by 1 in one coordinate.

    Each level, from the top bit down, reads one bit of every coordinate as
    the Gray code of the sub-cube, whose orientation then turns the lower bits.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        one, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for d in range(dims):
            flip = (x[:, d] & one) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(flip, below, swap)
            if d:
                x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (np.int64(1) << level), (np.int64(1) << level) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[:, d] >> level) & 1)
    return out


def bin_of(value: Column, bits: int) -> Column:
    """A category's cell; null is cell 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits))).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for each row.

    Source, language and the logarithm of the size are quantised; rows are
    ordered by their place on the curve, then doc_id and checksum, and the
    order is cut into runs whose counts differ by one at most (law ``rows``).
    Categories are cells by hash, so that rows of a source or language lie in
    few runs and files can be skipped by any of the dimensions. Texts are not
    moved. A null text has no bytes; repeated rows are rows of
    their own; with fewer rows than shards some shards stay empty. Columns
    other than doc_id, text, source and lang are not read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    data = F.coalesce("text", F.lit("")).cast("binary")
    octets = F.octet_length(F.coalesce("text", F.lit("")))
    scale = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(octets.cast("double") + 1) * 2).cast("int"))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([a, b, c], axis=1), bits))

    slim = docs.select("doc_id", (octets + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), bin_of(F.col("source"), bits).alias("_a"), bin_of(F.col("lang"), bits).alias("_b"), scale.alias("_c"))
    placed = slim.withColumn("curve", curve("_a", "_b", "_c")).drop("_a", "_b", "_c")
    ranked, n = global_rank(placed, [F.col("curve"), F.col("doc_id"), F.col("text_crc32")], "_rank", scratch)
    n = max(n, 1)
    # shard k holds the ranks from ceil(k * n / shards) on
    number = F.expr(f"cast(_rank * {shards} div {n} as int)")
    first = F.expr(f"(cast(shard as long) * {n} + {shards} - 1) div {shards}")
    return ranked.withColumn("shard", number).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
