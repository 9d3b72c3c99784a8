"""Running values within segments of a sorted table, whatever the length of a segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.durable import Scratch, shuffle_width


class Running:
    """Running values over the batches of one range, with what stands at its end."""

    def __init__(self, keys: list[str], add: list[str], xor: list[str], fill: dict[str, list[str]]):
        self.keys, self.add, self.xor, self.fill = keys, add, xor, fill
        self.key: tuple | None = None
        self.held = dict.fromkeys([*add, *xor], 0)
        self.filled: dict[str, tuple | None] = dict.fromkeys(fill)
        self.segment = self.at = 0

    def take(self, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n = batch.num_rows
        key = [batch.column(c).to_numpy() for c in self.keys]
        start = np.zeros(n, bool)
        for x in key:
            start[1:] |= x[1:] != x[:-1]
        start[0] = self.key != tuple(int(x[0]) for x in key)
        segment, place = np.cumsum(start), np.arange(n)
        first = np.maximum.accumulate(np.where(start, place, 0))
        early = segment == 0  # rows of the segment that the last batch ended in
        out = {}
        for c in self.add:
            v = batch.column(c).to_numpy()
            run = np.cumsum(v)
            out[c] = run - np.where(early, -self.held[c], run[first] - v[first])
        for c in self.xor:
            v = batch.column(c).to_numpy()
            run = np.bitwise_xor.accumulate(v)
            out[c] = run ^ np.where(early, self.held[c], run[first] ^ v[first])
        for c in (*self.add, *self.xor):
            self.held[c] = out[c][-1]
            out[c] = pa.array(out[c])
        for flag, columns in self.fill.items():
            last = np.maximum.accumulate(np.where(batch.column(flag).to_numpy(zero_copy_only=False), place, -1))
            here = last >= np.where(early, 0, first)
            before = self.filled[flag] if early.any() else None
            values = []
            for k, c in enumerate(columns):
                v = batch.column(c).to_numpy(zero_copy_only=False)[np.maximum(last, 0)].astype(np.int64)
                if before is not None:
                    v = np.where(early & ~here, before[k], v)
                values.append(v)
            known = here | early if before is not None else here
            for c, v in zip(columns, values, strict=True):
                out[c] = pa.array(v, mask=~known)
            self.filled[flag] = tuple(int(v[-1]) for v in values) if known[-1] else None
        out["_head"] = pa.array(self.segment + segment <= 1)
        out["_at"] = pa.array(self.at + place)
        self.key, self.segment, self.at = tuple(int(x[-1]) for x in key), self.segment + int(segment[-1]), self.at + n
        return out


def segment_scan(
    df: DataFrame, keys: list[str], order: list[str | Column], scratch: Scratch, add: tuple[str, ...] = (), xor: tuple[str, ...] = (), fill: dict[str, list[str]] | None = None
) -> DataFrame:
    """``df`` with running values of its columns within each segment, the rows of equal ``keys``, by ``order``.

    Columns of ``add`` become their running sum and those of ``xor`` their
    running exclusive or; for each flag in ``fill``, its columns become those
    of the last row so far whose flag is true, null where there is none. All of
    these and the keys are longs without nulls. Rows are sorted in ranges; a
    segment may cross any number of them. A range is read once, batch by batch;
    what a range's first segment needs from the ranges before it is one row for
    each range, combined on the driver.
    """
    fill = fill or {}
    spark, summed = df.sparkSession, [*add, *xor]
    filled = [c for columns in fill.values() for c in columns]
    schema = StructType([StructField(f.name, LongType(), True) if f.name in filled else f for f in df.schema])
    for name, kind in (("_part", "long"), ("_head", "boolean"), ("_at", "long")):
        schema = schema.add(name, kind)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, running = TaskContext.get().partitionId(), Running(keys, list(add), list(xor), fill)
        for batch in batches:
            if batch.num_rows:
                out = running.take(batch)
                out["_part"] = pa.array(np.full(batch.num_rows, part))
                yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(c) for c in (*columns, "_part", "_head", "_at")], names=[*columns, "_part", "_head", "_at"])

    by = [*keys, *order]
    placed = df.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by)
    table = scratch.keep(placed.mapInArrow(run, schema))
    ends = table.groupBy("_part").agg(F.min_by(F.struct(*keys), "_at").alias("first"), F.max_by(F.struct(*keys, *summed, *filled, "_head"), "_at").alias("last"))
    carried, key, held = [], None, {}
    for part, first, last in sorted(tuple(r) for r in ends.collect()):  # one row for each range
        came = tuple(first) == key
        if came:
            carried.append((part, *(held[c] for c in (*summed, *filled))))
        now = {c: last[c] for c in (*summed, *filled)}
        if came and last["_head"]:
            for c in add:
                now[c] += held[c]
            for c in xor:
                now[c] ^= held[c]
            for c in filled:
                now[c] = held[c] if now[c] is None else now[c]
        key, held = tuple(last[c] for c in keys), now
    out = table.drop("_at")
    if carried:
        carry = spark.createDataFrame(carried, StructType([StructField(c, LongType()) for c in ("_from", *(f"_c_{c}" for c in (*summed, *filled)))]))
        out = out.join(F.broadcast(carry), (F.col("_part") == F.col("_from")) & F.col("_head"), "left")
        new = {c: F.col(c) + F.coalesce(f"_c_{c}", F.lit(0)) for c in add} | {c: F.col(c).bitwiseXOR(F.coalesce(f"_c_{c}", F.lit(0))) for c in xor} | {c: F.coalesce(c, f"_c_{c}") for c in filled}
        out = out.withColumns(new)
    out = out.select(*columns)
    out._scratch_path = table._scratch_path
    return out
