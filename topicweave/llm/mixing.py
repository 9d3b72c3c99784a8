"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from ..plans.ranking import global_rank
from .scans import segment_scan
from .words import word_count

#: Weights that the sources take in turn; how often a text may be repeated; rows of a leaf and children of a node of the reduction tree.
WEIGHTS = (1, 2, 3)
CAP = 3
LEAF_ROWS = 2_000
FAN_IN = 64

STATE = "doc_id long, source string, size long, source_size long, target double, copies long, frac double, leaf long, width long, done boolean"


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same in every run."""
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def pair(size: np.ndarray, frac: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Make all but one of the fractions 0 or 1, keeping their expectations and the sum of size * fraction.

    Two fractional rows meet; words move between them until one is 0 or 1, in
    a direction drawn so that neither expectation changes. The other one meets
    the next row.
    """
    x, carried = frac.astype(float).tolist(), -1
    a = size.tolist()
    for i in range(len(x)):
        if not (0.0 < x[i] < 1.0 and a[i] > 0):
            continue
        if carried < 0:
            carried = i
            continue
        c = carried
        up, down = min(a[c] * (1 - x[c]), a[i] * x[i]), min(a[c] * x[c], a[i] * (1 - x[i]))
        move = up if u[i] * (up + down) < down else -down
        x[c], x[i] = x[c] + move / a[c], x[i] - move / a[i]
        for k in (c, i):
            if min(x[k], 1 - x[k]) < 1e-9:
                x[k] = float(round(x[k]))
        carried = next((k for k in (c, i) if 0.0 < x[k] < 1.0), -1)
    return np.array(x)


def pivot(size: np.ndarray, frac: np.ndarray, u: np.ndarray) -> np.ndarray:
    """As ``pair`` for rows of one fraction: here the row that stays fractional is among the smallest.

    Rows come from the largest to the smallest. Each is paired with the pool
    of all rows after it: words move between the two until the row is 0 or 1,
    or the pool is empty or full, in a direction drawn so that no expectation
    changes. Giving scales all fractions of the pool, taking scales what they
    lack of 1, so one affine map says how the pool stands.
    """
    out = frac.astype(float).copy()
    rows = np.flatnonzero((frac > 0) & (frac < 1) & (size > 0))
    a, x0 = size[rows].astype(float), out[rows]
    mass = np.append(np.cumsum(a[::-1])[::-1][1:], 0.0)
    held = np.append(np.cumsum((a * x0)[::-1])[::-1][1:], 0.0)
    shift, scale = 0.0, 1.0
    for k in range(len(rows)):
        x = shift + scale * x0[k]
        pool = min(max(shift * mass[k] + scale * held[k], 0.0), mass[k])
        lack, need, give = mass[k] - pool, a[k] * (1 - x), a[k] * x
        up, down = min(need, pool), min(give, lack)
        if up + down > 0 and u[rows[k]] * (up + down) < down:
            x = 1.0 if up == need else x + up / a[k]
            left = 1 - up / pool
            shift, scale = shift * left, scale * left
        elif up + down > 0:
            x = 0.0 if down == give else x - down / a[k]
            left = 1 - down / lack
            shift, scale = 1 - left * (1 - shift), scale * left
        out[rows[k]] = float(round(x)) if min(x, 1 - x) < 1e-9 else x
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int, scratch: Scratch) -> DataFrame:
    """source, source_size, n_rows, target. Weights go by code point order, null last; what a cap cuts off is shared anew by weight."""
    ranked, _ = global_rank(sizes, [F.col("source").asc_nulls_last()], "_rank", scratch)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = scratch.keep(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * cap))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:  # a round caps at least one source more, usually nearly all that it will
        over = F.col("_weight") * share > F.col("_cap")
        n, used, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))).first()
        if not n and not free or n == capped:
            break
        capped = n
        share = (total - used) / free if free else share
    return table.select("source", "source_size", "n_rows", F.least(F.col("_cap").cast("double"), F.col("_weight") * share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of ``docs``.

    A text's size is its number of words, null texts and blank ones have none
    and none is taken of them. Each row is copied target / source_size times
    in expectation; the whole part is certain, the rest is rounded within its
    source by a reduction tree, whose leaves are hashed parts of bounded size,
    so that a hot source is many leaves. The taken words of a source miss its
    target by less than the size of one text. Draws depend on doc_id and seed
    alone. Repeated rows are rows of their own; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    # named apart: the join must tell null sources too
    aims = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, cap, scratch).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    width = F.ceil(F.col("n_rows") / F.lit(leaf_rows))
    rows = slim.join(aims, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", rate)
    state = rows.select(
        "doc_id", "source", "size", "source_size", "target",
        F.floor("_rate").alias("copies"), (F.col("_rate") - F.floor("_rate")).alias("frac"),
        F.pmod(F.xxhash64("doc_id", "size"), width).alias("leaf"), width.alias("width"), F.lit(False).alias("done"),
    )

    def reduce(level: int):
        def rounds(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["size", "doc_id"], ascending=False, kind="stable").reset_index(drop=True)
            frac = np.where(part["size"] > 0, part["frac"], 0.0)
            u = uniform(part["doc_id"].fillna(-1).to_numpy(np.int64), seed * 1000 + level)
            # the rows of a leaf have the fraction of their source; what leaves have over differs
            x = (pair if level else pivot)(part["size"].to_numpy(), frac, u)
            whole = (x <= 0.0) | (x >= 1.0)
            if (part["width"] <= 1).all():  # the root: what is left is drawn by itself
                last = uniform(part["doc_id"].fillna(-1).to_numpy(np.int64), seed * 1000 + 999)
                x = np.where(whole, x, (last < x).astype(float))
                whole[:] = True
            part["copies"] = part["copies"] + np.where(whole, x, 0.0).astype(np.int64)
            part["frac"] = np.where(whole, 0.0, x)
            part["done"] = whole
            part["leaf"] = part["leaf"] // FAN_IN
            part["width"] = -(-part["width"] // FAN_IN)
            return part

        return rounds

    widest = slim.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    widest, level, decided = -(-widest // leaf_rows), 0, []
    while True:
        state = scratch.keep(state.groupBy("source", "leaf", "width").applyInPandas(reduce(level), STATE))
        decided.append(state.filter("done"))
        state = state.filter("not done")
        if widest <= 1:
            break
        widest, level = -(-widest // FAN_IN), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` copies it; its columns are unchanged.

    Rows are told apart by doc_id, source and size. Rows that share all three
    share their copies: of m such rows with c copies the k-th, by a hash of its
    text, is taken floor(k c / m) - floor((k - 1) c / m) times, c in all.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    chosen = mix(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    chosen = chosen.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"), word_count(F.col("text")).alias("_n"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    same = F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    met = rows.join(chosen, same)
    out = met.filter("_rows = 1").select("_row", "_copies")
    several = chosen.filter("_rows > 1")
    if not several.isEmpty():
        keys = {"_a": F.xxhash64("_d", "_s", "_n"), "_b": F.xxhash64(F.lit(1), "_d", "_s", "_n"), "_text": F.xxhash64("_row.text"), "_place": F.lit(1).cast("long")}
        placed = segment_scan(rows.join(several, same).select("_row", "_copies", "_rows", *(c.alias(name) for name, c in keys.items())), ["_a", "_b"], ["_text"], scratch, add=("_place",))
        share = lambda k: F.floor(k * F.col("_copies") / F.col("_rows"))
        out = out.unionByName(placed.select("_row", (share(F.col("_place")) - share(F.col("_place") - 1)).alias("_copies")).filter("_copies > 0"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
