"""The trie of shared conversation prefixes, summed over subtrees by heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch, shuffle_width
from .scans import segment_scan

#: Conversations that share the first one's opening, and turns that an opening may have (one more than the longest).
GROUP, OPENINGS = 100, 6
#: Characters of one piece of a list of ids.
PIECE = 65536


def half(digest: Column, start: int) -> Column:
    """Sixteen hexadecimal digits as a signed number."""
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns with their place (conv, pos from 1, h1, h2, len, borrowed), and conversations (conv, base, borrow, after, length).

    ``borrow`` turns of ``base`` come first, then the own turns after the first ``after``.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("len"))
    sizes = scratch.keep(slim.groupBy("conv").agg(F.count("*").alias("own")))
    own = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % GROUP).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS).alias("after"))
    there = sizes.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    borrow = F.least("after", F.coalesce("there", F.lit(0)))
    plan = scratch.keep(own.join(there, "base", "left").select("conv", "base", "after", borrow.alias("borrow"), (borrow + F.greatest(F.col("own") - F.col("after"), F.lit(0))).alias("length")))
    nothing = F.lit(0).cast("long")
    heads = plan.select("conv", F.lit(True).alias("head"), F.lit(None).cast(slim.schema["turn"].dataType).alias("turn"), F.lit("").alias("digest"), nothing.alias("len"), nothing.alias("pos"), F.col("borrow").alias("borrowed"))
    turns = slim.select("conv", F.lit(False).alias("head"), "turn", "digest", "len", F.lit(1).cast("long").alias("pos"), nothing.alias("borrowed"))
    # the head of a conversation stands before its turns and hands what it plans to them
    placed = segment_scan(heads.unionByName(turns), ["conv"], [F.col("head").desc(), F.col("turn").asc_nulls_first(), "digest"], scratch, add=("pos",), fill={"head": ["borrowed"]})
    turns = placed.filter("not head").select("conv", "pos", half(F.col("digest"), 1).alias("h1"), half(F.col("digest"), 17).alias("h2"), "len", "borrowed")
    turns._scratch_path = placed._scratch_path
    return turns, plan


def rebuilt(turns: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each rebuilt conversation and depth, 0 included: conv, depth, len, p1, p2 (the parent's prefix), k1, k2 (this prefix), last.

    A prefix is known by 128 bits, the exclusive or of what each turn and its
    place hash to, so that a conversation's prefixes are a running value.
    """
    after = F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS
    own = turns.filter(F.col("pos") > after).select("conv", (F.col("pos") - after + F.col("borrowed")).alias("depth"), "h1", "h2", "len")
    openings = turns.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < OPENINGS)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "h1", "h2", "len")
    lent = plan.filter("borrow > 0").join(openings, "base").filter("depth <= borrow").select("conv", "depth", "h1", "h2", "len")
    nothing = F.lit(0).cast("long")
    rows = own.unionByName(lent).select(
        "conv", F.lit(False).alias("head"), "depth", "len", F.xxhash64(F.lit(1), "depth", "h1").alias("x1"), F.xxhash64(F.lit(2), "depth", "h2").alias("x2"), nothing.alias("length")
    )
    heads = plan.select("conv", F.lit(True).alias("head"), nothing.alias("depth"), nothing.alias("len"), nothing.alias("x1"), nothing.alias("x2"), "length")
    rows = heads.unionByName(rows).withColumns({"k1": F.col("x1"), "k2": F.col("x2")})
    known = segment_scan(rows, ["conv"], ["depth"], scratch, xor=("k1", "k2"), fill={"head": ["length"]})
    out = known.select(
        "conv", "depth", "len", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "k1", "k2", (F.col("depth") == F.col("length")).alias("last")
    )
    out._scratch_path = known._scratch_path
    return out


def ends_digest(rows: DataFrame) -> DataFrame:
    """depth, k1, k2, ends: SHA-256 of the sorted ids of the conversations that end at a node, joined by commas.

    The ids of a node are written as pieces where they are sorted, in as many
    ranges as they fill, and the pieces of a node pass one task one by one.
    """
    keys = ["depth", "k1", "k2"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*keys, "conv")), strict=True):
                if now != key or size > PIECE:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = now, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) >= 1000:
                yield table(out, [*keys, "first", "piece"])
                out = []
        if ids:
            out.append((*key, first, ",".join(ids)))
        if out:
            yield table(out, [*keys, "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *now, piece in zip(*(batch.column(c).to_pylist() for c in (*keys, "piece")), strict=True):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(piece.encode())
            if out:
                yield table(out, [*keys, "ends"])
        if key is not None:
            yield table([(*key, state.hexdigest())], [*keys, "ends"])

    def table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.string() if n in ("piece", "ends") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    wide = shuffle_width(rows.sparkSession)
    placed = rows.select(*keys, "conv").repartitionByRange(wide, *keys, "conv").sortWithinPartitions(*keys, "conv")
    cut = placed.mapInArrow(pieces, "depth long, k1 long, k2 long, first long, piece string")
    return cut.repartition(wide, *keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends string")


def nodes_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, depth, parent, members, len, children, ends, light: a node goes by its smallest member and its depth.

    Of a node's children that with the most members (of equal ones that with
    the smaller id) is heavy; any other has at most half of its parent's
    members, so that no way to the root has more light nodes than the
    logarithm of the number of conversations.
    """
    keys = ["depth", "k1", "k2"]
    grouped = scratch.keep(rows.groupBy(*keys).agg(F.min("conv").alias("conv"), F.count("*").alias("members"), F.min("len").alias("len"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    largest = F.max(F.struct("members", (-F.col("conv")).alias("c")))
    below = grouped.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"), (-largest["c"]).alias("heavy"))
    ends = ends_digest(rows.filter("last"))
    full = scratch.keep(grouped.join(below, keys, "left").join(ends, keys, "left").withColumn("children", F.coalesce("children", F.lit(0))))
    scratch.drop(grouped)
    told = ["members", "len", "children", "ends"]
    # a parent stands before its children and hands its id and its heavy child to them, however many they are
    up = full.select(*keys, F.lit(True).alias("above"), "conv", *told, F.col("conv").alias("parent"), F.coalesce("heavy", "conv").alias("heavy"))
    nothing = F.lit(0).cast("long")
    down = full.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(False).alias("above"), "conv", *told, nothing.alias("parent"), nothing.alias("heavy"))
    met = segment_scan(up.filter("children > 0").unionByName(down), keys, [F.col("above").desc(), "conv"], scratch, fill={"above": ["parent", "heavy"]})
    out = scratch.keep(met.filter("not above").select("conv", (F.col("depth") + 1).alias("depth"), "parent", *told, (F.col("heavy").isNull() | (F.col("heavy") != F.col("conv"))).alias("light")))
    scratch.drop(full, met)
    return out


def with_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with head, start: the id and depth of the node at which the heavy path of each begins.

    The nodes of one smallest member are a chain. Within a chain the path
    begins at the last light node so far; a chain that begins with a heavy
    node continues the path of its first node's parent. These continuations
    are followed by doubling.
    """
    one = F.lit(1).cast("long")
    local = segment_scan(nodes.withColumns({"start": F.col("depth"), "place": one}), ["conv"], ["depth"], scratch, add=("place",), fill={"light": ["start"]})
    tops = scratch.keep(local.filter("place = 1 and not light"))
    lead = tops.select(F.col("conv").alias("chain"), F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
    found = lead.join(local.select("conv", "depth", "start"), ["conv", "depth"])
    follow = scratch.keep(found.select("chain", F.when(F.col("start").isNotNull(), F.col("conv")).alias("head"), "start", F.when(F.col("start").isNull(), F.col("conv")).alias("next")))
    while not follow.filter("next is not null").isEmpty():
        then = follow.select(F.col("chain").alias("_chain"), F.col("head").alias("_head"), F.col("start").alias("_start"), F.col("next").alias("_next"))
        met = follow.join(then, F.col("next") == F.col("_chain"), "left")
        again = scratch.keep(met.select("chain", F.coalesce("head", "_head").alias("head"), F.coalesce("start", "_start").alias("start"), F.col("_next").alias("next")))
        scratch.drop(follow)
        follow = again
    own = ["conv", "depth", "parent", "members", "len", "children", "ends", "light"]
    led = tops.drop("start").join(follow.select(F.col("chain").alias("conv"), "head", "start"), "conv").select(*own, F.lit(True).alias("told"), "head", "start")
    rest = local.filter("light or place > 1").select(*own, F.col("light").alias("told"), F.col("conv").alias("head"), F.coalesce("start", F.lit(0)).alias("start"))
    out = segment_scan(led.unionByName(rest), ["conv"], ["depth"], scratch, fill={"told": ["head", "start"]})
    scratch.drop(local, tops, follow)
    return out


def subtree_sums(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with leaves, saved: summed over the subtree of each.

    Each path is summed; round by round these sums go up one light edge, to
    the parent at which a path is attached and to that parent's path; then
    sums from the end of a path on give the subtrees of its nodes.
    """
    own = nodes.drop("told").withColumns({"leaves": (F.col("children") == 0).cast("long"), "saved": (F.col("members") - 1) * F.col("len")})
    # where light children hang: the parent stands before them and hands its path to them
    nothing = F.lit(0).cast("long")
    above = own.filter("children > 1").select(F.col("conv").alias("at"), F.col("depth").alias("level"), F.lit(True).alias("above"), "conv", F.col("head").alias("path"), F.col("start").alias("top"))
    heads = own.filter("light and depth > 0").select(F.col("parent").alias("at"), (F.col("depth") - 1).alias("level"), F.lit(False).alias("above"), "conv", nothing.alias("path"), nothing.alias("top"))
    hung = segment_scan(above.unionByName(heads), ["at", "level"], [F.col("above").desc(), "conv"], scratch, fill={"above": ["path", "top"]})
    edges = hung.filter("not above").select(F.col("conv").alias("head"), (F.col("level") + 1).alias("start"), "at", "level", "path", "top")
    moving = own.groupBy("head", "start").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    gained, passed = [], []
    while True:
        step = scratch.keep(moving.join(edges, ["head", "start"]).select("at", "level", "path", "top", "leaves", "saved"))
        passed.append(step)
        if step.isEmpty():
            break
        gained.append(step.groupBy("at", "level").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        moving = step.groupBy(F.col("path").alias("head"), F.col("top").alias("start")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    if gained:
        more = reduce(DataFrame.unionByName, gained).groupBy(F.col("at").alias("conv"), F.col("level").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        own = own.join(more, ["conv", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("_leaves", "_saved")
    out = segment_scan(own, ["head", "start"], [F.col("depth").desc()], scratch, add=("leaves", "saved"))
    scratch.drop(hung, *passed)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct prefix.

    Conversations (conv_id, turn, role, text) are rebuilt first: of conv_id c
    the first h turns of c - c % 100 (all if it has fewer, none if it is not
    there), then the own turns after the first h, with h = crc32(c) % 6. Turns
    go by ``turn``, null first; rows of one turn by a digest of role and text,
    each of repeated rows being a turn. Null roles and texts are empty. Rows
    with a null conv_id belong to no conversation and are left out. For
    negative ids the remainder is negative too, so -99 to 99 share the opening of 0.
    An empty table gives no rows; further columns are not read. Turns and
    prefixes are equal when 128 bits of their hashes are.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    turns, plan = ordered_turns(conversations, scratch)
    rows = rebuilt(turns, plan, scratch)
    scratch.drop(turns)
    nodes = nodes_of(rows, scratch)
    scratch.drop(rows, plan)
    paths = with_paths(nodes, scratch)
    summed = subtree_sums(paths, scratch)
    scratch.drop(nodes, paths)
    nobody = hashlib.sha256(b"").hexdigest()
    return summed.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(nobody)).alias("ends_sha256"),
    )


SQL = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda crc, d: list_reduce(list_value(xor(crc, d), 0, 0, 0, 0, 0, 0, 0, 0), lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))) % {OPENINGS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS MATERIALIZED (SELECT c.conv_id, h, count(t.pos) AS m FROM c LEFT JOIN t ON t.conv_id = c.base AND t.pos <= h GROUP BY ALL),
r AS MATERIALIZED (
  SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT b.conv_id, t.pos - h + m, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos > h),
x AS MATERIALIZED (
  SELECT conv_id, d, length(text) AS len, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
n AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(len) AS len FROM x GROUP BY d, key),
l AS (SELECT conv_id, max(d) AS d FROM x GROUP BY conv_id),
e AS (SELECT x.d, x.key, string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) AS ids FROM x JOIN l USING (conv_id, d) GROUP BY x.d, x.key),
k AS MATERIALIZED (SELECT d - 1 AS d, key[:d - 1] AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
s AS MATERIALIZED (SELECT u.conv_id, u.d, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((v.n_convs - 1) * v.len) AS saved
  FROM n v LEFT JOIN k ON k.d = v.d AND k.key = v.key, range(0, v.d + 1) a(up) JOIN n u ON u.d = up AND u.key = v.key[:up] GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s ON s.conv_id = n.conv_id AND s.d = n.d
LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.key[:n.d - 1]
LEFT JOIN k ON k.d = n.d AND k.key = n.key
LEFT JOIN e ON e.d = n.d AND e.key = n.key
"""
