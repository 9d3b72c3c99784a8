"""Near-duplicate vectors by small-world graphs, one for each shard, that every shard is searched against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..plans.durable import Scratch
from .lookups import look_up
from .near_dedup import components
from .small_world import GROUND, LINKS, ROWS, SmallWorld

#: Cosine from which vectors are linked; how far single precision may be off it.
LEAST, SLACK = 0.95, 1e-5
#: Shards, more where a shard would exceed as many vectors or components.
SHARDS, SHARD_VECTORS, SHARD_COMPONENTS = 4, 65_536, 1 << 23
#: Width of the beam at first and at most (beyond it all vectors of the shard are compared); vectors of either side by which a width is audited, and the share of their links that it must find.
BEAM, WIDEST, AUDITED, RECALL = 32, 128, 256, 0.995
#: Products held at once where all vectors of a shard are compared.
AT_ONCE = 1 << 22

GRAPH = "shard int, nodes binary, weights binary, vectors binary, links array<binary>"


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def graph(part: pd.DataFrame) -> pd.DataFrame:
    """A shard's vectors (node, weight, v) as one row, in the order of their graph."""
    part = part.sort_values("node", ignore_index=True)
    vectors = np.stack(part["v"].to_list())
    world = SmallWorld.build(unit(vectors).astype(np.float32))
    row = {"shard": int(part["shard"].iloc[0])} | {name: [part[c].to_numpy(np.int64)[world.order].tobytes()] for name, c in (("nodes", "node"), ("weights", "weight"))}
    return pd.DataFrame(row | {"vectors": [vectors[world.order].tobytes()], "links": [[x.tobytes() for x in world.links]]})


class Shard:
    """A shard as ``graph`` wrote it."""

    def __init__(self, row: pd.Series, kind: type):
        self.nodes, self.weights = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.exact = unit(np.frombuffer(row["vectors"], kind).reshape(len(self.nodes), -1))
        self.rough = self.exact.astype(np.float32)
        links = [np.frombuffer(x, np.int32) for x in row["links"]]
        self.world = SmallWorld(self.rough, np.arange(len(self.nodes)), [x.reshape(-1, GROUND if k == 0 else LINKS) for k, x in enumerate(links)])


class Forest:
    """Components of what is linked so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.root[x]
        while (up := self.root[x]).tobytes() != x.tobytes():
            x = up
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            self.root[a] = b  # of several for one root the last stays; what is left apart comes again


def exhaustive(queries: np.ndarray, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``queries`` and places in the shard of all pairs that are alike enough in single precision."""
    step = max(1, AT_ONCE // len(shard.nodes))
    for s in range(0, len(queries), step):
        row, place = np.nonzero(queries[s : s + step] @ shard.rough.T >= LEAST - SLACK)
        yield row + s, place


def candidates(queries: np.ndarray, shard: Shard, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by the graph: a query whose beam is full of such vectors gets a wider one, and all vectors of the shard beyond the widest."""
    waiting = np.arange(len(queries))
    while len(waiting) and width <= WIDEST and width < len(shard.nodes):
        full = []
        for s in range(0, len(waiting), ROWS):
            some = waiting[s : s + ROWS]
            found, product = shard.world.search(queries[some], width)
            alike = product >= LEAST - SLACK
            more = alike.all(axis=1)
            full.append(some[more])
            row, at = np.nonzero(alike & ~more[:, None])
            yield some[row], found[row, at]
        waiting, width = np.concatenate(full), 2 * width
    for row, place in exhaustive(queries[waiting], shard):
        yield waiting[row], place


def audited(left: Shard, right: Shard) -> int:
    """The least width of the beam with which vectors of both shards find their links in the right one."""
    probes = [x.rough[:: max(1, len(x.nodes) // AUDITED)] for x in ((left, right) if left is not right else (left,))]
    queries = np.concatenate(probes)
    true = sum(len(row) for row, _ in exhaustive(queries, right))
    width = BEAM
    while width <= WIDEST and sum(len(row) for row, _ in candidates(queries, right, width)) < RECALL * true:
        width *= 2
    return width


def linked(part: pd.DataFrame, kind: type) -> pd.DataFrame:
    """node, links, root for the vectors of two shards (or of one) that are linked: how many others, and the first of those they hang together with."""
    shards = [Shard(row, kind) for _, row in part.sort_values("shard").iterrows()]
    left, right = shards[0], shards[-1]
    same, offset = left is right, 0 if left is right else len(left.nodes)
    forest, links = Forest(offset + len(right.nodes)), np.zeros(offset + len(right.nodes), np.int64)
    for row, place in candidates(left.rough, right, audited(left, right)):
        if same:  # each pair once
            row, place = row[place < row], place[place < row]
        for s in range(0, len(row), 1 << 16):
            a, b = row[s : s + (1 << 16)], place[s : s + (1 << 16)]
            sure = np.einsum("ij,ij->i", left.exact[a], right.exact[b]) >= LEAST
            a, b = a[sure], b[sure]
            np.add.at(links, a, right.weights[b])
            np.add.at(links, b + offset, left.weights[a])
            forest.join(a, b + offset)
    nodes = right.nodes if same else np.concatenate([left.nodes, right.nodes])
    hit = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[hit], "links": links[hit], "root": nodes[forest.find(hit)]})


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``embeddings`` (vec_id, embedding).

    Vectors are linked at a cosine of 0.95 or more, verified in double
    precision. Equal vectors (by 128 bits of their hashes) are one from the
    start, with a weight. They are dealt into shards by hash; each shard gets
    a graph; each pair of shards is searched once, the vectors of one in the
    graph of the other, with a beam as wide as an audit against all vectors of
    the shard asks for. A link is decided in one of these searches, so both
    of its ends count it. A task holds two shards and returns, for vectors
    that are linked, counts and one edge to the component within these shards.

    Rows whose vector is null, empty, zero or holds null or non-finite
    components, and rows with a null vec_id, link with nothing: n_links is 0
    and component_id their vec_id. Vectors of unlike lengths are not compared.
    Rows that share a vec_id are vectors of their own, and count as others to
    each other where they are linked. An empty table gives no rows; further
    columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    kind = embeddings.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).withColumn("fit", usable(F.col("v")) & F.col("vec_id").isNotNull())
    keyed = rows.withColumn("key", F.when(F.col("fit"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    groups = keyed.filter("fit").groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    distinct = scratch.keep(groups.withColumn("node", F.monotonically_increasing_id()))
    deal, begin = [], 0
    for length, n in sorted(tuple(r) for r in distinct.groupBy(F.size("v")).count().collect()):  # a row for each length of vectors
        wide = max(SHARDS, -(-n // min(SHARD_VECTORS, max(1024, SHARD_COMPONENTS // length))))
        deal.append((length, begin, wide))
        begin += wide
    if not deal:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dealt = F.broadcast(spark.createDataFrame(deal, "length int, begin int, wide int"))
    sharded = distinct.join(dealt, F.size("v") == F.col("length")).select((F.col("begin") + F.pmod(F.xxhash64("node"), F.col("wide"))).cast("int").alias("shard"), "node", "weight", "v")
    graphs = scratch.keep(sharded.groupBy("shard").applyInPandas(graph, GRAPH))
    # every shard goes to each pair that it is one of
    peers = graphs.join(dealt, (F.col("shard") >= F.col("begin")) & (F.col("shard") < F.col("begin") + F.col("wide")))
    each = peers.withColumn("peer", F.explode(F.sequence("begin", F.col("begin") + F.col("wide") - 1)))
    meet = each.select(F.least("shard", "peer").alias("low"), F.greatest("shard", "peer").alias("high"), "shard", "nodes", "weights", "vectors", "links")
    kind = np.float32 if single else np.float64
    found = scratch.keep(meet.groupBy("low", "high").applyInPandas(lambda part: linked(part, kind), "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    named = labels.join(distinct.select("node", "least"), "node")
    names = scratch.keep(named.groupBy("label").agg(F.min("least").alias("component")))
    placed = look_up(labels.select("node", "label"), names, "label").select("node", "component")
    some = distinct.select("key", "node", "least", "weight").join(counts, "node", "left").join(placed, "node", "left").filter("weight > 1 or links is not null")
    told = scratch.keep(some.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")))
    out = look_up(keyed.select("vec_id", "key"), told, "key").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    scratch.drop(distinct, graphs, found, names)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
