"""Near duplicates by an LSH forest over min-hash signatures, finished by an exact join."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import Scratch, shuffle_width
from .prefix_join import like_pairs
from .shingles import minima, set_digests, shingle_sets, slices

#: Sorted orders; those of a first round; min-hashes of one, the longest prefix; the shortest prefix that makes neighbours.
TREES, ROUND_TREES, DEPTH, LEAST_PREFIX = 12, 4, 8, 2
#: Rows of a region whose texts are all compared. A larger one is divided by the next min-hash of the prefix.
REGION = 24
#: Single bytes of min-hashes by which a pair is estimated; how many must agree. At a similarity of 0.75, 48 are expected, and 31 or fewer once in a million.
SKETCH, AGREE = 64, 32
#: Links hold at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Ids that may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Sets that are written and meet at one time: so many bytes, or this share of all sets if that is more.
SLICE_BYTES, SLICE_SHARE = 64 << 20, 0.1

#: Texts for each file of the small tables: pairs, links and labels, a few numbers for a text.
FILE_TEXTS = 20_000

COLUMNS = ["kind", "a", "b", "agree", "place", "tree", "prefix", "rep", "label", "sketch"]
PAIRS = "kind int, a long, b long, agree int, place int, tree int, prefix binary, rep long, label long, sketch binary"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, signature (big-endian min-hashes), sketch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, TREES * DEPTH // SKETCH)
        for part in parts:
            for some in slices(part.assign(text=part["text"].fillna(""))):
                values, bounds = shingle_sets(some["text"].tolist())
                low = minima(values, bounds, TREES * DEPTH)
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].astype("Int64").to_numpy(),
                        "n_shingles": np.diff(bounds),
                        "digest": set_digests(values, bounds),
                        "signature": [x.tobytes() for x in low.astype(">u4")],
                        "sketch": [x.tobytes() for x in (low[:, ::step][:, :SKETCH] & 0xFF).astype(np.uint8)],
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, digest binary, signature binary, sketch binary")


def forest(reps: DataFrame, trees: range) -> DataFrame:
    """A row for each text and order: tree, prefix (the min-hashes by which it is sorted), rep, label, sketch."""
    width = 4 * DEPTH
    orders = F.transform(F.sequence(F.lit(trees[0]), F.lit(trees[-1])), lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * width + 1, F.lit(width)).alias("prefix")))
    return reps.select("rep", "label", "sketch", F.explode(orders).alias("o")).select("o.tree", "o.prefix", "rep", "label", "sketch")


def regions(tree: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each sorted row the first row of its region.

    The longest common prefix of neighbours says how deep each pair of them
    stays together. A region is a run that shares LEAST_PREFIX min-hashes; one
    of more than REGION rows is taken at the next depth, as often as needed,
    so that every region has the depth that its crowd asks for. What is still
    crowded at the full depth stays one region.
    """
    n = len(tree)
    common = np.zeros(n, np.int64)
    common[1:] = np.cumprod(prefix[1:] == prefix[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
    first, settled = np.arange(n), np.zeros(n, bool)
    for depth in range(LEAST_PREFIX, DEPTH + 1):
        start = common < depth
        group = np.cumsum(start) - 1
        now = ~settled & ((np.bincount(group)[group] <= REGION) | (depth == DEPTH))
        first[now] = np.flatnonzero(start)[group[now]]
        settled |= now
    return first


def near(rows: pd.DataFrame, fresh: int, best: bool) -> pd.DataFrame:
    """Pairs (a, b, agree) of sorted rows from ``fresh`` on with rows of other labels before them in their region, all or for each row the most alike.

    In a region that is crowded at the full depth a row meets the REGION - 1
    before it; the exact join finds what else is linked there.
    """
    tree, rep, label = (rows[c].to_numpy() for c in ("tree", "rep", "label"))
    prefix = np.frombuffer(b"".join(rows["prefix"]), ">u4").reshape(len(rows), DEPTH)
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
    first = regions(tree, prefix) if len(rows) else np.zeros(0, np.int64)
    found, at = [], np.arange(max(fresh, 1), len(rows))
    for d in range(1, REGION):
        at = at[at - d >= first[at]]
        if not len(at):
            break
        other = at[label[at] != label[at - d]]
        agree = (sketch[other] == sketch[other - d]).sum(axis=1)
        hit = other[agree >= AGREE]
        found.append(pd.DataFrame({"row": hit, "a": np.minimum(rep[hit], rep[hit - d]), "b": np.maximum(rep[hit], rep[hit - d]), "agree": agree[agree >= AGREE]}))
    out = pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "a", "b", "agree")})
    if best:
        out = out.sort_values("agree", ascending=False, kind="stable").drop_duplicates("row")
    return out.drop(columns="row")


def small(rows: DataFrame, texts: int) -> DataFrame:
    """``rows``, a few numbers for each of ``texts``, in files that are as many as the texts ask for and not as many as a shuffle has partitions."""
    return rows.coalesce(max(1, math.ceil(texts / FILE_TEXTS)))


def candidates(reps: DataFrame, trees: range, best: bool, scratch: Scratch) -> DataFrame:
    """a, b, agree: pairs of texts of unlike labels that are neighbours in some order and agree in enough bytes of their sketches.

    The orders are sorted together in ranges, by all min-hashes of a prefix,
    so that a region where many share the first ones is ordered by the next.
    A range also returns its first and last rows, by which the pairs across
    its bounds are found.
    """
    spark = reps.sparkSession
    texts = reps.count()
    ranges = max(1, min(shuffle_width(spark), texts * len(trees) // 2000))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, head, tail = TaskContext.get().partitionId(), None, None

        def bound(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
            return rows.assign(kind=kind, a=0, b=0, agree=0, place=place)[COLUMNS]

        for part in parts:
            fresh = 0 if tail is None else len(tail)
            both = part if tail is None else pd.concat([tail, part], ignore_index=True)
            head = both.head(REGION) if head is None or len(head) < REGION else head
            yield near(both, fresh, best).assign(kind=0, place=0, tree=0, prefix=b"", rep=0, label=0, sketch=b"")[COLUMNS]
            tail = both.tail(REGION)
        if head is not None:
            yield bound(head, 1)
            yield bound(tail, 2)

    order = ("tree", "prefix", "rep")
    ordered = forest(reps, trees).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = scratch.keep(ordered.mapInPandas(run, PAIRS))
    pairs = found.filter("kind = 0").select("a", "b", "agree")
    places = sorted(r[0] for r in found.filter("kind = 1").select("place").distinct().collect())  # a number for each range
    if len(places) > 1:
        after = spark.createDataFrame(list(zip(places, range(len(places)), strict=True)), "place int, number int")
        # the last rows of a range stand before the first of the next
        edges = found.filter("kind > 0").join(F.broadcast(after), "place").withColumn("bound", F.col("number") + F.when(F.col("kind") == 2, 1).otherwise(0))

        def across(part: pd.DataFrame) -> pd.DataFrame:
            part = part.assign(late=part["kind"] == 1).sort_values(["late", *order], ignore_index=True)
            fresh = int((~part["late"]).sum())
            return near(part, fresh if fresh else len(part), best)

        pairs = pairs.unionByName(edges.groupBy("bound").applyInPandas(across, "a long, b long, agree int"))
    out = scratch.keep(small(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), texts))
    scratch.drop(found)
    return out


def most_alike(pairs: DataFrame) -> DataFrame:
    """a, b: for each text the pair in which most agrees, of equal ones that with the smallest id."""
    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = each.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("c"))).alias("m")).select("a", (-F.col("m.c")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(named: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, shingles of the documents that ``named`` (rep) has: each set is hashed once."""
    few = F.broadcast(named) if named.count() <= BROADCAST_IDS else named

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in slices(part.assign(text=part["text"].fillna(""))):
                values, bounds = shingle_sets(some["text"].tolist())
                yield pd.DataFrame({"rep": some["rep"].to_numpy(), "shingles": [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(few, "rep", "left_semi")
    return scratch.keep(texts.mapInPandas(run, "rep long, shingles binary"))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold. ``sets`` has rep and shingles."""
    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = np.zeros(len(part), bool)
            for i, (x, y) in enumerate(part[["x", "y"]].itertuples(index=False)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                met = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * met >= PERCENT * (len(p) + len(q) - met) and met > 0
            yield part.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, set_bytes: float, all_bytes: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold, written.

    A pair brings two sets, of ``set_bytes`` in the mean, to one place. Pairs
    go in slices by hash, so that the sets that are on disk at one time stay a
    share of all sets however many pairs there are.
    """
    spark = docs.sparkSession
    count = pairs.count()
    slices_ = max(1, math.ceil(2 * count * set_bytes / max(SLICE_BYTES, SLICE_SHARE * all_bytes)))
    links = []
    for k in range(slices_):
        some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(slices_)) == k)
        ids = some.select(F.col("a").alias("rep")).unionByName(some.select(F.col("b").alias("rep"))).distinct()
        named = scratch.keep(small(ids, 2 * count // slices_))
        sets = sets_of(named, docs, scratch)
        scratch.drop(named)
        links.append(scratch.keep(confirm(some, sets)))
        scratch.drop(sets)
        del sets
        forget(spark)
    if len(links) == 1:
        return links[0]
    out = scratch.keep(reduce(DataFrame.unionByName, links))
    scratch.drop(*links)
    return out


def relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: the distinct pairs of unlike labels that ``links`` join; a node without a label (node, label) is its own."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    both = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return both.filter("a < b").distinct()


def components(links: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """node, label for the nodes of ``links`` (a, b): the smallest node of the component.

    Labels shrink to the smallest among a node's neighbours and then to the
    label of their label, until nothing changes; each round is written.
    ``known`` has node, label of earlier links and stays in the result: its
    components are nodes here, so that only links between them are followed.
    """
    if known is not None:
        between = scratch.keep(small(relabelled(links, known), links.count()))
        merged = components(between, scratch)
        after = merged.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        old = known.join(after, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
        out = scratch.keep(small(old.unionByName(merged.join(known.select("node"), "node", "left_anti")), known.count()))
        scratch.drop(merged, between)
        return out
    many = links.count()
    edges = scratch.keep(small(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), many))
    labels = scratch.keep(small(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), many))
    while True:
        best = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("best"))
        lower = labels.join(best, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = scratch.keep(small(lower.join(jump, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", F.coalesce("_l", "label")).alias("label")), many))
        changed = not new.filter("label < old").isEmpty()
        scratch.drop(labels)
        labels = new.select("node", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            scratch.drop(edges)
            return labels


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is written and no longer read, which else stay until the driver's memory runs short."""
    gc.collect()
    spark._jvm.System.gc()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Words are lower-cased (A-Z); a set holds the 5-word shingles, or all words
    as one where there are fewer. Documents are linked when their sets have
    a similarity of 0.75 or more; component_id is the smallest doc_id reachable.
    Equal sets (by a 128-bit digest of all their shingles) are one text from
    the start. In rounds, each with some of the orders of the forest, every
    text's most alike candidate in another component is confirmed on the full
    sets; then an exact join finds all pairs of other components that may be
    linked, so that no link between components is lost. Null, empty and blank texts have no
    shingles and are linked with nothing; rows with a null doc_id have a null
    component_id. Rows that share a doc_id are one document with several
    texts. An empty table gives no rows; columns besides doc_id and text are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    forget(docs.sparkSession)
    full = scratch.keep(signatures(docs))
    alike = full.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "signature", "sketch")).alias("r"))
    reps = scratch.keep(alike.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.signature").alias("signature"), F.col("r.sketch").alias("sketch")))
    table = scratch.keep(full.select("doc_id", "n_shingles", "digest"))
    texts, shingles = full.agg(F.count_if(F.col("n_shingles") > 0), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    scratch.drop(full)
    del full, alike
    labels, links, tried = None, [], []
    for k in range(0, TREES + 1, ROUND_TREES):
        last = k >= TREES
        if last:  # signatures have done their part
            signed, reps = reps, scratch.keep(reps.select("digest", "rep"))
            scratch.drop(signed)
            del signed
        forget(docs.sparkSession)
        known = reps.withColumn("label", F.col("rep")) if labels is None else reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        found = like_pairs(docs, known, PERCENT, scratch) if last else candidates(known, range(k, k + ROUND_TREES), True, scratch)
        forget(docs.sparkSession)
        pairs = found if last else most_alike(found)
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(scratch.keep(small(pairs, texts)))
        scratch.drop(found)
        del pairs
        forget(docs.sparkSession)
        links.append(confirmed(tried[-1], docs, 8 * shingles / max(texts, 1), 8 * shingles, scratch))
        if labels is None or not links[-1].isEmpty():
            before, labels = labels, components(links[-1], scratch, labels)
            if before is not None:
                scratch.drop(before)
            del before
        del known, found
    scratch.drop(*tried, *links)
    classes = reps.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("_label"))
    # a row without shingles has no class; it goes by its own id, so that such rows are not one key
    rows = table.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).otherwise(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")).alias("digest"))
    out = rows.join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("_label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; its columns are unchanged."""
    gone = Scratch(docs.sparkSession, "near-dedup").keep(near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("_kept")).filter("not _kept").select("doc_id"))
    forget(docs.sparkSession)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
