"""Scores of whole texts by logistic mixing of hashed-context bit predictors, beside a unigram base.

Words are coded one after another by shares whose weights are mixed from
contexts that cross words (``word_contexts``): what follows the word before is
counted over the whole corpus. Words that no other text has are spelled bit by bit from contexts
within the word, whose tables are of letters and keep their size.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch, shuffle_width
from .shingles import cuts, mixed, per_text, powers, slices, word_hashes
from .word_contexts import FINE, bits_log10, bucket_bits, coded, found, grouped, learn_starts, narrow, pair_counts, pair_ids, pair_table, stream, widened

#: Bits of the table of each predictor. Its context is the last byte, two, three, four, or the whole word so far.
TABLES = (16, 17, 18, 19, 20)
#: Added to both counts of a bit; largest stretched probability.
PRIOR, CLIP = 0.4, 8.0
#: Words of a step of the mixer; its rate; words of a partition that counts bits; words, about, of a group that learns weights for itself.
STEP_WORDS, RATE, PART_WORDS, GROUP_WORDS = 500, 0.05, 1_000_000, 200_000
#: Words whose bits are worked on at once, so that they stay in a processor's cache.
CACHED_WORDS = 1000
#: Places of the mixer's first gate (places in a word times bits of a byte); buckets of the refinement.
PLACES, BUCKETS = 8, 33
#: Steps, by doubling, of how often a context was seen.
LEVELS = 8
#: Parts into which one file split is dealt, so that a dictionary and its texts fit a worker.
PARTS_OF_SPLIT = 1
#: Most frequent words whose scores are broadcast; the others go where they are used.
COMMON = 1 << 16
#: Words that a task holds before it deals them to their chunks; the bucket that marks such rows among those of pairs.
DEALT_WORDS, WORDS_OF_CHUNK = 500_000, -1
#: The bytes that end a word and a text. Neither is in a word.
SPACE, END = b" ", b"\n"

SIZES = [1 << b for b in TABLES]
BASES = np.concatenate([[0], np.cumsum(SIZES)])
INPUTS = len(TABLES) + 1
GATES = (PLACES * 8, 3 * LEVELS * LEVELS)
_SALT = [np.uint64(x) for x in np.random.default_rng(11).integers(0, 1 << 62, 2 * len(TABLES), dtype=np.uint64) * 2 + 1]


@dataclass
class Bits:
    """Every bit of some words: slots of its contexts, place gate, value, and the word to which it belongs."""

    slots: np.ndarray  # inputs x bits
    gate: np.ndarray
    value: np.ndarray
    owner: np.ndarray


def bits_of(words: list[bytes]) -> Bits:
    coded = [w + SPACE if w else END for w in words]
    lengths = np.array([len(c) for c in coded])
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(data))
    place = at - start
    context = [np.zeros(len(data), np.uint64)]
    for k in range(1, 5):
        before = np.where(place >= k, data[np.maximum(at - k, 0)] + np.uint64(1), 0).astype(np.uint64)
        context.append(context[-1] * np.uint64(257) + before)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up, out=total[1:])
    context = [*context[1:], (total[at] - total[start]) * down[start] + np.uint64(1)]
    shift = np.arange(8, dtype=np.uint64)
    node = ((np.uint64(1) << shift) | (data[:, None] >> (np.uint64(8) - shift))).astype(np.uint64)
    value = ((data[:, None] >> (np.uint64(7) - shift)) & np.uint64(1)).astype(np.float32)
    slots = np.empty((len(TABLES), len(data), 8), np.int64)
    for k, bits in enumerate(TABLES):
        hashed = mixed(context[k] * _SALT[2 * k])
        slots[k] = ((((hashed[:, None] + node) * _SALT[2 * k + 1]) >> np.uint64(64 - bits)) + np.uint64(BASES[k])).astype(np.int64)
    gate = np.minimum(place, PLACES - 1)[:, None] * 8 + np.arange(8)
    owner = np.repeat(np.arange(len(words)), lengths * 8)
    return Bits(slots.reshape(len(TABLES), -1), gate.ravel(), value.ravel(), owner)


@dataclass
class Mixer:
    """Two sets of weights, chosen by the place of the bit and by how well its longest contexts are known, and a refinement by what happened at like predictions."""

    weights: list[np.ndarray]
    hits: np.ndarray  # gate of the bit in its byte x bucket x (ones, all)

    @classmethod
    def new(cls) -> Mixer:
        first = np.full((GATES[0], INPUTS), 0.15)
        return cls([first, np.full((GATES[1], INPUTS), 0.15)], np.zeros((8, BUCKETS, 2)))

    @classmethod
    def size(cls) -> int:
        return sum(GATES) * INPUTS + 8 * BUCKETS * 2

    def flat(self) -> np.ndarray:
        return np.concatenate([*(w.ravel() for w in self.weights), self.hits.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Mixer:
        a, b = GATES[0] * INPUTS, GATES[1] * INPUTS
        return cls([flat[:a].reshape(-1, INPUTS), flat[a : a + b].reshape(-1, INPUTS)], flat[a + b :].reshape(8, BUCKETS, 2))

    def inputs(self, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched probabilities with a constant, and the second gate: how often the last two contexts were seen, and if the last has seen both bits."""
        x = np.empty((INPUTS, zeros.shape[1]), np.float32)
        x[:-1] = np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -CLIP, CLIP)
        x[-1] = 0.3
        seen = np.minimum(np.log2(zeros[-2:] + ones[-2:] + 1), LEVELS - 1).astype(np.int64)
        both = (zeros[-1] > 0).astype(np.int64) + (ones[-1] > 0)
        return x, (both * LEVELS + seen[0]) * LEVELS + seen[1]

    def mix(self, x: np.ndarray, gates: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros(x.shape[1], np.float32)
        for w, g in zip(self.weights, gates, strict=True):
            w = np.ascontiguousarray(w.T, np.float32)
            for k in range(INPUTS):
                out += w[k].take(g) * x[k]
        return np.clip(out, -12, 12)

    @staticmethod
    def bucket(logit: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((logit + 12) * (BUCKETS - 1) / 24), 0, BUCKETS - 1).astype(np.int64)

    def refined(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The probability of a one: the mean of the mixed one and of the share of ones at like predictions."""
        p = 1 / (1 + np.exp(-logit))
        at = (gate % 8) * BUCKETS + self.bucket(logit)
        ones, seen = (self.hits[..., k].ravel().take(at) for k in (0, 1))
        return np.clip((p + (ones + 8 * p) / (seen + 8)) / 2, 1e-6, 1 - 1e-6)


def online(words: Iterator[tuple[list[bytes], np.ndarray]], zeros: np.ndarray, ones: np.ndarray) -> tuple[Mixer, float]:
    """The mixer after one pass over words with their counts, step by step; the sum of counts.

    A word is predicted from the counts of all other occurrences: its own one
    is taken out of them.
    """
    mixer, mass = Mixer.new(), 0.0
    speed = [np.full_like(w, 1e-4) for w in mixer.weights]
    for some, count in words:
        b = bits_of(some)
        n0, n1 = zeros[b.slots], ones[b.slots]
        n1 = np.maximum(n1 - b.value, 0)
        n0 = np.maximum(n0 - (1 - b.value), 0)
        x, seen = mixer.inputs(n0, n1)
        gates = (b.gate, seen)
        logit = mixer.mix(x, gates)
        weight = count[b.owner]
        error = weight * (b.value - 1 / (1 + np.exp(-logit)))
        for w, s, g, size in zip(mixer.weights, speed, gates, GATES, strict=True):
            total = np.maximum(np.bincount(g, weight, size), 1e-9)
            for k in range(INPUTS):
                slope = np.bincount(g, error * x[k], size) / total
                s[:, k] += slope * slope
                w[:, k] += RATE * slope / np.sqrt(s[:, k])
        at = (b.gate % 8) * BUCKETS + mixer.bucket(logit)
        mixer.hits[..., 0] += np.bincount(at, weight * b.value, 8 * BUCKETS).reshape(8, BUCKETS)
        mixer.hits[..., 1] += np.bincount(at, weight, 8 * BUCKETS).reshape(8, BUCKETS)
        mass += float(count.sum())
    return mixer, mass


def log10_of(words: list[bytes], zeros: np.ndarray, ones: np.ndarray, mixer: Mixer, own: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each word, after ``own`` counts of it are taken out."""
    b = bits_of(words)
    n0, n1 = zeros.take(b.slots), ones.take(b.slots)
    if own is not None:
        mine = own.astype(np.float32).take(b.owner)
        n0, n1 = np.maximum(n0 - mine * (1 - b.value), 0), np.maximum(n1 - mine * b.value, 0)
    x, seen = mixer.inputs(n0, n1)
    p = mixer.refined(mixer.mix(x, (b.gate, seen)), b.gate)
    return np.bincount(b.owner, np.log10(np.where(b.value > 0, p, 1 - p)), len(words))


def steps(parts: Iterator[pd.DataFrame], size: int = STEP_WORDS) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for part in parts:
        words, counts = part["word"].tolist(), part["c"].to_numpy(float)
        for k in range(0, len(words), size):
            yield words[k : k + size], counts[k : k + size]


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of (hash, n, place), with the sums of n and one place of each."""
    hashes, n, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(hashes)
    hashes = hashes[order]
    start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    return hashes[start], np.add.reduceat(n[order], start) if len(start) else n, place[order][start]


def split_words(docs: DataFrame) -> DataFrame:
    """hash, word, n, chunk: each distinct word of each chunk of texts and its training occurrences. The end is the empty word, of hash 0."""

    def rows(chunk: int, buffers: list, found: list) -> Iterator[pd.DataFrame]:
        hashes, n, place = merged(found)
        for k in range(0, len(hashes), 50_000):
            at = place[k : k + 50_000]
            which, at = np.where(at < 0, -1, at >> 32), at & 0xFFFFFFFF
            starts, stops = np.zeros_like(at), np.zeros_like(at)
            for w in np.unique(which[which >= 0]).tolist():
                mine = which == w
                starts[mine], stops[mine] = buffers[w][1][at[mine]], buffers[w][2][at[mine]]
            words = [buffers[w][0][x:y] if w >= 0 else b"" for w, x, y in zip(which.tolist(), starts.tolist(), stops.tolist(), strict=True)]
            yield pd.DataFrame({"hash": hashes[k : k + 50_000].view(np.int64), "word": words, "n": n[k : k + 50_000], "chunk": chunk})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple[list, list]] = {}
        size = 0
        for part in parts:
            part = part.assign(text=part["text"].fillna(""))
            for chunk, some in part.groupby("chunk", sort=False):
                buffers, found = state.setdefault(chunk, ([], []))
                for batch in slices(some):
                    train = ~batch["held_out"].to_numpy()
                    words, bounds, data, first, last = word_hashes(batch["text"].tolist())
                    n = np.repeat(train, np.diff(bounds)).astype(np.int64)
                    found.append(merged([(words, n, (len(buffers) << 32) + np.arange(len(words)))]))
                    found.append((np.zeros(1, np.uint64), np.array([train.sum()]), np.array([-1])))
                    buffers.append((data, first, last))
                    size += len(data)
            if size > 64_000_000:
                for chunk, (buffers, found) in state.items():
                    yield from rows(chunk, buffers, found)
                state, size = {}, 0
        for chunk, (buffers, found) in state.items():
            yield from rows(chunk, buffers, found)

    return docs.select("chunk", "held_out", "text").mapInPandas(run, "hash long, word binary, n long, chunk long")


@dataclass
class Model:
    zeros: np.ndarray
    ones: np.ndarray
    mixer: Mixer


def learn(vocabulary: DataFrame, words: int) -> Model:
    """The tables and the mixer from all distinct training words (hash, word, c), each once.

    Words go by hash into groups of about ``GROUP_WORDS``, each of which learns
    weights for itself; the mixer has their means and the sums of refinements.
    Only words that no other text has are spelled, so words count and not their
    occurrences. The tables hold statistics of letters and keep their size.
    """
    spark = vocabulary.sparkSession
    width = max(1, min(shuffle_width(spark), -(-words // PART_WORDS)))
    types = vocabulary.filter("c > 0").select("hash", "word", F.lit(1).alias("c"))
    known = types.coalesce(width)  # a task sends a table's worth of slots at most
    groups = max(1, -(-words // GROUP_WORDS))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BASES[-1]))
        flat = sums.reshape(-1)
        for some, counts in steps(parts, CACHED_WORDS):
            b = bits_of(some)
            np.add.at(flat, (b.slots + b.value.astype(np.int64) * BASES[-1]).ravel(), np.tile(counts[b.owner], len(TABLES)))
        slot = np.flatnonzero(sums.any(axis=0))
        for k in range(0, len(slot), 100_000):
            s = slot[k : k + 100_000]
            yield pd.DataFrame({"slot": s.astype(np.int32), "a": sums[0, s], "b": sums[1, s]})

    table = known.mapInPandas(count, "slot int, a double, b double").groupBy("slot").agg(F.sum("a").cast("float").alias("a"), F.sum("b").cast("float").alias("b"))
    rows = table.toArrow()  # of all tables, whose size is fixed
    slot = rows["slot"].to_numpy()
    zeros, ones = np.zeros(BASES[-1], np.float32), np.zeros(BASES[-1], np.float32)
    zeros[slot], ones[slot] = rows["a"].to_numpy(), rows["b"].to_numpy()
    del rows, slot
    tables = spark.sparkContext.broadcast((zeros, ones))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        mixer, mass = online(steps([part.sort_values("hash")]), *tables.value)
        flat = np.concatenate([*(np.rint(w.ravel() * FINE * mass) for w in mixer.weights), np.rint(mixer.hits.ravel()), [mass]])
        return pd.DataFrame({"slot": np.arange(len(flat)), "v": flat.astype(np.int64)})  # whole numbers, so that their sums have no order

    rows = types.groupBy(F.pmod("hash", F.lit(groups))).applyInPandas(train, "slot long, v long").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()  # a row for each number of a mixer
    if not len(rows):
        return Model(zeros, ones, Mixer.new())
    flat = rows.sort_values("slot")["v"].to_numpy(float)
    flat[: sum(GATES) * INPUTS] /= FINE * flat[-1]
    return Model(zeros, ones, Mixer.of(flat[:-1]))


def read_only(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table as it is read, with columns chosen or rows filtered at most, so that each row knows its file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def score(docs: DataFrame, parts_of_split: int = PARTS_OF_SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.

    All words and all pairs of neighbouring words of texts that are not held
    out are counted; ``score`` is the probability of the text word after word,
    its end included, from the counts of all other training texts: a training
    text's own occurrences are taken out, so only what stands elsewhere too is
    known. The base keeps the text's own occurrences, as it is defined. Counts
    grow with the corpus and meet each chunk of texts (a part of a file split)
    by joins; words that are among a bounded number of frequent ones go to all.
    Weights start from those learned on all training words and documents, in
    groups by hash whose means are taken, and adapt within each document;
    a frame that is more than a table read from files is written first, and
    results do not depend on the number of partitions. Null texts count as
    empty: one end. With nothing to learn from, the base is that of no counts.
    Repeated rows are learned and scored each, as different texts; an empty
    table gives no rows; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not read_only(docs):
        slim = scratch.keep(slim)
    chunk = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id"), F.lit(parts_of_split)))
    rows = slim.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), chunk.alias("chunk"))
    # a list holds a number for each chunk at most
    vocabulary = scratch.keep(split_words(rows).groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("c"), F.collect_set("chunk").alias("chunks"), F.count_if(F.col("n") > 0).alias("holders")))
    total, distinct, words = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = bucket_bits(size)
    model = learn(vocabulary.select("hash", "word", "c"), words)
    shared = spark.sparkContext.broadcast(model)

    def price(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            spelled = part.column("holders").to_numpy() < 2  # others are in another text, wherever they are scored
            words, own = part.column("word").filter(pa.array(spelled)).to_pylist(), np.minimum(part.column("c").to_numpy(), 1)[spelled]
            some = [log10_of(words[k : k + CACHED_WORDS], m.zeros, m.ones, m.mixer, own[k : k + CACHED_WORDS]) for k in range(0, len(words), CACHED_WORDS)]
            cost = np.zeros(len(spelled), np.float32)
            cost[spelled] = np.concatenate([np.zeros(0), *some])
            yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("c"), pa.array(cost), part.column("chunks")], ["hash", "c", "cost", "chunks"])

    priced = scratch.keep(vocabulary.mapInArrow(price, "hash long, c long, cost float, chunks array<long>"))
    scratch.drop(vocabulary)
    del vocabulary
    spark._jvm.System.gc()  # lets Spark remove the shuffle files of what is written and no longer read
    border = priced.select("c").orderBy(F.col("c").desc()).limit(COMMON).agg(F.min("c"), F.count("*")).first()
    border = border[0] if border[1] == COMMON else -1
    common = priced.filter(F.col("c") > border).select("hash", "c", "cost").toArrow()  # fewer than COMMON words
    everywhere = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("hash", "c", "cost")))
    width = "chunk long, bucket long, keys binary, totals binary, costs binary"

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk its words: their hashes, counts and costs, some at a time."""

        def rows_of(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            chunk, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            start = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])[: len(chunk)])
            cut = [[narrow(p) if k == 1 else p.tobytes() for p in np.split(c[order], start[1:])] for k, c in enumerate(columns)]
            return pd.DataFrame({"chunk": chunk[start], "bucket": WORDS_OF_CHUNK, "keys": cut[0], "totals": cut[1], "costs": cut[2]})

        held, size = [], 0
        for part in parts:
            lists = part.column("chunks")
            times = np.diff(lists.offsets.to_numpy())
            held.append((lists.flatten().to_numpy(zero_copy_only=False), *(np.repeat(part.column(c).to_numpy(zero_copy_only=False), times) for c in ("hash", "c", "cost"))))
            size += len(held[-1][0])
            if size > DEALT_WORDS:
                yield pa.RecordBatch.from_pandas(rows_of(held), preserve_index=False)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pandas(rows_of(held), preserve_index=False)

    dictionary = priced.filter(F.col("c") <= border).mapInArrow(deal, width)
    # written, so that what they are made of is gone before they meet whole texts
    counts = scratch.keep(dictionary.unionByName(pair_counts(rows, bits).withColumn("costs", F.lit(None).cast("binary"))))
    scratch.drop(priced)
    del priced, dictionary
    gc.collect()
    spark._jvm.System.gc()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, bytes long, left double, features binary"
    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known")), ("base_score", pa.float64()), ("bytes", pa.int64()), ("left", pa.float64()), ("features", pa.binary())])

    def features(part: pa.Table, counted: pa.Table) -> pa.Table:
        bucket = counted["bucket"].to_numpy()
        keys, totals, costs = ([x.as_buffer() for x in counted[c]] for c in ("keys", "totals", "costs"))
        own, sent = np.flatnonzero(bucket == WORDS_OF_CHUNK).tolist(), np.flatnonzero(bucket != WORDS_OF_CHUNK).tolist()
        hashes, seen, cost = everywhere.value
        hashes = np.concatenate([hashes, *(np.frombuffer(keys[k], np.int64) for k in own)]).view(np.uint64)
        order = np.argsort(hashes)
        known = hashes[order]
        seen = np.concatenate([seen, *(widened(totals[k], len(keys[k]) // 8).astype(np.int64) for k in own)])[order]
        cost = np.concatenate([cost, *(np.frombuffer(costs[k], np.float32) for k in own)])[order]
        base = np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
        ids, times = pair_table(bucket[sent], [keys[k] for k in sent], [totals[k] for k in sent])
        del counted, keys, totals, costs, hashes, order
        out = []
        size = pc.fill_null(pc.binary_length(part["text"]), 0).to_numpy().astype(np.int64)
        for a, b in cuts(size):
            some = part.slice(a, b - a)
            words, bounds, *_ = word_hashes([t or "" for t in some["text"].to_pylist()])
            now, before, ends = stream(words, bounds)
            train = 1 - some["held_out"].to_numpy().astype(np.int64)
            own = np.repeat(train, np.diff(ends))
            distinct_words, place, inside = grouped(now, ends)
            c, at = found(known, seen, distinct_words)
            if (known[at] != distinct_words).any():
                raise ValueError("a text has a word that its chunk did not have before")
            at = at[place]
            word = c[place] - own * inside
            distinct_pairs, place, inside = grouped(pair_ids(before, now, bits), ends)
            pair = found(ids, times, distinct_pairs)[0][place] - own * inside
            marks, left = coded(word, pair, train, ends, int(seen[0]), total, cost[at])
            sums = lambda v, at=at, ends=ends: per_text(np.add, v[at], ends, 0)
            cut = [marks[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            out.append(pa.table([some["doc_id"], some["held_out"], np.diff(ends), sums((seen > 0).astype(np.int64)), sums(base), size[a:b], per_text(np.add, left.astype(float), ends, 0), pa.array(cut, pa.binary())], schema=empty))
        return pa.concat_tables(out) if out else empty.empty_table()

    coded_texts = scratch.keep(rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(features, schema))
    scratch.drop(counts)
    del counts
    gc.collect()
    spark._jvm.System.gc()  # the counts have met their texts
    training = coded_texts.filter("NOT held_out")
    starts = spark.sparkContext.broadcast(learn_starts(training, training.count()))

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            k = 0
            while k < len(part):
                n, tokens = k, 0
                while n < len(part) and (n == k or tokens < 200_000):
                    tokens += part["n_tokens"].iat[n]
                    n += 1
                some, k = part.iloc[k:n], n
                marks = np.concatenate([np.frombuffer(f, np.uint16) for f in some["features"]])
                score = some["left"].to_numpy() + bits_log10(starts.value, marks, np.concatenate([[0], np.cumsum(some["n_tokens"].to_numpy())]))
                yield some[["doc_id", "held_out", "n_tokens", "n_known"]].assign(train_tokens=total, base_score=some["base_score"], score=score, bits_per_byte=-score / math.log10(2) / some["bytes"].clip(lower=1))

    return coded_texts.mapInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
