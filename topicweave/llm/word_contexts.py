"""Counts of word pairs over a whole corpus, and the two decisions by which a word is coded after another.

The first decision says whether a word is one of the corpus at all; if not, it
costs its spelling. The second says how much its share of the words that follow
the word before it elsewhere counts, and how much its share of all words: a
known word's probability is the mean of both shares, weighted by what the
decision is believed to be. Both decisions are predicted from contexts that
cross words, by logistic mixing that adapts within each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed, slices, word_hashes

#: Bytes of text for one bucket of pairs: buckets grow with the corpus, so that a bucket and the rate of false meetings do not.
BUCKET_BYTES = 4_000_000
#: Tokens that a task holds before it hands over its pairs.
HELD_TOKENS = 1_000_000
_PAIR = [np.uint64(x) for x in np.random.default_rng(17).integers(0, 1 << 62, 2, dtype=np.uint64) * 2 + 1]


def stream(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with an end (0) after each, the word before each (an end before the first), and the bounds of each text."""
    now = np.insert(words, bounds[1:], np.uint64(0))
    before = np.concatenate([np.zeros(1, np.uint64), now[:-1]]) if len(now) else now
    return now, before, bounds + np.arange(len(bounds))


def pair_ids(before: np.ndarray, now: np.ndarray, bits: int) -> np.ndarray:
    """bits + 32 bits for each pair, the bucket first."""
    return mixed(before * _PAIR[0] + mixed(now + np.uint64(1)) * _PAIR[1]) >> np.uint64(32 - bits)


def bucket_bits(size: int) -> int:
    return min(30, max(4, (size // BUCKET_BYTES).bit_length()))


def pair_counts(rows: DataFrame, bits: int) -> DataFrame:
    """bucket, chunk, keys, totals for rows of chunk, held_out, text.

    ``keys`` are the pairs of the chunk that training texts hold, as sorted
    32-bit places in the bucket, and ``totals`` how often they do in the whole
    corpus (``narrow``); a chunk has one row for a bucket. A pair is left out where it occurs once in the corpus' training
    texts and that is its only place in the chunk, since no other text of the
    chunk can use it. Every text counts whole; a chunk sends each of its pairs
    once, so a frequent pair meets in one task as often as there are chunks.
    """

    def blobs(chunk: int, marked: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        every = np.sort(np.concatenate(marked))  # the last bit of each says if its text is a training text
        ids = every >> np.uint64(1)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids = ids[first]
        train = np.add.reduceat((every & np.uint64(1)).astype(np.uint32), first, dtype=np.uint32)
        alone = np.diff(first, append=len(every)) == 1
        bucket = (ids >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        cut = lambda v: [p.tobytes() for p in np.split(v, start[1:])]
        yield pd.DataFrame({"bucket": bucket[start], "chunk": chunk, "keys": cut(ids.astype(np.uint32)), "train": cut(train), "alone": cut(alone)})

    def collect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, list] = {}
        held = 0
        for part in parts:
            part = part.assign(text=part["text"].fillna(""))
            for chunk, some in part.groupby("chunk", sort=False):
                for batch in slices(some):
                    words, bounds, *_ = word_hashes(batch["text"].tolist())
                    now, before, ends = stream(words, bounds)
                    own = np.repeat(~batch["held_out"].to_numpy(bool), np.diff(ends))
                    state.setdefault(chunk, []).append((pair_ids(before, now, bits) << np.uint64(1)) | own.astype(np.uint64))
                    held += len(now)
                    if held > HELD_TOKENS:
                        for c, marked in state.items():
                            yield from blobs(c, marked)
                        state, held = {}, 0
        for c, marked in state.items():
            yield from blobs(c, marked)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint32) for k in part["keys"]]
        train = [np.frombuffer(k, np.uint32) for k in part["train"]]
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(back, np.concatenate(train)).astype(np.int64)[back]
        used: dict[int, list] = {}
        at = 0
        for chunk, k, n, alone in zip(part["chunk"].tolist(), keys, train, part["alone"], strict=True):
            total = totals[at : at + len(k)]
            at += len(k)
            use = (total > 0) & ~((total == 1) & (n == 1) & np.frombuffer(alone, bool))
            if use.any():
                used.setdefault(chunk, []).append((k[use], total[use]))
        out = []
        for chunk, found in used.items():
            k, total = found[0]
            if len(found) > 1:  # the chunk's pairs were handed over in several parts
                k, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
                total = np.concatenate([f[1] for f in found])[first]
            out.append((part["bucket"].iat[0], chunk, k.tobytes(), narrow(total)))
        return pd.DataFrame(out, columns=["bucket", "chunk", "keys", "totals"])

    sent = rows.select("chunk", "held_out", "text").mapInPandas(collect, "bucket long, chunk long, keys binary, train binary, alone binary")
    return sent.groupBy("bucket").applyInPandas(merge, "bucket long, chunk long, keys binary, totals binary")


def narrow(counts: np.ndarray) -> bytes:
    """Counts, none of them negative, as bytes of the width that the largest asks for."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def widened(counts, size: int) -> np.ndarray:
    """``size`` counts of ``narrow``."""
    return np.frombuffer(counts, f"u{len(counts) // size}")


def pair_table(buckets: np.ndarray, keys: list, totals: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pair ids and their totals, of a chunk's rows of ``pair_counts``: one for a bucket, each sorted."""
    order = np.argsort(buckets).tolist()
    sizes = [len(keys[k]) // 4 for k in order]
    width = max((len(totals[k]) // n for k, n in zip(order, sizes, strict=True)), default=1)
    ids, counts, at = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), f"u{width}"), 0
    for k, n in zip(order, sizes, strict=True):
        ids[at : at + n] = np.frombuffer(keys[k], np.uint32)
        ids[at : at + n] |= np.uint64(buckets[k]) << np.uint64(32)
        counts[at : at + n] = widened(totals[k], n)
        at += n
    return ids, counts


def grouped(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, the place of each token's among them, and how often the token's text has it."""
    order = np.argsort(ids, kind="stable")  # texts stay in order within an id
    there = ids[order]
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))[order]
    new = np.ones(len(ids), bool)
    new[1:] = there[1:] != there[:-1]
    run = new.copy()
    run[1:] |= text[1:] != text[:-1]
    start = np.flatnonzero(run)
    sizes = np.diff(start, append=len(ids))
    place, inside = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    inside[order] = np.repeat(sizes, sizes)
    return there[new], place, inside


def found(table: np.ndarray, totals: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The total of each of ``ids`` in a sorted table (0 where it is missing), and its place there."""
    at = np.minimum(np.searchsorted(table, ids), max(len(table) - 1, 0))
    return (np.where(table[at] == ids, totals[at].astype(np.int64), 0) if len(table) else np.zeros(len(ids), np.int64)), at


#: Steps by doubling of the counts that are contexts: of the word before, and of the pair before.
WORD_LEVELS, PAIR_LEVELS = 16, 8
#: What happened at a token: it was spelled, known by itself, or known after the word before.
SPELLED, KNOWN, FOLLOWS = 0, 1, 2
#: Features but for the odds of the two shares, which have what 16 bits leave: steps of an octave, the step of even odds, and all (2**-32 to 2**23).
MARKS = WORD_LEVELS * PAIR_LEVELS * 3
ODDS_STEPS, ODDS_ONE, ODDS_CODES = 3, 98, (1 << 16) // MARKS - 1
ODDS = np.concatenate([[0], 2.0 ** ((np.arange(1, ODDS_CODES + 1) - ODDS_ONE) / ODDS_STEPS)])


def levels(count: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float32))[1], most - 1)


def coded(word: np.ndarray, pair: np.ndarray, train: np.ndarray, bounds: np.ndarray, ends: int, tokens: int, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every token (16 bits), and log10 of its share of what follows the word before, or of all words, or of its spelling.

    Features of a word that follows say also how likely it is as any word
    (``odds``), since both shares are its probability. ``word`` and ``pair`` are the counts of each token and of it after the one
    before in all other training texts: a training text's own occurrences
    (``train`` is 1) are taken out, so that no text is known by itself.
    """
    sizes = np.diff(bounds)
    document = np.repeat(np.arange(len(sizes)), sizes)
    before = np.concatenate([np.zeros(1, np.int64), word[:-1]])
    before[bounds[:-1]] = ends - train
    word, before = np.maximum(word, 0), np.maximum(before, 0)
    pair = np.clip(pair, 0, np.minimum(before, word))  # a false meeting of ids promises no more than the words allow
    rest = np.maximum(tokens - train * sizes, 1)[document]
    follows = pair > 0
    state = follows.astype(np.int64) + (word > 0)  # what follows is a word of the corpus
    left = np.where(state == SPELLED, spelled, np.log10(np.where(follows, pair, np.maximum(word, 1)) / np.where(follows, before, rest)))
    last = np.concatenate([np.zeros(1, np.int64), pair[:-1]])
    last[bounds[:-1]] = 0
    marks = (levels(before, WORD_LEVELS) * PAIR_LEVELS + levels(last, PAIR_LEVELS)) * 3 + state
    other = np.log2(np.maximum(word, 1) / rest) - np.log2(np.maximum(pair, 1) / np.maximum(before, 1))
    code = np.clip(np.rint(other * ODDS_STEPS).astype(np.int64) + ODDS_ONE, 1, ODDS_CODES)
    return (marks + MARKS * np.where(follows, code, 0)).astype(np.uint16), left


def odds(features: np.ndarray) -> np.ndarray:
    """For each token that follows: its share of all words over its share of the words after the one before; 0 for others."""
    code = features // np.uint16(MARKS)
    return ODDS[code]


#: Places of the tables of one decision's predictors: the last eight follows, the last five states, the counts before with states, and recent follows.
PLACES = (256, 243, WORD_LEVELS * 9, WORD_LEVELS * PAIR_LEVELS * 3, 33 * WORD_LEVELS)
STARTS = np.concatenate([[0], np.cumsum(PLACES)])
TABLE = int(STARTS[-1])
INPUTS = len(PLACES) + 1
GATES = (9, WORD_LEVELS)
BUCKETS = 33
PRIOR, CLIP = 0.4, 8.0
#: Rate of the mixer; tokens after which weights change, at first and beyond LATER tokens; weight of what refinement knows before a document.
RATE, STEP, LATER, LONG_STEP, TRUST = 0.001, 64, 4096, 256, 16.0
#: Documents of a stream, in which weights are learned one token after another; streams of a group, which advance together.
STREAM_DOCUMENTS, STREAMS = 128, 16
#: Steps of 1 in which weights are summed, as whole numbers, so that their sums have no order.
FINE = 1 << 20


def decisions(features: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the first and the second decision: the tokens that have it, its places (predictors x tokens), gates (2 x tokens) and values."""
    features = (features % np.uint16(MARKS)).astype(np.int16)  # all that is made of them is below 2**15
    state, rest = features % 3, features // 3
    last, before = rest % PAIR_LEVELS, rest // PAIR_LEVELS
    at = np.arange(len(state), dtype=np.int32)
    deep = np.minimum(at - np.repeat(bounds[:-1].astype(np.int32), np.diff(bounds)), 32).astype(np.int16)

    def back(k: int) -> np.ndarray:
        out = np.zeros_like(state)
        out[k:] = state[: len(state) - k] if k < len(state) else 0
        return out * (deep >= k)

    follows, states = np.zeros_like(state), np.zeros_like(state)
    for k in range(8, 0, -1):
        b = back(k)
        follows = follows * 2 + (b == FOLLOWS)
        if k <= 5:
            states = states * 3 + b
    sums = np.concatenate([[0], np.cumsum(state == FOLLOWS, dtype=np.int32)]).astype(np.int32)
    recent = (sums[:-1] - sums[at - deep]).astype(np.int16)
    places = np.stack([follows, states, before * 9 + states % 9, (before * PAIR_LEVELS + last) * 3 + states % 3, recent * WORD_LEVELS + before]) + STARTS[:-1, None].astype(np.int16)
    gates = np.stack([states % 9, before])
    yield at, places, gates, state != SPELLED
    second = np.flatnonzero((state != SPELLED) & (before > 0))  # after a word that no other text has, nothing is known to follow
    yield second, places.take(second, axis=1), gates.take(second, axis=1), state[second] == FOLLOWS


def place_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """slot, all, ones: how often each place of both decisions' tables was met, and with a one. Whole numbers, so that their sums have no order."""
    seen, ones = np.zeros(2 * TABLE, np.int64), np.zeros(2 * TABLE, np.int64)
    for part in parts:
        for features, bounds in batches(part):
            for k, (_, places, _, value) in enumerate(decisions(features, bounds)):
                for p in places:
                    seen[k * TABLE : (k + 1) * TABLE] += np.bincount(p, minlength=TABLE)
                    ones[k * TABLE : (k + 1) * TABLE] += np.bincount(p[value], minlength=TABLE)
    slot = np.flatnonzero(seen)
    yield pd.DataFrame({"slot": slot, "all": seen[slot], "ones": ones[slot]})


def batches(part: pd.DataFrame, tokens: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of some documents one after another, with their bounds."""
    held, size = [], 0
    for f in part["features"]:
        held.append(np.frombuffer(f, np.uint16))
        size += len(held[-1])
        if size >= tokens:
            yield np.concatenate(held), np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)


class Start:
    """What a document starts from: tables, weights of both gates, and the refinement, for one decision."""

    def __init__(self, seen: np.ndarray, ones: np.ndarray):
        self.stretch = np.clip(np.log((ones + PRIOR) / (seen - ones + PRIOR)), -CLIP, CLIP).astype(np.float32)
        self.weights = [np.full((g, INPUTS), 0.1, np.float32) for g in GATES]
        self.hits = np.zeros((3 * BUCKETS, 2), np.float32)

    def run(self, places: np.ndarray, gates: np.ndarray, value: np.ndarray, bounds: np.ndarray, odds: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The natural logarithm of the probability of every value, and weights and refinement of each document after it.

        With ``odds``, what is a one may come from a zero too, so many times as
        likely as from a one, and its probability is the sum of both ways.

        Each document has its own weights and refinement, which follow what
        happens in it, a step of tokens at a time; steps depend on the place in
        the document alone, so a result does not depend on other documents.
        """
        out = np.zeros(len(value))
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], bounds[:-1][order]
        weights = [np.tile(w.T, (1, len(sizes))) for w in self.weights]  # inputs x (documents and gates)
        ones, seen = (np.tile(h, len(sizes)) for h in (self.hits * np.float32(TRUST) / np.maximum(self.hits[:, 1:], TRUST)).T)
        at, longest = 0, sizes[0] if len(sizes) else 0
        while at < longest:
            step = STEP if at < LATER else LONG_STEP
            active = int(np.searchsorted(-sizes, -at, "left"))
            n = np.minimum(sizes[:active] - at, step)
            who = np.repeat(np.arange(active), n)
            t = np.repeat(starts[:active] + at - np.cumsum(n) + n, n) + np.arange(len(who))
            xs, v = [*(self.stretch.take(p.take(t)) for p in places), np.float32(0.3)], value.take(t)
            gate = [g.take(t) for g in gates]
            rows = [who * size + g for size, g in zip(GATES, gate, strict=True)]
            logit = np.zeros(len(t), np.float32)
            for k in range(INPUTS):
                logit += (weights[0][k].take(rows[0]) + weights[1][k].take(rows[1])) * xs[k]
            logit = np.clip(logit, -12, 12)
            p = 1 / (1 + np.exp(-logit.astype(np.float64)))
            cell = (who * 3 + gate[0] % 3) * BUCKETS + np.rint((logit + 12) * ((BUCKETS - 1) / 24)).astype(np.int64)
            both = np.clip((p + (ones.take(cell) + 8 * p) / (seen.take(cell) + 8)) / 2, 1e-6, 1 - 1e-6)
            out[t] = np.where(v, both if odds is None else both + (1 - both) * odds.take(t), 1 - both)
            error = RATE * (v - p)
            for k in range(INPUTS):
                moved = error * xs[k]
                for w, r, size in zip(weights, rows, GATES, strict=True):
                    w[k, : active * size] += np.bincount(r, moved, active * size).astype(np.float32)
            m = active * 3 * BUCKETS
            ones[:m] += np.bincount(cell, v, m).astype(np.float32)
            seen[:m] += np.bincount(cell, minlength=m).astype(np.float32)
            at += step
        return np.log(out), [np.ascontiguousarray(w.T) for w in weights], np.stack([ones, seen], axis=1)


def stream_sums(seen: np.ndarray, ones: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """For both decisions: the weights after one pass over some documents, and how often what happened at like predictions.

    The documents are a few streams, each one text; weights are summed over
    streams by their tokens and come as whole numbers (``FINE``), before the
    sum of tokens.
    """
    out = []
    streams = max(1, min(STREAMS, len(features) // STREAM_DOCUMENTS))
    sizes = np.array([len(f) for f in features])
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    edges = bounds[np.arange(streams + 1) * len(features) // streams]
    for k, (tokens, places, gates, value) in enumerate(decisions(np.concatenate(features), bounds)):
        start = Start(seen[k * TABLE : (k + 1) * TABLE], ones[k * TABLE : (k + 1) * TABLE])
        own = np.searchsorted(tokens, edges)
        _, weights, hits = start.run(places, gates, value, own)
        mass = np.sort(np.diff(own))[::-1]  # ``run`` has the longest first
        summed = [np.rint(w.reshape(streams, -1).astype(float) * FINE * mass[:, None]).astype(np.int64).sum(axis=0) for w in weights]
        counted = hits.reshape(streams, -1).astype(np.int64).sum(axis=0)
        out += [*summed, [mass.sum()], counted]
    return np.concatenate(out)


def starts_of(seen: np.ndarray, ones: np.ndarray, flat: np.ndarray) -> list[Start]:
    """Both decisions' starts: the tables as given, and the means and sums of what ``stream_sums`` returned."""
    starts = [Start(seen[k * TABLE : (k + 1) * TABLE], ones[k * TABLE : (k + 1) * TABLE]) for k in (0, 1)]
    a, b = (g * INPUTS for g in GATES)
    for s, own in zip(starts, np.split(flat, 2), strict=True):
        if mass := own[a + b]:
            mean = (own[: a + b] / (float(FINE) * mass)).astype(np.float32)
            s.weights = [mean[:a].reshape(-1, INPUTS), mean[a:].reshape(-1, INPUTS)]
        s.hits = own[a + b + 1 :].reshape(-1, 2).astype(np.float32)
    return starts


def learned(seen: np.ndarray, ones: np.ndarray, some: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[Start]:
    """Both decisions' starts from the features and bounds of some documents, as one group."""
    return starts_of(seen, ones, stream_sums(seen, ones, [f for features, bounds in some for f in np.split(features, bounds[1:-1])]))


def bits_log10(starts: list[Start], features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 of the probability of the decisions of each document, and of the other way to the words that follow: what is added to ``coded``'s shares."""
    out = np.zeros(len(bounds) - 1)
    for s, other, (tokens, places, gates, value) in zip(starts, (None, odds(features)), decisions(features, bounds), strict=True):
        own = np.searchsorted(tokens, bounds)
        cost, *_ = s.run(places, gates, value, own, None if other is None else other[tokens])
        out += np.bincount(np.repeat(np.arange(len(out)), np.diff(own)), cost, len(out)) / np.log(10)
    return out


def learn_starts(features: DataFrame, documents: int) -> list[Start]:
    """The starts, from the features of all training documents (doc_id, features): tables, weights and refinement.

    Documents go by hash into groups, more with their number. Each group learns
    for itself, in streams; the start has the means of all streams' weights and
    the sums of all refinements.
    """
    table = features.select("features").mapInPandas(place_counts, "slot long, all long, ones long").groupBy("slot").agg(F.sum("all").alias("all"), F.sum("ones").alias("ones")).toPandas()  # a row for each place
    seen, ones = np.zeros(2 * TABLE), np.zeros(2 * TABLE)
    seen[table["slot"]], ones[table["slot"]] = table["all"], table["ones"]
    by = F.xxhash64("doc_id", F.col("features"))
    groups = max(1, -(-documents // (STREAMS * STREAM_DOCUMENTS)))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("by", kind="stable")
        flat = stream_sums(seen, ones, [np.frombuffer(f, np.uint16) for f in part["features"]])
        return pd.DataFrame({"slot": np.arange(len(flat)), "v": flat})

    dealt = features.select("features", by.alias("by")).withColumn("group", F.pmod("by", F.lit(groups)))
    rows = dealt.groupBy("group").applyInPandas(train, "slot long, v long").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()  # a row for each number of a start
    flat = rows.sort_values("slot")["v"].to_numpy() if len(rows) else np.zeros(2 * (sum(GATES) * INPUTS + 1 + 6 * BUCKETS), np.int64)
    return starts_of(seen, ones, flat)
