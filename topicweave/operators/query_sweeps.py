"""Retrieval by sampling: documents' topics are drawn again and again under a fixed word side, and query words are scored after each sweep."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import doc_bags
from .counts import doc_props
from .inference import BLOCK, BROADCAST_BYTES, dense, lowest, packed, prune, topic_count, word_blocks

#: Tokens of documents that are swept together, and perhaps a quarter more.
TOGETHER = 8_000_000
#: Documents up to which a step is done in plain numbers.
FEW = 16


def generator(seed: int, doc: int) -> np.random.Generator:
    """A document's own draws, so that partitions do not change them."""
    return np.random.Generator(np.random.Philox(key=[seed, doc & (2**64 - 1)]))


def sampled_counts(docs: np.ndarray, lens: np.ndarray, word: np.ndarray, side: np.ndarray, alpha: float, sweeps: int, burn: int, seed: int) -> np.ndarray:
    """Sweeps x topics x documents: the topics' counts after each of ``sweeps`` sweeps that follow ``burn`` others.

    ``word`` has the rows of ``side`` (words x topics) of the documents' tokens,
    one document after another, ``lens`` their number. Documents do not depend
    on each other, so they advance together, one token of each at a time: they
    go by length, and what stands at one place of all documents lies together.
    """
    count, topics, places = len(docs), side.shape[1], int(lens.max(initial=0))
    rank = np.argsort(-lens, kind="stable")
    at = np.empty(count, np.int64)
    at[rank] = np.arange(count)
    live = count - np.searchsorted(np.sort(lens), np.arange(places), "right")  # documents longer than a place
    start = np.concatenate([[0], np.cumsum(live)])
    ends = np.cumsum(lens)
    to = (start[np.arange(len(word)) - np.repeat(ends - lens, lens)] + np.repeat(at, lens)).astype(np.int32)
    placed = np.empty(len(word), np.int32)
    placed[to] = word
    rng = [generator(seed, int(d)) for d in docs]
    every, alone = np.arange(count), int(np.searchsorted(-live, -FEW))  # from this place on few documents are left
    few = [(i, np.flatnonzero(live[alone:] > i) + alone) for i in range(int(live[alone]) if alone < places else 0)]
    tails = [(i, start[k] + i, side[placed[start[k] + i]].tolist()) for i, k in few]
    n = np.zeros((topics, count))
    flat = n.reshape(-1)
    z = np.full(len(word), -1, np.int32)  # places in ``flat``
    drawn, u = np.empty(len(word)), np.empty(len(word))
    p, rows = np.empty((topics, count)), np.empty((count, topics))
    out = np.zeros((sweeps, topics, count))
    for r in range(burn + sweeps):
        for g, a, e in zip(rng, ends - lens, ends, strict=True):
            g.random(out=drawn[a:e])
        u[to] = drawn
        for k in range(alone):
            m, here = live[k], slice(start[k], start[k + 1])
            if r:
                flat[z[here]] -= 1
            np.take(side, placed[here], axis=0, out=rows[:m], mode="clip")
            c = np.add(n[:, :m], alpha, out=p[:, :m])
            c *= rows[:m].T
            for t in range(1, topics):
                c[t] += c[t - 1]
            new = np.add.reduce(c[:-1] < u[here] * c[-1], axis=0, dtype=np.int16).astype(np.int64) * count + every[:m]
            z[here] = new
            flat[new] += 1
        for i, at, phi in tails:
            own = n[:, i].tolist()
            z[at] = singly(own, ((z[at] - i) // count).tolist() if r else [-1] * len(at), phi, u[at].tolist(), alpha) * count + i
            n[:, i] = own
        if r >= burn:
            out[r - burn][:, rank] = n
    return out


def singly(n: list[float], old: list[int], phi: list[list[float]], u: list[float], alpha: float) -> np.ndarray:
    """The topics drawn for tokens of one document in turn, in plain numbers; ``n`` is changed."""
    drawn, last = [], len(n) - 1
    for z, row, x in zip(old, phi, u, strict=True):
        if z >= 0:
            n[z] -= 1
        total, sums = 0.0, []
        for a, b in zip(n, row, strict=True):
            total += (a + alpha) * b
            sums.append(total)
        z = min(bisect_left(sums, x * total), last)
        n[z] += 1
        drawn.append(z)
    return np.array(drawn, np.int64)


def mean_costs(counts: np.ndarray, lens: np.ndarray, asked: np.ndarray, alpha: float) -> np.ndarray:
    """Documents x words: the mean over the sweeps of ``counts`` of -ln sum_t theta phi of the rows ``asked``."""
    sweeps, topics, count = counts.shape
    out = np.zeros((count, len(asked)))
    for n in counts:
        out -= np.log((n.T + alpha) / (lens[:, None] + topics * alpha) @ asked.T)
    return out / sweeps


def query_sweeps(queries: DataFrame, tokens: DataFrame, phi: DataFrame, alpha: float, n: int, sweeps: int = 20, burn: int = 0, seed: int = 1, digits: int = 6) -> DataFrame:
    """qid, doc_id, score: the documents with the ``n`` smallest scores for each query (qid, word_id), ties by doc_id.

    A document's score is the sum over the query's words of the mean cost over
    the sweeps. Words without a row in ``phi`` are passed over, in documents
    and queries; documents without any other word have no score. A null qid,
    word or document matches nothing. A task keeps n documents of each query of
    a block; ``inference.best_documents`` merges them.
    """
    spark = phi.sparkSession
    topics = topic_count(phi)
    tokens = tokens.filter("doc_id is not null")
    docs, known = doc_bags.with_words(doc_bags.bags(tokens), tokens, packed(phi, "word_id", topics, "ph"), topics, BROADCAST_BYTES)
    side = spark.sparkContext.broadcast(known)
    wanted = queries.filter("qid is not null").select("qid", "word_id").distinct()
    blocks, found = word_blocks(wanted.count(), topics), None
    for b in range(blocks):
        some = wanted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        words, rows = dense(phi.join(some.select("word_id").distinct(), "word_id", "left_semi"), topics)
        asked = some.filter("word_id is not null").toArrow()  # bounded by the block
        qid, word = asked["qid"].to_numpy(), asked["word_id"].to_numpy()
        known = np.isin(word, words)
        qid, word = qid[known], word[known]
        order = np.argsort(qid, kind="stable")
        names, start = np.unique(qid[order], return_index=True)
        shared = spark.sparkContext.broadcast((names, start, np.searchsorted(words, word[order]), rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, start, at, rows = shared.value
            if not len(names):
                return
            ids, best = [np.zeros(0, np.int64)] * len(names), [np.zeros(0)] * len(names)
            step = max(1, BLOCK // (len(at) + len(rows)))
            for doc, lens, word, table in together(batches, side.value):
                counts = sampled_counts(doc, lens, word, table, alpha, sweeps, burn, seed)
                for k in range(0, len(doc), step):
                    cost = mean_costs(counts[:, :, k : k + step], lens[k : k + step], rows, alpha)
                    score = np.add.reduceat(cost[:, at], start, axis=1).round(digits)
                    for q in range(len(names)):
                        both, who = np.concatenate([best[q], score[:, q]]), np.concatenate([ids[q], doc[k : k + step]])
                        top = lowest(both, who, n)
                        best[q], ids[q] = both[top], who[top]
            kept = [np.repeat(names, [len(x) for x in ids]), np.concatenate(ids), np.concatenate(best)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["qid", "doc_id", "score"])

        part = docs.mapInArrow(run, "qid long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    return found


def joined(rows: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([rows, *more]) if any(map(len, more)) else rows


def together(batches: Iterator[pa.RecordBatch], side: doc_bags.Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc, lens, word, table: documents that are swept together, with the rows in ``table`` of their tokens' words; those without a known word are left out."""
    docs, lens, words, tables = [], [], [], []
    size = 0
    for batch in batches:
        for part in doc_bags.sliced(batch, TOGETHER // 4):
            row, key, cnt = doc_bags.items(part)
            known, at, more = side.places(key, part)
            tables.append(more)
            # rows that the batch brings stand after those of all batches before
            at = np.where(at < len(side.rows), at, at + sum(len(x) for x in tables[:-1]))
            words.append(np.repeat(at.astype(np.int32), cnt[known]))
            length = np.bincount(row[known], cnt[known], part.num_rows).astype(np.int64)
            docs.append(np.asarray(part.column("doc_id"))[length > 0])
            lens.append(length[length > 0])
            size += len(words[-1])
            if size >= TOGETHER:
                yield (*(np.concatenate(x) for x in (docs, lens, words)), joined(side.rows, tables))
                docs, lens, words, tables, size = [], [], [], [], 0
    if size:
        yield (*(np.concatenate(x) for x in (docs, lens, words)), joined(side.rows, tables))


def alike(lens: np.ndarray, width: int, more: int) -> Iterator[np.ndarray]:
    """Rows in order of length, in groups of at most BLOCK numbers, ``width`` for a token and ``more`` for a document, but for a longer document."""
    order, i = np.argsort(lens, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * (int(lens[order[j]]) * width + more) <= BLOCK:
            j += 1
        yield order[i:j]
        i = j


def query_topics(posterior: DataFrame, dt: DataFrame, share: float = 1e-4) -> DataFrame:
    """qid, topic, weight: the expected share of a topic in the documents of a query, small ones pruned."""
    found = dt.join(posterior.select("doc_id").distinct(), "doc_id", "left_semi")  # shares are of whole documents
    w = posterior.join(doc_props(found), "doc_id").groupBy("qid", "topic").agg(F.sum(F.col("prob") * F.col("prop")).alias("weight"))
    return prune(w, ["qid"], "weight", share)


def query_collocations(posterior: DataFrame, spans: DataFrame, share: float = 1e-4) -> DataFrame:
    """qid, term_id, weight: the expected count of a collocation in the documents of a query over the number of these, small ones pruned.

    ``spans`` has doc_id, term_id: a row for each place whose tokens have one topic.
    """
    saved = posterior.groupBy("qid").agg(F.count("*").alias("saved"))
    each = spans.groupBy("doc_id", "term_id").agg(F.count("*").alias("cnt"))
    w = posterior.join(each, "doc_id").groupBy("qid", "term_id").agg(F.sum(F.col("prob") * F.col("cnt")).alias("weight"))
    return prune(w.join(saved, "qid").select("qid", "term_id", (F.col("weight") / F.col("saved")).alias("weight")), ["qid"], "weight", share)
