"""Co-occurrence of words and pointwise mutual information."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import doc_bags

#: Pairs that a task holds before it sums equal ones, and returns them.
HELD_PAIRS = 4_000_000


def summed_pairs(each: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]):
    """A function over batches of documents (column ws) that returns w1 < w2, c, equal pairs summed in the task. ``each`` yields pairs of a document with their counts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def told() -> pd.DataFrame:
            w1, w2, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((w2, w1))
            w1, w2, c = w1[order], w2[order], c[order]
            start = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            return pd.DataFrame({"w1": w1[start], "w2": w2[start], "c": np.add.reduceat(c, start)})

        for part in parts:
            for ws in part["ws"]:
                for some in each(np.asarray(ws, np.int64)):
                    held.append(some)
                    size += len(some[0])
                    if size > HELD_PAIRS:
                        yield told()
                        held, size = [], 0
        if size:
            yield told()

    return run


def document_pairs(tokens: DataFrame, least: int = 1) -> DataFrame:
    """w1, w2, c with w1 < w2: pairs of words that at least ``least`` documents hold both, and how many do. Words in fewer documents are left out before they meet.

    A document's words are one row; its pairs are made and summed where it is, and sums of tasks meet.
    """
    seen = tokens.select("doc_id", "word_id").distinct()
    if least > 1:
        seen = seen.join(seen.groupBy("word_id").agg(F.count("*").alias("df")).filter(F.col("df") >= least).select("word_id"), "word_id")

    def each(ws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(0, len(ws), step := max(1, HELD_PAIRS // max(len(ws), 1))):
            i, j = np.nonzero(np.arange(k, min(k + step, len(ws)))[:, None] < np.arange(len(ws))[None, :])
            yield ws[i + k], ws[j], np.ones(len(i), np.int64)

    rows = seen.groupBy("doc_id").agg(F.sort_array(F.collect_list("word_id")).alias("ws")).select("ws")  # words of one document
    return rows.mapInPandas(summed_pairs(each), "w1 long, w2 long, c long").groupBy("w1", "w2").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def following(ws: np.ndarray) -> np.ndarray:
    """For each place that of the next use of its word; a place far away where there is none."""
    order = np.lexsort((np.arange(len(ws)), ws))
    out = np.full(len(ws), np.iinfo(np.int64).max // 2)
    same = ws[order][1:] == ws[order][:-1]
    out[order[:-1][same]] = order[1:][same]
    return out


def window_pairs(tokens: DataFrame, width: int, last_word: int | None = None) -> DataFrame:
    """w1, w2, c with w1 < w2: how many windows of ``width`` tokens hold both. A document has a window from every token on that leaves one whole, or a single shorter one.

    A window counts for the last uses of both words in it, at places p < q:
    it begins at p or before, ends at q or after, and ends before either word
    is used again. So the windows of a pair of places are a difference, and
    only places nearer than ``width`` are compared. Words after ``last_word``
    keep their places and make no pairs.
    """

    def each(ws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        wide = min(width, len(ws))
        again = following(ws)
        able = np.ones(len(ws), bool) if last_word is None else ws <= last_word
        for d in range(1, wide):
            p = np.arange(len(ws) - d)
            q = p + d
            last = np.minimum.reduce([p, again[p] - wide, again[q] - wide, np.full(len(p), len(ws) - wide)])
            c = last - np.maximum(q - wide + 1, 0) + 1
            some = (c > 0) & (ws[p] != ws[q]) & able[p] & able[q]
            x, y = ws[p[some]], ws[q[some]]
            yield np.minimum(x, y), np.maximum(x, y), c[some]

    return ordered_words(tokens).mapInPandas(summed_pairs(each), "w1 long, w2 long, c long").groupBy("w1", "w2").agg(F.sum("c").alias("c"))


def frequent_window_pairs(tokens: DataFrame, width: int, least: int, words: DataFrame) -> DataFrame:
    """window_pairs of ``least`` windows or more; ``words`` has word_id, n of window_counts. A word in fewer windows makes no such pair, nor do those after the last that is in enough: where ids are ranks, these are nearly all."""
    last = words.filter(F.col("n") >= least).agg(F.max("word_id")).first()[0]
    return window_pairs(tokens, width, -1 if last is None else last).filter(F.col("c") >= least)


def ordered_words(tokens: DataFrame) -> DataFrame:
    """ws: the words of each document in order, gathered where its tokens lie. Words and places are below 2**31."""

    def kernel(batch: pa.RecordBatch, row: np.ndarray, key: np.ndarray, cnt: np.ndarray) -> pa.RecordBatch:
        lens = np.bincount(row, cnt, batch.num_rows).astype(np.int64)
        return pa.RecordBatch.from_arrays([doc_bags.lists(lens, np.repeat(key & ((1 << 32) - 1), cnt))], names=["ws"])

    return doc_bags.over(doc_bags.bags(tokens, "shiftleft(cast(pos as bigint), 32) + word_id"), kernel, "ws array<long>", HELD_PAIRS)


def window_counts(tokens: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """word_id, n: windows that hold a word; and the number of all windows (one row, windows)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held = []
            for ws in part["ws"]:
                ws = np.asarray(ws, np.int64)
                wide, again, p = min(width, len(ws)), following(ws), np.arange(len(ws))
                c = np.minimum.reduce([p, again - wide, np.full(len(p), len(ws) - wide)]) - np.maximum(p - wide + 1, 0) + 1
                held.append((ws, np.maximum(c, 0)))
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            yield pd.DataFrame({"word_id": words, "n": np.bincount(at, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)})

    words = ordered_words(tokens).mapInPandas(run, "word_id long, n long").groupBy("word_id").agg(F.sum("n").alias("n"))
    lengths = tokens.groupBy("doc_id").agg(F.count("*").alias("len"))
    return words, lengths.agg(F.sum(F.greatest(F.col("len") - width + 1, F.lit(1))).alias("windows"))


def pmi(pairs: DataFrame, marginals: DataFrame, windows: int, alpha: float = 0.0, sigma: float = 0.0, normalise: bool = False) -> DataFrame:
    """w1, w2, pmi from pair counts, word counts (word_id, n) and the number of windows.

    ``alpha`` is added to the word counts. ``sigma`` moves all counts that many
    deviations towards independence, and past it a pair is independent.
    ``normalise`` divides by -ln of the pair's share of the windows.
    """
    a = marginals.select(F.col("word_id").alias("w1"), (F.col("n") + alpha).alias("n1"))
    b = marginals.select(F.col("word_id").alias("w2"), (F.col("n") + alpha).alias("n2"))
    both = pairs.join(a, "w1").join(b, "w2").withColumn("c", F.col("c").cast("double"))
    total = F.lit(float(windows))
    ratio = lambda c, n1, n2: (c / total) / ((n1 / total) * (n2 / total))
    value = ratio(F.col("c"), F.col("n1"), F.col("n2"))
    if sigma:
        less = [F.col(x) - sigma * F.sqrt(x) for x in ("c", "n1", "n2")]
        more = [F.col(x) + sigma * F.sqrt(x) for x in ("c", "n1", "n2")]
        lower = F.greatest(F.lit(1.0), ratio(less[0], more[1], more[2]))
        upper = F.when((less[1] <= 0) | (less[2] <= 0), 1.0).otherwise(F.least(F.lit(1.0), ratio(more[0], less[1], less[2])))
        value = F.when(value > 1, lower).otherwise(upper)
    score = F.log(value)
    return both.select("w1", "w2", (score / -F.log(F.col("c") / total) if normalise else score).alias("pmi"))


def strong_pairs(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """w1, w2, v: pairs in both directions, and words with themselves, with c * c >= threshold * c11 * c22, over the sum of what is kept of w2.

    ``own`` has word_id, n: the diagonal.
    """
    a, b = own.toDF("w1", "n1"), own.toDF("w2", "n2")
    kept = pairs.join(a, "w1").join(b, "w2").filter(F.col("c") * F.col("c") >= threshold * F.col("n1") * F.col("n2")).select("w1", "w2", "c")
    both = kept.unionByName(kept.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "c"))
    if threshold <= 1:
        both = both.unionByName(own.filter("n > 0").select(F.col("word_id").alias("w1"), F.col("word_id").alias("w2"), F.col("n").alias("c")))
    total = both.groupBy("w2").agg(F.sum("c").alias("total"))
    return both.join(total, "w2").select("w1", "w2", (F.col("c") / F.col("total")).alias("v"))


def prior_from_counts(vocab: DataFrame, external: DataFrame, alpha: float = 4.0, power: float = 1.0, subtract: bool = False) -> DataFrame:
    """word_id, weight: (cnt + alpha) ** power of an external count by lower-cased word, 0 where it has none; the own count taken out first if asked."""
    e = external.groupBy(F.lower("word").alias("_w")).agg(F.sum("cnt").alias("ext"))
    n = F.coalesce("ext", F.lit(0))
    n = F.greatest(n - F.col("cnt"), F.lit(0)) if subtract else n
    return vocab.join(e, F.lower("word") == F.col("_w"), "left").select("word_id", F.pow(n + alpha, F.lit(power)).alias("weight"))


def prior_from_self(bag: DataFrame, words: int, alpha: float = 4.0, power: float = 1.0) -> DataFrame:
    """word_id, weight for every id of 0 .. words - 1: (count + alpha) ** power."""
    every = bag.sparkSession.range(words).select(F.col("id").alias("word_id"))
    n = bag.groupBy("word_id").agg(F.sum("cnt").alias("n"))
    return every.join(n, "word_id", "left").select("word_id", F.pow(F.coalesce("n", F.lit(0)) + alpha, F.lit(power)).alias("weight"))


def unigram_perplexity(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """log2 of the perplexity of tokens under weights (word_id, weight), normalised."""
    total = F.broadcast(weights.agg(F.sum("weight").alias("total")))
    return tokens.join(weights, "word_id").crossJoin(total).agg((-F.avg(F.log2(F.col("weight") / F.col("total")))).alias("log2_perplexity"), F.count("*").alias("tokens"))
