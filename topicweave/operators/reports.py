"""Scores of words for topics, rankings, diagnostics and coherence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import counts


def scored(wt: DataFrame, kind: str, topics: int, phi: DataFrame | None = None, root: DataFrame | None = None) -> DataFrame:
    """topic, word_id, score for words with a count (or a probability, for phi and rat).

    count: n_wk. idf: (n_wk + 0.2) / (n_w + 0.2 T). cost: n_wk / n_k less what
    independence gives. q: how far a word's share of the topic is above 1 / T,
    times the word's share. phi: the probability. rat: that over the root's.
    """
    if kind == "phi":
        return phi.select("topic", "word_id", F.col("p").alias("score"))
    if kind == "rat":
        return phi.join(root.withColumnRenamed("p", "r"), "word_id").select("topic", "word_id", (F.col("p") / F.col("r")).alias("score"))
    n, w, k, total = F.col("n"), F.col("n_w"), F.col("n_k"), F.col("total")
    by_topic = counts.totals(wt, "topic", name="n_k")
    full = wt.join(counts.totals(wt, "word_id", name="n_w"), "word_id").join(F.broadcast(by_topic), "topic")  # a row for each topic
    full = full.crossJoin(F.broadcast(by_topic.agg(F.sum("n_k").alias("total"))))  # one row
    low, share = F.lit(1.0 / topics), n / w
    score = {
        "count": n.cast("double"),
        "idf": (n + 0.2) / (w + 0.2 * topics),
        "cost": n / k - (w.cast("double") * k / total) / total,
        "q": F.when(share <= low, 0.0).otherwise(w / total * (share - low) / (1 - low)),
    }[kind]
    return full.select("topic", "word_id", score.alias("score"))


def top_words(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """topic, rank, word_id, score: the largest scores; ties, after rounding, go to the smaller word_id."""
    s = scores.withColumn("score", F.round("score", digits))
    order = W.Window.partitionBy("topic").orderBy(F.col("score").desc(), "word_id")
    return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("topic", F.col("rank").cast("long").alias("rank"), "word_id", "score")


def topics_by_size(share: DataFrame) -> DataFrame:
    return share.withColumn("rank", F.row_number().over(W.Window.orderBy(F.col("n").desc(), "topic")).cast("long"))  # a row for each topic


def underused(tt: DataFrame, topics: int) -> DataFrame:
    """topic, n of topics with less than a hundredth of an even share or fewer than 5 tokens."""
    total = F.broadcast(tt.agg(F.sum("n").alias("total")))
    return tt.crossJoin(total).filter((F.col("n") * topics * 100 < F.col("total")) | (F.col("n") < 5)).select("topic", "n")


def diagnostics(wt: DataFrame, dt: DataFrame, phi: DataFrame, vocab: DataFrame, words: int, docs: int, topics: int) -> DataFrame:
    """One row for each topic: share, word and document sparsity, effective words (entropy and squares), effective
    documents, documents with much of it, distance from uniform and from the corpus, and mean word length."""
    share = counts.topic_share(counts.totals(wt, "topic")).select("topic", F.col("share").alias("p"))
    used = wt.groupBy("topic").agg((1 - F.count_if(F.col("n") > 0) / words).alias("ws"))
    used_docs = dt.groupBy("topic").agg((1 - F.count_if(F.col("n") > 0) / docs).alias("ds"))
    general = vocab.filter(F.col("word_id") < words).select("word_id", "word", (F.col("cnt") + 0.1).alias("g"))
    general = general.crossJoin(F.broadcast(general.agg(F.sum("g").alias("g_all")))).select("word_id", "word", (F.col("g") / F.col("g_all")).alias("g"))
    p = F.col("p")
    of_words = phi.join(general, "word_id").groupBy("topic").agg(
        F.exp(-F.sum(p * F.log(p))).alias("ew"),
        (1 / F.sum(p * p)).alias("ewp"),
        (1 - F.sum(F.sqrt(p / words))).alias("ud"),
        (1 - F.sum(F.sqrt(p * F.col("g")))).alias("pd"),
        F.sum(p * F.length("word")).alias("sl"),
    )
    props = counts.doc_props(dt)
    mass = props.groupBy("topic").agg(F.sum("prop").alias("mass"))
    q = F.col("prop") / F.col("mass")
    of_docs = props.join(F.broadcast(mass), "topic").groupBy("topic").agg(F.exp(-F.sum(q * F.log(q))).alias("ed"), F.count_if(F.col("prop") > 1 / topics**0.5).alias("da"))
    return share.join(used, "topic").join(used_docs, "topic").join(of_words, "topic").join(of_docs, "topic")


def further_diagnostics(rows: DataFrame, top1: DataFrame, coherence: DataFrame, pmi: DataFrame, burst: DataFrame | None = None, gamma: DataFrame | None = None, active: DataFrame | None = None, docs: int = 0) -> DataFrame:
    """``rows`` of ``diagnostics`` with t1, co, pmi and what the model has besides.

    t1: documents whose largest topic it is (topic, docs); co and pmi: its
    coherences (topic, coherence). bd: the concentration of bursts (topic, b).
    ng, ngv: the mean of a gamma weight (topic, shape, rate) over the sum of
    these means, and its deviation over its mean; nga: the share of ``docs``
    documents in which it is not active (topic, docs).
    """
    out = rows.join(top1.select("topic", F.col("docs").alias("t1")), "topic", "left").withColumn("t1", F.coalesce("t1", F.lit(0).cast("long")))
    out = out.join(coherence.select("topic", F.col("coherence").alias("co")), "topic", "left").join(pmi.select("topic", F.col("coherence").alias("pmi")), "topic", "left")
    if burst is not None:
        out = out.join(burst.select("topic", F.col("b").alias("bd")), "topic", "left")
    if gamma is not None:
        mean = F.col("shape") / F.col("rate")
        total = F.broadcast(gamma.agg(F.sum(mean).alias("all")))
        out = out.join(gamma.crossJoin(total).select("topic", (mean / F.col("all")).alias("ng"), (1 / F.sqrt("shape")).alias("ngv")), "topic", "left")
    if active is not None:
        out = out.join(active.select("topic", (1 - F.col("docs") / docs).alias("nga")), "topic", "left").withColumn("nga", F.coalesce("nga", F.lit(1.0)))
    return out


def coherence(top: DataFrame, cooc: DataFrame) -> DataFrame:
    """topic, coherence: the mean over pairs of top words of ln((D(i, j) + 1) / D(i, i)), i of the lower rank.

    ``top`` has topic, rank, word_id; ``cooc`` has w1 >= w2, docs.
    """
    return coherence_pairs(top, cooc).groupBy("topic").agg(F.avg("c").alias("coherence"))


def coherence_words(top: DataFrame, cooc: DataFrame) -> DataFrame:
    """topic, word_id, coherence: the sum of the terms of a word with those ranked before it."""
    return coherence_pairs(top, cooc).groupBy("topic", F.col("i").alias("word_id")).agg(F.sum("c").alias("coherence"))


def coherence_pairs(top: DataFrame, cooc: DataFrame) -> DataFrame:
    a = top.select("topic", F.col("rank").alias("ri"), F.col("word_id").alias("i"))
    b = top.select("topic", F.col("rank").alias("rj"), F.col("word_id").alias("j"))
    pairs = a.join(b, "topic").filter("rj < ri")  # k * k for each topic
    pairs = pairs.select("topic", "i", "j", F.greatest("i", "j").alias("w1"), F.least("i", "j").alias("w2"))
    own = cooc.filter("w1 = w2").select(F.col("w1").alias("i"), F.col("docs").alias("own"))
    both = pairs.join(cooc.withColumnRenamed("docs", "both"), ["w1", "w2"], "left").join(own, "i")
    return both.select("topic", "i", "j", F.log((F.coalesce("both", F.lit(0)) + 1) / F.col("own")).alias("c"))


def pmi_coherence(top: DataFrame, pmi: DataFrame, k: int) -> DataFrame:
    """topic, coherence: half the sum of PMI over all ordered pairs of top words, over k squared. ``pmi`` has w1 < w2, pmi; a missing pair is 0."""
    a, b = top.select("topic", F.col("word_id").alias("i")), top.select("topic", F.col("word_id").alias("j"))
    pairs = a.join(b, "topic").filter("i < j").select("topic", F.col("i").alias("w1"), F.col("j").alias("w2"))
    return pairs.join(pmi, ["w1", "w2"], "left").groupBy("topic").agg((F.coalesce(F.sum("pmi"), F.lit(0.0)) / (k * k)).alias("coherence"))


def overall_coherence(coherence: DataFrame, share: DataFrame) -> DataFrame:
    """coherence: the mean over topics (topic, coherence) weighted by their share of the tokens (topic, share)."""
    return coherence.join(share.select("topic", "share"), "topic").agg((F.sum(F.col("coherence") * F.col("share")) / F.sum("share")).alias("coherence"))


def pair_mean_coherence(top: DataFrame, pmi: DataFrame) -> DataFrame:
    """topic, coherence: the mean PMI over unordered pairs."""
    a, b = top.select("topic", F.col("word_id").alias("i")), top.select("topic", F.col("word_id").alias("j"))
    pairs = a.join(b, "topic").filter("i < j").select("topic", F.col("i").alias("w1"), F.col("j").alias("w2"))
    return pairs.join(pmi, ["w1", "w2"], "left").groupBy("topic").agg(F.avg(F.coalesce("pmi", F.lit(0.0))).alias("coherence"))


def sparsity_map(posterior: DataFrame, least: float) -> DataFrame:
    """word_id, topic, weight, perp: topics whose accumulated posterior is above ``least``, and exp of the entropy of the word's topics.

    ``posterior`` has word_id, topic, v.
    """
    v = posterior.groupBy("word_id", "topic").agg(F.sum("v").alias("weight"))
    share = F.col("weight") / F.col("total")
    stats = v.join(v.groupBy("word_id").agg(F.sum("weight").alias("total")), "word_id").groupBy("word_id").agg(F.exp(-F.sum(F.when(share > 0, share * F.log(share)))).alias("perp"))
    return v.filter(F.col("weight") > least).join(stats, "word_id")


def topic_measures(phi: DataFrame, topics: int) -> DataFrame:
    """t1 < t2, hellinger, kl, entropy of t1, over the words of ``phi`` (topic, word_id, p) that have both."""

    def measure(x: np.ndarray) -> dict[str, np.ndarray]:
        some = (x > 0).astype(float)
        log = np.log(np.where(x > 0, x, 1.0))
        own = x * log
        return {"root": np.sqrt(x).T @ np.sqrt(x), "kl": own.T @ some - x.T @ (log * some), "own": own.T @ np.ones_like(x)}

    sums = counts.pair_sums(phi, "word_id", "p", measure, topics).filter("t1 < t2")
    return sums.select("t1", "t2", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("root"))).alias("hellinger"), "kl", (-F.col("own")).alias("entropy"))


def vector_measures(pairs: DataFrame, key: list[str], p: Column, q: Column) -> DataFrame:
    """hellinger, kl and the entropy of p over each group."""
    return pairs.groupBy(*key).agg(
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(p * q)))).alias("hellinger"),
        F.sum(F.when((p > 0) & (q > 0), p * F.log(p / q)).otherwise(0.0)).alias("kl"),
        (-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"),
    )
