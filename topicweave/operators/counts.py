"""Count tables of a topic assignment and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans.durable import Scratch
from ..plans.ranking import running_sum


def word_topic(z: DataFrame) -> DataFrame:
    return z.groupBy("word_id", "topic").agg(F.count("*").alias("n"))


def doc_topic(z: DataFrame) -> DataFrame:
    return z.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


def totals(table: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return table.groupBy(*keys).agg(F.sum("n").alias(name))


def table_counts(wt: DataFrame) -> DataFrame:
    """topic, customers, tables, nonzero: one table wherever there is a customer, and the rollups."""
    t = F.when(F.col("n") > 0, 1).otherwise(0)
    return wt.groupBy("topic").agg(F.sum("n").alias("customers"), F.sum(t).alias("tables"), F.count_if(F.col("n") > 0).alias("nonzero"))


def clamp_tables(table: DataFrame) -> DataFrame:
    """Table counts t repaired to 1 <= t <= n where n > 0, else 0."""
    return table.withColumn("t", F.when(F.col("n") > 0, F.least("n", F.greatest("t", F.lit(1)))).otherwise(0).cast("long"))


def corrected_active(active: DataFrame, dt: DataFrame) -> DataFrame:
    """doc_id, topic: the active topics of documents that have tokens, and with them every topic that has a count there."""
    used = dt.filter("n > 0").select("doc_id", "topic")
    kept = active.select("doc_id", "topic").join(used.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.unionByName(used).distinct()


def topic_share(tt: DataFrame) -> DataFrame:
    """topic, n, share; ``tt`` has topic and n."""
    total = tt.agg(F.sum("n").alias("total"))
    return tt.crossJoin(F.broadcast(total)).select("topic", "n", (F.col("n") / F.col("total")).alias("share"))  # one row against a row for each topic


def doc_props(dt: DataFrame) -> DataFrame:
    """doc_id, topic, prop."""
    return dt.join(totals(dt, "doc_id", name="len"), "doc_id").select("doc_id", "topic", (F.col("n") / F.col("len")).alias("prop"))


def top_topic(dt: DataFrame) -> DataFrame:
    """doc_id, topic: the largest count, of equal ones the lowest topic."""
    return dt.groupBy("doc_id").agg((-F.max(F.struct("n", (-F.col("topic")).alias("m")))["m"]).alias("topic"))


def top_docs(dt: DataFrame) -> DataFrame:
    return top_topic(dt).groupBy("topic").agg(F.count("*").alias("docs"))


def nonzero(wt: DataFrame, dt: DataFrame) -> DataFrame:
    a = wt.filter("n > 0").agg(F.count("*").alias("word_cells"))
    return a.crossJoin(dt.filter("n > 0").agg(F.count("*").alias("doc_cells")))


def pair_sums(table: DataFrame, key: str, value: str, measure: Callable[[np.ndarray], dict[str, np.ndarray]], topics: int) -> DataFrame:
    """t1, t2 and what ``measure`` makes of rows by topics (topics x topics each), summed over all keys of ``table`` (key, topic, value).

    The topics of a key are one row, and a task sums its rows, so that no pair of topics is a row before that.
    """
    rows = table.groupBy(key).agg(F.collect_list(F.struct(F.col("topic").cast("int").alias("topic"), F.col(value).cast("double").alias("v"))).alias("r")).select(F.transform("r", lambda x: x["topic"]).alias("at"), F.transform("r", lambda x: x["v"]).alias("v"))  # topics of one key
    names = list(measure(np.zeros((0, topics))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            full = np.zeros((len(part), topics))
            lens = part["at"].map(len).to_numpy()
            if lens.sum():
                full[np.repeat(np.arange(len(part)), lens), np.concatenate(part["at"].to_list())] = np.concatenate(part["v"].to_list())
            new = measure(full)
            total = new if total is None else {k: total[k] + new[k] for k in names}
        if total is not None:
            i, j = np.indices((topics, topics)).reshape(2, -1)
            yield pd.DataFrame({"t1": i, "t2": j} | {k: total[k].ravel() for k in names})

    out = rows.mapInPandas(run, "t1 long, t2 long, " + ", ".join(f"{k} double" for k in names))
    return out.groupBy("t1", "t2").agg(*(F.sum(k).alias(k) for k in names))


def topic_correlation(dt: DataFrame, docs: int) -> DataFrame:
    """t1, t2 < t1, cor: the mean over documents of the product of shares, over the product of their means; pairs that share a document."""
    p = doc_props(dt)
    mean = p.groupBy("topic").agg((F.sum("prop") / docs).alias("m"))
    topics = int(dt.agg(F.max("topic")).first()[0] or 0) + 1
    sums = pair_sums(p, "doc_id", "prop", lambda x: {"pp": x.T @ x}, topics).filter("t2 < t1 and pp > 0").withColumn("pp", F.col("pp") / docs)
    return sums.join(mean.toDF("t1", "m1"), "t1").join(mean.toDF("t2", "m2"), "t2").select("t1", "t2", (F.col("pp") / (F.col("m1") * F.col("m2"))).alias("cor"))


def topic_by_class(z: DataFrame, classes: DataFrame) -> DataFrame:
    """topic, class, n; ``classes`` has doc_id and class."""
    return z.groupBy("doc_id", "topic").agg(F.count("*").alias("n")).join(classes, "doc_id").groupBy("topic", "class").agg(F.sum("n").alias("n"))


def class_entropy(tc: DataFrame) -> DataFrame:
    """topic, entropy (bits) of its classes."""
    p = F.col("n") / F.col("total")
    return tc.join(totals(tc, "topic", name="total"), "topic").groupBy("topic").agg((-F.sum(F.when(F.col("n") > 0, p * F.log2(p)))).alias("entropy"))


def cooccurrence(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """w1 >= w2, docs: documents that hold both of the given words; the diagonal is the document frequency."""
    seen = tokens.join(words.select("word_id").distinct(), "word_id", "left_semi").select("doc_id", "word_id").distinct()
    a, b = seen.toDF("doc_id", "w1"), seen.toDF("doc_id", "w2")
    return a.join(b, "doc_id").filter("w1 >= w2").groupBy("w1", "w2").agg(F.count("*").alias("docs"))


def one_topic_spans(z: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, term_id, topic: spans (doc_id, pos, len, term_id) whose tokens all have one topic."""
    inside = spans.withColumn("at", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)))
    met = inside.select("doc_id", F.col("pos").alias("start"), "len", "term_id", F.col("at").alias("pos")).join(z, ["doc_id", "pos"])
    one = met.groupBy("doc_id", "start", "len", "term_id").agg(F.min("topic").alias("topic"), F.max("topic").alias("m"), F.count("*").alias("k"))
    return one.filter("topic = m and k = len").select("doc_id", "term_id", "topic")


def next_word_spans(z: DataFrame) -> DataFrame:
    """doc_id, term_id, topic: words and the next ones that have one topic; term_id is 2**32 times the first word, plus the second.

    A document's tokens meet once, in order. Where a document has two tokens
    at one place, each is taken with each at the next.
    """
    order = W.Window.partitionBy("doc_id").orderBy("pos")
    here = z.select("doc_id", "pos", F.struct("word_id", "topic").alias("x"))
    after = F.collect_list("x").over(order.rangeBetween(1, 1))  # the tokens at the next place
    met = here.withColumn("_after", after).withColumn("y", F.explode("_after")).filter("x.topic = y.topic")
    return met.select("doc_id", (F.col("x.word_id") * 4294967296 + F.col("y.word_id")).alias("term_id"), F.col("x.topic").alias("topic"))


def term_topics(z: DataFrame, spans: DataFrame) -> DataFrame:
    """term_id, topic, n: of how many spans (doc_id, pos, len, term_id) all tokens have the topic."""
    return one_topic_spans(z, spans).groupBy("term_id", "topic").agg(F.count("*").alias("n"))


def bursts(z: DataFrame) -> DataFrame:
    """tokens, multi, tables, multi_tables: tokens of words repeated in their document, and a table for each (document, word, topic)."""
    cell = z.groupBy("doc_id", "word_id", "topic").agg(F.count("*").alias("n"))
    word = cell.groupBy("doc_id", "word_id").agg(F.sum("n").alias("c"), F.count("*").alias("t"))
    many = F.col("c") > 1
    return word.agg(F.sum("c").alias("tokens"), F.sum(F.when(many, F.col("c")).otherwise(0)).alias("multi"), F.sum("t").alias("tables"), F.sum(F.when(many, F.col("t")).otherwise(0)).alias("multi_tables"))


def epoch_counts(z: DataFrame) -> DataFrame:
    """epoch, topic, word_id, n; ``z`` has epoch."""
    return z.groupBy("epoch", "topic", "word_id").agg(F.count("*").alias("n"))


def ripple_tables(cells: DataFrame, epochs: int) -> DataFrame:
    """topic, word_id, epoch, s: initial table counts, 1 wherever this epoch or a later one has a count."""
    last = cells.filter("n > 0").groupBy("topic", "word_id").agg(F.max("epoch").alias("last"))
    return last.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("topic", "word_id", "epoch", F.lit(1).cast("long").alias("s")).filter(F.col("epoch") < epochs)


def sparsity(cells: DataFrame, words: int) -> DataFrame:
    """topic, sparsity: one less the share of words that the topic uses in any epoch."""
    return cells.filter("n > 0").groupBy("topic").agg((1 - F.count_distinct("word_id") / words).alias("sparsity"))


def running_mean(mean: DataFrame, new: DataFrame, saved: int, keys: list[str]) -> DataFrame:
    """The mean of ``saved`` values updated by one more; a missing value is 0."""
    both = mean.withColumnRenamed("p", "_a").join(new.withColumnRenamed("p", "_b"), keys, "full")
    return both.select(*keys, ((F.coalesce("_a", F.lit(0.0)) * saved + F.coalesce("_b", F.lit(0.0))) / (saved + 1)).alias("p"))


def cumulative_lengths(lengths: DataFrame) -> DataFrame:
    """doc_id, len, start: tokens before a document."""
    return running_sum(lengths.select("doc_id", "len"), [F.col("doc_id")], "len", "start", Scratch(lengths.sparkSession, "lengths"))


def active_sparsity(share: DataFrame, active: DataFrame, docs: int) -> DataFrame:
    """sparsity: one less the share-weighted part of the documents in which a topic is active. ``active`` has topic, docs."""
    return share.join(active, "topic", "left").agg((1 - F.sum(F.col("share") * F.coalesce("docs", F.lit(0)) / docs)).alias("sparsity"))


def probability_summary(probs: DataFrame, tables: DataFrame) -> DataFrame:
    """empty, effective: topics without a count, and exp of the entropy of their probabilities (topic, prob)."""
    p = F.col("prob")
    both = probs.join(tables.select("topic", "n"), "topic", "left")
    return both.agg(F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("empty"), F.exp(-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("effective"))
