"""Selections, splits, hold-outs, appends and renumbering of token tables (doc_id, pos, word_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def limit_vocab(tokens: DataFrame, words: int) -> DataFrame:
    return tokens.filter(F.col("word_id") < words)


def limit_docs(tokens: DataFrame, docs: int) -> DataFrame:
    return tokens.filter(F.col("doc_id") < docs)


def append(tokens: DataFrame, more: DataFrame, docs: int) -> DataFrame:
    """Both corpora; documents of the second one come after the ``docs`` of the first."""
    return tokens.unionByName(more.withColumn("doc_id", F.col("doc_id") + docs))


def split_name(doc: Column, docs: int, test: int) -> Column:
    """train for the first documents, test for the last ``test``."""
    return F.when(doc < docs - test, "train").otherwise("test")


def hold_dict(tokens: DataFrame, n: int) -> DataFrame:
    return tokens.withColumn("held", (F.col("word_id") + 1) % n == 0)


def hold_doc(tokens: DataFrame, n: int) -> DataFrame:
    return tokens.withColumn("held", (F.col("pos") + 1) % n == 0)


def hold_fract(tokens: DataFrame, fraction: float) -> DataFrame:
    """The head of each document, ``fraction`` of its length, is kept; what stands behind is held."""
    lengths = doc_lengths(tokens)
    return tokens.join(lengths, "doc_id").withColumn("held", F.col("pos") > F.lit(float(fraction)) * F.col("len")).drop("len")


def hold_all(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("held", F.lit(True))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count("*").alias("len"))


def min_doc_size(tokens: DataFrame, least: int) -> DataFrame:
    return tokens.join(doc_lengths(tokens).filter(F.col("len") >= least), "doc_id", "left_semi")


def thin(tokens: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """The ``words`` most frequent words, renumbered by rank; ``counts`` has word_id and cnt."""
    top = counts.orderBy(F.col("cnt").desc(), "word_id").limit(words)
    ranked = top.withColumn("rank", F.row_number().over(W.Window.orderBy(F.col("cnt").desc(), "word_id")) - 1)
    return tokens.join(ranked.select("word_id", "rank"), "word_id").select("doc_id", "pos", F.col("rank").cast("long").alias("word_id"))


def drop_first_words(tokens: DataFrame, first: int) -> DataFrame:
    """Without the first word ids; the others move down."""
    return tokens.filter(F.col("word_id") >= first).withColumn("word_id", F.col("word_id") - first)


def subset_vocab(tokens: DataFrame, words: DataFrame) -> DataFrame:
    return tokens.join(words.select("word_id").distinct(), "word_id", "left_semi")


def bags(tokens: DataFrame) -> DataFrame:
    """doc_id, word_id, cnt, duplicates merged."""
    return tokens.groupBy("doc_id", "word_id").agg(F.count("*").alias("cnt"))


def dense_docs(bag: DataFrame, docs: int) -> DataFrame:
    """Number of tokens of every document of 0 .. docs - 1, 0 where it has none."""
    every = bag.sparkSession.range(docs).select(F.col("id").alias("doc_id"))
    return every.join(bag.groupBy("doc_id").agg(F.sum("cnt").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


def random_split(docs: DataFrame, order: Column, test: int) -> DataFrame:
    """``docs`` with ``test``, true for the given number of them that ``order`` puts first."""
    chosen = docs.orderBy(order, "doc_id").limit(test).select("doc_id", F.lit(True).alias("test"))
    return docs.join(chosen, "doc_id", "left").withColumn("test", F.coalesce("test", F.lit(False)))


def epoch_of(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, epoch from the numbers of documents of consecutive epochs; an interval join."""
    bounds, at = [], 0
    for e, n in enumerate(sizes):
        bounds.append((e, at, at + n))
        at += n
    table = F.broadcast(docs.sparkSession.createDataFrame(bounds, "epoch long, lo long, hi long"))
    return docs.select("doc_id").join(table, (F.col("doc_id") >= F.col("lo")) & (F.col("doc_id") < F.col("hi"))).select("doc_id", "epoch")


def named(pairs: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """i, j, v with 1-based ids as words; ``rows`` and ``columns`` have word_id and word."""
    left = rows.select((F.col("word_id") + 1).alias("i"), F.col("word").alias("row_word"))
    right = columns.select((F.col("word_id") + 1).alias("j"), F.col("word").alias("col_word"))
    return pairs.join(left, "i").join(right, "j").select("row_word", "col_word", "v")


def project(matrix: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """A matrix (w1, w2, v) from one vocabulary (word_id, word) to another by the words; of a repeated word the first id counts."""
    first = lambda v: v.groupBy("word").agg(F.min("word_id").alias("word_id"))
    to = source.alias("s").join(first(target).alias("t"), "word").select(F.col("s.word_id").alias("old"), F.col("t.word_id").alias("new"))
    a, b = to.toDF("w1", "n1"), to.toDF("w2", "n2")
    return matrix.join(a, "w1").join(b, "w2").select(F.col("n1").alias("w1"), F.col("n2").alias("w2"), "v").filter("v <> 0")


def similarity_union(parts: list[DataFrame], vocab: DataFrame) -> DataFrame:
    """Word pairs with a value (a, b, v) of several files as ids, without zeros."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    left, right = vocab.select(F.col("word").alias("a"), F.col("word_id").alias("w1")), vocab.select(F.col("word").alias("b"), F.col("word_id").alias("w2"))
    return both.join(left, "a").join(right, "b").filter("v <> 0").select("w1", "w2", "v")


def normalised_log(table: DataFrame, keys: list[str]) -> DataFrame:
    """exp of ``logp``, summing to 1 over each group of ``keys``."""
    total = table.groupBy(*keys).agg(F.sum(F.exp("logp")).alias("total"))
    return table.join(total, keys).withColumn("p", F.exp("logp") / F.col("total")).drop("total", "logp")
