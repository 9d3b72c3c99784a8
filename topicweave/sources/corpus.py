"""Token tables: doc_id, pos, word_id, one row for each token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from ..plans.ranking import global_rank


#: Words of a vocabulary that may be broadcast.
BROADCAST_WORDS = 1_000_000


def tokens_of_text(docs: DataFrame, doc: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """doc_id, pos, word of lower-cased text."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(words).alias("pos", "word"))


def word_counts(docs: DataFrame, doc: str, text: str, pattern: str = "[a-z]+") -> DataFrame:
    """word, cnt, df of lower-cased text.

    Where no id is repeated a document's distinct words are counted in its
    row, so that only sums by word are shuffled.
    """
    repeated = docs.groupBy(doc).count().filter(F.col("count") > 1)
    if not repeated.isEmpty():
        return counted(tokens_of_text(docs, doc, text, pattern))
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    known = F.col(doc).isNotNull().cast("long")  # a null id is a document of no number
    rows = docs.select(words.alias("_ws"), known.alias("_one")).select("_one", F.explode(F.array(F.struct(F.col("_ws").alias("ws"), F.lit(True).alias("all")), F.struct(F.array_distinct("_ws").alias("ws"), F.lit(False).alias("all")))).alias("_p"))
    each = rows.select("_one", "_p.all", F.explode("_p.ws").alias("word"))
    return each.groupBy("word").agg(F.count_if("all").alias("cnt"), F.sum(F.when(~F.col("all"), F.col("_one")).otherwise(0)).alias("df"))


def counted(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("cnt"), F.count_distinct("doc_id").alias("df"))


def vocabulary(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word_id, word, cnt, df: the most frequent word is 0, ties go by the word. ``words`` are tokens, or counts of words."""
    each = words if "cnt" in words.columns else counted(words)
    ranked, _ = global_rank(each, [F.col("cnt").desc(), F.col("word")], "word_id", scratch)
    return ranked.select("word_id", "word", "cnt", "df")


def encode(words: DataFrame, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, pos, word_id; a vocabulary of known and bounded ``size`` is broadcast, so that tokens stay where they are."""
    ids = vocab.select("word", "word_id")
    return words.join(F.broadcast(ids) if size is not None and size <= BROADCAST_WORDS else ids, "word").select("doc_id", "pos", "word_id")


def coded(words: DataFrame, vocab: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """``words`` with word_id for word, written. Of a large vocabulary the most frequent words are broadcast, and only tokens of the others are shuffled."""
    ids, others = vocab.select("word", "word_id"), [c for c in words.columns if c != "word"]
    if size <= BROADCAST_WORDS:
        return scratch.keep(words.join(F.broadcast(ids), "word").select(*others, "word_id"))
    met = words.join(F.broadcast(ids.filter(F.col("word_id") < BROADCAST_WORDS)), "word", "left")
    met = scratch.keep(met.select(*others, "word_id", F.when(F.col("word_id").isNull(), F.col("word")).alias("word")))
    rest = met.filter("word_id is null").drop("word_id").join(ids.filter(F.col("word_id") >= BROADCAST_WORDS), "word")
    return met.filter("word_id is not null").select(*others, "word_id").unionByName(scratch.keep(rest.select(*others, "word_id")))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word_id").agg(F.count_distinct("doc_id").alias("df"))
