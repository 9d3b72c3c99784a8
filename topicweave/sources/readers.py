"""Readers of corpus, vocabulary, matrix and state files. A corpus is tokens(doc_id, pos, word_id)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.counts import cumulative_lengths
from .corpus import document_frequency
from .text import exists, lines, numbers


def unrolled(rows: DataFrame) -> DataFrame:
    """tokens of (doc_id, at, word_id, c): each entry c times, in the order of the entries."""
    before = F.sum("c").over(W.Window.partitionBy("doc_id").orderBy("at")) - F.col("c")
    each = rows.filter("c > 0").withColumn("_before", before).select("doc_id", "word_id", "_before", F.posexplode(F.array_repeat(F.lit(0), F.col("c").cast("int"))).alias("_k", "_v"))
    return each.select("doc_id", (F.col("_before") + F.col("_k")).cast("int").alias("pos"), "word_id")


def read_ldac(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``n w:c w:c ...``, words from 0."""
    entries = lines(spark, path).select(F.col("line").alias("doc_id"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(\d+):(\d+)"), F.lit(0))).alias("at", "e"))
    part = F.split("e", ":")
    return unrolled(entries.select("doc_id", "at", F.get(part, F.lit(0)).cast("long").alias("word_id"), F.get(part, F.lit(1)).cast("long").alias("c")))


def read_witdit(spark: SparkSession, words: str, docs: str) -> DataFrame:
    """Two files with an index a line, from 1: words and documents of the tokens."""
    w = lines(spark, words).select("line", (F.trim("value").cast("long") - 1).alias("word_id"))
    d = lines(spark, docs).select("line", (F.trim("value").cast("long") - 1).alias("doc_id"))
    pos = F.row_number().over(W.Window.partitionBy("doc_id").orderBy("line")) - 1
    return w.join(d, "line").select("doc_id", pos.alias("pos"), "word_id")


def read_docword(spark: SparkSession, path: str) -> DataFrame:
    """Three header lines (documents, words, entries), then ``d w c``, both from 1."""
    n = numbers(F.col("value"))
    rows = lines(spark, path).filter("line >= 3").select((F.get(n, F.lit(0)) - 1).alias("doc_id"), F.col("line").alias("at"), (F.get(n, F.lit(1)) - 1).alias("word_id"), F.get(n, F.lit(2)).alias("c"))
    return unrolled(rows)


def header(spark: SparkSession, path: str, count: int = 2) -> list[int]:
    return [int(r.value.split()[0]) for r in lines(spark, path).filter(F.col("line") < count).orderBy("line").collect()]


def read_bag(spark: SparkSession, path: str) -> DataFrame:
    """Header documents and words, then ``n w c w c ...``, words from 0. A word outside the header's number is an error."""
    _, words = header(spark, path)
    n = numbers(F.col("value"))
    rows = lines(spark, path).filter("line >= 2").select((F.col("line") - 2).alias("doc_id"), n.alias("n"))
    rows = rows.filter("size(n) > 2").select("doc_id", "n", F.posexplode(F.expr("sequence(1, size(n) - 2, 2)")).alias("at", "k"))
    w = F.get("n", F.col("k"))
    checked = F.when(w < words, w).otherwise(F.raise_error(F.lit("a word id is beyond the header's number of words")).cast("long"))
    return unrolled(rows.select("doc_id", "at", checked.alias("word_id"), F.get("n", F.col("k") + 1).alias("c")))


def read_lst(spark: SparkSession, path: str) -> DataFrame:
    """Header documents and words, then ``n w w ...`` in the order of the text."""
    rows = lines(spark, path).filter("line >= 2").select((F.col("line") - 2).alias("doc_id"), numbers(F.col("value")).alias("v"))
    return rows.select("doc_id", F.posexplode(F.expr("slice(v, 2, greatest(size(v) - 1, 0))")).alias("pos", "word_id"))


def read_corpus(spark: SparkSession, stem: str, form: str = "ldac") -> DataFrame:
    """The corpus of a stem in one of the forms ldac, witdit, docword, bag, lst."""
    if form == "ldac":
        return read_ldac(spark, f"{stem}.ldac")
    if form == "witdit":
        return read_witdit(spark, f"{stem}.wit", f"{stem}.dit")
    if form == "docword":
        return read_docword(spark, f"{stem}.docword")
    if form in ("bag", "lst"):
        return {"bag": read_bag, "lst": read_lst}[form](spark, f"{stem}.txtbag")
    raise ValueError(f"unknown corpus form {form!r}")


def read_vocab(spark: SparkSession, path: str, first: int = 0, end: int | None = None) -> DataFrame:
    """word_id, word of a file with a token a line, without control characters; ids first .. end - 1."""
    out = lines(spark, path).select(F.col("line").alias("word_id"), F.regexp_replace("value", r"\p{Cntrl}", "").alias("word")).filter(F.col("word_id") >= first)
    return out if end is None else out.filter(F.col("word_id") < end)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word_id, tag, hash, cnt, df, word of lines ``idx tag hash cnt df word``."""
    p = F.split(F.trim("value"), r"\s+", 6)
    return lines(spark, path).select(F.get(p, F.lit(0)).cast("long").alias("word_id"), F.get(p, F.lit(1)).alias("tag"), F.get(p, F.lit(2)).alias("hash"), F.get(p, F.lit(3)).cast("long").alias("cnt"), F.get(p, F.lit(4)).cast("long").alias("df"), F.get(p, F.lit(5)).alias("word"))


def read_df(spark: SparkSession, stem: str, tokens: DataFrame, docs: int) -> tuple[DataFrame, int]:
    """word_id, df and the number of documents behind it: of the .df file, else of .words, else counted."""
    if exists(spark, f"{stem}.df"):
        df = lines(spark, f"{stem}.df").select(F.col("line").alias("word_id"), F.trim("value").cast("long").alias("df"))
    elif exists(spark, f"{stem}.words"):
        df = read_words(spark, f"{stem}.words").select("word_id", "df")
    else:
        return document_frequency(tokens), docs
    known = read_params(spark, f"{stem}.srcpar") if exists(spark, f"{stem}.srcpar") else {}
    return df, int(known.get("dfdocs", docs))


def read_class(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("line").alias("doc_id"), F.trim("value").cast("int").alias("class"))


def read_epochs(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Documents of each epoch, training and test (empty where the file has no second block)."""
    n = [int(x) for r in lines(spark, path).orderBy("line").collect() for x in r.value.split()]  # a number for each epoch
    e = n[0]
    if len(n) not in (e + 1, 2 * e + 1):
        raise ValueError(f"{path}: {e} epochs need {e} or {2 * e} numbers")
    return n[1 : e + 1], n[e + 1 :]


def read_params(spark: SparkSession, path: str) -> dict[str, str]:
    """Of lines ``name = value``."""
    rows = lines(spark, path).filter(F.col("value").contains("=")).collect()
    return {k.strip(): v.strip() for k, v in (r.value.split("=", 1) for r in rows)}


def read_assignments(spark: SparkSession, path: str, tokens: DataFrame, topics: int) -> DataFrame:
    """tokens with topic and r of a file with ``t`` or ``t,r`` for each token in order."""
    p = F.split(F.trim("value"), ",")
    z = lines(spark, path).select("line", F.get(p, F.lit(0)).cast("long").alias("topic"), F.coalesce(F.get(p, F.lit(1)).cast("int") == 1, F.lit(True)).alias("r"))
    lengths = tokens.groupBy("doc_id").agg(F.count("*").alias("len"))
    placed = tokens.join(cumulative_lengths(lengths), "doc_id").withColumn("line", F.col("start") + F.col("pos"))
    checked = F.when((F.col("topic") >= 0) & (F.col("topic") < topics), F.col("topic")).otherwise(F.raise_error(F.lit("a topic is out of range")).cast("long"))
    return placed.join(z, "line").select("doc_id", "pos", "word_id", checked.alias("topic"), "r")


def read_sparse(spark: SparkSession, path: str, values: str = "long", head: int = 3) -> DataFrame:
    """i, j, v of lines ``i j v`` after the header (rows, columns, entries)."""
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).filter(F.col("line") >= head).filter(F.size(p) >= 3).select(F.get(p, F.lit(0)).cast("long").alias("i"), F.get(p, F.lit(1)).cast("long").alias("j"), F.get(p, F.lit(2)).cast(values).alias("v"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("line").alias("i"), F.trim("value").cast("double").alias("v"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, v of dense rows."""
    return lines(spark, path).select(F.col("line").alias("i"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def read_phi_binary(spark: SparkSession, path: str) -> DataFrame:
    """topic, word_id, p of a file with three 32-bit numbers (words, topics, samples) and a row of 32-bit floats for each topic, perhaps one more."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                words, _, _ = struct.unpack("<iii", data[:12])
                table = np.frombuffer(data, "<f4", offset=12).reshape(-1, words)
                for k, row in enumerate(table):
                    yield pd.DataFrame({"topic": k, "word_id": np.arange(words), "p": row.astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "topic long, word_id long, p double")


def read_probs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, topic, p of lines ``d: [class] k:p k:p ...``."""
    e = lines(spark, path).select(F.regexp_extract("value", r"^\s*(\d+):", 1).cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(F.regexp_replace("value", r"^\s*\d+:", ""), F.lit(r"(\d+):([0-9.eE+\-]+)"), F.lit(0))).alias("e"))
    p = F.split("e", ":")
    return e.select("doc_id", F.get(p, F.lit(0)).cast("long").alias("topic"), F.get(p, F.lit(1)).cast("double").alias("p"))


def read_epoch_phi(spark: SparkSession, stem: str, epochs: int) -> DataFrame:
    """epoch, topic, word_id, p of files stem.phi000, stem.phi001 ..."""
    out = None
    for e in range(epochs):
        one = read_phi_binary(spark, f"{stem}.phi{e:03d}").withColumn("epoch", F.lit(e).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, word_id of lines ``n w1 w2 ...``; a word repeated in one query counts once."""
    n = numbers(F.col("value"))
    return lines(spark, path).select(F.col("line").alias("qid"), n.alias("n")).filter("size(n) > 1").select("qid", F.explode(F.expr("slice(n, 2, get(n, 0))")).alias("word_id")).distinct()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.trim("value").cast("long").alias("word_id")).filter("word_id is not null").distinct()


def read_spans(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """doc_id, pos, len, term_id of lines ``n (pos len term)*``; terms from ``least`` on."""
    n = numbers(F.col("value"))
    rows = lines(spark, path).select(F.col("line").alias("doc_id"), n.alias("n")).filter("size(n) > 3").select("doc_id", "n", F.explode(F.expr("sequence(1, size(n) - 3, 3)")).alias("k"))
    at = lambda j: F.get("n", F.col("k") + j)
    return rows.select("doc_id", at(0).cast("int").alias("pos"), at(1).cast("int").alias("len"), at(2).alias("term_id")).filter(F.col("term_id") >= least)


def read_pmi(spark: SparkSession, path: str, words: int) -> DataFrame:
    """w1 < w2, pmi of lines ``w1 w2 pmi``, gzip or not, without the diagonal and ids beyond the vocabulary."""
    path = path if exists(spark, path) else f"{path}.gz"
    s = read_sparse(spark, path, "double", 0).filter((F.col("i") < words) & (F.col("j") < words) & (F.col("i") != F.col("j")))
    return s.groupBy(F.least("i", "j").alias("w1"), F.greatest("i", "j").alias("w2")).agg(F.max("v").alias("pmi"))


def read_log_probs(spark: SparkSession, path: str, words: int) -> DataFrame:
    """epoch, word_id, logp of a file with one log probability a line, epochs within words."""
    n = lines(spark, path).select("line", F.trim("value").cast("double").alias("logp"))
    epochs = n.count() // words
    return n.select((F.col("line") % epochs).alias("epoch"), F.floor(F.col("line") / epochs).alias("word_id"), "logp")


def read_foreign_state(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, word_id, topic of a table ``d w z t`` with a header line, as hierarchical samplers of other tools write it."""
    n = numbers(F.col("value"))
    rows = lines(spark, path).filter("line >= 1").select("line", F.get(n, F.lit(0)).alias("doc_id"), F.get(n, F.lit(1)).alias("word_id"), F.get(n, F.lit(2)).alias("topic"))
    return rows.withColumn("pos", F.row_number().over(W.Window.partitionBy("doc_id").orderBy("line")) - 1).select("doc_id", "pos", "word_id", "topic")

