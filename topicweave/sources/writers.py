"""Writers: corpora as text, states and reports as Parquet, parameters as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inference import kept_theta
from .text import exists

#: Tables of a saved state.
STATE = ("tokens", "doc_topic", "word_topic", "phi", "theta", "doc_latent", "mu")


def text_rows(rows: DataFrame, path: str, head: list[str] = ()) -> None:
    """Write value in the order of line, and of place where there is one, as part files whose names go by it, below the given head lines."""
    spark = rows.sparkSession
    place = F.col("place").cast("long") if "place" in rows.columns else F.lit(0).cast("long")
    both = rows.select(F.lit(1).alias("part"), F.col("line").cast("long").alias("line"), place.alias("place"), "value")
    if head:
        both = spark.createDataFrame([(0, k, 0, h) for k, h in enumerate(head)], "part int, line long, place long, value string").unionByName(both)
    order = ("part", "line", "place")
    both.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def by_document(tokens: DataFrame, docs: int, entry: str) -> DataFrame:
    """line, es: the entries of every document of 0 .. docs - 1 in order of place; entry is an expression of the row."""
    each = tokens.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.expr(entry).alias("e")))), lambda x: x["e"]).alias("es"))  # of one document
    every = tokens.sparkSession.range(docs).select(F.col("id").alias("doc_id"))
    return every.join(each, "doc_id", "left").select(F.col("doc_id").alias("line"), F.coalesce("es", F.array().cast("array<string>")).alias("es"))


def first_places(tokens: DataFrame) -> DataFrame:
    """doc_id, pos (of the first), word_id, c"""
    return tokens.groupBy("doc_id", "word_id").agg(F.min("pos").alias("pos"), F.count("*").alias("c"))


def write_ldac(tokens: DataFrame, path: str, docs: int) -> None:
    rows = by_document(first_places(tokens), docs, "concat(word_id, ':', c)")
    text_rows(rows.select("line", F.concat_ws(" ", F.size("es").cast("string"), "es").alias("value")), path)


def write_bag(tokens: DataFrame, path: str, docs: int, words: int) -> None:
    rows = by_document(first_places(tokens), docs, "concat(word_id, ' ', c)")
    text_rows(rows.select("line", F.concat_ws(" ", F.size("es").cast("string"), "es").alias("value")), path, [str(docs), str(words)])


def write_lst(tokens: DataFrame, path: str, docs: int, words: int) -> None:
    rows = by_document(tokens, docs, "cast(word_id as string)")
    text_rows(rows.select("line", F.concat_ws(" ", F.size("es").cast("string"), "es").alias("value")), path, [str(docs), str(words)])


def write_docword(tokens: DataFrame, path: str, docs: int, words: int) -> None:
    bag = first_places(tokens)
    text_rows(bag.select(F.col("doc_id").alias("line"), F.col("pos").alias("place"), F.concat_ws(" ", (F.col("doc_id") + 1).cast("string"), (F.col("word_id") + 1).cast("string"), F.col("c").cast("string")).alias("value")), path, [str(docs), str(words), str(bag.count())])


def write_witdit(tokens: DataFrame, words: str, docs: str) -> None:
    line = (F.col("doc_id").alias("line"), F.col("pos").alias("place"))
    text_rows(tokens.select(*line, (F.col("word_id") + 1).cast("string").alias("value")), words)
    text_rows(tokens.select(*line, (F.col("doc_id") + 1).cast("string").alias("value")), docs)


def write_probs(theta: DataFrame, path: str, least: float, renormalise: bool) -> None:
    """Lines ``d: k:p ...`` of theta rows above ``least``."""
    kept = kept_theta(theta, least, renormalise)
    rows = kept.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("topic", "p"))), lambda x: F.concat_ws(":", x["topic"].cast("string"), x["p"].cast("string"))).alias("es"))  # topics of one document
    text_rows(rows.select(F.col("doc_id").alias("line"), F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.concat_ws(" ", "es")).alias("value")), path)


def write_sparse(matrix: DataFrame, path: str, rows: int, columns: int) -> None:
    """i, j, v below a header, without zeros."""
    some = matrix.filter("v <> 0")
    value = F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("v").cast("string")).alias("value")
    text_rows(some.select(F.col("i").alias("line"), F.col("j").alias("place"), value), path, [str(rows), str(columns), str(some.count())])


def save_state(folder: str, tables: dict[str, DataFrame], params: dict) -> None:
    """A state that load_state continues from: Parquet tables and a JSON of parameters and scores."""
    spark = None
    for name, df in tables.items():
        if name not in STATE:
            raise ValueError(f"unknown table {name!r}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = df.sparkSession
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")


def load_state(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in STATE if exists(spark, f"{folder}/{name}")}
    return tables, json.loads(spark.read.text(f"{folder}/params").first().value)
