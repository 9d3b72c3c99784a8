"""From documents to packed training sequences: STAGES, each written as Parquet and read again by the next.

Every stage takes any table of documents: further columns, whatever their
names, pass unchanged up to the last stage, nulls in them too, and an empty
table gives an empty one. What is special to a stage stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicweave.llm import exact_dedup, language_id, mixing, near_dedup, packing
from topicweave.plans.durable import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty and blank texts and those without a letter. Of rows that share a doc_id all stay if any has one. Where no row has a lang to learn from, no text has a language."""
    return language_id.known_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that of the largest doc_id stays, one row of it if it is repeated; a null text equals an empty one, and a null doc_id loses to any other."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays. Texts without words and rows without a doc_id are linked with nothing and stay."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until each source is near its share. Null is a source of its own; texts without words have no size and go; equal rows share their copies."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. A null or empty text is its end id alone; long texts are cut; repeated rows are packed again."""
    return packing.packed(docs)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Near duplicates, mixing and packing have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(*before)  # what a stage read is not read again
        before = [docs]
        near_dedup.forget(spark)
    return docs
