"""The derived tables that most queries start from, built once for a session and an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts
from ..sources.corpus import coded, tokens_of_text, vocabulary, word_counts
from .durable import Scratch
from .hashing import hashed

#: Number of topics, Dirichlet priors, and the seed of topics drawn by hash.
TOPICS, ALPHA, BETA, SEED = 10, 0.1, 0.01, 7
EPOCHS = 4


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables, so that changed input is not answered from old tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


class Workspace:
    """Tables of one input directory; each is written when first asked for and then read back."""

    _known: dict[tuple, Workspace] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.scratch = Scratch(spark, "workspace")
        self.tables: dict[str, DataFrame] = {}
        self.words_known: int | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir))
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def keep(self, name: str, make) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.scratch.keep(make())
        return self.tables[name]

    @property
    def words(self) -> DataFrame:
        """doc_id, pos, word, split from the texts whenever they are read"""
        return tokens_of_text(self.read("documents"), "doc_id", "text")

    @property
    def vocab(self) -> DataFrame:
        """word_id, word, cnt, df"""
        return self.keep("vocab", lambda: vocabulary(word_counts(self.read("documents"), "doc_id", "text"), self.scratch))

    @property
    def tokens(self) -> DataFrame:
        """doc_id, pos, word_id: columns of ``z``, so that tokens are written once"""
        return self.z.select("doc_id", "pos", "word_id")

    @property
    def doc_count(self) -> int:
        return self.read("documents").count()

    @property
    def word_count(self) -> int:
        if self.words_known is None:
            self.words_known = self.vocab.count()
        return self.words_known

    @property
    def z(self) -> DataFrame:
        """doc_id, pos, word_id, topic of all tokens, topics drawn by hash."""
        topic = hashed(F.col("doc_id").cast("string"), F.col("pos").cast("string"), str(SEED)) % TOPICS
        if "z" not in self.tables:
            self.tables["z"] = coded(self.words.withColumn("topic", topic), self.vocab, self.word_count, self.scratch).select("doc_id", "pos", "word_id", "topic")
        return self.tables["z"]

    @property
    def word_topic(self) -> DataFrame:
        return self.keep("word_topic", lambda: counts.word_topic(self.z))

    @property
    def doc_topic(self) -> DataFrame:
        return self.keep("doc_topic", lambda: counts.doc_topic(self.z))

    @property
    def topics(self) -> DataFrame:
        """topic for every topic, used or not"""
        return self.spark.range(TOPICS).select(F.col("id").alias("topic"))

    def epoch(self, doc: Column) -> Column:
        return F.floor(doc * EPOCHS / self.doc_count).cast("long")
