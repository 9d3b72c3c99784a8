"""Scoring of documents as they arrive, with a fitted word side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fold_in(docs: DataFrame, vocab: dict[str, int], phi: np.ndarray, alpha: float, sweeps: int = 20) -> DataFrame:
    """doc_id, tokens, log2_perplexity, topics for each document (doc_id, text), streamed or not.

    Stateless: the topic weights of a document come from a fixed number of
    expectation steps over its own words. phi is topics x words and, with the
    vocabulary, of the size of the model, not of the stream.
    """
    model = docs.sparkSession.sparkContext.broadcast((vocab, phi))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, p = model.value
        for part in parts:
            out = []
            for ws in part["words"]:
                ids = np.array([words[w] for w in ws if w in words], dtype=int)
                theta = np.full(len(p), 1.0 / len(p))
                if len(ids):
                    q = p[:, ids]
                    for _ in range(sweeps):
                        r = theta[:, None] * q
                        theta = (r / r.sum(axis=0)).sum(axis=1) + alpha
                        theta /= theta.sum()
                    score = float(-np.log2(theta @ q).mean())
                else:
                    score = None
                out.append((len(ids), score, theta.tolist()))
            yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["tokens", "log2_perplexity", "topics"])], axis=1)

    split = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return docs.select("doc_id", split.alias("words")).mapInPandas(run, "doc_id long, tokens long, log2_perplexity double, topics array<double>")


def topic_counts(scored: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """window, topic, docs: documents by their strongest topic in event-time windows, late ones dropped after ``delay``."""
    best = F.array_position("topics", F.array_max("topics")) - 1
    return scored.withWatermark(time, delay).groupBy(F.window(time, window), best.alias("topic")).agg(F.count("*").alias("docs"))


def write(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
