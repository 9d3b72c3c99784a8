"""The log of a run: likelihoods, parameters and times by cycle, a row each, in a Parquet table that later runs append to."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import exists
from . import likelihood, tables

SCHEMA = "run string, cycle int, name string, value double"


def root_value(prior, tables_of: DataFrame, size: int) -> float:
    """ln likelihood of the tables of each dish (tables) under a root with even weights."""
    if prior.kind == "pdp":
        return likelihood.one(likelihood.root_weights(tables_of, size))
    if prior.kind == "hdp":
        return likelihood.one(likelihood.root_dirichlet(tables_of, size, prior.b0))
    return likelihood.one(likelihood.root_gem(tables_of, prior.a0, prior.b0))


def log_likelihood(model: tables.Model) -> dict[str, float]:
    """loglik_docs and loglik_words of a model with its table counts; bases must be even."""
    out, sides = {}, (("loglik_docs", model.alpha(), tables.doc_tables(model), "doc_id", "topic"), ("loglik_words", model.beta(), model.words, "topic", "word_id"))
    for name, side, cells, group, dish in sides:
        if np.ptp(side.base) > 1e-12 * side.base.max():
            raise ValueError("the log likelihood of a run is for even bases")
        cells = cells.filter("n > 0")
        if side.seated:
            value = likelihood.one(likelihood.pitman_yor(cells, group, side.prior.a, side.prior.b))
            value += root_value(side.prior, cells.groupBy(dish).agg(F.sum("t").alias("tables")), len(side.base))
        else:
            value = likelihood.one(likelihood.dirichlet_alpha(cells.select(F.col(group).alias("doc_id"), F.col(dish).alias("topic"), "n"), len(side.base), float(side.base[0])))
        out[name] = value
    return out


def parameters(model: tables.Model) -> dict[str, float]:
    """The parameters of both sides; those of words end in w."""
    out = {}
    for end, prior in (("", model.config.alpha), ("w", model.config.beta)):
        for name in ("a", "b", "a0", "b0") if prior.kind != "dir" else ("weight",):
            value = getattr(prior, name)
            if value is not None:
                out[f"{name}{end}"] = float(value)
    return out


class RunLog:
    """``fit(trace=RunLog(...))`` writes a cycle's rows when it ends, so that a run that stops leaves what it has done.

    A cycle that is done again after a restart is written again; ``read`` takes
    the row of the run that is last by name.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str = "0", every: int = 1):
        self.spark, self.folder, self.run, self.every, self.began = spark, folder, run, every, time.monotonic()

    def write(self, cycle: int, values: dict[str, float]) -> None:
        rows = [(self.run, cycle, name, float(v)) for name, v in values.items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def __call__(self, model: tables.Model) -> None:
        if model.cycle % self.every == 0:
            self.write(model.cycle, log_likelihood(model) | parameters(model) | {"seconds": time.monotonic() - self.began})

    def read(self) -> DataFrame:
        """cycle, name, value; no rows where nothing is written yet."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], SCHEMA).drop("run")
        rows = self.spark.read.schema(SCHEMA).parquet(self.folder)
        return rows.groupBy("cycle", "name").agg(F.max_by("value", "run").alias("value"))
