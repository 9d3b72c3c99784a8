"""The log of a run, reports and epoch tables as files."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import counts, likelihood, run_log, tables
from topicweave.plans.config import ModelConfig, Prior
from topicweave.sources import report_files


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(d, p, (d + p * p) % 5) for d in range(12) for p in range(3 + d % 4)]
    return spark.createDataFrame(rows, "doc_id long, pos int, word_id long")


@pytest.mark.parametrize("alpha", [Prior("dir"), Prior("hdp"), Prior("hpdd", a=0.3, a0=0.2), Prior("pdp", a=0.2)], ids=lambda p: p.kind)
def test_a_run_logs_each_cycle(spark, tokens, tmp_path, alpha):
    log = run_log.RunLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    model = tables.fit(tokens, ModelConfig(topics=3, cycles=2, alpha=alpha, beta=Prior("dir")), trace=log)[0]
    got = {(r["cycle"], r["name"]): r["value"] for r in log.read().collect()}
    assert {c for c, _ in got} == {1, 2}
    docs = tables.doc_tables(model)
    if alpha.kind == "dir":
        want = likelihood.one(likelihood.dirichlet_alpha(docs.filter("n > 0"), 3, float(model.alpha().base[0])))
    else:
        prior = model.alpha().prior
        root = docs.filter("n > 0").groupBy("topic").agg(F.sum("t").alias("tables"))
        want = likelihood.one(likelihood.pitman_yor(docs.filter("n > 0"), "doc_id", prior.a, prior.b)) + run_log.root_value(prior, root, 3)
    assert got[2, "loglik_docs"] == pytest.approx(want)
    assert got[2, "loglik_words"] < 0 and got[2, "seconds"] >= got[1, "seconds"]


def test_later_runs_win_and_uneven_bases_are_refused(spark, tokens, tmp_path):
    folder = str(tmp_path / "log")
    run_log.RunLog(spark, folder, "a").write(1, {"x": 1.0, "y": 2.0})
    last = run_log.RunLog(spark, folder, "b")
    last.write(1, {"x": 3.0})
    assert {r["name"]: r["value"] for r in last.read().collect()} == {"x": 3.0, "y": 2.0}
    model = tables.fit(tokens, ModelConfig(topics=2, cycles=1, alpha=Prior("hdp")))[0]
    with pytest.raises(ValueError, match="even"):
        run_log.log_likelihood(replace(model, topic_base=np.array([0.9, 0.1])))


def test_reports_round_trip(spark, tmp_path):
    top = spark.createDataFrame([(0, 1, 5, 0.5)], "topic long, rank long, word_id long, score double")
    report_files.write_reports(str(tmp_path / "r"), {"top_words": top})
    back = report_files.read_reports(spark, str(tmp_path / "r"))
    assert list(back) == ["top_words"] and back["top_words"].collect() == top.collect()
    with pytest.raises(ValueError, match="unknown"):
        report_files.write_reports(str(tmp_path / "s"), {"nope": top})
    with pytest.raises(ValueError, match="lacks"):
        report_files.write_reports(str(tmp_path / "s"), {"top_words": top.drop("score")})
    assert not (tmp_path / "s").exists()


def test_epoch_tables_put_ones_back(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 5, 3), (0, 1, 1, 1), (1, 0, 4, 1), (1, 1, 0, 0)], "epoch long, topic long, n long, t long")
    report_files.write_epoch_tables(str(tmp_path), "chain_tables", cells)
    assert spark.read.parquet(str(tmp_path / "chain_tables")).count() == 1
    back = report_files.read_epoch_tables(spark, str(tmp_path), "chain_tables", cells.drop("t"))
    assert sorted(map(tuple, back.select("epoch", "topic", "n", "t").collect())) == sorted(map(tuple, cells.collect()))


def test_counts_are_always_active(spark):
    dt = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (1, 2, 1)], "doc_id long, topic long, n long")
    active = spark.createDataFrame([(0, 1), (0, 0), (2, 1)], "doc_id long, topic long")  # document 2 has no tokens
    assert sorted(map(tuple, counts.corrected_active(active, dt).collect())) == [(0, 0), (0, 1), (1, 2)]
