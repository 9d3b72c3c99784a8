"""Sampled query scores against sums over all topic assignments of small documents."""

import itertools
from math import lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import inference, query_sweeps

PHI = np.array([[0.6, 0.1], [0.3, 0.2], [0.1, 0.7]])  # words x topics
DOCS = {0: [0, 0, 1], 1: [2, 2], 2: [0, 2, 1, 1], 3: [1]}
QUERIES = {7: [0], 8: [0, 2]}
ALPHA = 0.5


def exact(doc, word):
    """The posterior mean of -ln sum_t theta phi over all assignments."""
    weight, cost = [], []
    for z in itertools.product(range(2), repeat=len(doc)):
        n = np.bincount(z, minlength=2)
        weight.append(np.exp(sum(lgamma(x + ALPHA) - lgamma(ALPHA) for x in n)) * np.prod([PHI[w, k] for w, k in zip(doc, z)]))
        cost.append(-log((n + ALPHA) / (len(doc) + 2 * ALPHA) @ PHI[word]))
    return np.average(cost, weights=weight)


@pytest.fixture(scope="module")
def tables(spark):
    phi = spark.createDataFrame([(t, w, float(PHI[w, t])) for w in range(3) for t in range(2)], "topic long, word_id long, p double")
    tokens = spark.createDataFrame([(d, i, w) for d, ws in DOCS.items() for i, w in enumerate([*ws, 99])], "doc_id long, pos int, word_id long")
    queries = spark.createDataFrame([(q, w) for q, ws in QUERIES.items() for w in [*ws, 98]] + [(9, 98), (9, None)], "qid long, word_id long")
    return queries, tokens, phi


def test_mean_cost_is_near_the_exact_sum(tables):
    got = {(r.qid, r.doc_id): r.score for r in query_sweeps.query_sweeps(*tables, ALPHA, 10, sweeps=4000, burn=50).collect()}
    assert set(got) == {(q, d) for q in QUERIES for d in DOCS}
    for (q, d), v in got.items():
        assert v == pytest.approx(sum(exact(DOCS[d], w) for w in QUERIES[q]), rel=0.04)


def test_twenty_sweeps_rank_as_the_sum_and_repeat(tables):
    queries, tokens, phi = tables
    one = query_sweeps.query_sweeps(queries, tokens, phi, ALPHA, 2)
    best = {(r.qid, r["rank"]): r.doc_id for r in inference.best_documents(one, 2).collect()}
    assert len(best) == 4
    assert best[7, 1] == min(DOCS, key=lambda d: exact(DOCS[d], 0))
    every = lambda t: sorted(map(tuple, query_sweeps.query_sweeps(queries, t, phi, ALPHA, 10).collect()))
    assert every(tokens) == every(tokens.repartition(7, F.rand(3)))


def test_nothing_to_score(tables):
    queries, tokens, phi = tables
    assert query_sweeps.query_sweeps(queries, tokens.filter("false"), phi, ALPHA, 3).count() == 0
    assert query_sweeps.query_sweeps(queries.filter("qid = 9"), tokens, phi, ALPHA, 3).count() == 0
    nulls = tokens.unionByName(tokens.selectExpr("cast(null as bigint) doc_id", "pos", "word_id"))
    assert {r.doc_id for r in query_sweeps.query_sweeps(queries, nulls, phi, ALPHA, 9).collect()} == set(DOCS)


def test_groups_of_documents_are_bounded():
    lens = np.array([5, 1, 900_000, 3, 3])
    groups = list(query_sweeps.alike(lens, 10, 20))
    assert sorted(np.concatenate(groups).tolist()) == [0, 1, 2, 3, 4]
    assert [2] in [g.tolist() for g in groups]


def test_draws_are_those_of_one_document_after_another():
    """Documents that advance together, in order of length, draw what each draws by itself; beyond the bound words are joined."""
    rng = np.random.default_rng(4)
    side, lens = rng.random((30, 5)), np.array([3, 0, 17, 17, 1, 40])
    docs, word = np.arange(6) * 7, rng.integers(0, 30, lens.sum())
    got = query_sweeps.sampled_counts(docs, lens, word, side, ALPHA, 3, 2, 9)
    for i, d in enumerate(docs):
        own, g, n, z = word[lens[:i].sum() :][: lens[i]], query_sweeps.generator(9, int(d)), np.zeros(5), [-1] * lens[i]
        for r in range(5):
            for k, u in enumerate(g.random(lens[i])):
                if z[k] >= 0:
                    n[z[k]] -= 1
                p = np.cumsum((n + ALPHA) * side[own[k]])
                z[k] = min(int((p < u * p[-1]).sum()), 4)
                n[z[k]] += 1
            if r >= 2:
                assert got[r - 2, :, i].tolist() == n.tolist()


def test_rare_words_are_joined(tables, monkeypatch):
    queries, tokens, phi = tables
    every = lambda: sorted(map(tuple, query_sweeps.query_sweeps(queries, tokens, phi, ALPHA, 10).collect()))
    want = every()
    monkeypatch.setattr(query_sweeps, "BROADCAST_BYTES", 16)  # one word
    assert every() == want and len(want) == 8
