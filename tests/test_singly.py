"""Steps in plain numbers give what steps in arrays give, and cost little where documents differ in length."""

import time

import numpy as np
import pytest

from topicweave.operators import tables
from topicweave.plans.config import Prior

SIDES = {"dir": Prior("dir", weight=0.1), "hdp": Prior("hdp", a=0.4), "hpdd": Prior("hpdd", a=0.3, a0=0.2), "pdp": Prior("pdp", a=0.5)}


def swept(lens, doc, word, few, topics=4, size=30, fixed=None):
    rng = np.random.default_rng(2)
    w, z = np.minimum(rng.zipf(1.6, lens.sum()), size) - 1, rng.integers(0, topics, lens.sum())
    d = np.repeat(np.arange(len(lens)), lens)
    seats, n = np.zeros((len(lens), topics), int), np.zeros((size, topics), int)
    seats[d, z] = 1
    np.add.at(n, (w, z), 1)
    alpha, beta, t = tables.side_of(SIDES[doc], topics), tables.side_of(SIDES[word], size, np.arange(1.0, size + 1)), (n > 0).astype(int)
    words = tables.Words(beta, beta.base, n, t if beta.seated else 0 * t, n.sum(0), t.sum(0) if beta.seated else np.zeros(topics), t.sum(1) if beta.seated else np.zeros(size), int((t.sum(1) > 0).sum()))
    top = seats.sum(axis=0).astype(float)
    for _ in range(2):
        z = tables.sweep(lens, w, z, seats, alpha, top, words, np.random.default_rng(9), together=16, least=2, few=few, fixed=fixed)
    return [x.tolist() for x in (z, seats, top, words.n, words.t, words.n_all, words.t_all, words.root)] + [words.total, words.used]


@pytest.mark.parametrize(("doc", "word"), [("dir", "dir"), ("hdp", "dir"), ("hpdd", "hpdd"), ("pdp", "hdp"), ("dir", "pdp")])
def test_both_kinds_of_steps_agree(doc, word):
    lens = np.array([3, 40, 1, 12, 0, 9, 9, 300, 5, 7, 21, 2, 2, 33, 6, 8, 8, 4, 90, 11])
    arrays = swept(lens, doc, word, 0)
    assert swept(lens, doc, word, 5) == arrays
    assert swept(lens, doc, word, 10**6) == arrays


def test_both_kinds_agree_with_a_fixed_word_side():
    fixed = np.random.default_rng(1).random((30, 4))
    lens = np.array([3, 40, 12, 0, 9])
    assert swept(lens, "hdp", "dir", 0, fixed=fixed) == swept(lens, "hdp", "dir", 10**6, fixed=fixed)


def test_a_long_document_costs_as_much_a_token():
    lens = np.array([6000, *[20] * 50])
    began = time.process_time()
    swept(lens, "hdp", "hdp", None, topics=10, size=500)
    assert (time.process_time() - began) / (2 * lens.sum()) < 250e-6  # 1,000e-6 and more with a step in arrays for each place
