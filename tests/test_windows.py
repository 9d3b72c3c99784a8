"""Windows and pairs summed in tasks, running sums over ranges, best unseen words, and places of long documents."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import counts, inference, likelihood, pmi, sampler
from topicweave.plans.config import ModelConfig, Prior
from topicweave.sources import writers


@pytest.fixture
def tokens(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(d, i, int(w)) for d in range(12) for i, w in enumerate(rng.integers(0, 9, [0, 1, 3, 40, 7, 19][d % 6]))], "doc_id long, pos int, word_id long")


def documents(tokens):
    out = {}
    for r in sorted(tokens.collect()):
        out.setdefault(r.doc_id, []).append(r.word_id)
    return out


@pytest.mark.parametrize("width", [1, 2, 5, 60])
@pytest.mark.parametrize("held", [1, 2_000_000])
def test_windows(tokens, width, held, monkeypatch):
    monkeypatch.setattr(pmi, "HELD_PAIRS", held)
    pairs, words, total = Counter(), Counter(), 0
    for ws in documents(tokens).values():
        for s in range(max(len(ws) - width + 1, 1)):
            inside = sorted(set(ws[s : s + width]))
            pairs.update(combinations(inside, 2))
            words.update(inside)
            total += 1
    assert {(r.w1, r.w2): r.c for r in pmi.window_pairs(tokens, width).collect()} == pairs
    n, windows = pmi.window_counts(tokens, width)
    assert {r.word_id: r.n for r in n.collect()} == words and windows.first()[0] == total


@pytest.mark.parametrize("held", [1, 7, 2_000_000])
def test_document_pairs(tokens, held, monkeypatch):
    monkeypatch.setattr(pmi, "HELD_PAIRS", held)
    want = Counter(p for ws in documents(tokens).values() for p in combinations(sorted(set(ws)), 2))
    assert {(r.w1, r.w2): r.c for r in pmi.document_pairs(tokens).collect()} == want
    often = {k: c for k, c in want.items() if c >= 4}
    assert {(r.w1, r.w2): r.c for r in pmi.document_pairs(tokens, 4).collect()} == often


def test_lengths_before(spark):
    lengths = spark.createDataFrame([(d * 37 % 101, d % 7) for d in range(101)], "doc_id long, len long")
    start, want = 0, []
    for d, n in sorted(map(tuple, lengths.collect())):
        want.append((d, n, start))
        start += n
    assert sorted(map(tuple, counts.cumulative_lengths(lengths).select("doc_id", "len", "start").collect())) == want
    assert counts.cumulative_lengths(lengths.limit(0)).count() == 0


def test_best_unseen_words_are_exact():
    rng = np.random.default_rng(2)
    rows = rng.dirichlet(np.full(500, 0.05), 4).T
    theta, held = rng.dirichlet(np.full(4, 0.3), 60), [np.sort(rng.choice(500, int(rng.integers(0, 490)), replace=False)) for _ in range(60)]
    theta[0], rows[100:200] = [1, 0, 0, 0], rows[100]  # ties
    words = np.arange(500) * 3
    got = {d: (w.tolist(), s.tolist()) for d, w, s in inference.best_unseen(theta, [3 * h for h in held], words, rows, np.argsort(-rows, axis=0, kind="stable"), 10)}
    for d in range(60):
        score = (rows @ theta[d]).round(12)
        left = sorted((-score[w], 3 * w) for w in range(500) if w not in set(held[d]))[:10]
        assert got[d][0] == [w for _, w in left] and got[d][1] == pytest.approx([-s for s, _ in left])


def test_documents_beyond_a_million_tokens_keep_their_order(spark, tmp_path):
    far = 1 << 20
    rows = [(0, far + 5, 1), (1, 0, 2), (1, 1, 0), (0, 3, 2)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos long, word_id long")
    writers.write_witdit(tokens, f"file://{tmp_path}/w", f"file://{tmp_path}/d")
    order = [r.value for r in spark.read.text(f"file://{tmp_path}/w").select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert order == ["3", "2", "3", "1"]


def test_fit_leaves_its_callers_state(tokens):
    config = ModelConfig(topics=2, cycles=2, alpha=Prior("dir", weight=0.5), beta=Prior("dir", weight=0.5))
    state = sampler.fit(tokens, config)
    more = sampler.fit(tokens, ModelConfig(**{**config.__dict__, "cycles": 4}), state=sampler.State(state.tokens, ModelConfig(**{**state.config.__dict__, "cycles": 4}), state.root, state.cycle, state.words))
    assert more.cycle == 4 and state.tokens.count() == more.tokens.count() == tokens.count()


def test_likelihood_of_table_counts(spark):
    """By hand: one restaurant, S(4, 2; 1/2) S(3, 1; 1/2) and the weights of tables."""
    from math import lgamma, log

    table = spark.createDataFrame([(0, 0, 4, 2), (0, 1, 3, 1)], "doc_id long, topic long, n long, t long")
    # S(4, 2) = S(3, 1) + 2 S(3, 2) = 0.75 + 2 * 1.5, S(3, 1) = 0.75
    want = log(3.75) + log(0.75) + sum(log(2.0 + 0.5 * i) for i in range(3)) - (lgamma(9.0) - lgamma(2.0))
    assert likelihood.pitman_yor(table, "doc_id", 0.5, 2.0).first()[0] == pytest.approx(want)
    flat = likelihood.pitman_yor(table.withColumn("t", F.lit(1).cast("long")), "doc_id", 0.5, 2.0).first()[0]
    assert flat == pytest.approx(likelihood.pitman_yor(table.drop("t"), "doc_id", 0.5, 2.0).first()[0])


def test_next_words_of_one_topic_meet_once(spark):
    """What a join of all tokens finds, also where places are repeated or missing; tokens are shuffled once and not for several joins."""
    import random

    from topicweave.operators import counts

    r = random.Random(4)
    rows = [(d, i, r.randrange(6), r.randrange(2)) for d in range(8) for i in range(30) if r.random() < 0.9] + [(3, 5, 1, 0), (3, 6, 2, 0), (3, 6, 2, 0)]
    z = spark.createDataFrame(rows, "doc_id long, pos int, word_id long, topic long")
    want = sorted((a[0], a[2] * 4294967296 + b[2], a[3]) for a in rows for b in rows if a[0] == b[0] and b[1] == a[1] + 1 and a[3] == b[3])
    assert sorted(map(tuple, counts.next_word_spans(z).collect())) == want
    assert counts.next_word_spans(z)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_words_in_too_few_windows_make_no_pairs_and_keep_their_places(spark):
    rng = np.random.default_rng(11)
    rows = [(d, p, int(w)) for d in range(6) for p, w in enumerate(np.minimum(rng.geometric(0.2, 60) - 1, 30))]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, word_id long").repartition(3)
    words, _ = pmi.window_counts(tokens, 5)
    plain = {tuple(r) for r in pmi.window_pairs(tokens, 5).filter("c >= 12").collect()}
    n = {r.word_id: r.n for r in words.collect()}
    last = max(w for w, x in n.items() if x >= 12)
    assert plain and last < max(n)
    assert {tuple(r) for r in pmi.frequent_window_pairs(tokens, 5, 12, words).collect()} == plain
    assert all(r.w2 <= last for r in pmi.window_pairs(tokens, 5, last).collect())
    assert pmi.frequent_window_pairs(tokens, 5, 10**6, words).count() == 0
