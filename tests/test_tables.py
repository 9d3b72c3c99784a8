"""Sampling with table indicators: the posterior by enumeration, restaurants that stay whole, and the Spark cycles."""

import itertools
from collections import Counter
from dataclasses import replace
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicweave.functions.special import log_stirling
from topicweave.functions.stirling import Ratios, log_stirling_of
from topicweave.operators import hyper, tables
from topicweave.plans.config import ModelConfig, Prior
from topicweave.plans.durable import Scratch

SIDES = {
    "dir": Prior("dir", weight=0.4),
    "pdp": Prior("pdp", a=0.3, b=1.5),
    "hdp": Prior("hdp", a=0.0, b=1.2, b0=0.8),
    "hpdd": Prior("hpdd", a=0.4, b=0.9, a0=0.2, b0=1.1),
}
DOCS = [[0, 1, 0], [2, 0], [1, 1, 2]]


@pytest.mark.parametrize("a", [0.0, 0.3, 0.7])
def test_ratios_are_those_of_the_recursion(a):
    s = log_stirling(600, a)
    pairs = [(n, t) for n in (1, 2, 3, 10, 57, 300, 599) for t in (1, 2, 3, 7, 31) if t <= n]
    got = log_stirling_of([n for n, _ in pairs], [t for _, t in pairs], a)
    assert got == pytest.approx([s[n, t] for n, t in pairs], rel=1e-9, abs=1e-9)
    r = Ratios(a, 599, 40)
    n, t = np.array([p for p in pairs if p[0] < 599 and p[1] < 40]).T
    opens, stays = r.seats(n, t)
    assert np.log(opens) == pytest.approx(s[n + 1, t + 1] - s[n, t], rel=1e-3, abs=1e-3)
    some = t <= n
    assert np.log(stays[some]) == pytest.approx((s[n + 1, t] - s[n, t])[some], rel=1e-3, abs=1e-3)
    assert [x.tolist() for x in r.seats(np.array([0]), np.array([0]))] == [[1.0], [0.0]]


def test_large_counts_converge():
    far = log_stirling_of([300_000, 150_000], [3, 3], 0.5)
    # S(n, t) / S(n, 1) goes to 1 / (a ** (t - 1) (t - 1)!)
    assert far - np.array([lgamma(n - 0.5) - lgamma(0.5) for n in (300_000, 150_000)]) == pytest.approx(log(2.0), abs=0.02)


def tables_of(n):
    """All table counts of counts ``n`` (a matrix)."""
    cells = [(i, j) for i, j in zip(*np.nonzero(n), strict=True)]
    for some in itertools.product(*(range(1, n[c] + 1) for c in cells)):
        t = np.zeros_like(n)
        for c, x in zip(cells, some, strict=True):
            t[c] = x
        yield t


def posterior(alpha, beta, topics=2, words=3):
    """ln weight of every assignment, table counts summed out."""
    lens = [len(d) for d in DOCS]
    doc, word = np.repeat(range(3), lens), np.concatenate(DOCS)
    a, b, out = tables.side_of(alpha, topics, np.array([0.7, 0.3])), tables.side_of(beta, words, np.array([0.5, 0.2, 0.3])), {}

    def total(n, side):
        if not side.seated:
            return exp(tables.log_joint(None, n, n, side))
        return sum(exp(tables.log_joint(None, n, t, side)) for t in tables_of(n))

    known = {}
    for z in itertools.product(range(topics), repeat=len(doc)):
        n, m = np.zeros((3, topics), int), np.zeros((topics, words), int)
        np.add.at(n, (doc, z), 1)
        np.add.at(m, (z, word), 1)
        for key, side in ((("d", n.tobytes()), a), (("w", m.tobytes()), b)):
            if key not in known:
                known[key] = total(np.frombuffer(key[1], int).reshape(-1, topics if key[0] == "d" else words), side)
        out[z] = known["d", n.tobytes()] * known["w", m.tobytes()]
    norm = sum(out.values())
    return {z: p / norm for z, p in out.items()}


@pytest.mark.parametrize(("doc", "word"), [("dir", "dir"), ("hdp", "dir"), ("hpdd", "dir"), ("pdp", "pdp"), ("dir", "hdp"), ("hdp", "hpdd"), ("hpdd", "hdp")])
def test_meets_the_enumerated_posterior(doc, word):
    want = posterior(SIDES[doc], SIDES[word])
    alpha, beta = tables.side_of(SIDES[doc], 2, np.array([0.7, 0.3])), tables.side_of(SIDES[word], 3, np.array([0.5, 0.2, 0.3]))
    lens, w = np.array([len(d) for d in DOCS]), np.concatenate(DOCS)
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 2, len(w))
    d = np.repeat(range(3), lens)
    seats, cells = np.zeros((3, 2), int), np.zeros((3, 2), int)
    seats[d, topic] = 1
    np.add.at(cells, (w, topic), 1)
    t = (cells > 0).astype(int)
    top = seats.sum(axis=0).astype(float)
    words = tables.Words(beta, beta.base, cells, t if beta.seated else 0 * t, cells.sum(0), t.sum(0) if beta.seated else np.zeros(2), t.sum(1) if beta.seated else np.zeros(3), int((t.sum(1) > 0).sum()))
    seen, sweeps = Counter(), 4000
    for _ in range(sweeps):
        topic = tables.sweep(lens, w, topic, seats, alpha, top, words, rng, together=1)
        seen[tuple(topic.tolist())] += 1
    assert sum(abs(seen[z] / sweeps - p) for z, p in want.items()) / 2 < 0.09
    same = lambda p, i, j: sum(v for z, v in p.items() if z[i] == z[j])
    got = {z: c / sweeps for z, c in seen.items()}
    for i, j in ((0, 1), (0, 3), (5, 6), (2, 7)):
        assert same(got, i, j) == pytest.approx(same(want, i, j), abs=0.04)


@pytest.mark.parametrize("together", [1, 7, 64])
def test_restaurants_stay_whole(together):
    rng = np.random.default_rng(4)
    lens = rng.integers(0, 30, 50)
    w, k = rng.integers(0, 40, lens.sum()), 5
    topic, d = rng.integers(0, k, len(w)), np.repeat(np.arange(50), lens)
    seats, cells = np.zeros((50, k), int), np.zeros((40, k), int)
    seats[d, topic] = 1
    np.add.at(cells, (w, topic), 1)
    t = (cells > 0).astype(int)
    alpha, beta = tables.side_of(SIDES["hpdd"], k), tables.side_of(Prior("hpdd", a=0.5, b=5.0, a0=0.3, b0=2.0), 40)
    top = seats.sum(axis=0).astype(float)
    words = tables.Words(beta, beta.base, cells, t, cells.sum(0), t.sum(0), t.sum(1), int((t.sum(1) > 0).sum()))
    for _ in range(10):
        topic = tables.sweep(lens, w, topic, seats, alpha, top, words, rng, together)
        n, m = np.zeros((50, k), int), np.zeros((40, k), int)
        np.add.at(n, (d, topic), 1)
        np.add.at(m, (w, topic), 1)
        assert (words.n == m).all() and (words.n_all == m.sum(0)).all()
        for x, y in ((n, seats), (words.n, words.t)):
            assert ((y > 0) == (x > 0)).all() and (y <= x).all()
        assert (top == seats.sum(0)).all() and (words.t_all == words.t.sum(0)).all() and (words.root == words.t.sum(1)).all()
        assert words.used == (words.root > 0).sum() and words.total == words.t.sum()
    assert seats.max() > 1 and words.t.max() > 1


def corpus(spark, docs=60, length=40, seed=1):
    """Two planted topics of ten words each."""
    rng = np.random.default_rng(seed)
    rows = [(d, i, int(rng.integers(10) + 10 * (d % 2))) for d in range(docs) for i in range(length)]
    return spark.createDataFrame(rows, "doc_id long, pos int, word_id long")


CONFIG = ModelConfig(topics=4, cycles=6, alpha=Prior("hdp", b=5.0, b0=2.0), beta=Prior("hpdd", a=0.3, b=10.0, a0=0.2, b0=5.0))


def test_cycles_on_spark(spark):
    tokens = corpus(spark)
    model, means = tables.fit(tokens, replace(CONFIG, cycles=15), save_from=13)
    z = tables.tokens_of(model)
    assert z.select("doc_id", "pos", "word_id").exceptAll(tokens).count() == 0 and z.count() == tokens.count()
    want = {(r.word_id, r.topic): r.n for r in z.groupBy("word_id", "topic").agg(F.count("*").alias("n")).collect()}
    got = {(r.word_id, r.topic): (r.n, r.t) for r in model.words.collect()}
    assert {k: n for k, (n, _) in got.items()} == want and all(1 <= t <= n for n, t in got.values())
    docs = tables.doc_tables(model).toPandas()
    assert docs["n"].sum() == 2400 and (docs["t"] >= 1).all() and (docs["t"] <= docs["n"]).all()
    assert (docs.groupby("topic")["t"].sum().reindex(range(4), fill_value=0).to_numpy() == model.top).all()
    # planted topics do not mix
    sizes = z.groupBy("topic").agg(F.avg((F.col("doc_id") % 2).cast("double")).alias("m"), F.count("*").alias("n")).collect()
    assert sum(min(r.m, 1 - r.m) * r.n for r in sizes) / 2400 < 0.1
    assert means.saved == 3 and means.alpha.sum() == pytest.approx(1)
    for table, key in ((means.phi, "topic"), (means.theta, "doc_id")):
        assert all(abs(r.s - 1) < 1e-9 for r in table.groupBy(key).agg(F.sum("p").alias("s")).collect())


def test_words_by_join_are_as_broadcast(spark):
    scratch = Scratch(spark, "test")
    model = tables.start(corpus(spark), CONFIG, scratch)
    rows = [sorted(map(tuple, tables.tokens_of(tables.cycle(model, scratch, broadcast_bytes=b)).collect())) for b in (1 << 30, 0)]
    assert rows[0] == rows[1]


def test_averages_are_plain_means_and_resume(spark):
    tokens, scratch = corpus(spark, 20, 10), Scratch(spark, "test")
    kept = []
    trace = lambda m: kept.append((tables.phi(m).toPandas(), tables.theta(m).toPandas(), tables.root_weights(m)))
    model, means = tables.fit(tokens, CONFIG, save_from=2, save_every=2, trace=trace)
    half, part = tables.fit(tokens, ModelConfig(**{**CONFIG.__dict__, "cycles": 3}), save_from=2, save_every=2)
    again, both = tables.fit(tokens, CONFIG, model=replace(half, config=replace(half.config, cycles=6)), save_from=2, save_every=2, averages=part)
    for got in (means, both):
        assert got.saved == 3
        for k, table, keys in ((0, got.phi, ["topic", "word_id"]), (1, got.theta, ["doc_id", "topic"])):
            want = pd.concat(kept[c - 1][k] for c in (2, 4, 6)).groupby(keys)["p"].mean()
            assert table.toPandas().set_index(keys)["p"].sort_index().to_numpy() == pytest.approx(want.to_numpy(), abs=1e-12)
        assert got.alpha == pytest.approx(np.mean([kept[c - 1][2] for c in (2, 4, 6)], axis=0))
    assert half.words.count() > 0  # the caller's model is still there


def test_prior_vectors(spark):
    """A strong word base pulls topics to it, also given as a table."""
    tokens = corpus(spark, 20, 10)
    base = spark.createDataFrame([(w, 9.0 if w == 3 else 1.0) for w in range(20)], "word_id long, p double")
    config = ModelConfig(topics=2, cycles=2, alpha=Prior("dir"), beta=Prior("pdp", a=0.2, b=1000.0))
    model, _ = tables.fit(tokens, config, word_base=base)
    p = {(r.topic, r.word_id): r.p for r in tables.phi(model).collect()}
    assert all(p[k, 3] > 3 * p[k, 4] for k in range(2)) and sum(p.values()) == pytest.approx(2)
    skew, _ = tables.fit(tokens, ModelConfig(topics=2, cycles=2, alpha=Prior("pdp", b=1e4), beta=Prior("dir")), topic_base=np.array([9.0, 1.0]))
    share = {r.topic: r.s for r in tables.theta(skew).groupBy("topic").agg(F.avg("p").alias("s")).collect()}
    assert share[0] > 0.8


def seated(rng, groups, size, a, b, base):
    """Customers of Pitman-Yor restaurants seated one by one: (n, t) by group."""
    out = []
    for _ in range(groups):
        dishes, seats = [], []
        for i in range(size):
            if rng.random() * (i + b) < b + a * len(seats):
                dishes.append(int(rng.choice(len(base), p=base)))
                seats.append(1)
            else:
                seats[int(rng.choice(len(seats), p=(np.array(seats) - a) / (sum(seats) - a * len(seats))))] += 1
        n, t = np.zeros(len(base), int), np.zeros(len(base), int)
        np.add.at(n, dishes, seats)
        np.add.at(t, dishes, 1)
        out.append((n, t))
    return out


def test_parameters_are_recovered():
    rng = np.random.default_rng(5)
    a, b, base = 0.4, 6.0, np.full(8, 1 / 8)
    rooms = seated(rng, 150, 60, a, b, base)
    cells = np.array([(x, y, c) for (x, y), c in Counter((x, y) for n, t in rooms for x, y in zip(n, t, strict=True) if x).items()], float)
    totals, seats = np.array([(60, 150)], float), np.array(list(Counter(int(t.sum()) for _, t in rooms).items()), float)
    bs, aa = [], []
    x, y = 1.0, 0.1
    for _ in range(60):
        x = hyper.slice_sample(hyper.concentration(totals, seats, y), x, 0.001, 20_000, rng)
        y = hyper.slice_sample(hyper.seated_discount(cells, seats, x), y, 0.001, 0.98, rng)
        bs.append(x)
        aa.append(y)
    assert np.mean(aa[20:]) == pytest.approx(a, abs=0.08) and np.mean(bs[20:]) == pytest.approx(b, rel=0.3)
    # a root of sticks: the sizes of tables of one restaurant
    root = seated(rng, 1, 3000, 0.5, 4.0, np.full(100_000, 1e-5))[0][0]
    hist = np.array(list(Counter(int(n) for n in root if n).items()), float)
    x, y, bs, aa = 1.0, 0.1, [], []
    for _ in range(60):
        x = hyper.slice_sample(hyper.root_concentration(hist, "hpdd", y, 1), x, 0.001, 20_000, rng)
        y = hyper.slice_sample(hyper.root_discount(hist, x), y, 0.001, 0.98, rng)
        bs.append(x)
        aa.append(y)
    assert np.mean(aa[20:]) == pytest.approx(0.5, abs=0.1) and 1 < np.mean(bs[20:]) < 14
    # a Dirichlet root
    w = rng.dirichlet(np.full(50, 20.0 / 50))
    n = rng.multinomial(5000, w)
    hist = np.array(list(Counter(int(k) for k in n).items()), float)
    x, bs = 1.0, []
    for _ in range(40):
        x = hyper.slice_sample(hyper.root_concentration(hist, "hdp", 0.0, 50), x, 0.001, 20_000, rng)
        bs.append(x)
    assert np.mean(bs[10:]) == pytest.approx(20, rel=0.5)


def test_all_parameters_are_sampled(spark):
    names = ("a", "b", "b0", "a0", "aw", "bw", "aw0", "bw0")
    config = ModelConfig(topics=3, cycles=3, alpha=Prior("hpdd", a=0.2, a0=0.2), beta=Prior("hpdd", a=0.3, a0=0.3), sample=names, sample_start=1, sample_every=1)
    model, _ = tables.fit(corpus(spark, 20, 10), config)
    for side, old in ((model.config.alpha, config.alpha), (model.config.beta, config.beta)):
        assert all(getattr(side, x) != getattr(old, x) for x in ("a", "b", "a0", "b0"))
