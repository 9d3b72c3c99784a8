"""Operators, kernels and samplers against small examples that can be worked by hand or by plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.functions.special import beta_draw, gamma_prior, log_rising, log_rising_histogram, log_stirling, log_sum_exp, stirling_ratios
from topicweave.operators import counts, dynamic, hyper, inference, likelihood, pmi, reports, sampler, selection
from topicweave.plans.config import ModelConfig, Prior
from topicweave.plans.durable import Scratch
from topicweave.plans.ranking import global_rank
from topicweave.streaming.fold_in import fold_in, topic_counts

Z = [(0, 0, 0, 0), (0, 1, 0, 0), (0, 2, 1, 1), (1, 0, 1, 1), (1, 1, 2, 1), (2, 0, 3, 0), (2, 1, 3, 0), (2, 2, 3, 0), (2, 3, 2, 1)]
G = lambda n, a: math.lgamma(n + a) - math.lgamma(a)


@pytest.fixture(scope="module")
def z(spark):
    return spark.createDataFrame(Z, "doc_id long, pos int, word_id long, topic long")


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_counts_by_hand(z):
    wt, dt = counts.word_topic(z), counts.doc_topic(z)
    assert {(r.word_id, r.topic): r.n for r in wt.collect()} == {(0, 0): 2, (1, 1): 2, (2, 1): 2, (3, 0): 3}
    assert {(r.doc_id, r.topic): r.n for r in dt.collect()} == {(0, 0): 2, (0, 1): 1, (1, 1): 2, (2, 0): 3, (2, 1): 1}
    assert {r.topic: r.n for r in counts.totals(wt, "topic").collect()} == {0: 5, 1: 4}
    assert sum(r.n for r in dt.collect()) == len(Z)
    assert counts.nonzero(wt, dt).first() == (4, 5)
    assert {r.doc_id: r.topic for r in counts.top_topic(dt).collect()} == {0: 0, 1: 1, 2: 0}


def test_clamp_keeps_invariants(spark):
    t = spark.createDataFrame([(5, 9), (5, 0), (0, 3), (2, 2), (7, -1)], "n long, t long")
    assert sorted(tuple(r) for r in counts.clamp_tables(t).collect()) == [(0, 0), (2, 2), (5, 1), (5, 5), (7, 1)]


def test_bursts_by_hand(z):
    assert tuple(counts.bursts(z).first()) == (9, 5, 6, 2)


def test_stirling_identities():
    for a in (0.0, 0.3, 0.5, 0.9):
        s = log_stirling(25, a)
        for n in range(1, 24):
            assert s[n, 1] == pytest.approx(G(n - 1, 1 - a))
            for t in range(1, n + 1):
                left = math.exp(s[n + 1, t])
                right = (math.exp(s[n, t - 1]) if s[n, t - 1] > -np.inf else 0) + (n - a * t) * math.exp(s[n, t])
                assert left == pytest.approx(right, rel=1e-9)
        u, v = stirling_ratios(20, a)
        for n in range(2, 19):
            for t in range(2, n):
                assert u[n, t] == pytest.approx((n - a * t) + 1 / v[n, t])


def test_indicator_weights_follow_the_posterior():
    """Opening and staying add up to the ratio of the sums that a customer more makes."""
    n, t, a, b, base, total = 4, 2, 0.3, 2.0, 0.2, 5
    opens, stays = sampler.indicator_weights(n, t, total, base, a, b)
    s = log_stirling(10, a)
    comb = lambda n, t: math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1)
    weight = lambda n, t: math.exp(s[n, t] - comb(n, t))
    assert stays == pytest.approx(weight(n + 1, t) / weight(n, t))
    assert opens == pytest.approx(weight(n + 1, t + 1) / weight(n, t) * (b + a * total) * base)


def test_table_draws_match_the_distribution():
    rng = np.random.default_rng(0)
    n, base, a, b = np.array([6]), np.array([0.4]), 0.3, 1.5
    got = np.bincount([sampler.draw_tables(n, base, a, b, rng)[0] for _ in range(8000)], minlength=7)[1:] / 8000
    s = log_stirling(6, a)[6, 1:]
    w = np.exp(s + np.arange(1, 7) * math.log(0.4) + np.array([sum(math.log(b + a * k) for k in range(t)) for t in range(1, 7)]))
    assert np.abs(got - w / w.sum()).max() < 0.03


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0,), (1,), (17,)], "n long")
    for r in df.select("n", log_rising(F.col("n"), 0.7).alias("g")).collect():
        assert r.g == pytest.approx(G(r.n, 0.7))
    assert log_rising_histogram(df, "n", 0.7).first().v == pytest.approx(sum(G(n, 0.7) for n in (0, 1, 17)))
    assert df.agg(log_sum_exp(F.col("n").cast("double"), F.lit(17.0)).alias("v")).first().v == pytest.approx(math.log(sum(map(math.exp, (0, 1, 17)))))
    assert spark.range(1).select(gamma_prior(2.0).alias("p")).first().p == pytest.approx(0.1 * math.log(2) - 2)
    assert 0 < beta_draw(np.random.default_rng(1), 1e-4, 5.0) < 1


def test_likelihoods_by_hand(z):
    dt, wt = counts.doc_topic(z), counts.word_topic(z)
    alpha, beta = 0.4, 0.05
    want = sum(G(n, alpha) for n in (2, 1, 2, 3, 1)) - sum(G(n, 2 * alpha) for n in (3, 2, 4))
    assert likelihood.dirichlet_alpha(dt, 2, alpha).first().loglik == pytest.approx(want)
    want = sum(G(n, beta) for n in (2, 2, 2, 3)) - G(5, 4 * beta) - G(4, 4 * beta)
    assert likelihood.dirichlet_beta(wt, 4, beta).first().loglik == pytest.approx(want)
    a, b = 0.3, 2.0
    want = sum(G(n - 1, 1 - a) for n in (2, 1, 2, 3, 1)) + sum(t * math.log(a) + G(t, b / a) - G(n, b) for t, n in ((2, 3), (1, 2), (2, 4)))
    assert likelihood.pitman_yor(dt, "doc_id", a, b).first().loglik == pytest.approx(want)
    want = sum(G(n - 1, 1) for n in (2, 1, 2, 3, 1)) + sum(t * math.log(b) - G(n, b) for t, n in ((2, 3), (1, 2), (2, 4)))
    assert likelihood.pitman_yor(dt, "doc_id", 0, b).first().loglik == pytest.approx(want)


def test_merge_gain_is_the_difference_of_likelihoods(z):
    alpha, beta = 0.4, 0.05

    def total(t):
        dt, wt = counts.doc_topic(t), counts.word_topic(t)
        cells = sum(G(r.n, alpha) for r in dt.collect()) + sum(G(r.n, beta) for r in wt.collect())
        return cells - sum(G(r.n, 4 * beta) for r in counts.totals(wt, "topic").collect())

    gain = likelihood.merge_gains(counts.doc_topic(z), counts.word_topic(z), 4, alpha, beta, least=1).first()
    merged = likelihood.apply_merges(z, z.sparkSession.createDataFrame([(0, 1, 1.0)], "k1 long, k2 long, gain double"), 1)
    assert {r.topic for r in merged.collect()} == {0}
    assert gain.gain == pytest.approx(total(merged) - total(z))


def test_probabilities_sum_to_one(z):
    dt, wt = counts.doc_topic(z), counts.word_topic(z)
    latent = dt.select("doc_id").distinct().withColumn("un", F.lit(2.0))
    thetas = [(inference.theta_gamma(dt, latent, 3, 0.1, 1.0, s), "doc_id") for s in (None, (1.0, 1.0))]
    for df, key in ((inference.theta_dirichlet(dt, 3, 0.1), "doc_id"), (inference.phi_dirichlet(wt, 5, 3, 0.1), "topic"), *thetas):
        assert all(r.s == pytest.approx(1) for r in df.groupBy(key).agg(F.sum("p").alias("s")).collect())
    base = z.sparkSession.createDataFrame([(k, 1 / 3) for k in range(3)], "topic long, p double")
    assert all(r.s == pytest.approx(1) for r in inference.theta_pitman_yor(dt, base, 0.3, 2.0).groupBy("doc_id").agg(F.sum("p").alias("s")).collect())
    tables = z.sparkSession.createDataFrame([(0, 3), (1, 2), (2, 0), (3, 0)], "topic long, tables long")
    gem = {r.topic: r.p for r in inference.base_gem(tables, 4, 0.2, 1.0).collect()}
    assert sum(gem.values()) == pytest.approx(1) and gem[2] > 0 and gem[3] == 0


def test_epoch_chain_sums_to_one_and_ripples(spark):
    cells = spark.createDataFrame([(0, 0, 0, 3), (2, 0, 0, 1), (1, 0, 1, 2), (3, 0, 2, 5)], "epoch long, topic long, word_id long, n long")
    base = spark.createDataFrame([(w, 0.25) for w in range(4)], "word_id long, p double")
    p = dynamic.chain(cells, ["topic"], "word_id", 4, 0.3, 2.0, base)
    assert all(r.s == pytest.approx(1) for r in p.groupBy("epoch").agg(F.sum("p").alias("s")).collect())
    ripple = {(r.word_id, r.epoch) for r in counts.ripple_tables(cells, 4).collect()}
    assert ripple == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)}


def test_selection(spark):
    tokens = spark.createDataFrame([(d, p, w) for d, p, w, _ in Z], "doc_id long, pos int, word_id long")
    held = lambda df: sorted((r.doc_id, r.pos) for r in df.filter("held").collect())
    assert held(selection.hold_dict(tokens, 2)) == [(0, 2), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert held(selection.hold_doc(tokens, 3)) == [(0, 2), (2, 2)]
    assert held(selection.hold_fract(tokens, 0.5)) == [(0, 2), (2, 3)]
    assert selection.hold_all(tokens).filter("held").count() == 9
    assert {r.doc_id for r in selection.min_doc_size(tokens, 3).collect()} == {0, 2}
    assert {r.epoch for r in selection.epoch_of(tokens.select("doc_id").distinct(), [1, 2]).collect()} == {0, 1}
    assert selection.append(tokens, tokens, 3).select("doc_id").distinct().count() == 6
    assert {(r.doc_id, r.n) for r in selection.dense_docs(selection.bags(tokens), 4).collect()} == {(0, 3), (1, 2), (2, 4), (3, 0)}
    top = selection.thin(tokens, counts.totals(tokens.withColumn("n", F.lit(1)), "word_id", name="cnt"), 2)
    assert {r.word_id for r in top.collect()} == {0, 1}
    logs = spark.createDataFrame([(0, 0, -1.0), (0, 1, -2.0)], "topic long, word_id long, logp double")
    assert sum(r.p for r in selection.normalised_log(logs, ["topic"]).collect()) == pytest.approx(1)
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "word_id long, word string")
    sims = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.0), ("a", "x", 1.0)], "a string, b string, v double")
    assert [tuple(r) for r in selection.similarity_union([sims], vocab).collect()] == [(0, 1, 0.5)]


def test_pmi_shrinks_to_independence(spark):
    pairs = spark.createDataFrame([(0, 1, 10), (0, 2, 25)], "w1 long, w2 long, c long")
    marginals = spark.createDataFrame([(0, 50), (1, 10), (2, 60)], "word_id long, n long")
    raw = {(r.w1, r.w2): r.pmi for r in pmi.pmi(pairs, marginals, 100).collect()}
    assert raw[0, 1] == pytest.approx(math.log(0.1 / (0.5 * 0.1))) and raw[0, 2] == pytest.approx(math.log(0.25 / 0.3))
    soft = {(r.w1, r.w2): r.pmi for r in pmi.pmi(pairs, marginals, 100, sigma=0.5).collect()}
    assert 0 <= soft[0, 1] < raw[0, 1] and raw[0, 2] < soft[0, 2] <= 0
    assert all(r.pmi == 0 for r in pmi.pmi(pairs, marginals, 100, sigma=9.0).collect())


def test_predictions_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    theta, phi = rng.dirichlet(np.ones(3), 5), rng.dirichlet(np.ones(12) * 0.3, 3)
    seen = [(d, w) for d in range(5) for w in range(12) if rng.random() < 0.4]
    frame = lambda m, a, b: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], f"{a} long, {b} long, p double")
    got = {(r.doc_id, r.rank): r.word_id for r in inference.predict_topk(frame(theta, "doc_id", "topic"), frame(phi, "topic", "word_id"), spark.createDataFrame(seen, "doc_id long, word_id long"), 3).collect()}
    score = theta @ phi
    for d in range(5):
        best = sorted((w for w in range(12) if (d, w) not in seen), key=lambda w: (-round(score[d, w], 12), w))[:3]
        assert [got[d, r] for r in range(1, len(best) + 1)] == best


def test_query_hits_match_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    theta, phi = rng.dirichlet(np.ones(3), 40), rng.dirichlet(np.ones(12) * 0.3, 3)
    theta[20:] = theta[:20]  # ties
    queries = [(q, int(w)) for q in range(6) for w in rng.choice(14, 4, replace=False)] + [(9, 13)]  # words 12 and 13 are unknown
    frame = lambda m, a, b: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], f"{a} long, {b} long, p double")
    asked = spark.createDataFrame(queries, "qid long, word_id long")
    want = {}
    for q in range(6):
        words = [w for p, w in queries if p == q and w < 12]
        cost = {d: round(float(-np.log(theta[d] @ phi[:, words]).sum()), 6) for d in range(40)}
        want |= {(q, r): d for r, d in enumerate(sorted(cost, key=lambda d: (cost[d], d))[2:7], 3)}
    for size in (inference.BROADCAST_BYTES, 100):
        monkeypatch.setattr(inference, "BROADCAST_BYTES", size)
        hits = inference.query_hits(asked, frame(theta, "doc_id", "topic").repartition(3), frame(phi, "topic", "word_id"), 7)
        assert {(r.qid, r.rank): r.doc_id for r in inference.best_documents(hits, 5, skip=2).collect()} == want


def test_precision_and_recall_count_unseen_words(spark):
    predicted = spark.createDataFrame([(d, w) for d in range(4) for w in range(3)], "doc_id long, word_id long")
    actual = spark.createDataFrame([(0, 0), (0, 0), (0, 9), (1, 2), (2, 7), (5, 1)], "doc_id long, word_id long")
    r = inference.precision_recall(predicted, actual, 3).first()
    assert (r.docs, r.empty) == (3, 1) and r.precision == pytest.approx((1 / 2 + 1 + 0) / 3) and r.recall == pytest.approx((1 / 2 + 1 + 0) / 3)


def test_measures(spark):
    pairs = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5)], "p double, q double").withColumn("k", F.lit(1))
    r = reports.vector_measures(pairs, ["k"], F.col("p"), F.col("q")).first()
    assert (r.hellinger, r.kl, r.entropy) == (pytest.approx(0), pytest.approx(0), pytest.approx(math.log(2)))


def test_global_rank_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked, n = global_rank(df, [F.col("v")], "r", Scratch(spark, "test"))
    assert n == 1000 and all(r.v == r.r for r in ranked.collect())
    assert global_rank(spark.range(0), [F.col("id")], "r", Scratch(spark, "test"))[1] == 0


def test_slice_sampler_finds_the_density():
    rng = np.random.default_rng(0)
    xs, x = [], 1.0
    for _ in range(3000):
        x = hyper.slice_sample(lambda v: 3 * math.log(v) - 2 * v, x, 1e-3, 100.0, rng, 1)
        xs.append(x)
    assert np.mean(xs) == pytest.approx(2.0, abs=0.15)  # a gamma of shape 4 and rate 2


@pytest.fixture(scope="module")
def planted(spark):
    """40 documents, each of one of two topics with words of their own."""
    rng = np.random.default_rng(5)
    rows = [(d, p, int(rng.integers(0, 20) + 20 * (d % 2))) for d in range(40) for p in range(30)]
    return spark.createDataFrame(rows, "doc_id long, pos int, word_id long")


def purity(state):
    n = {}
    for r in state.tokens.collect():
        n.setdefault(r.word_id // 20, {}).setdefault(r.topic, 0)
        n[r.word_id // 20][r.topic] += 1
    return sum(max(v.values()) for v in n.values()) / sum(sum(v.values()) for v in n.values())


@pytest.mark.parametrize(
    "config",
    [
        ModelConfig(topics=2, cycles=25, alpha=Prior("dir", weight=0.3), beta=Prior("dir", weight=0.05)),
        ModelConfig(topics=2, cycles=25, alpha=Prior("hdp", b=1.0), beta=Prior("dir", weight=0.05)),
        ModelConfig(topics=2, cycles=25, alpha=Prior("hpdd", a=0.2, b=1.0, a0=0.1), beta=Prior(a=0.1, b=5.0)),
        ModelConfig(topics=2, cycles=25, alpha=Prior("ng", weight=0.3), beta=Prior("dir", weight=0.05), sparse=(1.0, 1.0)),
    ],
    ids=["dir", "hdp", "hpdd", "ng"],
)
def test_planted_topics_are_found(planted, config):
    assert purity(sampler.fit(planted, config)) > 0.9


def test_bursty_and_epoch_models_run_and_repeat(spark, planted):
    config = ModelConfig(topics=2, cycles=3, alpha=Prior("hdp"), burst_a=0.1, burst_b=20.0)
    one, two = (sorted(map(tuple, sampler.fit(planted, config).tokens.collect())) for _ in range(2))
    assert one == two and len(one) == 1200
    epochs = spark.range(40).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 20).alias("epoch"))
    state = sampler.fit(planted, ModelConfig(topics=2, cycles=3, alpha=Prior("hdp"), epochs=2), epochs)
    assert state.tokens.count() == 1200 and state.tokens.select("epoch").distinct().count() == 2


def test_perplexity_falls(planted):
    config = ModelConfig(topics=2, cycles=1, alpha=Prior("dir", weight=0.3), beta=Prior("dir", weight=0.05))
    test = selection.hold_doc(planted.filter("doc_id < 10"), 3)
    early = sampler.log2_perplexity(sampler.fit(planted, config), test, 2, 3)
    late = sampler.log2_perplexity(sampler.fit(planted, ModelConfig(**{**config.__dict__, "cycles": 25})), test, 2, 3)
    assert late[0] < early[0] and late[1] == 100


def test_hyper_parameters_stay_in_bounds(planted):
    config = ModelConfig(topics=2, cycles=4, alpha=Prior("dir"), beta=Prior("dir"), sample=("alpha", "beta"), sample_start=1, sample_every=1)
    end = sampler.fit(planted, config).config
    assert 1e-4 <= end.alpha.weight <= 1 and 1e-4 <= end.beta.weight <= 1


@pytest.mark.parametrize(
    "bad",
    [{"topics": 0}, {"alpha": Prior("x")}, {"alpha": Prior("hdp", a0=0.1)}, {"alpha": Prior("dir", a=0.1)}, {"sparse": (1.0, 1.0)}, {"burst_b": -1.0}, {"epochs": 2, "burst_b": 1.0}, {"sample": ("q",)}, {"sample": ("alpha",)}],
)
def test_refused_configurations(bad):
    with pytest.raises(ValueError):
        ModelConfig(**bad)


def test_configuration_round_trip():
    c = ModelConfig(topics=3, alpha=Prior("ng", weight=0.5), sparse=(1.0, 2.0)).scaled(1000, 10)
    assert ModelConfig.from_dict(c.as_dict()) == c and c.beta.weight == 0.001


def test_fold_in_batch_and_stream(spark, tmp_path):
    phi = np.array([[0.45, 0.45, 0.05, 0.05], [0.05, 0.05, 0.45, 0.45]])
    vocab = {w: i for i, w in enumerate(["a", "b", "c", "d"])}
    docs = spark.createDataFrame([(0, "a b a", "2024-01-01 00:00:00"), (1, "C d d", "2024-01-01 00:01:00"), (2, None, "2024-01-01 00:02:00")], "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.doc_id: r for r in fold_in(docs, vocab, phi, 0.1).collect()}
    assert np.argmax(got[0].topics) == 0 and np.argmax(got[1].topics) == 1
    assert got[2].tokens == 0 and got[2].log2_perplexity is None
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = fold_in(stream, vocab, phi, 0.1).writeStream.format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("folded").count() == 3
    timed = spark.createDataFrame([(0, [0.9, 0.1], "2024-01-01 00:00:00")], "doc_id long, topics array<double>, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert topic_counts(timed, "ts", "1 minute", "5 minutes").first().topic == 0


def test_sampled_perplexity_resume_and_growth(spark, planted, tmp_path):
    from topicweave.sources import writers

    config = ModelConfig(topics=2, cycles=10, alpha=Prior("dir", weight=0.3), beta=Prior("dir", weight=0.05))
    state = sampler.fit(planted, config)
    value, n = sampler.log2_perplexity_sampled(state, planted.filter("doc_id < 6"), 2, 3)
    assert n == 180 and 4 < value < 5.5  # 20 words for each topic
    writers.save_state(str(tmp_path / "s"), {"tokens": state.tokens}, {"config": state.config.as_dict(), "root": state.root.tolist(), "cycle": state.cycle})
    tables, params = writers.load_state(spark, str(tmp_path / "s"))
    back = sampler.resume(tables["tokens"], ModelConfig.from_dict(params["config"]), np.array(params["root"]), params["cycle"])
    assert back.config == state.config and sorted(map(tuple, back.tokens.collect())) == sorted(map(tuple, state.tokens.collect()))
    more = sampler.fit(planted, config, state=sampler.grow(sampler.resume(tables["tokens"], back.config), 3))
    assert more.config.topics == 3 and more.tokens.count() == 1200 and purity(more) > 0.9
    with pytest.raises(ValueError, match="more than the model"):
        sampler.resume(tables["tokens"], ModelConfig(topics=1))


def test_fixed_word_side(spark, planted):
    phi = spark.createDataFrame([(k, w, 0.05 if w // 20 == k else 1e-6) for k in range(2) for w in range(40)], "topic long, word_id long, p double")
    state = sampler.fit(planted, ModelConfig(topics=2, cycles=2, alpha=Prior("dir", weight=0.3), beta=Prior("dir")), phi=phi)
    assert state.tokens.filter("topic = floor(word_id / 20)").count() > 1190


def test_left_to_right_is_near_the_exact_sum(planted):
    import itertools

    phi, prior, words = np.array([[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]]), np.array([0.5, 0.5]), np.array([0, 2, 2, 1])
    exact = 0.0
    for z in itertools.product(range(2), repeat=4):
        p, n = 1.0, np.zeros(2)
        for w, k in zip(words, z, strict=True):
            p *= (n[k] + prior[k]) / (n.sum() + prior.sum()) * phi[k, w]
            n[k] += 1
        exact += p
    assert sampler.left_to_right(words, phi, prior, 4000, np.random.default_rng(0)) == pytest.approx(math.log(exact), abs=0.05)
    state = sampler.fit(planted, ModelConfig(topics=2, cycles=10, alpha=Prior("dir", weight=0.3), beta=Prior("dir", weight=0.05)))
    value, n = sampler.log2_perplexity_left_to_right(state, planted.filter("doc_id < 3"), 5)
    assert n == 90 and 4 < value < 5.5
