"""Sharding, mixing, packing and the pipeline."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.llm import mixing, packing, sharding

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_all_cells_by_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = sharding.hilbert(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [5, 100, 1003])
def test_shards(docs, n):
    rows = [(k % 900, f"text {k % 50}" * (k % 9), "en", f"s{k % 4}") for k in range(n)]
    got = sharding.shard(docs(rows)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[k]) for k in range(24)]
    assert len(got) == n and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, _, _ in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_odd(odd, empty):
    got = {r.doc_id: r for r in sharding.shard(odd).collect()}
    assert got[1].size == 8 and got[1].text_crc32 == 0 and sharding.shard(odd).count() == 10
    assert sharding.shard(empty).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(w[s] for s in free), 1)
        over = [s for s in free if share * w[s] > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, share * w[s]) for s in names}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("leaf", [7, 10_000])
def test_mix(docs, leaf):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.pareto(1.3) * 20 + 1)), None, (None, "a", "B", "é", "big", "tiny", "z")[int(min(6, rng.pareto(1) * 2))]) for k in range(600)]
    rows += [(900, None, None, "a"), (901, "", None, "only blank"), (902, "x y", None, "small"), (5, rows[5][1], None, rows[5][3])]
    got = mixing.mix(docs(rows), leaf_rows=leaf).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    aims, taken = brute_targets(dict(sizes)), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(aims[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - aims[s]) <= largest for s in sizes)
    again = mixing.mix(docs(rows).repartition(3), leaf_rows=leaf).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_edges(odd, empty, docs):
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).count() == 0
    rows = [(k, "a b c d", "en", "s" if k % 3 else "t") for k in range(40)]
    out = mixing.mixed(docs(rows))
    have = out.groupBy("doc_id").count().collect()
    want = {r.doc_id: r.copies for r in mixing.mix(docs(rows)).collect()}
    assert {r.doc_id: r["count"] for r in have} == {i: c for i, c in want.items() if c} and out.columns == docs(rows).columns


def test_mixed_rows_that_repeat_share_their_copies(docs):
    """Equal rows are taken as often as the mix takes them in all."""
    rows = [(5, "one two three", None, "a")] * 200 + [(k, "w " * (k % 9), None, "b" if k % 3 else "c") for k in range(10, 300)] + [(6, "four five six", None, "a")] * 3
    table = docs(rows)
    taken = {r.source: r.t for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    got = {r.source: r.t for r in mixing.mixed(table).groupBy("source").agg(F.sum(words).alias("t")).collect()}
    assert got == taken
    target = mixing.mix(table).filter("source = 'a'").first().target
    assert abs(got["a"] - target) <= 3


@pytest.mark.parametrize(("step", "frac"), [(mixing.pivot, [0.37] * 7), (mixing.pair, [0.4, 0.1, 0.7, 0.5, 0.2, 0.9, 0.6])], ids=["pool", "pairs"])
def test_rounding_keeps_mass_and_expectations(step, frac):
    rng = np.random.default_rng(2)
    size, frac = np.array([900, 500, 100, 90, 40, 7, 3]), np.array(frac)
    drawn = np.array([step(size, frac, rng.random(7)) for _ in range(6000)])
    assert np.abs(drawn.mean(axis=0) - frac).max() < 0.03
    assert np.allclose(drawn @ size, frac @ size)
    assert (((drawn > 0) & (drawn < 1)).sum(axis=1) <= 1).all()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


WEIRD = ["a  b", " lead", "trail ", "x\n\ny z", "don't I'll we've", "tab\tx \n y", "word.\nNext, end.\n", "1.5,a,b;c 'sx o'.s", "é.È ñ!a\x1cb \x1c c", "", "  ", "a.\n b.\nc", "v.'s ll.'ll a.\n's", "a. b  c", "日本語 テスト.次\n。x", "a,_b ._c", "é. é,"]


@pytest.mark.parametrize("text", WEIRD, ids=range(len(WEIRD)))
def test_encoder_equals_tokenizer(text):
    import public_tokenizers

    e = packing.Encoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(e.encode(text), "<u4").tolist() == [*tokenizer().encode(text, add_special_tokens=False).ids, 0]


def test_encoder_equals_tokenizer_on_random_texts():
    import public_tokenizers

    e, t, rng = packing.Encoder.of(public_tokenizers.path("byte_bpe_50k.json")), tokenizer(), np.random.default_rng(3)
    assert e.fast is not None
    parts = ["<|endoftext|>", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\u00a0", "\u3000", "1", "23", "½", "a", "bc", "The", "é", "ß", "漢", "ع", "𝔘", "🙂", "́", ".", ",", "'", "_", "-", "<|", "|>"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def plain_packing(leaves, window):
    """Sequences of (doc, start, length) by the stated rule, level after level, with levels tried one by one: one root above the leaves."""

    def place(levels, size):
        def cost(h):
            n = {k: len(v) for k, v in levels.items()}
            if h:
                n[h] -= 1
            if h + size < window:
                n[h + size] = n.get(h + size, 0) + 1
            return sum(x * x for x in n.values())

        return min((cost(h), -h) for h in range(window - size + 1) if h == 0 or levels.get(h))[1] * -1

    def put(levels, pieces, size, done):
        h = place(levels, size)
        held = (levels[h].pop() if h else []) + pieces
        if h + size == window:
            done.append(held)
        else:
            levels.setdefault(h + size, []).append(held)

    done, passed = [], []
    for docs in leaves:
        levels = {}
        for doc, n in docs:
            cut = n - n % window
            done += [[(doc, s, window)] for s in range(0, cut, window)]
            if n > cut:
                put(levels, [(doc, cut, n - cut)], n - cut, done)
        passed += [x for h in sorted(levels, reverse=True) for w in levels[h] for x in w]
    levels = {}
    for x in sorted(passed, key=lambda x: -x[2]):
        put(levels, [x], x[2], done)
    flow = [(d, s + i) for h in sorted(levels, reverse=True) for w in levels[h] for d, s, n in w for i in range(n)]
    for k in range(0, len(flow), window):
        part = flow[k : k + window]
        starts = [i for i, (d, s) in enumerate(part) if not i or part[i - 1] != (d, s - 1)]
        done.append([(*part[i], j - i) for i, j in zip(starts, [*starts[1:], len(part)], strict=True)])
    return sorted(map(tuple, done))


@pytest.mark.parametrize("window", [16, 64, 256])
def test_packing_equals_a_plain_one(spark, window):
    t, rng = tokenizer(), np.random.default_rng(window)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 2 * window)))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    leaves = [[(r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in part] for part in table.rdd.glom().collect()]
    seq = defaultdict(list)
    for p in packing.packed(table, window=window).collect():
        seq[p.sequence_id].append((p.offset, p.doc_id, p.start, p.length))
    got = sorted(tuple(x[1:] for x in sorted(ps)) for ps in seq.values())
    assert got == plain_packing([p for p in leaves if p], window)


@pytest.mark.parametrize(("fan_in", "most_open"), [(2, 3), (8, 2048)])
def test_packing_tree(spark, fan_in, most_open):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 300)))) for i in range(600)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), window=128, fan_in=fan_in, most_open=most_open).collect()
    assert whole(pieces, rows, 128) > 0.99
    if most_open > 600:
        assert sum(p.length for p in pieces if p.poured) < 0.15 * sum(p.length for p in pieces)


def whole(pieces, rows, window=1024):
    """Every id in one piece; offsets without gaps; no sequence above the window."""
    t, by, seq = tokenizer(), defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    texts = defaultdict(list)
    for i, text in rows:
        texts[i].append(text or "")
    assert set(by) == set(texts)
    for i, ts in texts.items():
        if len(ts) > 1:
            continue
        ids, at = np.array([*t.encode(ts[0], add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    return sum(p.length for p in pieces) / (len(seq) * window)


@data
def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert whole(packing.packed(docs.coalesce(1)).collect(), [(r.doc_id, r.text) for r in docs.collect()]) > 0.98


def test_packing_edges(odd, empty):
    from .conftest import ODD

    got = packing.packed(odd).collect()
    whole(got, ODD)
    assert next(r for r in got if r.doc_id == 1).length == 1 and packing.packed(empty).count() == 0


def test_sum_of_squares_places_best():
    s = packing.SumOfSquares(10)
    rng = np.random.default_rng(0)
    for _ in range(500):
        size = int(rng.integers(1, 10))
        n = s.count[:10].copy()

        def after(level, n=n, size=size):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 10:
                m[level + size] += 1
            return (m[1:] ** 2).sum()

        options = [h for h in range(0, 11 - size) if h == 0 or n[h]]
        level = s.place(size)
        assert level in options and after(level) == min(map(after, options))
        s.add([(0,)], size)


@data
def test_pipeline_matches_its_stages(spark):
    import corpus_pipeline
    from topicweave.llm import exact_dedup, near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    known = {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
    newest = {}
    for i in sorted(known):
        newest[rows[i].text] = i
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        out[name] = [r.doc_id for r in now.collect()]
    assert set(out["language id"]) == known
    assert sorted(out["exact dedup"]) == sorted(newest.values())
    left = docs.filter(docs.doc_id.isin(out["exact dedup"]))
    assert set(out["near dedup"]) == {r.doc_id for r in near_dedup.near_duplicates(left).collect() if r.kept}
    assert set(out["mixing"]) <= set(out["near dedup"])
    assert exact_dedup.keep_one(left).count() == left.count()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got if r.start == 0) == sorted(out["mixing"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_odd_rows(docs, odd, empty, spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names pass all stages; an empty table stays one."""
    import corpus_pipeline

    def through(now):
        seen = [now.count()]
        columns = now.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, "").write.parquet(f"file://{tmp_path}/{seen[0]}-{k}")
            now = spark.read.parquet(f"file://{tmp_path}/{seen[0]}-{k}")
            assert name == "packing" or now.columns == columns
            seen.append(now.count())
        return now, seen

    last, seen = through(odd.withColumn("lang", F.lit("en")))
    # texts without a letter go, then the repeated row; the null id stays a row of its own
    assert seen[0] == 10 and seen[1] == 7 and seen[2] == 6 and seen[3] == 6
    assert {r.doc_id for r in last.collect()} <= {None, 4, 5, 7, 8, 9}
    pieces = last.filter("doc_id = 8").collect()
    total = {r.doc_tokens for r in pieces}
    assert not pieces or sum(r.length for r in pieces) % total.pop() == 0
    assert through(empty)[1] == [0] * 6
