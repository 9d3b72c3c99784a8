"""Exact and near duplicates against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.llm import exact_dedup, near_dedup, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in sets}


def exact(rows):
    best, size = {}, {}
    for i, t in rows:
        k = t or ""
        best[k] = max(best.get(k, -1), -1 if i is None else i)
        size[k] = size.get(k, 0) + 1
    return sorted(((i, None if best[t or ""] < 0 else best[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))], ids=["sha256", "colliding"])
def test_exact(docs, odd, empty, digest):
    from .conftest import ODD

    rows = ODD + [(100 + k, f"text {k % 7}") for k in range(60)] + [(200, "a B"), (201, "a b"), (202, "a b ")]
    got = exact_dedup.exact_duplicates(docs(rows), digest=digest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())
    assert exact_dedup.exact_duplicates(empty, digest=digest).count() == 0


def test_exact_rows_of_hot_texts(docs, monkeypatch):
    """Texts of many copies take another way to their winner, broadcast or salted, with the same rows."""
    from topicweave.llm import lookups

    rows = [(k, "hot" if k % 3 else f"text {k % 50}") for k in range(400)] + [(None, "hot"), (7, "hot")]
    for large, most in ((5, 100), (5, 0), (1000, 100), (1, 0)):
        monkeypatch.setattr(exact_dedup.with_winners, "__defaults__", (large,))
        monkeypatch.setattr(lookups.look_up, "__defaults__", (most, 4))
        got = exact_dedup.exact_duplicates(docs(rows))
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == exact(rows)


def test_exact_keep_one(docs, empty):
    rows = [(1, "a", "en", "s"), (3, "a", "fr", "t"), (2, None), (4, ""), (5, "b")]
    kept = exact_dedup.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id, r.text, r.lang) for r in kept.collect()) == [(3, "a", "fr"), (4, "", None), (5, "b", None)]
    assert exact_dedup.keep_one(empty).count() == 0


def test_exact_keep_one_with_maps(spark):
    rows = [(1, "a", {"k": 1}, [{"x": 2}]), (3, "a", {"k": 3}, None), (None, "a", None, None), (None, "b", {"z": 0}, [])]
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, l array<map<string,int>>"))
    assert sorted(((r.text, r.doc_id, r.m) for r in kept.collect())) == [("a", 3, {"k": 3}), ("b", None, {"z": 0})]


def sample():
    import random

    rnd = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for size in (6, 40, 120, 300):
        for _ in range(8):
            base = [rnd.choice(words) for _ in range(size)]
            for _ in range(rnd.randint(1, 6)):
                t = list(base)
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    t[rnd.randrange(size)] = rnd.choice(words)
                rows.append((n, " ".join(t).title() if rnd.random() < 0.3 else " \n".join(t)))
                n += 1
    common = " ".join(rnd.choice(words) for _ in range(60))
    rows += [(n + k, common + " " + " ".join(rnd.choice(words) for _ in range(150))) for k in range(40)]
    n = len(rows)
    base = [rnd.choice(words) for _ in range(200)]
    for k in range(60):  # a large group, some of it near the threshold
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(200)] = rnd.choice(words)
        rows.append((n + k, " ".join(t)))
    return [*rows, (1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "One  two"), (1005, "y" * 50_000), (1006, "q z " * 5000), (1007, "Q z " * 5000)]


def test_near_matches_brute_force(docs):
    rows = sample()
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(rows)).collect()}
    want = components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingle_set(dict(rows)[i])) and r.kept == (i == want[i]) for i, r in got.items())


def test_near_over_many_ranges(docs, spark, monkeypatch):
    """Pairs across the bounds of ranges are found too."""
    rows = sample()
    monkeypatch.setattr(near_dedup, "shuffle_width", lambda s: 7)
    plain = near_dedup.DataFrame.count
    monkeypatch.setattr(near_dedup.DataFrame, "count", lambda self: plain(self) * 1000)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert got == components(rows)


def crowd(groups, size=2):
    """Texts that share much below the threshold, some of which are linked just above it."""
    import random

    rnd = random.Random(11)

    def some(n):
        return [f"v{rnd.randrange(10**9)}" for _ in range(n)]

    core, rows = some(500), []
    for _ in range(groups):
        shared = some(25)
        rows += [" ".join(core + shared + some(81)) for _ in range(size)] + [" ".join(core + some(106)) for _ in range(2)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [5_000, 7], ids=["whole", "blocks"])
def test_near_in_a_crowd(docs, monkeypatch, block):
    """No link is lost where many texts are nearly linked, also when frequent shingles are split into blocks."""
    from topicweave.llm import prefix_join

    monkeypatch.setattr(prefix_join, "BLOCK", block)
    rows = crowd(100)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(rows)).collect()}
    want = components(rows)
    assert len(set(want.values())) == 300
    assert got == want


def test_near_hub(docs):
    """Texts that are each linked with one text and not with each other are one component."""
    import random

    rnd = random.Random(6)
    base = [f"h{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        t = list(base)
        for j in rnd.sample(range(10, 390), 11):
            t[j] = f"x{k}y{j}"
        rows.append((k, " ".join(t)))
    sets = [shingle_set(t) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets[1:]) and 100 * len(sets[1] & sets[2]) < 75 * len(sets[1] | sets[2])
    assert {r.component_id for r in near_dedup.near_duplicates(docs(rows)).collect()} == {0}


def test_regions_take_the_depth_that_their_crowd_asks_for(monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 3)
    rng = np.random.default_rng(2)
    prefix = rng.integers(0, 3, (500, near_dedup.DEPTH)).astype(">u4")
    tree = np.sort(rng.integers(0, 2, 500))
    order = np.lexsort((*prefix.T[::-1], tree))
    tree, prefix = tree[order], prefix[order]
    rows = [(t, *p) for t, p in zip(tree.tolist(), prefix.tolist(), strict=True)]

    def region(i):
        for depth in range(near_dedup.LEAST_PREFIX, near_dedup.DEPTH + 1):
            same = [j for j, r in enumerate(rows) if r[: depth + 1] == rows[i][: depth + 1]]
            if len(same) <= 3 or depth == near_dedup.DEPTH:
                return same[0]

    assert near_dedup.regions(tree, prefix).tolist() == [region(i) for i in range(500)]


def test_prefix_join_finds_every_pair(docs, monkeypatch, tmp_path, spark):
    """Without the rounds before it, in any order of shingles and however they are split."""
    from topicweave.llm import prefix_join
    from topicweave.plans.durable import Scratch

    rows = [(i, t) for i, t in sample() if t and t.strip()]
    sets = {i: shingle_set(t) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    scratch, table = Scratch(spark, "test"), docs(rows)
    reps = near_dedup.signatures(table).select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"), "digest")
    for block, known in ((5_000, 200_000), (3, 200_000), (5_000, 1)):
        monkeypatch.setattr(prefix_join, "BLOCK", block)
        monkeypatch.setattr(prefix_join, "KNOWN", known)
        got = {(r.a, r.b) for r in prefix_join.like_pairs(table, reps, 75, scratch).collect()}
        assert want <= got


def test_near_odd_rows(odd, empty, docs):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1
    assert by[None].component_id is None and by[None].kept
    assert by[5].component_id == 5 and by[7].n_shingles == 1
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(docs([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, "a b c d e f")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
    assert "a b" in kept.columns


def test_shingles_of_a_batch():
    texts = ["a b c d e f", "", "A B C D E F", "a b", "x\x0by\x0cz w v", "é É ß   x"]
    values, bounds = shingles.shingle_sets(texts)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert sets[0] == sets[2] and len(set(sets)) == 5
    d = shingles.set_digests(values, bounds)
    assert d[0] == d[2] and len({d[0], d[1], d[3], d[4], d[5]}) == 5
    m = shingles.minima(values, bounds, 8)
    assert (m[0] == m[2]).all() and (m[1] == 0xFFFFFFFF).all()


def test_pairs_are_confirmed_in_slices_of_bounded_size(docs, monkeypatch):
    """All sets that pairs name were written and met at once before; slices find the same links."""
    rows = [(k, " ".join(f"w{k // 2}x{i}" for i in range(20 + k % 2))) for k in range(80)]
    want = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs(rows)).collect())
    written, once = [], near_dedup.sets_of

    def counted(pairs, docs, scratch):
        out = once(pairs, docs, scratch)
        written.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "sets_of", counted)
    monkeypatch.setattr(near_dedup, "SLICE_BYTES", 1)
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs(rows)).collect())
    assert got == want == [(k, k // 2 * 2) for k in range(80)]
    assert sum(written) >= 80 and max(written) <= 40


def test_pipeline_keeps_no_table_that_is_not_read_again(spark, tmp_path, docs, monkeypatch):
    import os

    import corpus_pipeline

    docs([(k, f"some words of text {k} that are its own", "en", "s") for k in range(20)]).write.parquet(f"{tmp_path}/documents.parquet")
    kept, keep = [], corpus_pipeline.Scratch.keep

    def noted(self, *args):
        out = keep(self, *args)
        if "/pipeline-" in out._scratch_path:
            kept.append(out._scratch_path.removeprefix("file:"))
        return out

    monkeypatch.setattr(corpus_pipeline.Scratch, "keep", noted)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 20
    assert len(kept) == 5 and [os.path.exists(p) for p in kept[:3]] == [False] * 3 and os.path.exists(kept[-1])


def test_later_rounds_follow_links_between_components_only(spark):
    """A round's links are those of components known before; what is inside one of them is not walked again."""
    from topicweave.plans.durable import Scratch

    scratch = Scratch(spark, "rounds")
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first, second = [(k, k + 1) for k in range(40)] + [(50, 51)], [(k, k + 2) for k in range(39)] + [(60, 61), (7, 51), (55, 60)]
    known = near_dedup.components(frame(first), scratch)
    assert sorted(map(tuple, near_dedup.relabelled(frame(second), known).collect())) == [(0, 50), (55, 60), (60, 61)]
    got = {r.node: r.label for r in near_dedup.components(frame(second), scratch, known).collect()}
    assert got == {r.node: r.label for r in near_dedup.components(frame(first + second), scratch).collect()}
    assert got == dict.fromkeys([*range(41), 50, 51], 0) | dict.fromkeys([55, 60, 61], 55)


def test_small_tables_have_few_files(spark):
    """Pairs, links and labels are written in as many files as their texts ask for, not as a shuffle has partitions."""
    rows = spark.range(1000).repartition(50)
    assert near_dedup.small(rows, 1000).rdd.getNumPartitions() == 1
    assert near_dedup.small(rows, 3 * near_dedup.FILE_TEXTS).rdd.getNumPartitions() == 3
    assert near_dedup.small(rows, 0).count() == 1000
