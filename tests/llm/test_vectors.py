"""Operators on vectors and conversations against plain versions."""

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pytest

from topicweave.llm import embedding_dedup, lookups, prefix_trie, scans, small_world, vector_codes
from topicweave.plans.durable import Scratch

VECTORS = "vec_id long, embedding array<float>, label int, key string, v string, node long, weight string, shard int, label2 string"


def frame(spark, rows):
    """Vectors (vec_id, embedding, label) with more columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "k", "v", 1, "w", 2, "l") for r in rows], VECTORS)


def clustered(n, seed, dims=16):
    """Unit-like vectors of which a third are near copies of one, some exact copies, and some of others."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    hot = rng.normal(size=dims)
    x[: n // 3] = hot + 0.05 * rng.normal(size=(n // 3, dims))
    x[n // 3 : n // 3 + 20] = x[n // 3]
    for k in range(n // 2, n // 2 + 60, 3):
        x[k + 1], x[k + 2] = x[k] + 0.1 * rng.normal(size=dims), x[k] + 0.3 * rng.normal(size=dims)
    return x.astype(np.float32)


def plain_links(rows):
    ok = [k for k, (i, v, _) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links, label = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    label[find(a)] = find(b)
    least = {}
    for k in ok:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((r[0], links[k], least[find(k)] if k in ok else r[0]) for k, r in enumerate(rows)), key=str)


def linked(df):
    assert all(r.kept == (r.vec_id == r.component_id) for r in df.collect())
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_embedding_dedup(spark):
    rows = [(i, v.tolist(), 0) for i, v in zip(range(500, 0, -1), clustered(500, 1), strict=True)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [float("nan")] * 16, None), (1005, [float("inf")] + [1.0] * 15, 1)]
    rows += [(None, rows[0][1], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [-1.0, 2.0], 1), (1009, [3e38] * 16, 2), (1010, [1e-38] * 16, 2), (7, rows[3][1], 0), (7, rows[3][1], 0)]
    got = linked(embedding_dedup.near_duplicates(frame(spark, rows).repartition(3)))
    assert got == plain_links(rows)


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert linked(embedding_dedup.near_duplicates(frame(spark, [(1, None, 1), (None, [1.0], 1)]))) == [(1, 0, 1), (None, 0, None)]
    assert linked(embedding_dedup.near_duplicates(frame(spark, [(5, [1.0, 0.0], 1)]))) == [(5, 0, 5)]


def test_more_shards_and_double_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARDS", 7)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(300, 2))]
    wide = frame(spark, rows).selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert linked(embedding_dedup.near_duplicates(wide)) == plain_links(rows)


def test_small_world_finds_what_all_comparisons_find():
    x = embedding_dedup.unit(clustered(3000, 3, 32)).astype(np.float32)
    world = small_world.SmallWorld.build(x)
    assert [len(level) for level in world.links] == sorted((len(level) for level in world.links), reverse=True)
    found, product = world.search(x[::7], 64)
    true = x[::7] @ world.vectors.T
    best = np.sort(true, axis=1)[:, -10:].sum()
    assert np.sort(product, axis=1)[:, -10:].sum() >= 0.97 * best
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in found)
    again = small_world.SmallWorld.build(x)
    assert all((a == b).all() for a, b in zip(world.links, again.links, strict=True))


def test_audit_widens_to_all(monkeypatch):
    """With a graph that finds nothing, all vectors are compared."""
    x = clustered(400, 4)
    row = embedding_dedup.graph(pd.DataFrame({"shard": 0, "node": range(400), "weight": 1, "v": list(x)})).iloc[0]
    shard = embedding_dedup.Shard(row, np.float32)
    monkeypatch.setattr(shard.world, "search", lambda q, w: (np.zeros((len(q), 1), int), np.full((len(q), 1), -1.0, np.float32)))
    width = embedding_dedup.audited(shard, shard)
    assert width > embedding_dedup.WIDEST
    found = sum(len(r) for r, _ in embedding_dedup.candidates(shard.rough, shard, width))
    assert found == (shard.rough @ shard.rough.T >= embedding_dedup.LEAST - embedding_dedup.SLACK).sum()


def plain_codes(rows, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v) and len(v) % 8 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * c) for c in r[1]]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[math.floor(4096 * max(min(c, 4096), -4096)) for c in np.array(v, np.float32).astype(float)] for _, v, _ in kept], dtype=object)
    width = x.shape[1] // 8
    parts = [x[:, p * width : (p + 1) * width] for p in range(8)]
    books = [list(map(list, p[:16])) for p in parts]

    def assign():
        codes, errors = [], []
        for p in range(8):
            far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in books[p]] for v in parts[p]]
            codes.append([f.index(min(f)) for f in far])
            errors.append([min(f) for f in far])
        return codes, [sum(e) for e in zip(*errors, strict=True)]

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(8):
            for k in range(len(books[p])):
                mine = [v for v, c in zip(parts[p], codes[p], strict=True) if c == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    codes, errors = assign()
    by = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for p in books for entry in p for c in entry).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{codes[p][k]:02x}" for p in range(8)), errors[k], by[r[2]], digest) for k, r in enumerate(kept)), key=str)


def coded(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_vector_codes(spark):
    rows = [(i, v.tolist(), i % 3 if i % 5 else None) for i, v in zip(range(150, 0, -1), clustered(150, 5), strict=True)]
    rows += [(1000, None, 1), (-1, [1.0, None] * 8, 1), (-2, [float("nan")] * 16, 1), (-3, [], 1), (-4, [1.0] * 7, 1), (2000, [1.0] * 8, 1), (3000, [1e30] * 16, 1), (None, [0.5] * 16, 1), (4, rows[7][1], 2), (4, rows[7][1], 2)]
    assert coded(vector_codes.encode(frame(spark, rows).repartition(5))) == plain_codes(rows)


def test_vector_codes_of_few(spark):
    few = [(i, [float(i * k % 5) for k in range(8)], 1) for i in range(5)]
    assert coded(vector_codes.encode(frame(spark, few))) == plain_codes(few)
    assert vector_codes.encode(frame(spark, few).limit(0)).count() == 0
    assert vector_codes.encode(frame(spark, [(1, None, 1)])).count() == 0


def test_only_changes_are_summed(spark):
    """Running sums are those of all assignments, and a round tells no more than what moved."""
    rows = [(i, v.tolist(), 1) for i, v in enumerate(clustered(200, 6))]
    fit = frame(spark, rows).selectExpr("vec_id", "cast(label as string) label", "transform(embedding, x -> cast(floor(x * 4096) as int)) v")
    scratch = Scratch(spark, "test")
    state, books, known = vector_codes.train(fit, scratch, rounds=3)
    before = {r.vec_id: bytes(r.codes) for r in state.collect()}
    done = scratch.keep(vector_codes.one_round(state, books, known))
    after = {r.vec_id: bytes(r.codes) for r in done.filter("part is null").collect()}
    moved = {(p, c[p]) for i in before for p in range(8) for c in (before[i], after[i]) if before[i][p] != after[i][p]}
    count, _ = vector_codes.changes(done, books.shape[2])
    assert {(r.part, r.entry) for r in done.filter("part is not null").collect()} <= moved
    want = np.zeros_like(count)
    for i in before:
        for p in range(8):
            want[p, after[i][p]] += 1
            want[p, before[i][p]] -= 1
    assert (count == want).all()


def test_look_up_salts_hot_keys(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as k")
    table = spark.createDataFrame([(7, "seven"), (None, "none"), (11, "eleven")], "k long, name string")
    want = {i: "seven" if i % 3 == 0 else "none" if i % 3 == 1 else "eleven" if i == 11 else None for i in range(1000)}
    for most in (10, 0):
        assert {r.id: r.name for r in lookups.look_up(rows, table, "k", most).collect()} == want


def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    turns = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    out = []
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        inner = {p[:-1] for p in members if p}
        ends = ",".join(str(c) for c in who if built[c] == prefix)
        out.append((who[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(who), sum(p[:-1] == prefix for p in members if p), sum(p not in inner for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_of(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, True, "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, depth long, head boolean, digest string")
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df.repartition(parts)).collect())


def test_prefix_trie(spark):
    rng = np.random.default_rng(7)
    rows = [(c, t, "user" if t % 2 else "bot", f"say {rng.integers(3)}" + "é𝔘" * int(rng.integers(3))) for c in range(0, 260) for t in range(int(rng.integers(0, 7)))]
    rows += [(100, t, "user", "again") for t in range(300, 420)]  # one long conversation
    rows += [(c, 0, "user", "hello") for c in range(1000, 1060)] + [(c, 1, "bot", None) for c in range(1000, 1040)] + [(c, 2, None, "third") for c in range(1000, 1020)]
    rows += [(5, None, "user", "first"), (5, 3, "x", "tie"), (5, 3, "y", "tie"), (5, 3, "y", "tie"), (None, 1, "user", "nobody"), (-150, 1, "user", "minus"), (-7, 1, "u", "m"), (-7, 2, "u", "n"), (777, 2, None, None)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_prefix_trie_of_little(spark):
    assert trie_of(spark, [(None, 1, "a", "b")]) == []
    assert trie_of(spark, [(3, 1, "a", "b")]) == plain_trie([(3, 1, "a", "b")])


def test_heavy_paths_are_short(spark):
    """No node is below more light nodes than the logarithm of the conversations, though the trie is deep."""
    rows = [(100 * c, t, "u", "same" if t < c else f"own {c}") for c in range(40) for t in range(c + 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "test")
    turns, plan = prefix_trie.ordered_turns(df, scratch)
    nodes = prefix_trie.nodes_of(prefix_trie.rebuilt(turns, plan, scratch), scratch)
    at = {(r.conv, r.depth): r for r in nodes.collect()}
    light = 0
    for r in at.values():
        n = 0
        while r.depth:
            n += r.light
            r = at[(r.parent, r.depth - 1)]
        light = max(light, n)
    assert 1 <= light <= math.log2(40)
    heads = {(r.conv, r.depth): (r.head, r.start) for r in prefix_trie.with_paths(nodes, scratch).collect()}
    for key, r in at.items():
        assert heads[key] == (key if r.light else heads[(r.parent, r.depth - 1)])


@pytest.mark.parametrize("width", ["1", "9"])
def test_segments_across_ranges(spark, width):
    rng = np.random.default_rng(8)
    rows = [(0 if k < 300 else int(rng.integers(1, 9)), k, int(rng.integers(-5, 6)), int(rng.integers(-(2**62), 2**62)), bool(rng.random() < 0.05), k) for k in range(900)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        df = spark.createDataFrame(rows, "g long, o long, a long, x long, f boolean, v long")
        got = scans.segment_scan(df, ["g"], ["o"], Scratch(spark, "test"), add=("a",), xor=("x",), fill={"f": ["v"]}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want, state = [], {}
    for g, o, a, x, f, v in sorted(rows):
        s = state.setdefault(g, [0, 0, None])
        s[0], s[1], s[2] = s[0] + a, s[1] ^ x, v if f else s[2]
        want.append((g, o, s[0], s[1], f, s[2]))
    assert sorted(tuple(r) for r in got) == want
