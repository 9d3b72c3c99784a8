"""Language, quality rules, URL filters, scores and licenses."""

import datetime
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.llm import language_id, license_scan, lm_scoring, quality_rules, queries, url_filters

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@data
@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_url_filters", "op7_exact_dedup", "op9_license_scan"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    plain = lambda cols, rows: sorted(tuple(str(r[i]) for i in sorted(range(len(cols)), key=cols.__getitem__)) for r in rows)
    assert plain(df.columns, df.collect()) == plain(want.columns, want.fetchall())


@data
def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97


def test_language_odd_rows(odd, empty, docs, spark):
    got = language_id.identify(odd).collect()
    assert len(got) == 10 and {r.lang_pred for r in got} == {"und"}  # nothing is labelled
    assert language_id.identify(empty).count() == 0
    rows = [(k, "the thing that then", "en") for k in range(12)] + [(20 + k, "le chat était où", "fr") for k in range(12)] + [(50, "123 !!", "en"), (51, None, "fr"), (52, "that thing")]
    got = {r.doc_id: r for r in language_id.identify(docs(rows)).collect()}
    assert got[52].lang_pred == "en" and got[50].lang_pred == got[51].lang_pred == "und" and got[50].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    kept = language_id.known_language(docs(rows))
    assert {r.doc_id for r in kept.collect()} == set(got) - {50, 51} and kept.columns == docs(rows).columns


def test_language_vectors_and_counts():
    grams, place, owner, n = language_id.count_grams(["ab, ab", "", "B"])
    found = {(tuple(map(chr, grams[p])), o): c for p, o, c in zip(place, owner, n, strict=True)}
    assert found == {(("\0", "a", "b"), 0): 2, (("a", "b", "\0"), 0): 2, (("b", "\0", "a"), 0): 1, (("\0", "b", "\0"), 2): 1}
    v = language_id.gram_vectors(np.array([[97, 98, 99], [98, 97, 99]]), 1024)
    want = np.roll(language_id.letter_vector(97, 1024), 2) * np.roll(language_id.letter_vector(98, 1024), 1) * language_id.letter_vector(99, 1024)
    assert (v[0] == want).all() and abs(v[0] @ v[1]) < 200


def plain_vector(text, dimensions, order=3):
    """The bundle of a text's n-grams, letter by letter."""
    import unicodedata

    words = "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in text).split()
    line = ["\0", *(c for w in words for c in (*w, "\0"))] if words else []
    total = np.zeros(dimensions)
    for k in range(len(line) - order + 1):
        v = np.ones(dimensions)
        for j, c in enumerate(line[k : k + order]):
            v = v * np.roll(language_id.letter_vector(ord(c), dimensions), order - 1 - j)
        total += v
    return total, max(0, len(line) - order + 1)


def test_language_predictions_equal_plain_ones(docs, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 7)
    rng = np.random.default_rng(8)
    letters = {"x": "aeitnr", "y": "aeioun", "z": "éaßtdn"}
    make = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), rng.integers(1, 7))) for _ in range(rng.integers(1, 12)))
    rows = [(k, make("xyz"[k % 3]), "xyz"[k % 3]) for k in range(60)] + [(k, make("xyz"[k % 3]) + " 12!") for k in range(60, 90)]
    sums = {}
    for i, text, lang in rows[:60]:
        v, n = plain_vector(text, 64)
        if n and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + v / n
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    for r in language_id.identify(docs(rows), dimensions=64).collect():
        v, n = plain_vector(rows[r.doc_id][1], 64)
        cosine = {k: float(v @ u / max(np.linalg.norm(v), 1e-9)) for k, u in unit.items()}
        if n:
            assert abs(r.score - (1 + max(cosine.values())) / 2) < 1e-4 and cosine[r.lang_pred] > max(cosine.values()) - 1e-4
        else:
            assert r.lang_pred == "und"


def test_language_memory_of_a_text_with_many_letters():
    """A million random characters out of 20,000 stay below 1 GB."""
    import subprocess
    import sys

    code = """
import numpy as np
from topicweave.llm import language_id as m
text = "".join(map(chr, np.random.default_rng(0).integers(0x4E00, 0x4E00 + 20000, 1_000_000)))
g, p, o, n = m.count_grams([text])
v = m.bundles(g, p, o, n, 1, m.DIMENSIONS)
peak = [l for l in open("/proc/self/status") if l.startswith("VmHWM")][0].split()[1]  # of this program; ru_maxrss keeps that of the caller
print(len(g), int(peak) // 1024)
"""
    grams, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-2:])
    assert grams > 990_000 and mb < 1000


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(rep)


def test_quality_base_counts(odd, empty, docs):
    from .conftest import ODD

    rows = ODD + [(50, "a b c a b c a b"), (51, "x\nx\n \n\ny\nx"), (52, " ".join(["w"] * 60)), (53, "k" + " l m n" * 30)]
    got = quality_rules.judge(docs(rows)).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert have == sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize(("places", "bits"), [(24, 40), (24, 2), (3, 40)], ids=["hashes", "hashes that clash", "more windows than places"])
def test_repeated_words_whatever_the_hash(spark, places, bits):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"][: 2 + k % 3], k)) for k in range(40)] + ["", "a", "a b", "a b c", "a a a a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("r", quality_rules.repeated_words(quality_rules.word_list(F.col("text")), places, bits))
    assert {r.k: r.r for r in rows.collect()} == {k: brute_base(t)[4] for k, t in enumerate(texts)}


def test_quality_lines(docs):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, f"Share this  page\n{own(k)}", None, "h") for k in range(30)]
    rows += [(100, "SHARE this page\n" * 1 + "share this page\n" + "a " * 2 + own(100)[:9] + "\n" + "share this page\n" * 20, None, "h"), (101, f"share this page\n{own(101)}", None, "other"), (102, f"share this page\n{own(102)}")]
    rows += [(200 + k, "copy of one line " * 20, None, "h") for k in range(40)]  # one document in many copies
    lines = quality_rules.line_rows(docs(rows))
    frequent = {by: quality_rules.frequent_lines(lines, 20, by) for by in (False, True)}
    assert [r._host for r in frequent[True].collect()] == ["h"] and [r._host for r in frequent[False].collect()] == ["h", "h"]
    plain = lambda t: sorted(map(str, t.collect()))
    assert plain(quality_rules.line_losses(lines, frequent[False])) == plain(quality_rules.line_losses(lines, frequent[False], 0))
    copies = quality_rules.judge(docs(rows)).filter("doc_id >= 200").collect()
    assert not any(r.kept for r in copies) and {r.lost_chars for r in copies} == {len("copy of one line " * 20) - 1}
    got = {r.doc_id: r for r in quality_rules.judge(docs(rows), by_text=True).collect()}
    assert got[0].kept and got[0].lost_chars == len("share this page") and got[101].lost_chars == 0
    assert not got[100].kept and got[200].lost_chars == 0
    clean = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(docs([*rows, (300, None, None, "h")]), by_text=True).collect()}
    assert clean[0] == own(0) and clean[101].startswith("share") and clean[300] is None


def test_url_filters(spark):
    day = datetime.date
    pages = [(1, "http://Sub.Bad.org:80/x", day(2024, 1, 5)), (2, "https://u@bad.org/", day(2024, 2, 1)), (3, "http://bad.org.", day(2024, 3, 1)), (4, "http://notbad.org/", day(2024, 1, 5)), (5, None, day(2024, 1, 5)), (6, "junk", day(2024, 1, 5)), (7, "http://bad.org/", None), (1, "http://Sub.Bad.org:80/x", day(2024, 1, 5)), (8, "http://bad.org/", day(2024, 1, 1)), (9, "http://bad.org/", day(2023, 12, 31))]
    entries = [("bad.org", "a", day(2024, 1, 1), True), ("bad.org", "a", day(2024, 2, 1), False), ("bad.org", "a", day(2024, 2, 20), True), ("bad.org", "b", day(2024, 1, 1), True), ("bad.org", "b", day(2024, 1, 1), False), ("bad.org", "b", day(2024, 1, 6), False)]
    captures = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, day date, domain string, _salt int")
    listed = spark.createDataFrame(entries, "domain string, label string, day date, listed boolean")
    got = sorted(((r.page_id, r.blocked, r.labels) for r in url_filters.filter_captures(captures, listed).collect()))
    assert got == [(1, True, "a,b"), (1, True, "a,b"), (2, False, ""), (3, True, "a"), (4, False, ""), (5, False, ""), (6, False, ""), (7, False, ""), (8, True, "a,b"), (9, False, "")]
    assert url_filters.filter_captures(captures.limit(0), listed).count() == 0
    assert url_filters.filter_captures(captures, listed.limit(0)).filter("blocked").count() == 0


def test_url_hosts(spark):
    urls = {"http://[::1]:80/x": ("[::1]", ["[::1]"]), "http://u@10.20.30.40:8/": ("10.20.30.40", ["10.20.30.40"]), "http://a.b.c.org./": ("a.b.c.org", ["a.b.c.org", "b.c.org", "c.org"]), "http://localhost": ("localhost", ["localhost"]), "http://[": (None, [None]), "http://": (None, [None])}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("h", url_filters.host(F.col("url")))
    assert {r.url: (r.h, r.d) for r in rows.withColumn("d", url_filters.domains(F.col("h"))).collect()} == urls


def brute_scores(rows):
    words = {k: [*WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), None] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((rows[k][0], held[k], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for k, ws in words.items()), key=str)


def test_lm_base_and_bits(odd, empty, docs):
    from .conftest import ODD

    rows = ODD + [(k, f"the cat sat on mat {k % 3} and the dog") for k in range(20, 60)]
    got = lm_scoring.score(docs(rows)).collect()
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str)
    assert have == brute_scores(rows)
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score(empty).count() == 0
    assert lm_scoring.score(odd.filter("doc_id = 1")).count() == 1


def test_lm_is_a_distribution_and_learns():
    words = [w.encode() for w in ("the", "then", "cat", "dog", "that")] + [b""]
    counts = np.array([50.0, 5, 9, 9, 20, 10])
    sums = np.zeros((2, lm_scoring.BASES[-1]), np.float32)
    b = lm_scoring.bits_of(words)
    for v in (0, 1):
        for k in range(len(lm_scoring.TABLES)):
            sums[v] += np.bincount(b.slots[k, b.value == v], counts[b.owner][b.value == v], lm_scoring.BASES[-1])
    mixer, mass = lm_scoring.online([(words, counts)] * 50, sums[0], sums[1])
    assert mass == 50 * counts.sum()
    cost = lm_scoring.log10_of([*words, b"zebra"], sums[0], sums[1], mixer)
    assert cost[0] > cost[1] > cost[-1]
    # all bytes that may follow a prefix share one: their bits are the leaves of a binary tree
    one = [bytes([x]) for x in range(256)]
    zeros, ones = sums
    first = []
    for x in one:
        s = lm_scoring.bits_of([x])
        z, seen = mixer.inputs(zeros[s.slots[:, :8]], ones[s.slots[:, :8]])
        p = mixer.refined(mixer.mix(z, (s.gate[:8], seen)), s.gate[:8])
        first.append(np.prod(np.where(s.value[:8] > 0, p, 1 - p)))
    assert sum(first) == pytest.approx(1, abs=1e-3)


def brute_marks(rows):
    """For each row: by brute force over all pairs, what each token is and the log10 of its share (None where it is spelled)."""
    texts = []
    for doc_id, text in rows:
        words = [w.lower() if w.isascii() else "".join(c.lower() if c < "\x80" else c for c in w) for w in WORD.findall(text or "")]
        texts.append((zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1, [None, *words, None]))
    ones, twos = Counter(), Counter()
    for train, t in texts:
        if train:
            ones.update(t[1:])
            twos.update(zip(t, t[1:], strict=False))
    out = []
    for train, t in texts:
        own1, own2 = (Counter(t[1:]), Counter(zip(t, t[1:], strict=False))) if train else (Counter(), Counter())
        n = sum(ones.values()) - sum(own1.values())
        marks = []
        for h, w in zip(t, t[1:], strict=False):
            pair, before, word = twos[h, w] - own2[h, w], ones[h] - own1[h], ones[w] - own1[w]
            marks.append((2, math.log10(pair / before)) if pair else (1, math.log10(word / n)) if word else (0, None))
        out.append(marks)
    return out


def test_lm_word_contexts_match_brute_force(docs, monkeypatch):
    import random

    from topicweave.llm import word_contexts

    from .conftest import ODD

    rnd = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [r for r in ODD if r[0] != 7] + [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for k in range(20, 120)]
    rows += [(k, "one passage that stands in two texts and nowhere else") for k in (200, 201)]
    seen = []
    want = Counter()
    for marks in brute_marks(rows):
        want[tuple(m[0] for m in marks), round(sum(m[1] or 0 for m in marks), 6)] += 1
    # the operator's own stages, in one chunk and in this process
    texts = [t or "" for _, t in rows]
    train = np.array([zlib.crc32(b"" if k is None else str(k).encode()) % 5 != 1 for k, _ in rows])
    found, bounds, *_ = word_contexts.word_hashes(texts)
    now, before, ends = word_contexts.stream(found, bounds)
    own = np.repeat(train, np.diff(ends)).astype(np.int64)
    _, at, mine = word_contexts.grouped(now, ends)
    ids, place, mine2 = word_contexts.grouped(word_contexts.pair_ids(before, now, 4), ends)
    c, pairs = np.bincount(at, own).astype(np.int64), np.bincount(place, own).astype(np.int64)
    marks, left = word_contexts.coded(c[at] - own * mine, pairs[place] - own * mine2, train.astype(np.int64), ends, int(train.sum()), int(own.sum()), np.zeros(len(now)))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        seen.append((tuple((marks[a:b] % 3).tolist()), round(left[a:b].sum(), 6)))
    assert Counter(seen) == want
    # and the counts that chunks get: every pair that another text can use, with its total
    frame = docs(rows).select("text", lm_scoring.held_out(F.col("doc_id")).alias("held_out"), (F.coalesce("doc_id", F.lit(0)) % 3).alias("chunk"))
    total = dict(zip(ids.tolist(), pairs.tolist(), strict=True))
    chunks = np.repeat([(k or 0) % 3 for k, _ in rows], np.diff(ends))
    for limit in (10**6, 50):  # all at once, and handed over in many parts
        monkeypatch.setattr(word_contexts, "HELD_TOKENS", limit)
        got = word_contexts.pair_counts(frame, 4).toPandas()
        for chunk in range(3):
            mine = got[got["chunk"] == chunk]
            have = dict(zip(*(x.tolist() for x in word_contexts.pair_table(mine["bucket"].to_numpy(), mine["keys"].tolist(), mine["totals"].tolist())), strict=True))
            inside = Counter(ids[place[chunks == chunk]].tolist())
            assert all(total[i] == n for i, n in have.items())
            assert {i for i, n in inside.items() if total[i] > 1 or (total[i] == 1 and n > 1)} <= have.keys() <= inside.keys()


def test_lm_order_of_words_counts_and_partitions_do_not(spark, docs):
    import random

    rnd = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rnd.choices(words, k=40))) for k in range(400)]
    twice = " ".join(rnd.choices(words, k=40))
    mixed = twice.split()
    rnd.shuffle(mixed)
    rows += [(1001, twice), (1002, twice), (1003, " ".join(mixed))]
    train = [k for k in (1001, 1002) if zlib.crc32(str(k).encode()) % 5 != 1]
    assert train
    before = spark.conf.get("spark.sql.shuffle.partitions")
    scores = []
    for width in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        scores.append({r.doc_id: r for r in lm_scoring.score(docs(rows).repartition(int(width))).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(r.score == pytest.approx(scores[1][k].score, abs=1e-9) for k, r in scores[0].items())
    one = scores[0]
    # the same words in another order, and texts that stand once, are far less likely than a text that stands twice
    assert one[1003].base_score == pytest.approx(one[1001].base_score)
    assert one[1001].score > one[1003].score / 2 and one[1003].score < -80
    assert max(one[k].score for k in range(400)) < one[1001].score


def test_lm_bits_follow_a_document():
    from topicweave.llm import word_contexts

    rnd = np.random.default_rng(3)
    bounds = np.array([0, 0, 700, 6000, 6001])
    state = rnd.integers(0, 3, 6001)
    state[700:6000] = np.where(np.arange(5300) % 1000 < 500, 2, 1)  # long runs
    features = ((rnd.integers(0, 16, 6001) * 8 + rnd.integers(0, 8, 6001)) * 3 + state).astype(np.uint16)
    import pandas as pd

    table = next(word_contexts.place_counts(iter([pd.DataFrame({"features": [features[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})])))
    seen, ones = np.zeros(2 * word_contexts.TABLE), np.zeros(2 * word_contexts.TABLE)
    seen[table["slot"]], ones[table["slot"]] = table["all"], table["ones"]
    starts = word_contexts.learned(seen, ones, iter([(features, bounds)]))
    together = word_contexts.bits_log10(starts, features, bounds)
    apart = [word_contexts.bits_log10(starts, features[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert together == pytest.approx(apart)  # a document's bits cost the same beside others
    assert together[0] == 0 and together[2] / 5300 > together[1] / 700  # runs are cheaper than noise
    for s, (_, places, gates, value) in zip(starts, word_contexts.decisions(features, bounds), strict=True):
        one, *_ = s.run(places[:, :1], gates[:, :1], value[:1], np.array([0, 1]))
        other, *_ = s.run(places[:, :1], gates[:, :1], ~value[:1], np.array([0, 1]))
        assert np.exp(one[0]) + np.exp(other[0]) == pytest.approx(1)


def test_license_edges(odd, empty, docs):
    assert license_scan.license_labels(empty).count() == 0
    got = license_scan.license_labels(odd).collect()
    assert len(got) == 10 and {r.labels for r in got} == {""} and all(r.first_word is None for r in got)
    rows = [(1, "This is UNDER the MIT-License, under the mit license."), (2, "This work is licensed under\nthe GNU General Public License, version 3."), (3, "version 3 license public general gnu the under licensed is work this text"), (7, "this work is licensed under the gnu general public license version"), (8, "the public license under which mit is licensed"), (4, "cc-by-nc and apache license version 2"), (5, "under the KMIT license"), (6, "under the mit licenses")]
    got = {r.doc_id: r for r in license_scan.license_labels(docs(rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (2, 2, 6, "mit", 1.0)
    assert got[2].labels == "gpl-3" and got[2].base_labels == "" and got[3].labels == "gpl-3" and got[3].base_labels == "" and got[3].score == 1.0
    assert got[4].labels == "apache-2,cc-by-nc" and got[4].n_base == 2
    assert got[5].base_labels == "" and got[6].base_labels == ""
    assert got[7].labels == "" and got[8].labels == ""  # no version, so neither; words of a phrase are no phrase


def test_license_join_matches_all_pairs(docs):
    import random

    rnd = random.Random(2)
    pool = sorted({w for t in license_scan.TEMPLATES for w in t.split()}) + ["zz", "yy"]
    rows = []
    for k in range(200):
        t = rnd.choice(list(license_scan.TEMPLATES)).split()
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(pool)
        rnd.shuffle(t)
        wrap = [rnd.choice(" \n") if k % 2 else " " for _ in t]  # half of the texts are wrapped anywhere
        rows.append((k, "zz\n" + "aa bb\n" * rnd.randint(0, 20) + "".join(w + x for w, x in zip(t, wrap, strict=True)) + "cc " * rnd.randint(0, 40)))
    got = {(r._key, r._kind, r._block, r.label, round(r.held, 9)) for r in license_scan.template_matches(docs(rows), F.col("doc_id"), containment=0.8).collect()}
    want = {}
    for k, text in rows:
        ws = text.split()
        for t, label in license_scan.TEMPLATES.items():
            half = next(h for h in license_scan.HALVES if h >= len(t.split()))
            s, telling = set(t.split()), license_scan.TELLING.get(label)
            for i in range(max(1, -(-len(ws) // half) - 1)):
                block = set(ws[half * i : half * i + 2 * half])
                held = len(s & block)
                if held >= math.ceil(0.8 * len(s) - 1e-9) and (telling is None or telling not in s or telling in block):
                    want[k, half, i, label] = max(want.get((k, half, i, label), 0), round(held / len(s), 9))
    assert got == {(*k, v) for k, v in want.items()}
    assert {k for k, *_ in want if k % 2} and {kind for _, kind, *_ in want} == set(license_scan.HALVES)


def test_strewn_license_words_are_no_license(docs):
    """3,000 words on one line, with words of templates strewn among them, hold no license; the license itself does."""
    import random

    rnd = random.Random(5)
    pool = sorted({w for t in license_scan.TEMPLATES for w in t.split()})
    line = [f"w{rnd.randrange(500)}" for _ in range(3000)]
    for at, w in zip(rnd.sample(range(3000), len(pool)), pool, strict=True):
        line[at] = w
    mit = next(iter(license_scan.TEMPLATES))
    rows = [(1, " ".join(line)), (2, " ".join(line) + "\n" + mit), (3, " ".join([*line[:1500], *mit.split()[:-3], *line[1500:]]))]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_labels(docs(rows)).collect()}
    assert got[1] == ("", 0.0) and got[2] == ("mit", 1.0) and got[3][0] == "mit" and got[3][1] >= 0.9


def test_license_wrapped_anywhere(docs):
    """A template's words are found wherever the text is wrapped, and however much stands before and after."""
    rows, labels = [], {}
    for k, (t, label) in enumerate(license_scan.TEMPLATES.items()):
        for before in (0, 1, 17, 100, 333):
            rows.append((len(rows), "zz " * before + "\n".join(t.split()) + " yy" * 40))
            labels[len(rows) - 1] = label
    got = {r.doc_id: r for r in license_scan.license_labels(docs(rows)).collect()}
    assert all(label in got[i].labels.split(",") for i, label in labels.items()) and all(got[i].score == 1 for i in labels)


def test_lm_chunks_of_any_frame(spark, docs, tmp_path):
    """Joined, shuffled and united frames of several files score as the table itself, in more than one chunk."""
    rows = [(k, f"a small text of number {k % 7} and word {k * k}") for k in range(60)]
    docs(rows).repartition(4).write.parquet(f"file://{tmp_path}/d")
    table = spark.read.parquet(f"file://{tmp_path}/d")
    assert lm_scoring.read_only(table) and lm_scoring.read_only(table.select("doc_id", "text").filter("doc_id >= 0"))
    want = {r.doc_id: r.score for r in lm_scoring.score(table).collect()}
    for other in (table.join(table.select("doc_id").distinct(), "doc_id"), table.repartition(3), table.dropDuplicates(["doc_id"]), table.filter("doc_id < 30").unionByName(table.filter("doc_id >= 30"))):
        assert not lm_scoring.read_only(other)
        assert {r.doc_id: r.score for r in lm_scoring.score(other).collect()} == pytest.approx(want)


def test_lm_weights_are_learned_from_every_training_text(spark, monkeypatch):
    """Each text enters the starts however many there are; groups' results are whole numbers, so that their sums have no order."""
    from topicweave.llm import word_contexts

    monkeypatch.setattr(word_contexts, "STREAM_DOCUMENTS", 2)
    monkeypatch.setattr(word_contexts, "STREAMS", 2)
    rng = np.random.default_rng(3)
    marks = [rng.integers(0, 16 * 8 * 3, 40).astype(np.uint16) for _ in range(30)]
    frame = spark.createDataFrame([(k, bytearray(m.tobytes())) for k, m in enumerate(marks)], "doc_id long, features binary")
    starts = word_contexts.learn_starts(frame.repartition(3), 30)
    again = word_contexts.learn_starts(frame.coalesce(1), 30)
    for k, s in enumerate(starts):
        bits = sum(len(list(word_contexts.decisions(m, np.array([0, len(m)])))[k][0]) for m in marks)
        assert s.hits[:, 1].sum() == bits
        assert (s.hits == again[k].hits).all() and all((x == y).all() for x, y in zip(s.weights, again[k].weights, strict=True))
        assert not np.allclose(s.weights[0], 0.1)


def test_lm_mixer_is_learned_from_every_word(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP_WORDS", 10)
    words = sorted({f"w{k * 7919 % 1000}x{k}".encode() for k in range(60)})
    frame = spark.createDataFrame([(k * 7919, bytearray(w), 1) for k, w in enumerate(words)], "hash long, word binary, c long")
    model = lm_scoring.learn(frame.repartition(3), len(words))
    assert model.mixer.hits[..., 1].sum() == 8 * sum(len(w) + 1 for w in words)
    assert (lm_scoring.learn(frame.coalesce(1), len(words)).mixer.flat() == model.mixer.flat()).all()


def test_lm_shares_of_a_word_are_summed():
    """A word that follows the word before it is likely as any word, too; that way was left out, so words that may come next did not share one."""
    from topicweave.llm import word_contexts

    rng = np.random.default_rng(2)
    bounds = np.arange(0, 2001, 50)
    learned = ((rng.integers(1, 16, 2000) * 8 + rng.integers(0, 8, 2000)) * 3 + rng.choice(3, 2000, p=[0.2, 0.4, 0.4])).astype(np.uint16)
    seen, ones = np.full(2 * word_contexts.TABLE, 9.0), np.full(2 * word_contexts.TABLE, 4.0)
    starts = word_contexts.learned(seen, ones, iter([(learned, bounds)]))

    def chance(words, pairs):  # of a text that is held out; 60 texts' ends and 1,000 tokens
        bounds, train = np.array([0, len(words)]), np.zeros(1, np.int64)
        marks, left = word_contexts.coded(np.array(words), np.array(pairs), train, bounds, 60, 1000, np.zeros(len(words)))
        return 10 ** (left.sum() + word_contexts.bits_log10(starts, marks, bounds)[0])

    # the first word (400 times, 20 of them at the start), and all that may come after it: four known words, three of which follow it elsewhere, or one that is spelled
    after = [(400, 100), (340, 250), (200, 50), (60, 0), (0, 0)]
    both = [chance([400, w], [20, p]) for w, p in after]
    assert sum(both) == pytest.approx(chance([400], [20]), rel=0.02)
    # rare pairs and frequent words: every way counts, to a sixth of an octave of the lesser
    odds = word_contexts.odds(word_contexts.coded(np.array([400, 300]), np.array([20, 1]), np.zeros(1, np.int64), np.array([0, 2]), 60, 1000, np.zeros(2))[0])
    assert odds == pytest.approx([0.4 / (20 / 60), 0.3 / (1 / 400)], rel=0.13)
