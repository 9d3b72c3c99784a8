"""The same small corpus in all forms, and the other files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.sources import readers, writers

DOCS = [[0, 0, 1], [1, 2], [3, 3, 3, 2]]
TOKENS = [(d, p, w) for d, ws in enumerate(DOCS) for p, w in enumerate(ws)]


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "pos", "word_id").collect())


def bags(df):
    return sorted(tuple(r) for r in df.groupBy("doc_id", "word_id").agg(F.count("*")).collect())


@pytest.fixture
def stem(tmp_path):
    (tmp_path / "c.ldac").write_text("2 0:2 1:1\n2 1:1 2:1\n2 3:3 2:1\n")
    (tmp_path / "c.wit").write_text("\n".join(str(w + 1) for _, _, w in TOKENS) + "\n")
    (tmp_path / "c.dit").write_text("\n".join(str(d + 1) for d, _, _ in TOKENS) + "\n")
    (tmp_path / "c.docword").write_text("3\n4\n6\n1 1 2\n1 2 1\n2 2 1\n2 3 1\n3 4 3\n3 3 1\n")
    (tmp_path / "c.txtbag").write_text("3\n4\n2 0 2 1 1\n2 1 1 2 1\n2 3 3 2 1\n")
    return str(tmp_path / "c")


@pytest.mark.parametrize("form", ["ldac", "witdit", "docword", "bag"])
def test_forms_agree(spark, stem, form):
    assert rows(readers.read_corpus(spark, stem, form)) == TOKENS


def test_lst_keeps_order(spark, tmp_path):
    (tmp_path / "s.txtbag").write_text("2\n4\n3 2 0 2\n0\n")
    assert rows(readers.read_corpus(spark, str(tmp_path / "s"), "lst")) == [(0, 0, 2), (0, 1, 0), (0, 2, 2)]


def test_unknown_form(spark, stem):
    with pytest.raises(ValueError, match="unknown corpus form"):
        readers.read_corpus(spark, stem, "xml")


def test_bag_beyond_vocabulary_fails(spark, tmp_path):
    (tmp_path / "b.txtbag").write_text("1\n2\n1 7 1\n")
    with pytest.raises(Exception, match="beyond the header"):
        readers.read_corpus(spark, str(tmp_path / "b"), "bag").collect()


@pytest.mark.parametrize("form", ["ldac", "bag", "lst", "docword", "witdit"])
def test_round_trip(spark, tmp_path, form):
    tokens = spark.createDataFrame(TOKENS, "doc_id long, pos int, word_id long").repartition(3)
    p = str(tmp_path / "o")
    if form == "ldac":
        writers.write_ldac(tokens, f"{p}.ldac", 4)
        back = readers.read_ldac(spark, f"{p}.ldac")
    elif form == "bag":
        writers.write_bag(tokens, f"{p}.txtbag", 4, 4)
        back = readers.read_bag(spark, f"{p}.txtbag")
    elif form == "lst":
        writers.write_lst(tokens, f"{p}.txtbag", 4, 4)
        back = readers.read_lst(spark, f"{p}.txtbag")
    elif form == "docword":
        writers.write_docword(tokens, f"{p}.docword", 4, 4)
        back = readers.read_docword(spark, f"{p}.docword")
    else:
        writers.write_witdit(tokens, f"{p}.wit", f"{p}.dit")
        back = readers.read_witdit(spark, f"{p}.wit", f"{p}.dit")
    assert bags(back) == bags(tokens)
    assert rows(back) == TOKENS


def test_small_files(spark, tmp_path):
    (tmp_path / "v.tokens").write_text("al\x01pha\nbeta\ngamma\n")
    assert [r.word for r in readers.read_vocab(spark, str(tmp_path / "v.tokens"), 0, 2).orderBy("word_id").collect()] == ["alpha", "beta"]
    (tmp_path / "c.class").write_text("0\n1\n1\n")
    assert [r["class"] for r in readers.read_class(spark, str(tmp_path / "c.class")).orderBy("doc_id").collect()] == [0, 1, 1]
    (tmp_path / "c.epoch").write_text("2\n3\n4\n1\n1\n")
    assert readers.read_epochs(spark, str(tmp_path / "c.epoch")) == ([3, 4], [1, 1])
    (tmp_path / "c.epoch2").write_text("2\n3\n")
    with pytest.raises(ValueError):
        readers.read_epochs(spark, str(tmp_path / "c.epoch2"))
    (tmp_path / "c.srcpar").write_text("documents=3\ndfdocs = 9\n")
    assert readers.read_params(spark, str(tmp_path / "c.srcpar")) == {"documents": "3", "dfdocs": "9"}
    (tmp_path / "q").write_text("3 1 2 1\n1 5\n")
    assert sorted(map(tuple, readers.read_queries(spark, str(tmp_path / "q")).collect())) == [(0, 1), (0, 2), (1, 5)]
    (tmp_path / "smap").write_text("4\n2\n")
    assert sorted(r.word_id for r in readers.read_word_list(spark, str(tmp_path / "smap")).collect()) == [2, 4]
    (tmp_path / "colls").write_text("2 0 2 9 3 2 8\n0\n")
    assert sorted(map(tuple, readers.read_spans(spark, str(tmp_path / "colls")).collect())) == [(0, 0, 2, 9), (0, 3, 2, 8)]
    (tmp_path / "pmi").write_text("0 1 0.5\n1 1 9\n2 0 0.25\n0 7 3\n")
    assert sorted(map(tuple, readers.read_pmi(spark, str(tmp_path / "pmi"), 3).collect())) == [(0, 1, 0.5), (0, 2, 0.25)]
    (tmp_path / "m").write_text("2\n2\n1\n1 0 7\n")
    assert [tuple(r) for r in readers.read_sparse(spark, str(tmp_path / "m")).collect()] == [(1, 0, 7)]
    (tmp_path / "t").write_text("0: 0:0.5 2:0.5\n1: 1 1:1.0\n")
    assert sorted(map(tuple, readers.read_probs(spark, str(tmp_path / "t")).collect())) == [(0, 0, 0.5), (0, 2, 0.5), (1, 1, 1.0)]
    (tmp_path / "d").write_text("0.5 1.5\n2 3\n")
    assert sorted(map(tuple, readers.read_matrix(spark, str(tmp_path / "d")).collect())) == [(0, 0, 0.5), (0, 1, 1.5), (1, 0, 2.0), (1, 1, 3.0)]
    (tmp_path / "w").write_text("0 text ab 5 2 one\n1 text cd 4 1 two\n")
    assert [(r.cnt, r.df, r.word) for r in readers.read_words(spark, str(tmp_path / "w")).orderBy("word_id").collect()] == [(5, 2, "one"), (4, 1, "two")]
    (tmp_path / "f").write_text("d w z t\n0 1 2 0\n0 3 1 0\n")
    assert sorted(map(tuple, readers.read_foreign_state(spark, str(tmp_path / "f")).collect())) == [(0, 0, 1, 2), (0, 1, 3, 1)]


def test_phi_binary(spark, tmp_path):
    table = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "m.phi").write_bytes(struct.pack("<iii", 3, 2, 1) + table.tobytes())
    got = {(r.topic, r.word_id): r.p for r in readers.read_phi_binary(spark, str(tmp_path / "m.phi")).collect()}
    assert got == {(k, w): float(table[k, w]) for k in range(2) for w in range(3)}


def test_document_frequency_precedence(spark, stem, tmp_path):
    tokens = readers.read_corpus(spark, stem, "ldac")
    df, n = readers.read_df(spark, stem, tokens, 3)
    assert n == 3 and {r.word_id: r.df for r in df.collect()} == {0: 1, 1: 2, 2: 2, 3: 1}
    (tmp_path / "c.words").write_text("0 t h 9 5 a\n1 t h 8 4 b\n")
    (tmp_path / "c.srcpar").write_text("dfdocs=77\n")
    df, n = readers.read_df(spark, stem, tokens, 3)
    assert n == 77 and {r.word_id: r.df for r in df.collect()} == {0: 5, 1: 4}
    (tmp_path / "c.df").write_text("3\n2\n")
    assert {r.word_id: r.df for r in readers.read_df(spark, stem, tokens, 3)[0].collect()} == {0: 3, 1: 2}


def test_assignments_and_state(spark, stem, tmp_path):
    tokens = readers.read_corpus(spark, stem, "witdit")
    (tmp_path / "z").write_text("\n".join(["0,1", "0,0", "1", "1", "1", "0", "0", "0", "1"]) + "\n")
    z = readers.read_assignments(spark, str(tmp_path / "z"), tokens, 2)
    n = {(r.doc_id, r.topic): r.n for r in z.groupBy("doc_id", "topic").agg(F.count("*").alias("n")).collect()}
    assert n == {(0, 0): 2, (0, 1): 1, (1, 1): 2, (2, 0): 3, (2, 1): 1}
    assert z.filter("not r").count() == 1
    writers.save_state(str(tmp_path / "state"), {"tokens": z}, {"topics": 2})
    tables, params = readers_state(spark, tmp_path)
    assert params == {"topics": 2} and rows(tables["tokens"]) == rows(z)
    with pytest.raises(ValueError, match="unknown table"):
        writers.save_state(str(tmp_path / "other"), {"nope": z}, {})


def readers_state(spark, tmp_path):
    return writers.load_state(spark, str(tmp_path / "state"))


def test_probs_round_trip(spark, tmp_path):
    theta = spark.createDataFrame([(0, 0, 0.75), (0, 1, 0.2), (0, 2, 0.05), (1, 2, 1.0)], "doc_id long, topic long, p double")
    writers.write_probs(theta, str(tmp_path / "th"), 0.1, True)
    got = {(r.doc_id, r.topic): round(r.p, 6) for r in readers.read_probs(spark, str(tmp_path / "th")).collect()}
    assert got == {(0, 0): round(0.75 / 0.95, 6), (0, 1): round(0.2 / 0.95, 6), (1, 2): 1.0}


def test_rare_words_alone_are_shuffled_in_a_large_vocabulary(spark, monkeypatch):
    """Beyond the bound all tokens were shuffled with their words; now only those of words past it."""
    from topicweave.plans.durable import Scratch
    from topicweave.sources import corpus

    docs = spark.createDataFrame([(0, "a a B c"), (1, "a b d, e"), (2, None), (3, ""), (None, "a f")], "doc_id long, text string")
    words = corpus.tokens_of_text(docs, "doc_id", "text")
    scratch = Scratch(spark, "t")
    vocab = corpus.vocabulary(corpus.word_counts(docs, "doc_id", "text"), scratch)
    want = sorted(map(tuple, corpus.vocabulary(words, scratch).collect()))
    assert sorted(map(tuple, vocab.collect())) == want
    twice = docs.unionByName(docs.limit(1))
    assert sorted(map(tuple, corpus.word_counts(twice, "doc_id", "text").collect())) == sorted(map(tuple, corpus.counted(corpus.tokens_of_text(twice, "doc_id", "text")).collect()))
    whole = sorted(map(tuple, corpus.encode(words, vocab, 6).select("pos", "word_id").collect()))
    monkeypatch.setattr(corpus, "BROADCAST_WORDS", 2)
    kept, keep = [], scratch.keep
    scratch.keep = lambda df: kept.append(out := keep(df)) or out
    assert sorted(map(tuple, corpus.coded(words, vocab, 6, scratch).select("pos", "word_id").collect())) == whole
    assert kept[1].count() == 4
