import pytest

#: Names that the operators use themselves, and one that needs quoting.
CLASH = "_text string, digest string, _id long, rep long, label string, n long, _row string, size long, `a b` string"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text[, lang[, source]]) with more columns, whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, *(None, None)[len(r) - 2 :], "x", "y", 1, 2, "z", 3, "r", 4, "q") if len(r) < 4 else (*r, "x", "y", 1, 2, "z", 3, "r", 4, "q") for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, {CLASH}")

    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "a b c d e f g h i j"), (5, "a b c d e f g h i j"), (None, "null id text of some words here"), (7, "x" * 100_000), (8, "lange wörter É ß 𝔘 " * 3000), (9, "<|endoftext|> [#*$%&|<>]\r\n\r\n")]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([(0, "x")]).limit(0)
