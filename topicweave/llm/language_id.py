"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch

#: Components of a vector; letters of an n-gram; characters for which a worker counts at a time.
DIMENSIONS = 1024
ORDER = 3
BATCH_CHARS = 500_000
#: N-grams whose vectors a worker holds at a time.
BLOCK = 1024
#: Ids that may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For each code point its lower-cased letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xAC00 <= c < 0xD7A4 or 0x4E00 <= c < 0xA000 or 0x20000 <= c < 0x32000:
            out[c] = c if unicodedata.category(chr(c))[0] == "L" else 0
        elif unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1 << 15)
def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """Random signs for a letter, the same everywhere; 0 stands for a word's edge."""
    return np.random.default_rng([7, letter]).integers(0, 2, dimensions).astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """One row for each row of letters: the product of their vectors, the first turned furthest."""
    out = np.ones((len(grams), dimensions), np.float32)
    for k in range(grams.shape[1]):
        letters, which = np.unique(grams[:, k], return_inverse=True)
        turned = np.roll(np.stack([letter_vector(int(x), dimensions) for x in letters]), grams.shape[1] - 1 - k, axis=1) if len(letters) else np.ones((0, dimensions), np.int8)
        out *= turned[which]
    return out


def count_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of these texts; and for each n-gram of each text, in the order of n-grams, its place among them, the text and how often it stands there.

    Words are runs of letters with one edge around them; windows hold a letter
    at least and stay inside a text.
    """
    data = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    code, owner = letter_codes()[data], np.repeat(np.arange(len(texts)), lengths)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    start = np.ones(len(code), bool)
    start[1:] = owner[1:] != owner[:-1]
    lead = np.flatnonzero(start & (code != 0))  # a text that begins with a letter gets its edge
    code, owner = np.insert(code, lead, 0), np.insert(owner, lead, owner[lead])
    letters = np.unique(code)
    at = np.searchsorted(letters, code)
    n = max(0, len(code) - order + 1)
    same = owner[:n] == owner[order - 1 : order - 1 + n]
    base, key, some = len(letters), np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(order):
        key = key * base + at[k : k + n]
        some |= code[k : k + n] != 0
    key, owner = key[same & some], owner[:n][same & some]
    values, place = np.unique(key, return_inverse=True)
    cell, n = np.unique(place * len(texts) + owner, return_counts=True)
    grams = np.stack([letters[(values // base ** (order - 1 - k)) % base] for k in range(order)], axis=1) if len(values) else np.zeros((0, order), np.uint32)
    return grams, cell // max(len(texts), 1), cell % max(len(texts), 1), n


def bundles(grams: np.ndarray, place: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, dimensions: int) -> np.ndarray:
    """For each row the sum of the vectors of its n-grams by weight. Vectors are made for a block of n-grams at a time, so memory does not grow with their number."""
    out = np.zeros((rows, dimensions), np.float32)
    for k in range(0, len(grams), BLOCK):
        a, b = np.searchsorted(place, [k, k + BLOCK])
        size = min(BLOCK, len(grams) - k)
        counts = np.bincount(row[a:b] * size + place[a:b] - k, weight[a:b], rows * size).reshape(rows, size).astype(np.float32)
        out += counts @ gram_vectors(grams[k : k + BLOCK], dimensions)
    return out


def batches(part: pd.DataFrame, most: int = 128) -> Iterator[pd.DataFrame]:
    """Slices with few texts and a bounded number of characters, but for a text that is longer by itself."""
    sizes, k = part["text"].str.len().to_numpy(), 0
    while k < len(part):
        n, chars = k, 0
        while n < len(part) and n - k < most and (n == k or chars + sizes[n] <= BATCH_CHARS):
            chars += sizes[n]
            n += 1
        yield part.iloc[k:n]
        k = n


def train(rows: DataFrame, dimensions: int = DIMENSIONS, order: int = ORDER) -> dict[str, np.ndarray]:
    """The prototype of each language: the unit bundle of its texts, every text weighing the same.

    ``rows`` has text and lang. A vector for each language and partition is
    summed by component, and a row for each language reaches the driver.
    """

    def bundle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for some in batches(part):
                grams, place, owner, n = count_grams(some["text"].tolist(), order)
                total = np.bincount(owner, n, len(some))
                langs, which = np.unique(some["lang"].to_numpy(str), return_inverse=True)
                for lang, v in zip(langs, bundles(grams, place, which[owner], n / total[owner], len(langs), dimensions), strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    part = rows.select("text", "lang").filter("text is not null and lang is not null").mapInPandas(bundle, "lang string, v array<double>")
    summed = part.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    table = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).toPandas()
    out = {r.lang: np.array([x["x"] for x in r.v], np.float32) for r in table.itertuples()}
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], order: int = ORDER) -> DataFrame:
    """doc_id, lang_pred, score for each row: the prototype of largest cosine, of equal ones the first by name; score is (1 + cosine) / 2."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSIONS), np.float32)
    model = docs.sparkSession.sparkContext.broadcast((names, matrix))  # languages x dimensions

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = model.value
        for part in parts:
            part = part.assign(text=part["text"].fillna(""))
            for some in batches(part):
                grams, place, owner, n = count_grams(some["text"].tolist(), order)
                out = pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "lang_pred": "und", "score": 0.0})
                if names and len(grams):
                    vectors = bundles(grams, place, owner, n, len(some), matrix.shape[1])
                    norm = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ matrix.T) / np.maximum(norm, 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    known = np.bincount(owner, n, len(some)) > 0
                    out["lang_pred"] = np.where(known, np.array(names, object)[best], "und")
                    out["score"] = np.where(known, np.clip((1 + cosine.max(axis=1).astype(float)) / 2, 0, 1), 0.0)
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def held_out_rows():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Prototypes come from the labelled rows that are not held out; a null
    doc_id counts as an empty one. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text when nothing could be learned.
    Whole texts count, however long. Repeated rows are learned and predicted
    each; an empty table gives no rows; other columns are not read.
    """
    model = train(docs.filter(~held_out_rows()), dimensions, order)
    return predict(docs, model, order).select("doc_id", held_out_rows().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, that is some letter; its columns are unchanged.

    Rows go by doc_id: where rows share one, all stay if any has a language.
    """
    found = predict(docs, train(docs.filter(~held_out_rows())))
    without = found.groupBy("doc_id").agg(F.max(F.col("lang_pred") != "und").alias("_known")).filter("not _known").select(F.col("doc_id").alias("_id"))
    without = Scratch(docs.sparkSession, "language-id").keep(without)
    without = F.broadcast(without) if without.count() <= BROADCAST_IDS else without
    rows = docs.select(F.col("doc_id").alias("_d"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    return rows.join(without, F.col("_d").eqNullSafe(F.col("_id")), "left_anti").select("_row.*")
