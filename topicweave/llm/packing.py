"""Packing token sequences into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch

WINDOW = 1024
#: Fixed value: the id that ends a document.
END = 0
#: Partitions whose open windows meet in one node of the reduction; open windows that a node passes on.
FAN_IN, MOST_OPEN = 8, 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, poured boolean"
#: What stands with a piece of a window that is still open: the node that holds it, and its ids.
OPEN = f"{SCHEMA}, node long, ids binary"
NAMES = [x.split()[0] for x in OPEN.split(", ")]

#: Fixed value: how a byte-level tokenizer without a pattern of its own splits a text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDED = array("I", [END]).tobytes()


def byte_of_letter() -> dict[str, int]:
    """The byte for which each letter stands in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Ids of whole texts, the same as those of ``tokenizers`` for the file, without added special tokens.

    A byte-level file whose merges stand in the order of their ids is read
    into an encoder that is several times faster; tests compare the two. Other
    files, and texts with a very long run without a border, go to
    ``tokenizers`` itself.
    """

    RUN = re.compile(r"\S{50000}|\s{50000}")
    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._fast(path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    @staticmethod
    def _fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain &= before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        marks = spec.get("added_tokens") or []
        plain &= not any(m["single_word"] or m["lstrip"] or m["rstrip"] for m in marks)
        special, letters = {m["content"]: m["id"] for m in marks}, byte_of_letter()
        vocab = {w: i for w, i in model.get("vocab", {}).items() if w not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        if not plain or any(c not in letters for w in vocab for c in w) or [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, with END after them."""
        if self.fast is not None and not self.RUN.search(text):
            ids = self.fast.encode(text, allowed_special="all")
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() + ENDED


class SumOfSquares:
    """Open windows by fill level; ``place`` says which level takes a piece."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # open windows at each level; a full one is not open
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, size: int) -> int:
        """The level, 0 for a new window, at which ``size`` more leaves the smallest sum of squared counts; of equal ones the fullest."""
        n = self.count
        top = self.window - size
        delta = 2 * (n[size : top + size + 1] - n[: top + 1] + 1)  # one window less at the level, one more above it
        delta[top] = 1 - 2 * n[top]  # a full window counts no more
        delta[0] = 2 * n[size] + 1
        delta[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(delta[::-1]))

    def add(self, pieces: list[tuple], size: int) -> list | None:
        """Put pieces in, together; all pieces of their window if it is full now."""
        level = self.place(size)
        held = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        held = held + pieces
        if level + size == self.window:
            return held
        self.open[level + size].append(held)
        self.count[level + size] += 1
        return None

    def rest(self) -> list[list]:
        """The open windows, the fullest first."""
        return [w for level in range(self.window - 1, 0, -1) for w in self.open[level]]


def pack(ids: Iterator[tuple[int | None, bytes]], state: SumOfSquares) -> Iterator[list[tuple]]:
    """Full sequences, each a list of (doc_id, start, ids, doc_tokens). Whole windows of a long document are sequences of their own; what is left of it is placed online."""
    window = state.window
    for doc, data in ids:
        total = len(data) // 4
        whole = total - total % window
        for s in range(0, whole, window):
            yield [(doc, s, data[4 * s : 4 * (s + window)], total)]
        if total > whole and (full := state.add([(doc, whole, data[4 * whole :], total)], total - whole)):
            yield full


def pour(windows: list[list], window: int) -> Iterator[list[tuple]]:
    """Open windows put one after the other into new ones, cut where one is full, so that at most one sequence is short."""
    poured, level = [], 0
    for doc, start, data, total in (p for pieces in windows for p in pieces):
        while data:
            part = data[: 4 * (window - level)]
            poured.append((doc, start, part, total))
            start, level, data = start + len(part) // 4, level + len(part) // 4, data[len(part) :]
            if level == window:
                yield poured
                poured, level = [], 0
    if poured:
        yield poured


class Rows:
    """Sequences as rows; sequence ids go up from ``base``."""

    def __init__(self, base: int, node: int):
        self.next, self.node, self.rows = base, node, []

    def add(self, pieces: list[tuple], is_open: bool = False, poured: bool = False) -> None:
        offset = 0
        for doc, start, data, total in pieces:
            where = (self.node, data) if is_open else (None, None)
            self.rows.append((doc, start, len(data) // 4, zlib.crc32(data), total, self.next, offset, poured, *where))
            offset += len(data) // 4
        self.next += 1

    def frame(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=NAMES).astype({"doc_id": "Int64", "node": "Int64"})


def packed(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, fan_in: int = FAN_IN, most_open: int = MOST_OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, poured.

    Each partition places its own documents, in the order in which it reads
    them, and holds only the windows that are open. The pieces of windows open
    at its end go up a tree: a node takes those of ``fan_in`` children and
    places them anew by the same rule, the longest first. What is open at the
    root, and what is beyond ``most_open`` windows at a node, is poured into
    new windows and cut where one is full; ``poured`` says of which pieces.

    A null or empty text is its end id alone; special tokens in a text are
    tokens; a text longer than a window is cut; repeated rows are packed
    again; an empty table gives no rows. sequence_id has the level of the tree
    above bit 56 and the node above bit 32. Only doc_id and text are read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")

    def ids(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        encoder = Encoder.of(tokenizer_path)
        for part in parts:
            docs = part["doc_id"].astype(object).where(part["doc_id"].notna(), None)
            yield from zip(docs, map(encoder.encode, part["text"].fillna("")), strict=True)

    def leaf(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        node = TaskContext.get().partitionId()
        state, out = SumOfSquares(window), Rows(node << 32, node)
        for pieces in pack(ids(parts), state):
            out.add(pieces)
            if len(out.rows) >= 10_000:
                yield out.frame()
        for pieces in state.rest():
            out.add(pieces, is_open=True)
            if len(out.rows) >= 10_000:
                yield out.frame()
        yield out.frame()

    def fold(level: int, root: bool):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            node = int(part["node"].iloc[0]) // fan_in
            state, out = SumOfSquares(window), Rows((level << 56) + (node << 32), node)
            part = part.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
            docs = part["doc_id"].astype(object).where(part["doc_id"].notna(), None)
            for piece in zip(docs, part["start"].tolist(), map(bytes, part["ids"]), part["doc_tokens"].tolist(), strict=True):
                if full := state.add([piece], len(piece[2]) // 4):
                    out.add(full)
            rest = state.rest()
            passed = 0 if root else most_open
            for sequence in pour(rest[: max(0, len(rest) - passed)], window):
                out.add(sequence, poured=True)
            for one in rest[max(0, len(rest) - passed) :]:
                out.add(one, is_open=True)
            return out.frame()

        return run

    scratch = Scratch(docs.sparkSession, "packing")
    now = scratch.keep(docs.select("doc_id", "text").mapInPandas(leaf, OPEN))
    decided, level = [now.filter("node is null")], 1
    width = now.agg(F.max("node")).first()[0]
    while width is not None:
        width = width // fan_in
        parent = F.floor(F.col("node") / fan_in).alias("parent")
        now = scratch.keep(now.filter("node is not null").groupBy(parent).applyInPandas(fold(level, width == 0), OPEN))
        decided.append(now.filter("node is null"))
        if width == 0:
            break
        level += 1
    return reduce(DataFrame.unionByName, decided).drop("node", "ids")
