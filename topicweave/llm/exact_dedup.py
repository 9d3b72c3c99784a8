"""Exact duplicates by skew-safe combining of salted digest groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..plans.durable import Scratch
from .lookups import look_up

#: Parts into which the copies of one text are dealt before their winners meet.
SALTS = 16
#: Copies from which a text's rows get their winner by look_up; fewer meet by their digest.
LARGE = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(has_map(f.dataType) for f in kind)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, ArrayType) and has_map(kind.elementType)


def combine(rows: DataFrame, salts: int = SALTS, payload: list[str] | None = None) -> DataFrame:
    """One row for each distinct (_digest, _text): the winner and the number of rows.

    Three combining steps, each keyed by the digest and the full content: the
    map side of the first aggregation (local), its reduce side over salted
    groups, and the global aggregation of salt winners. Digests that collide
    stay apart because the content is part of every key.
    """
    row = F.struct("doc_id", *(payload or []))
    # columns without an order, such as maps, cannot decide between rows of one doc_id
    ordered = not any(has_map(f.dataType) for f in rows.select(*(payload or [])).schema)
    best = F.max(row) if ordered else F.max_by(row, F.struct("doc_id"))
    again = F.max("_best") if ordered else F.max_by("_best", F.struct("_best.doc_id"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    salted = rows.groupBy("_digest", salt.alias("_salt"), "_text").agg(best.alias("_best"), F.count("*").alias("_n"))
    return salted.groupBy("_digest", "_text").agg(again.alias("_best"), F.sum("_n").alias("_n"))


def with_winners(slim: DataFrame, winners: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size. Rows of a text with many copies do not meet in one task.

    There are no more texts of ``large`` copies than rows over ``large``.
    These are looked up; their rows then go by a key of their own through the
    join of all others.
    """
    many = winners.filter(F.col("group_size") >= large).select("_digest", F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    few = winners.filter(F.col("group_size") < large).withColumnRenamed("_digest", "_key")
    own = F.concat("_digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = look_up(slim, many, "_digest").withColumn("_key", F.when(F.col("_size").isNull(), F.col("_digest")).otherwise(F.concat(own, F.lit("+").cast("binary"))))
    met = rows.join(few, "_key", "left")
    return met.select("doc_id", "text_sha256", F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", "group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Texts are equal when they are the same code points; null counts as empty.
    The largest doc_id of a group stays. Null doc_ids lose to any other. Rows
    repeated with the same doc_id and text are marked alike and counted one by
    one. An empty table gives no rows; columns besides doc_id and text are not
    read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    hexadecimal = F.lower(F.hex("_digest")) if digest is sha256 else F.sha2("_text", 256)
    winners = scratch.keep(combine(rows, salts).select("_digest", F.col("_best.doc_id").alias("keep_id"), F.col("_n").alias("group_size")))
    slim = rows.select("doc_id", "_digest", hexadecimal.alias("text_sha256"))
    collided = winners.groupBy("_digest").agg(F.count("*").alias("_texts")).filter("_texts > 1").select("_digest")
    if collided.isEmpty():
        out = with_winners(slim, winners)
    else:  # unequal contents share a digest: those groups are told apart by their text again
        clash = scratch.keep(collided)
        texts = rows.join(clash, "_digest", "left_semi")
        mark = combine(texts, salts).select("_digest", "_text", F.col("_best.doc_id").alias("keep_id"), F.col("_n").alias("group_size"))
        told = texts.join(mark, ["_digest", "_text"]).select("doc_id", hexadecimal.alias("text_sha256"), "keep_id", "group_size")
        out = with_winners(slim.join(clash, "_digest", "left_anti"), winners).unionByName(told)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` with one row for each text, that of the largest doc_id; its columns are unchanged.

    The other columns travel with the winner, so the texts are not joined
    again. A null text stays null only if its group's winner has it.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.col("text").isNull().alias("_null"), *held).withColumn("_digest", sha256(F.col("_text")))
    won = combine(rows, salts, ["_null", *(f"_c{i}" for i in range(len(others)))])
    cols = {"doc_id": F.col("_best.doc_id"), "text": F.when(~F.col("_best._null"), F.col("_text"))} | {c: F.col(f"_best._c{i}") for i, c in enumerate(others)}
    return won.select(*(cols[c].alias(c) for c in docs.columns))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
