"""Product codes of vectors: Lloyd's rounds in whole numbers, maintained by what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from .lookups import look_up

#: Parts of a vector, entries of a part's codebook, rounds, and the scale at which components become whole numbers.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this become it, so that squares and their sums stay whole numbers of 64 bits.
MOST = 4096.0
#: Whole numbers held at once for the differences of a batch.
AT_ONCE = 4_000_000

STATE = "vec_id long, label string, ints binary, codes binary, part int, entry int, n long, sums array<long>"


def usable(vector: Column) -> Column:
    """Neither null nor empty nor with null or non-finite components, and of a length that can be cut."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & F.coalesce(finite, F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double"), F.lit(MOST)), F.lit(-MOST)) * SCALE).cast("int"))


def nearest(vectors: np.ndarray, books: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest of the first ``known`` entries of each part, ties to the lower, and its squared distance."""
    n, width = len(vectors), books.shape[2]
    codes, errors = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), np.int64)
    step = max(1, AT_ONCE // (known * width))
    for a in range(0, n, step):
        for part in range(PARTS):
            x = vectors[a : a + step, part * width : (part + 1) * width].astype(np.int64)
            far = ((x[:, None, :] - books[part, None, :known]) ** 2).sum(axis=2)
            codes[a : a + step, part] = best = far.argmin(axis=1)
            errors[a : a + step, part] = far[np.arange(len(x)), best]
    return codes, errors


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def one_round(state: DataFrame, books: np.ndarray, known: int) -> DataFrame:
    """Assign anew. Rows of ``state`` with their new codes; and, for each task, part and entry, what joined less what left."""
    width = books.shape[2]
    length = PARTS * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("ints"), np.int32, length)
            had = batch.column("codes").is_valid().to_numpy(zero_copy_only=False)
            old = np.zeros((len(vectors), PARTS), np.uint8)
            old[had] = matrix(batch.column("codes").drop_null(), np.uint8, PARTS)
            new, _ = nearest(vectors, books, known)
            for part in range(PARTS):
                moved = ~had | (new[:, part] != old[:, part])
                x = vectors[:, part * width : (part + 1) * width].astype(np.int64)
                np.add.at(count[part], new[moved, part], 1)
                np.add.at(total[part], new[moved, part], x[moved])
                left = moved & had
                np.subtract.at(count[part], old[left, part], 1)
                np.subtract.at(total[part], old[left, part], x[left])
            codes = pa.array([c.tobytes() for c in new], pa.binary())
            nothing = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), codes, *nothing], names=names)
        parts, entries = np.nonzero((count != 0) | (total != 0).any(axis=2))
        if len(parts):
            nothing = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary())]
            told = [pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(count[parts, entries]), pa.array(list(total[parts, entries]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*nothing, *told], names=names)

    names = ["vec_id", "label", "ints", "codes", "part", "entry", "n", "sums"]
    return state.select("vec_id", "label", "ints", "codes").mapInArrow(run, STATE)


def changes(done: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The round's plus and minus over all tasks: counts and sums by part and entry, no more numbers than the codebooks hold."""
    told = done.filter("part is not null")
    count, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
    for r in told.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect():
        if r["at"]:
            total[r["part"], r["entry"], r["at"] - 1] = r["x"]
        else:
            count[r["part"], r["entry"]] = r["x"]
    return count, total


def train(vectors: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, int]:
    """The state after ``rounds``, the codebooks, and how many entries each has. ``vectors``: vec_id, label, v (whole numbers of one length).

    A round reads the state (vectors with their last assignment), assigns
    again and writes the state where it lies, without a shuffle. What meets
    over tasks are sums of the parts that changed, at most one row for each
    task, part and entry; they are added to the running sums.
    """
    first = [r[0] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    width, known = len(first[0]) // PARTS, len(first)
    books = np.zeros((PARTS, ENTRIES, width), np.int64)
    for entry, v in enumerate(first):
        books[:, entry] = np.array(v, np.int64).reshape(PARTS, width)
    count, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column("v").flatten().to_numpy().astype(np.int32).reshape(batch.num_rows, -1) if batch.num_rows else []
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes() for x in ints], pa.binary()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "ints", "codes"])

    state = vectors.mapInArrow(packed, "vec_id long, label string, ints binary, codes binary")
    written = None
    for _ in range(rounds):
        done = scratch.keep(one_round(state, books, known))
        more, sums = changes(done, width)
        if written is not None:
            scratch.drop(written)
        state, written = done.filter("part is null"), done
        if not more.any() and not sums.any():  # no part moved: no later round would change anything
            break
        count, total = count + more, total + sums
        used = count > 0
        books[used] = total[used] // count[used][:, None]
    return state, books, known


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), code, error, label_error, codebooks_sha256 for each usable row of ``vectors`` (vec_id, embedding, label).

    Left out are rows whose vector is null, empty, holds null or non-finite
    components, has a length that cannot be cut in 8, or a length unlike that
    of the usable row with the smallest vec_id. Components beyond 4,096 count
    as 4,096. Null vec_ids stand last among candidates for the first entries,
    rows that share a vec_id in order of their vectors; each row counts, also
    if it is repeated. With fewer than 16 rows a codebook has as many entries
    as there are rows. A sum over a label that exceeds 64 bits is null. An
    empty table gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    fit = vectors.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole(F.col("embedding")).alias("v"))
    least = fit.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).collect()
    out = "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string"
    if not least:
        return spark.createDataFrame([], out)
    state, books, known = train(fit.filter(F.size("v") == least[0][0]), scratch)
    length = PARTS * books.shape[2]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = nearest(matrix(batch.column("ints"), np.int32, length), books, known)
                columns = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    coded = scratch.keep(state.select("vec_id", "label", "ints").mapInArrow(last, "vec_id long, label string, code string, error long"))
    totals = scratch.keep(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(str(x) for x in books[:, :known].ravel().tolist()).encode()).hexdigest()
    return look_up(coded, totals, "label").withColumn("codebooks_sha256", F.lit(digest))


def sql(rounds: int = ROUNDS) -> str:
    """DuckDB's rows: the rounds one below the other."""
    far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(part))",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p) WHERE entry < {ENTRIES})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(f * {ENTRIES} + entry) AS best FROM (SELECT vec_id, part, entry, {far} AS f FROM p JOIN c{r} c USING (part)) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM (
    SELECT part, best % {ENTRIES} AS entry, place, sum(x[place])::BIGINT AS s, count(*) AS n FROM p JOIN a{r} USING (vec_id, part), range(1, 1 + len(x)) t(place) GROUP BY ALL)
  GROUP BY part, entry) m USING (part, entry))""")
    steps.append(f"""e AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN k USING (vec_id)"""


SQL = sql()
