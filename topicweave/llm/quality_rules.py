"""Quality rules: counts of a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from .words import SPACES, let, word_list

#: A line is frequent in more distinct documents of its host than this, whatever the host's size.
MOST_DOCUMENTS = 20
#: Frequent lines that may be broadcast (a host and a hash each); parts into which documents are dealt where there are more.
BROADCAST_LINES, SALTS = 500_000, 16
#: A document is depleted when less than this share of its line characters remains.
REMAINS = 0.5
#: The base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "), F.lit(" ")))


def covered(at: Column) -> Column:
    """Words in the 3-word windows that start at these sorted places; a place may stand more than once."""
    steps = F.transform(at, lambda p, i: F.when(i == F.size(at) - 1, 3).otherwise(F.least(F.lit(3), F.get(at, i + 1) - p)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, places: int = 24, hash_bits: int = 40) -> Column:
    """Words in 3-word windows that occur twice or more in the list.

    Windows are sorted as numbers of hash and place, and neighbours with equal
    hashes are compared word by word. If all such neighbours are equal, these
    are all repeats. Else, and in lists with more windows than ``places`` bits
    can number, windows are sorted by their words.
    """
    mask = (1 << places) - 1

    def of(ws: Column) -> Column:
        last = F.size(ws) - 3

        def window(i: Column) -> Column:
            return F.struct(ws[i], ws[i + 1], ws[i + 2])

        def repeats(near: Column, place) -> Column:
            return let(F.sort_array(F.flatten(F.transform(near, lambda i: F.array(place(i - 1), place(i))))), covered)

        def by_hash(s: Column) -> Column:
            place = lambda i: s[i].bitwiseAND(mask).cast("int")
            near = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i <= last) & (F.shiftright(F.get(s, i), places) == F.shiftright(F.get(s, i - 1), places)))
            return let(near, lambda n: F.when(~F.exists(n, lambda i: window(place(i)) != window(place(i - 1))), repeats(n, place)))

        def by_words(s: Column) -> Column:
            near = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i <= last) & (F.get(s, i)["w"] == F.get(s, i - 1)["w"]))
            return repeats(near, lambda i: s[i]["i"])

        each = F.sequence(F.lit(0), last)
        keys = F.transform(each, lambda i: F.shiftleft(F.shiftright(F.xxhash64(ws[i], ws[i + 1], ws[i + 2]), 64 - hash_bits), places).bitwiseOR(i.cast("long")))
        exact = lambda: let(F.sort_array(F.transform(each, lambda i: F.struct(window(i).alias("w"), i.alias("i")))), by_words)
        quick = F.when(last <= mask, let(F.sort_array(keys), by_hash))
        return F.when(last < 0, F.lit(0).cast("long")).otherwise(F.coalesce(quick, exact()))

    return let(words, of)


def base_counts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    counts = let(word_list(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).alias("r")))
    rows = docs.select("doc_id", *more, F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"), counts.alias("_w"))
    n, r = F.col("_w.n"), F.col("_w.r")
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    return rows.select("doc_id", *(m for m in rows.columns if m.startswith("_k")), n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"))


def line_rows(docs: DataFrame) -> DataFrame:
    """_doc, _host, _content, _place, _line (hash), _chars for each line with a word."""
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), content.alias("_content"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_place", "_text"))
    rows = rows.withColumn("_text", normal(F.col("_text"))).filter("_text <> ''")
    return rows.select("_doc", "_host", "_content", "_place", F.xxhash64("_text").alias("_line"), F.length("_text").cast("long").alias("_chars"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """line_rows, written once; rows repeated with the same doc_id, source and text count once."""
    rows = line_rows(docs).dropDuplicates(["_doc", "_host", "_content", "_place"])
    return Scratch(docs.sparkSession, "quality-rules").keep(rows)


def frequent_lines(lines: DataFrame, most: int = MOST_DOCUMENTS, by_text: bool = False) -> DataFrame:
    """_host, _line of lines in more than ``most`` distinct documents of a host, or distinct texts with ``by_text``. Duplicates are combined before each exchange."""
    each = lines.select("_host", "_line", "_content" if by_text else "_doc").distinct()
    return each.groupBy("_host", "_line").agg(F.count("*").alias("_in")).filter(F.col("_in") > most).select("_host", "_line", F.lit(True).alias("_often"))


def line_losses(lines: DataFrame, frequent: DataFrame, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """_doc, _host, _content, _gone, _lost, _chars of documents with frequent lines: their hashes, their characters and those of all lines.

    A frequent line stands in many rows by its nature, so these are not dealt
    by it alone: frequent lines are broadcast or repeated for each salt.
    """
    if frequent.count() <= broadcast_lines:
        marked = lines.join(F.broadcast(frequent), ["_host", "_line"], "left")
    else:
        salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_doc", "_content"), F.lit(SALTS)).cast("int"))
        marked = salted.join(frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_line", "_salt"], "left")
    out = marked.groupBy("_doc", "_host", "_content").agg(F.collect_set(F.when(F.col("_often"), F.col("_line"))).alias("_gone"), F.sum(F.when(F.col("_often"), F.col("_chars"))).alias("_lost"), F.sum("_chars").alias("_chars"))
    return out.filter("_lost is not null")


def losses(docs: DataFrame, scratch: Scratch, most: int, by_text: bool) -> DataFrame:
    """line_losses of ``docs``, written; what is written on the way is freed."""
    lines = scratch.keep(line_rows(docs).dropDuplicates(["_doc", "_host", "_content", "_place"]))  # rows with the same doc_id, source and text count once
    frequent = scratch.keep(frequent_lines(lines, most, by_text))
    out = scratch.keep(line_losses(lines, frequent))
    scratch.drop(lines, frequent)
    return out


def judge(docs: DataFrame, most: int = MOST_DOCUMENTS, remains: float = REMAINS, by_text: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lost_chars for each row of ``docs``.

    Hosts are sources, null and empty being one. Lines are compared in lower
    case with single spaces; documents are counted by doc_id, so that copies
    of a page count each, or by their text with ``by_text``. A row goes when a
    base rule fails or when less than ``remains`` of its line characters is
    left without frequent lines. Null and empty texts have no words, so the
    base fails. Rows that share doc_id, source and text are judged alike. An
    empty table gives no rows; other columns are not read.
    """
    keys = [F.col("doc_id").alias("_kdoc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_khost"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_kcontent")]
    lost = losses(docs, Scratch(docs.sparkSession, "quality-rules"), most, by_text).select("_doc", "_host", "_content", "_lost", (F.col("_lost") > F.col("_chars") * (1 - remains)).alias("_depleted"))
    same = F.col("_kdoc").eqNullSafe(F.col("_doc")) & (F.col("_khost") == F.col("_host")) & (F.col("_kcontent") == F.col("_content"))
    out = base_counts(docs, *keys).join(lost, same, "left")
    kept = ~F.col("base_failed") & ~F.coalesce("_depleted", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.coalesce("_lost", F.lit(0)).alias("lost_chars"))


def without_frequent_lines(docs: DataFrame, most: int = MOST_DOCUMENTS, by_text: bool = False) -> DataFrame:
    """``docs`` with frequent lines cut from the texts."""
    gone = losses(docs, Scratch(docs.sparkSession, "quality-rules"), most, by_text).select("_doc", "_host", "_content", "_gone")
    rows = docs.select(F.col("doc_id").alias("_d"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_s"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    left = F.filter(F.split("_row.text", "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(normal(x))))
    text = F.when(F.col("_gone").isNull() | F.col("_row.text").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n")).alias("text")
    joined = rows.join(gone, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_s") == F.col("_host")) & (F.col("_t") == F.col("_content")), "left")
    return joined.select(*(text if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS r
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS l
  FROM (SELECT doc_id, host, text, unnest(ls) AS l FROM t)),
frequent AS (SELECT host, l FROM lines WHERE l <> '' GROUP BY host, l HAVING count(DISTINCT doc_id) > {MOST_DOCUMENTS}),
lost AS (
  SELECT doc_id, sum(length(l)) AS chars, sum(CASE WHEN (host, l) IN (SELECT (host, l) FROM frequent) THEN length(l) ELSE 0 END) AS gone
  FROM lines GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, len(ws)::bigint AS n_words, length(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', ''))::bigint AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint AS n_dup_lines,
         coalesce(r, 0)::bigint AS n_repeat_words, coalesce(gone, 0)::bigint AS lost_chars, coalesce(chars, 0) AS chars
  FROM t LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT lost_chars > chars * {1 - REMAINS}::double AS kept,
       lost_chars
FROM counted
"""
