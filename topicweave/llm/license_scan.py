"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import let

#: Phrases whose words stand consecutively, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: License texts and notices without their copyright lines, with their labels. A block that holds enough of one's words has its label.
TEMPLATES = {
    """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
    files the software to deal in the software without restriction including without limitation the rights to use copy modify
    merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
    furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
    express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
    noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
    whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
    other dealings in the software""": "mit",
    """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
    provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
    and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
    and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
    whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
    arising out of or in connection with the use or performance of this software""": "isc",
    """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
    following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
    the following disclaimer in the documentation and or other materials provided with the distribution this software is
    provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
    the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the
    copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages
    including but not limited to procurement of substitute goods or services loss of use data or profits or business
    interruption however caused and on any theory of liability whether in contract strict liability or tort including
    negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
    damage""": "bsd",
    """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
    sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or
    non commercial and by any means""": "unlicense",
    """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
    any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
    including commercial applications and to alter it and redistribute it freely""": "zlib",
    """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
    you may obtain a copy of the license at http www apache org licenses license 2 0""": "apache-2",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
    as published by the free software foundation either version 3 of the license or at your option any later version""": "gpl-3",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
    as published by the free software foundation either version 2 of the license or at your option any later version""": "gpl-2",
    """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
    with this file you can obtain one at""": "mpl-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
}
#: Words of the windows in which templates are sought, half a window each: a template is sought in the shortest whose half holds all of it.
HALVES = (16, 48, 128, 256)
#: Share of a template's distinct words that a block must hold, and words that must be among them whatever the share: two versions differ by one.
CONTAINMENT = 0.9
TELLING = {"gpl-3": "3", "gpl-2": "2"}
#: Everything of ASCII but letters and digits; capitals are lowered before.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of lowered text."""
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def phrase_starts(ws: Column, phrase: str) -> Column:
    """Places in the list, from 0, at which the phrase's words stand."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(ws, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out &= F.get(ws, i + k) == p
        return out

    return F.when(F.size(ws) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(ws) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def phrase_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, _base (labels). Places are sought only in texts that hold all words of a phrase."""

    def scan(ws: Column) -> Column:
        at = []
        for phrase, label in phrases.items():
            holds = F.lit(True)
            for w in dict.fromkeys(phrase.split()):
                holds &= F.array_contains(ws, w)
            none = F.array().cast("array<struct<at:int,label:string>>")
            at.append(F.when(holds, labelled(phrase_starts(ws, phrase), label)).otherwise(none))
        return F.struct(F.size(ws).cast("long").alias("n"), F.concat(*at).alias("found"))

    rows = docs.withColumn("_s", let(words(lowered(F.col("text"))), scan))
    found = F.col("_s.found")
    at = F.transform(found, lambda x: x["at"].cast("long"))
    labels = F.array_distinct(F.transform(found, lambda x: x["label"]))
    return rows.withColumns({"n_words": F.col("_s.n"), "n_base": F.size(found).cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at), "_base": labels}).drop("_s")


def half_window(template: str) -> int:
    """The half of the windows in which the template is sought."""
    return next(h for h in HALVES if h >= len(template.split()))


def need_of(words: list[str], containment: float) -> int:
    return math.ceil(containment * len(words) - 1e-9)


def template_blocks(docs: DataFrame, key: Column, sets: list[tuple[str, list[str], int]], containment: float) -> DataFrame:
    """_key, _kind, _block, _words (template words, distinct) for the blocks of texts that hold enough words of a template.

    Blocks are windows of the text, whatever its line breaks: for each kind of
    half window, twice as many words, one from every half on. Any run of as
    many words as a template has lies whole in a window of its kind, and no
    block is longer than a window.
    """
    low = lowered(F.col("text"))
    known = F.array(*(F.lit(w) for w in sorted({w for _, s, _ in sets for w in s})))

    def enough(held: Column) -> Column:
        out = F.lit(False)
        for _, s, _ in sets:
            out |= F.size(F.array_intersect(held, F.array(*(F.lit(w) for w in s)))) >= need_of(s, containment)
        return out

    def of_kind(ws: Column, half: int) -> Column:
        some = [s for _, s, h in sets if h == half]
        known = F.array(*(F.lit(w) for w in sorted({w for s in some for w in s})))
        least = min(need_of(s, containment) for s in some)
        last = F.greatest(F.ceil(F.size(ws) / half).cast("int") - 2, F.lit(0))
        held = lambda i: F.array_intersect(F.slice(ws, i * half + 1, 2 * half), known)
        block = lambda i: F.struct(F.lit(half).alias("kind"), i.alias("at"), held(i).alias("words"))
        return F.filter(F.transform(F.sequence(F.lit(0), last), block), lambda b: F.size(b["words"]) >= least)

    def windows(ws: Column) -> Column:
        return F.concat(*(of_kind(ws, half) for half in sorted({h for *_, h in sets})))

    # no block holds more words than its text
    some = docs.filter(let(F.array_intersect(words(low), known), enough))
    return some.select(key.alias("_key"), F.explode(let(words(low), windows)).alias("_b")).select("_key", F.col("_b.kind").alias("_kind"), F.col("_b.at").alias("_block"), F.col("_b.words").alias("_words"))


def template_matches(docs: DataFrame, key: Column, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """_key, _kind, _block, label, held for every block and template of which the block holds at least ``containment``.

    Words outside all templates cannot count, so a block is its set of template
    words. These are ordered by the number of blocks that hold them in the
    whole table, the rarest first. A block can only match a template of which
    it has a word among the first n - need + 1 (prefix), if it has enough
    words (length), and if enough stand behind the meeting place on both sides
    (position). What passes is counted in full.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split())), half_window(t)) for t, label in templates.items()]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    blocks = template_blocks(docs, key, sets, containment)
    counted = {r["w"]: r["n"] for r in blocks.select(F.explode("_words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each template word
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for i, (label, s, half) in enumerate(sets):
        tokens, need = sorted(rank[w] for w in s), need_of(s, containment)
        telling = rank[TELLING[label]] if TELLING.get(label) in s else None
        rows += [(i, half, label, len(s), need, tokens, telling, t, p) for p, t in enumerate(tokens[: len(s) - need + 1])]
    index = F.broadcast(spark.createDataFrame(rows, "_template int, _kind int, label string, _size int, _need int, _tokens array<int>, _telling int, _token int, _at int"))
    ranks = F.create_map(*(F.lit(x) for w in order for x in (w, rank[w])))
    sorted_blocks = blocks.withColumn("_set", F.sort_array(F.transform("_words", lambda w: F.element_at(ranks, w)))).drop("_words")
    shortest = F.lit(min(r[4] for r in rows))
    tokens = sorted_blocks.select("_key", "_kind", "_block", "_set", F.posexplode(F.slice("_set", 1, F.size("_set") - shortest + 1)).alias("_place", "_token"))
    size = F.size("_set")
    met = tokens.join(index, ["_kind", "_token"]).filter((size >= F.col("_need")) & (1 + F.least(F.col("_size") - F.col("_at") - 1, size - F.col("_place") - 1) >= F.col("_need")))
    met = met.withColumn("_held", F.size(F.array_intersect("_set", "_tokens"))).filter("_held >= _need and (_telling is null or array_contains(_set, _telling))")
    return met.groupBy("_key", "_kind", "_block", "label").agg(F.max(F.col("_held") / F.col("_size")).alias("held"))


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``.

    Blocks are overlapping windows of words, at most four times as long as the
    template that is sought in them (32 words for short ones), so that a
    license may be wrapped over lines, and words of one that are strewn over a
    text are none. score is 1 for a text with a phrase, else the largest
    containment found, else 0. Null texts count as empty: no words, no labels.
    Rows that share doc_id and text have the same labels; an empty table gives
    no rows; other columns are not read.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.coalesce("text", F.lit(""))))
    found = template_matches(docs.select("doc_id", "text"), key).groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("held").alias("_held"))
    rows = phrase_scan(docs.select("doc_id", "text").withColumn("_k", key)).drop("text").join(found, F.col("_k") == F.col("_key"), "left")
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_held", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in PHRASES.items())
    templates = ", ".join(f"({half_window(t)}, '{label}', {sorted(set(t.split()))!r}, {TELLING.get(label, '')!r})" for t, label in TEMPLATES.items())
    return rf"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{BREAK}'), lambda x: x <> '') AS ws FROM low),
phrases(label, parts) AS (VALUES {phrases}),
starts AS (
  SELECT doc_id, label, i FROM (
    SELECT doc_id, label, parts, ws, unnest(range(0, len(ws))) AS i
    FROM t, phrases WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(parts, ' ') || ' '))
  WHERE ws[i + 1:i + len(parts)] = parts),
base AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list_sort(list_distinct(list(label))) AS labels FROM starts GROUP BY doc_id),
templates(half, label, parts, telling) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, half, list_distinct(ws[i * half + 1:(i + 2) * half]) AS ws FROM (
    SELECT doc_id, ws, half, unnest(range(0, greatest(ceil(len(ws) / half)::bigint - 1, 1))) AS i FROM t, (VALUES {", ".join(f"({h})" for h in sorted(set(map(half_window, TEMPLATES))))}) h(half))),
held AS (
  SELECT doc_id, label, len(list_intersect(ws, parts)) AS h, len(parts) AS size
  FROM blocks JOIN templates USING (half) WHERE len(list_intersect(ws, parts)) >= ceil({CONTAINMENT}::double * len(parts) - 1e-9) AND (telling = '' OR NOT list_contains(parts, telling) OR list_contains(ws, telling))),
more AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(h::double / size) AS held FROM held GROUP BY doc_id)
SELECT t.doc_id, len(ws)::bigint AS n_words, coalesce(n, 0)::bigint AS n_base, a::bigint AS first_word, b::bigint AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE coalesce(held, 0.0) END::double AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


SQL = _sql()
