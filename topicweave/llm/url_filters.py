"""URL filters: captures joined with the list entries that were valid when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Parts into which the captures of one host are dealt.
SALTS = 16
#: For the query: captures spread over these days, entries added and lifted by rules over the hosts.
FIRST_DAY, DAYS = "2024-01-01", 360


#: How a url names its host, and which hosts are addresses.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^\[/?#:@]+)"
ADDRESS = r"^(\[.*|[0-9.]+)$"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and trailing dot; null where there is none. An address of version 6 keeps its brackets."""
    h = F.lower(F.regexp_extract(F.trim(url), HOST, 1))
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def domains(h: Column) -> Column:
    """The host and every domain above it, down to two labels; an address has none above it.

    There is no list of public suffixes, so ``co.uk`` is a domain, which
    matters only if a list has it as an entry.
    """
    parts = F.split(h, r"\.")
    n = F.size(parts)
    return F.when((n <= 2) | h.rlike(ADDRESS), F.array(h)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """domain, label, valid_from, valid_to from dated entries (domain, label, day, listed).

    An entry holds until the next of its domain and label; of entries of one
    day the one that lists wins. Only listing intervals are returned, the last
    open-ended.
    """
    daily = entries.groupBy("domain", "label", "day").agg(F.max("listed").alias("listed"))
    after = F.lead("day").over(W.Window.partitionBy("domain", "label").orderBy("day"))
    return daily.withColumn("valid_to", after).filter("listed").select("domain", "label", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, host, day, blocked, labels for each row of ``captures`` (page_id, url, day).

    Every capture is joined as of its day with the intervals of its host and
    the domains above it. Captures are salted and intervals repeated for each
    salt, since a host may hold a third of the captures and its intervals are
    few. A null or malformed url or a null day is matched by nothing. Rows
    that share page_id, url and day are one capture in several copies, and
    each is returned. Empty tables give no rows or no blocks; other columns
    are not read.
    """
    rows = captures.select("page_id", host(F.col("url")).alias("host"), "day")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "day"), F.lit(salts)).cast("int"))
    keys = salted.select("page_id", "host", "day", "_salt").distinct().withColumn("domain", F.explode(domains(F.col("host"))))
    spans = validity(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    valid = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    hits = keys.join(spans, ["domain", "_salt"]).filter(valid).groupBy("page_id", "host", "day").agg(F.collect_set("label").alias("_labels"))
    h = hits.select(*(F.col(c).alias(f"_{c}") for c in ("page_id", "host", "day")), "_labels")
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("host") == F.col("_host")) & (F.col("day") == F.col("_day"))
    out = rows.join(h, same, "left")
    return out.select("page_id", "host", F.col("day").cast("string").alias("day"), F.col("_labels").isNotNull().alias("blocked"), F.coalesce(F.array_join(F.sort_array("_labels"), ","), F.lit("")).alias("labels"))


def dated_entries(hosts: DataFrame) -> DataFrame:
    """A list for tests of hosts (host): by the length of its name a host or its domain is listed, lifted and listed again."""
    n = F.length("host")
    parent = F.element_at(domains(F.col("host")), -1)
    first = F.to_date(F.lit(FIRST_DAY))
    day = lambda k: F.date_add(first, (k).cast("int"))
    entry = lambda d, label, at, listed: F.struct(d.alias("domain"), F.lit(label).alias("label"), day(at).alias("day"), F.lit(listed).alias("listed"))
    both = F.array(entry(F.col("host"), "spam", n * 5, True), entry(F.col("host"), "spam", n * 5 + 60, False), entry(F.col("host"), "spam", n * 5 + 200, True))
    wide = F.array(entry(parent, "adult", F.lit(100), True), entry(parent, "adult", F.lit(130), False))
    picked = F.when(n % 2 == 0, both).when(n % 5 == 0, wide)
    return hosts.select(F.explode(picked).alias("e")).select("e.*").distinct()


def fetched(page_id: Column) -> Column:
    """The query's stand-in for a crawl log, which the table lacks: a day for each page."""
    return F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(DAYS)).cast("int"))


SQL = rf"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '{HOST}', 1)), '\.+$', ''), '') AS host,
         DATE '{FIRST_DAY}' + (page_id % {DAYS})::int AS day FROM pages),
named AS (
  SELECT DISTINCT host, length(host)::int AS n, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS parent FROM captures WHERE host IS NOT NULL),
entries AS (
  SELECT DISTINCT * FROM (
    SELECT host AS domain, 'spam' AS label, DATE '{FIRST_DAY}' + k AS day, k <> n * 5 + 60 AS listed FROM (SELECT host, n, unnest([n * 5, n * 5 + 60, n * 5 + 200]) AS k FROM named WHERE n % 2 = 0)
    UNION ALL SELECT parent, 'adult', DATE '{FIRST_DAY}' + k, k = 100 FROM (SELECT parent, unnest([100, 130]) AS k FROM named WHERE n % 2 <> 0 AND n % 5 = 0))),
spans AS (SELECT *, lead(day) OVER (PARTITION BY domain, label ORDER BY day) AS until FROM entries),
hits AS (
  SELECT DISTINCT page_id, label FROM captures JOIN spans ON host = domain OR ends_with(host, '.' || domain) AND NOT regexp_matches(host, '{ADDRESS}')
  WHERE listed AND captures.day >= spans.day AND (until IS NULL OR captures.day < until)),
labels AS (SELECT page_id, array_to_string(list_sort(list(label)), ',') AS labels FROM hits GROUP BY page_id)
SELECT page_id, host, day::varchar AS day, labels IS NOT NULL AS blocked, coalesce(labels, '') AS labels FROM captures LEFT JOIN labels USING (page_id)
"""
