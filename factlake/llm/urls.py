"""URL filters as a temporal list join.

Entries of the list are dated: one blocks or allows a host or a domain from its day on, until the
next entry for the same pattern or one that removes it. They become validity intervals, and each
capture is joined with the intervals of its host and the domains above it that hold at fetch time;
of several, the most specific decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Host of a URL, after lower-casing.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: A list with at most so many intervals is broadcast.
MOST_BROADCAST = 100_000
#: (kind, pattern, action, day); a domain stands for itself and every host below it.
ENTRIES = (
    ("domain", "spam-farm.example.org", "block", "2024-02-01"),
    ("domain", "spam-farm.example.org", "remove", "2024-08-01"),
    ("domain", "spam-farm.example.org", "block", "2025-01-15"),
    ("domain", "cheap-pills.example.com", "block", "2023-06-01"),
    ("host", "www.cheap-pills.example.com", "allow", "2024-05-01"),
    ("host", "www.cheap-pills.example.com", "remove", "2024-11-01"),
    ("domain", "example.net", "block", "2025-03-01"),
    ("domain", "example.net", "remove", "2025-04-01"),
    ("host", "m.ththth.example.net", "allow", "2025-03-10"),
    ("domain", "ththed.example.org", "block", "2024-06-15"),
)
_VALUES = ", ".join(f"('{k}', '{p}', '{a}', DATE '{d}')" for k, p, a, d in ENTRIES)


def dated_list(spark: SparkSession) -> DataFrame:
    """The list above as a table."""
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(kind, pattern, action, day)")


def fetch_time(page_id: Column) -> Column:
    """A day of two years for each page, since the pages have no fetch time of their own."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(730)).cast("int"))


def validity(entries: DataFrame) -> DataFrame:
    """``(key, pattern, kind, action, since, until)``; ``until`` is null while nothing follows.

    Entries that lack a pattern, a day or a known action or kind are ignored; of entries of one
    pattern and day, the last action in order counts. An interval whose action removes is dropped.
    """
    known = entries.filter("kind in ('host', 'domain') and action in ('block', 'allow', 'remove')")
    known = known.filter("pattern is not null and day is not null").select("kind", F.lower("pattern").alias("pattern"), "action", "day")
    later = Window.partitionBy("kind", "pattern").orderBy("day", "action")
    spans = known.withColumn("until", F.lead("day").over(later)).filter("action <> 'remove'")
    spans = spans.filter("until is null or until > day")
    key = F.concat(F.when(F.col("kind") == "host", "=").otherwise("."), "pattern")
    return spans.select(key.alias("key"), "pattern", "kind", "action", F.col("day").alias("since"), "until")


def url_host(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))


def label_counts(spans: DataFrame) -> list[int]:
    """The numbers of labels that domains of the list have.

    Domains of k different numbers of labels have some k * k / 2 characters together, so a list of a
    gigabyte has 45,000 of them at most, and one of real names no more than 127.
    """
    rows = spans.filter("kind = 'domain'").select(_labels(F.col("pattern")).alias("n")).distinct().collect()
    return sorted(r["n"] for r in rows)


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def host_keys(host: Column, counts: list[int]) -> Column:
    """The host itself, and the domains it lies in that have as many labels as some domain of the list."""
    tails = [F.when(_labels(host) >= n, F.concat(F.lit("."), F.substring_index(host, ".", -n))) for n in counts]
    return F.array_compact(F.array(F.concat(F.lit("="), host), *tails))


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str, time_col: str) -> DataFrame:
    """``captures`` with ``host``, ``entry``, ``action`` and ``blocked``.

    The join runs over distinct pairs of host and time, so a host with a large share of the captures
    counts once for each time. A list of at most ``MOST_BROADCAST`` intervals is broadcast, a longer
    one is shuffled by key.

    Defined results: a null or unparsable URL, or a null time, matches nothing and isn't blocked; a
    URL of any length is read whole, in time linear in it times the numbers of labels that the list's
    domains have; repeated captures stay; an empty list blocks nothing, and an
    empty table of captures stays empty; columns named like the four results are replaced, and any
    other names may occur.
    """
    new = {"host", "entry", "action", "blocked"}
    names = [c for c in captures.columns if c.lower() not in new]
    # The row goes along as one struct, so that only columns of this function have names.
    host = F.nullif(url_host(F.col(f"`{url_col}`").cast("string")), F.lit(""))
    own = captures.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), host.alias("host"), F.col(f"`{time_col}`").alias("at"))
    spans = validity(entries)
    counts = label_counts(spans)
    if spans.count() <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    asked = own.select("host", "at").dropna().distinct().withColumn("key", F.explode(host_keys(F.col("host"), counts)))
    active = asked.join(spans, "key").filter("since <= at and (until is null or until > at)")
    rank = F.struct(F.length("pattern"), F.col("kind") == "host", "pattern", "action")
    best = active.groupBy("host", "at").agg(F.max(rank).alias("best"))
    best = best.select("host", "at", F.col("best.pattern").alias("entry"), F.col("best.action").alias("action"))
    out = own.join(best, ["host", "at"], "left")
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in names), "host", "entry", "action",
        F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"),
    )


FILTER_SQL = f"""
WITH entries(kind, pattern, action, day) AS (VALUES {_VALUES}),
spans AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day, action) AS until FROM entries)
  WHERE action <> 'remove' AND (until IS NULL OR until > day)),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 730)::INT AS fetched,
    nullif(rtrim(regexp_extract(lower(url), '{HOST}', 1), '.'), '') AS host FROM pages),
hits AS (
  SELECT c.page_id, s.pattern, s.action,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC, s.kind = 'host' DESC) AS n
  FROM captures c JOIN spans s
    ON s.day <= c.fetched AND (s.until IS NULL OR s.until > c.fetched)
    AND (c.host = s.pattern OR (s.kind = 'domain' AND ends_with(c.host, '.' || s.pattern))))
SELECT c.page_id, c.url, c.fetched, c.host, h.pattern AS entry, h.action, coalesce(h.action = 'block', false) AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.n = 1
"""
