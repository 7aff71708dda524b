"""URL filter by dated lists, as a temporal join in DataFrame operations.

A list is a history: entries are added and removed at dates.  Each addition is
valid from its date until the next event of the same list and key, so every
history becomes validity intervals that do not overlap.  A capture is evaluated
as of its fetch time: its keys (the host, the domains above it, and its path
prefixes) are joined to the intervals on the key, and an interval counts if it
holds the fetch time.  Among active entries the longest key decides; at equal
length ``allow`` beats ``block``.

The intervals are broadcast only if they are few (``SMALL`` rows, counted
first); otherwise both sides are shuffled on the key and a salt, with the
intervals repeated for each salt, so that a hot host is dealt to ``SALTS`` tasks.

Defined results: a null or unparseable URL has no keys and is kept; a null fetch
time matches nothing; events of one list, key and date count in the order remove,
add; repeated captures each get their verdict; empty lists keep everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import stored, table

SMALL = 20_000
SALTS = 16
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; '' if there is none."""
    authority = F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """(list, verdict, key, since, until) from events (list, verdict, key, action, at)."""
    order = Window.partitionBy("list", "verdict", "key").orderBy("at", F.desc("action"))
    following = events.withColumn("until", F.lead("at").over(order))
    return following.filter((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("at")))).select("list", "verdict", "key", F.col("at").alias("since"), "until")


def keys_of(host: Column, path: Column, depth: int) -> Column:
    """The host, the domains above it of two labels or more, and path prefixes of up to ``depth`` parts."""
    labels = F.split(host, r"\.")
    domains = F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))
    if not depth:
        return F.when(host != "", domains)
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, depth)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host != "", F.concat(domains, F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))))


def filtered(captures: DataFrame, events: DataFrame, small: int = SMALL, salts: int = SALTS) -> DataFrame:
    """Captures (page_id, url, fetched) with host, n_active, rule (list and key) and blocked.

    No list key can match deeper than the deepest key, so deeper prefixes are not made.
    """
    valid = stored(intervals(events), "intervals")
    n, depth = valid.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("key") - F.length(F.replace("key", F.lit("/")))), F.lit(0))).first()
    rows = captures.select("page_id", "fetched", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    asked = rows.select("row", "page_id", "fetched", "host", F.explode_outer(keys_of(F.col("host"), F.col("path"), depth)).alias("asked"))
    inside = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if n <= small:
        met = asked.join(F.broadcast(valid), (F.col("asked") == F.col("key")) & inside, "left")
    else:
        dealt = asked.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
        spread = valid.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = dealt.join(spread, (F.col("asked") == F.col("key")) & (F.col("salt") == F.col("salt2")) & inside, "left")
    rank = F.struct(F.length("key").alias("n"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allow"), F.col("list"), F.col("key"))
    best = met.groupBy("row", "page_id", "fetched", "host").agg(F.count("key").alias("n_active"), F.max(F.when(F.col("key").isNotNull(), rank)).alias("best"))
    rule = F.concat_ws(":", F.col("best.list"), F.col("best.key"))
    return best.select("page_id", "fetched", "host", "n_active", rule.alias("rule"), F.coalesce(F.col("best.allow") == 0, F.lit(False)).alias("blocked"))


def _draw(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int")


def fetch_day(page_id: Column) -> Column:
    """The pages carry no dates: the day of 2024, from the id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 37, F.lit(365)).cast("int"))


def derived_lists(pages: DataFrame) -> DataFrame:
    """List histories for the query, by rule from the hosts of the pages.

    A quarter of the hosts is blocked twice for 60 days, a seventh is allowed from
    some day on, a ninth of the first path parts is blocked from some day on, and
    a third of the registered domains is blocked for 30 days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("key"), path_of(F.col("url")).alias("path")).filter("key != ''")
    part = F.split("path", "/")
    paths = hosts.filter(F.get(part, 1) != "").select(F.concat("key", F.lit("/"), F.get(part, 1)).alias("key"))
    domains = hosts.select(F.substring_index("key", ".", -2).alias("key"))
    start = F.lit("2024-01-01").cast("date")

    def history(keys: DataFrame, name: str, verdict: str, share: int, *steps: tuple[str, int]) -> DataFrame:
        own = keys.select("key").distinct().withColumn("x", _draw(F.concat(F.lit(name + "|"), F.col("key")))).filter(F.col("x") % share == 0)
        day = F.col("x") % 200
        events = F.array(*(F.struct(F.lit(a).alias("action"), F.date_add(start, (day + plus).cast("int")).alias("at")) for a, plus in steps))
        own = own.select("key", F.explode(events).alias("e"))
        return own.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), "key", "e.action", "e.at")

    return (
        history(hosts.select("key"), "spam", "block", 4, ("add", 0), ("remove", 60), ("add", 100), ("remove", 160))
        .unionByName(history(hosts.select("key"), "trusted", "allow", 7, ("add", 30)))
        .unionByName(history(paths, "paths", "block", 9, ("add", 10)))
        .unionByName(history(domains, "domains", "block", 3, ("add", 0), ("remove", 30)))
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", fetch_day(F.col("page_id")))
    return filtered(captures, derived_lists(pages))


SQL = r"""
WITH raw AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS fetched,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (SELECT 'spam' AS list, host AS k, 4 AS share FROM raw WHERE host <> ''
  UNION SELECT 'trusted', host, 7 FROM raw WHERE host <> ''
  UNION SELECT 'paths', host || '/' || string_split(path, '/')[2], 9 FROM raw WHERE host <> '' AND coalesce(string_split(path, '/')[2], '') <> ''
  UNION SELECT 'domains', array_to_string(string_split(host, '.')[-2:], '.'), 3 FROM raw WHERE host <> ''),
drawn AS (SELECT *, CAST('0x' || substr(md5(list || '|' || k), 1, 4) AS INTEGER) AS x FROM named),
kept AS (SELECT list, k, x % 200 AS d FROM drawn WHERE x % share = 0),
valid AS (
  SELECT list, k, d AS since, d + 60 AS until FROM kept WHERE list = 'spam'
  UNION ALL SELECT list, k, d + 100, d + 160 FROM kept WHERE list = 'spam'
  UNION ALL SELECT list, k, d + 30, 9999 FROM kept WHERE list = 'trusted'
  UNION ALL SELECT list, k, d + 10, 9999 FROM kept WHERE list = 'paths'
  UNION ALL SELECT list, k, d, d + 30 FROM kept WHERE list = 'domains'),
dated AS (SELECT list, CASE WHEN list = 'trusted' THEN 1 ELSE 0 END AS allow, k, DATE '2024-01-01' + CAST(since AS INTEGER) AS since, DATE '2024-01-01' + CAST(until AS INTEGER) AS until FROM valid),
labelled AS (SELECT row_number() OVER () AS r, *, string_split(host, '.') AS l, string_split(path, '/')[2] AS p FROM raw),
asked AS (
  SELECT r, page_id, fetched, host, array_to_string(l[i:], '.') AS k FROM labelled, unnest(range(1, greatest(len(l), 2))) AS t(i) WHERE host <> ''
  UNION ALL SELECT r, page_id, fetched, host, host || '/' || p FROM labelled WHERE host <> '' AND coalesce(p, '') <> ''
  UNION ALL SELECT r, page_id, fetched, host, NULL FROM labelled),
met AS (SELECT a.*, d.list, d.allow, d.k AS hit FROM asked a LEFT JOIN dated d ON a.k = d.k AND a.fetched >= d.since AND a.fetched < d.until),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY (hit IS NULL), length(hit) DESC, allow DESC, list DESC, hit DESC) AS n, count(hit) OVER (PARTITION BY r) AS n_active FROM met)
SELECT page_id, fetched, host, n_active, coalesce(list || ':' || hit, '') AS rule, coalesce(allow = 0, FALSE) AS blocked FROM ranked WHERE n = 1
"""
