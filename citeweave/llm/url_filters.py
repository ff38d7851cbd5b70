"""URL filters: a temporal join of captures with dated list entries, in DataFrame functions only.

A list is a history of entries (list, kind, pattern, action, dated): at `dated` a pattern is put on a list (`add`) or
taken off it (`remove`). For each list and pattern the history becomes validity intervals [from, to): the state after
an entry holds until the next one. A capture (url, fetched_at) meets the entries active at the time it was fetched
(from <= fetched_at < to), not those of today.

kind `host`: the pattern is a host name and holds for it and everything below it. kind `prefix`: host and path (which may
be empty), with no scheme; it holds for that host's URLs that go on after it at a segment's end. Hosts are compared in
lower case, paths as they are. Of all matches of a capture the longest
pattern decides; between lists with equal patterns an allowing list wins over a blocking one, then the list's name.

Each distinct (url, fetched_at) is evaluated once: its keys (the host and its parent domains, and the path's prefixes)
are exploded and equi-joined with the intervals' patterns, and the interval is tested in the join. A URL has as many
keys as it has labels and segments. The intervals are broadcast if they are at most `broadcast_rows`; beyond that both
sides are shuffled, the intervals of each pattern being copied to each of `salts` salts, so that one host's captures
never meet in one task. Both ways give the same rows. Verdicts meet their captures in a salted join, so neither do
captures that repeat.

Defined cases: a null or unparsable URL matches nothing and is kept. URLs of any length are read whole. A capture without time matches nothing. Entries
with a null pattern, action or date, or of another kind, are ignored. Of entries of one list and pattern with one date, `remove` wins. Rows
that repeat get the same verdict, each in a row of its own. Empty captures or lists are no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ascii_lower, free_name, hot_keys, salted_join, stored

_NEVER = 2**62

#: The lists of production; dates are days of 2024. (list, allows, kind, pattern, action, date)
ENTRIES = [
    ("spam", False, "host", "cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", False, "host", "cheap-pills.example.com", "remove", "2024-04-15"),
    ("spam", False, "host", "cheap-pills.example.com", "add", "2024-07-01"),
    ("spam", False, "host", "casino.example.net", "add", "2024-01-15"),
    ("spam", False, "host", "tiontion.example.com", "add", "2024-03-01"),
    ("spam", False, "host", "tiontion.example.com", "remove", "2024-09-01"),
    ("adult", False, "host", "ththan.example.net", "add", "2024-05-10"),
    ("adult", False, "host", "blog.ththth.example.org", "add", "2024-01-01"),
    ("adult", False, "host", "blog.ththth.example.org", "remove", "2024-06-01"),
    ("optout", False, "prefix", "tionsh.example.net/de", "add", "2024-03-20"),
    ("optout", False, "prefix", "tionsh.example.net/fr", "add", "2024-08-01"),
    ("optout", False, "prefix", "tionsh.example.net/fr", "remove", "2024-10-01"),
    ("optout", False, "host", "thther.example.org", "add", "2024-06-15"),
    ("trusted", True, "host", "m.tiontion.example.com", "add", "2024-05-01"),
    ("trusted", True, "prefix", "tionsh.example.net/de", "add", "2024-11-01"),
    ("trusted", True, "host", "blog.tionble.example.com", "add", "2024-01-01"),
    ("malware", False, "host", "tionble.example.com", "add", "2024-02-10"),
    ("malware", False, "host", "ththon.example.com", "add", "2024-04-01"),
    ("malware", False, "host", "ththon.example.com", "remove", "2024-04-20"),
    ("malware", False, "host", "ththon.example.com", "add", "2024-10-05"),
]


def production_entries(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ENTRIES, "list string, allows boolean, kind string, pattern string, action string, day string")
    return rows.withColumn("dated", F.unix_timestamp("day", "yyyy-MM-dd")).drop("day")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, allows, kind, pattern, valid_from, valid_to) of the states in which a pattern is on a list. entries: list,
    allows, kind, pattern, action, dated (seconds)."""
    rows = entries.filter("pattern is not null and dated is not null and action in ('add', 'remove') and kind in ('host', 'prefix')")
    host = ascii_lower(F.regexp_extract("pattern", r"^([^/]*)", 1))
    pattern = F.regexp_replace(F.concat(host, F.regexp_extract("pattern", r"^[^/]*(.*)$", 1)), "/+$", "")
    rows = rows.groupBy("list", "kind", pattern.alias("pattern"), "dated").agg(
        F.max((F.col("action") == "remove").cast("int")).alias("off"), F.max("allows").alias("allows")
    )
    order = Window.partitionBy("list", "kind", "pattern").orderBy("dated")
    rows = rows.withColumn("valid_to", F.coalesce(F.lead("dated").over(order), F.lit(_NEVER)))
    return rows.filter("off = 0").select("list", "allows", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port or a final dot; empty if there is none."""
    return F.regexp_replace(ascii_lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"\.+$", "")


def url_keys(url: Column) -> Column:
    """(kind, key): the host and its parent domains as hosts; the host, and host and path up to each segment's end, as
    prefixes."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.transform(parts, lambda p, i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    of = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.concat(F.transform(hosts, of("host")), F.transform(F.concat(F.array(host), paths), of("prefix")))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """captures with kept, list, pattern and n_matches (names that captures has already get underscores)."""
    out = {c: free_name(captures, c) for c in ("kept", "list", "pattern", "n_matches")}
    intervals = validity_intervals(entries)
    u, t = free_name(captures, "capture_url"), free_name(captures, "capture_time")
    named = captures.withColumn(u, F.col(url)).withColumn(t, F.col(fetched).cast("long"))
    distinct = stored(named.filter(F.col(u).isNotNull() & F.col(t).isNotNull()).groupBy(u, t).agg(F.count(F.lit(1)).alias("n_captures")))
    keys = distinct.select(F.col(u).alias("u"), F.col(t).alias("t"), F.explode(url_keys(F.col(u))).alias("k")).select("u", "t", F.col("k.kind").alias("key_kind"), F.col("k.key").alias("key"))
    active = (F.col("key") == F.col("pattern")) & (F.col("key_kind") == F.col("kind")) & (F.col("valid_from") <= F.col("t")) & (F.col("t") < F.col("valid_to"))
    if intervals.count() <= broadcast_rows:
        hits = keys.join(F.broadcast(intervals), active)
    else:
        keys = keys.withColumn("salt", F.pmod(F.xxhash64("u", "t"), F.lit(salts)).cast("int"))
        spread = intervals.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = keys.join(spread, active & (F.col("salt") == F.col("salt_of")))
    # the longest pattern first, then allowing lists, then the list's name: the least of this struct
    best = F.struct(-F.length("pattern"), ~F.coalesce("allows", F.lit(False)), "list", "pattern", F.coalesce("allows", F.lit(False)).alias("allows"))
    n, verdict = free_name(named, "n_hits"), free_name(named, "best")
    verdicts = hits.groupBy(F.col("u").alias(u), F.col("t").alias(t)).agg(F.min(best).alias(verdict), F.count(F.lit(1)).alias(n))
    often = hot_keys(distinct, "n_captures", captures.count())
    # captures without URL or time match nothing and needn't move
    lone = F.col(u).isNull() | F.col(t).isNull()
    alone = named.filter(lone).withColumns({verdict: F.lit(None).cast(verdicts.schema[verdict].dataType), n: F.lit(None).cast("long")})
    joined = salted_join(named.filter(~lone), verdicts, [u, t], often, "left").unionByName(alone)
    return joined.select(
        *captures.columns,
        F.coalesce(F.col(verdict)["allows"], F.lit(True)).alias(out["kept"]),
        F.col(verdict)["list"].alias(out["list"]),
        F.col(verdict)["pattern"].alias(out["pattern"]),
        F.coalesce(F.col(n), F.lit(0)).cast("long").alias(out["n_matches"]),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures. The table has no time of capture: one is derived, spread over 2024 by page_id."""
    fetched = F.lit(1704067200) + F.pmod(F.col("page_id") * 48271, F.lit(366 * 1440)) * 60
    return pages.select("page_id", "url", fetched.cast("long").alias("fetched_at"))


def filter_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    out = filter_urls(captures_of(pages), production_entries(spark))
    return out.select("page_id", "url", url_host(F.col("url")).alias("host"), "fetched_at", "kept", "list", "pattern", "n_matches")


def _values() -> str:
    return ",\n  ".join(f"('{n}', {str(a).lower()}, '{k}', '{p}', '{act}', epoch(TIMESTAMP '{d} 00:00:00')::BIGINT)" for n, a, k, p, act, d in ENTRIES)


FILTER_SQL = f"""
WITH entries(list, allows, kind, pattern, action, dated) AS (VALUES
  {_values()}),
states AS (
  SELECT list, allows, kind, pattern, action, dated AS valid_from,
         coalesce(lead(dated) OVER (PARTITION BY list, kind, pattern ORDER BY dated), {_NEVER}) AS valid_to FROM entries),
captures AS (
  SELECT page_id, url, 1704067200 + ((page_id * 48271) % (366 * 1440)) * 60 AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^?#]*)', 1), '/+$', '') AS path FROM pages),
hits AS (
  SELECT c.page_id, s.list, s.allows, s.pattern,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC, s.allows DESC, s.list) AS place,
         count(*) OVER (PARTITION BY c.page_id) AS n
  FROM captures c JOIN states s ON s.action = 'add' AND s.valid_from <= c.fetched_at AND c.fetched_at < s.valid_to
   AND (s.kind = 'host' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))
        OR s.kind = 'prefix' AND starts_with(c.host || '/' || c.path || '/', s.pattern || '/')))
SELECT c.page_id, c.url, c.host, c.fetched_at::BIGINT AS fetched_at, coalesce(h.allows, true) AS kept, h.list, h.pattern,
       coalesce(h.n, 0)::BIGINT AS n_matches
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1
"""
