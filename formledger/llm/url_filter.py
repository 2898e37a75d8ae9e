"""Temporal URL filter: every capture is judged by the list entries in force when it was fetched.

A list is a log of dated entries (host pattern, action, day). The entries of one pattern, in order, become validity
intervals: an ``add`` is in force from its day until the next ``remove`` of that pattern. A capture matches a pattern if
its host is the pattern or lies below it, so each capture is joined by equality on its host and each parent domain (a
few rows), and the interval decides: an as-of join without any range scan. A host that holds a third of all captures
is an ordinary skewed key of an inner join, which adaptive execution splits.

Defined results: a null or hostless URL matches nothing; a null fetch day matches nothing; repeated rows are judged alike;
same-day entries take effect in the order add, remove (so a remove wins); repeated adds prolong, they do not nest; an
empty list blocks nothing; a host of more than LONGEST_HOST characters is no host; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formledger.llm.common import table


#: Fixed value: characters that a host name may have; so a host has a bounded number of parent domains.
LONGEST_HOST = 253


def host(url: Column) -> Column:
    """Lower-case host without user, port or a final dot; "" if there is none, or it is longer than a host name may be."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?:[:/?#]|$)", 1))
    return F.when(F.length(name) <= LONGEST_HOST, name).otherwise("")


def patterns(name: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, action, day) -> (pattern, since, until): until is the first day no longer in force, or null."""
    ordered = W.partitionBy("pattern").orderBy("day", "action")
    daily = entries.where("pattern IS NOT NULL AND day IS NOT NULL").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    # Runs of equal actions count from their first day.
    turns = daily.withColumn("last", F.lag("action").over(ordered)).where("last IS NULL OR last <> action")
    return (
        turns.withColumn("until", F.lead("day").over(ordered)).where("action = 'add'").select("pattern", F.col("day").alias("since"), "until")
    )


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures (page_id, url, day) -> page_id, host, day, blocked, n_entries and the most specific pattern in force."""
    named = captures.select("page_id", host(F.col(url)).alias("host"), F.col(day).alias("day"))
    keys = named.where("host <> ''").select(
        "host", "day", F.explode(patterns(F.col("host"))).alias("pattern")
    ).distinct()  # one row a host and day, however many captures share them
    in_force = keys.join(intervals(entries), "pattern").where("day >= since AND (until IS NULL OR day < until)")
    judged = in_force.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n"), F.max_by("pattern", F.length("pattern")).alias("pattern"))
    return named.join(judged, ["host", "day"], "left").select(
        "page_id",
        "host",
        "day",
        F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).alias("n_entries"),
        F.coalesce("pattern", F.lit("")).alias("pattern"),
    )


#: Days of the synthetic captures and entries run from 0 to 364.
_DAYS = 365


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from the pages' hosts and their parent domains: two in five are added, half of these removed, some
    added again."""
    h = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long")
    hosts = pages.select(host(F.col("url")).alias("host")).where("host <> ''").select(F.explode(patterns(F.col("host"))).alias("pattern")).distinct()
    added = hosts.where(h % 5 < 2).withColumn("first", (h % 97).cast("int"))
    log = F.array(
        F.struct(F.lit("add").alias("action"), F.col("first").alias("day")),
        F.struct(F.when(h % 2 == 0, F.lit("remove")).alias("action"), (F.col("first") + 60 + h % 50).cast("int").alias("day")),
        F.struct(F.when(h % 3 == 0, F.lit("add")).alias("action"), (F.col("first") + 160 + h % 40).cast("int").alias("day")),
    )
    return added.select("pattern", F.explode(log).alias("e")).select("pattern", "e.action", "e.day").where("action IS NOT NULL")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") * 7919 % _DAYS).cast("int"))
    return evaluate(captures, entries_of(pages))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, (page_id * 7919 % 365)::INT AS day,
         CASE WHEN length(name) <= 253 THEN name ELSE '' END AS host
  FROM (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?:[:/?#]|$)', 1)) AS name FROM pages)
), h AS (
  SELECT DISTINCT unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
         lambda x: array_to_string(list_slice(string_split(host, '.'), x, len(string_split(host, '.'))), '.'))) AS pattern
  FROM p WHERE host <> ''
), c AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS h FROM h), a AS (SELECT *, (h % 97)::INT AS first FROM c WHERE h % 5 < 2),
e AS (
  SELECT pattern, 'add' AS action, first AS day FROM a
  UNION ALL SELECT pattern, 'remove', (first + 60 + h % 50)::INT FROM a WHERE h % 2 = 0
  UNION ALL SELECT pattern, 'add', (first + 160 + h % 40)::INT FROM a WHERE h % 3 = 0
), d AS (SELECT pattern, day, max(action) AS action FROM e GROUP BY pattern, day),
t AS (SELECT *, lag(action) OVER (PARTITION BY pattern ORDER BY day) AS last FROM d),
i AS (
  SELECT pattern, action, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until
  FROM t WHERE last IS NULL OR last <> action
), k AS (
  SELECT page_id, host, day, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
         lambda x: array_to_string(list_slice(string_split(host, '.'), x, len(string_split(host, '.'))), '.'))) AS pattern
  FROM p WHERE host <> ''
), j AS (
  SELECT page_id, count(*) AS n, arg_max(k.pattern, length(k.pattern)) AS pattern
  FROM k JOIN i ON i.pattern = k.pattern AND i.action = 'add' AND day >= since AND (until IS NULL OR day < until)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.day, n IS NOT NULL AS blocked, coalesce(n, 0)::BIGINT AS n_entries, coalesce(j.pattern, '') AS pattern
FROM p LEFT JOIN j ON j.page_id = p.page_id
"""
QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": OP3_SQL}
