"""Dated list entries and captures derived from ``pages``, and the temporal list join over them in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.llm import url_lists
from voxelcohort.llm.textgrid import need, table

START = "2024-01-01"
# (list, verdict, kind, value, action, day offset from the first page of the value, which values): dated entries.
ENTRY_RULES = (
    ("hosts", "block", "domain", "host", "add", "f * 13 % 200", "f % 3 = 0"),
    ("hosts", "block", "domain", "host", "remove", "f * 13 % 200 + 120", "f % 6 = 0"),
    ("hosts", "block", "domain", "host", "add", "f * 13 % 200 + 240", "f % 12 = 0"),
    ("parents", "block", "domain", "parent", "add", "g * 29 % 300", "g % 2 = 1"),
    ("parents", "block", "domain", "parent", "remove", "g * 29 % 300 + 60", "g % 2 = 1"),
    ("paths", "allow", "prefix", "host || '/en'", "add", "f * 7 % 400", "f % 2 = 0"),
)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = need(table(spark, sf_dir, "pages"), page_id="long", url="string")
    return pages.withColumn("fetched_on", F.expr(f"date_add(DATE '{START}', CAST(page_id * 37 % 540 AS INT))"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries that follow the hosts of the pages, so that the list grows with them."""
    hosts = need(table(spark, sf_dir, "pages"), page_id="long", url="string").withColumn("host", url_lists.host_of(F.col("url")))
    by_host = hosts.filter("host <> ''").groupBy("host").agg(F.min("page_id").alias("f")).withColumn("parent", F.substring_index("host", ".", -2))
    by_parent = by_host.groupBy("parent").agg(F.min("f").alias("g"))
    both = by_host.join(by_parent, "parent")
    rows = [
        both.filter(chosen).selectExpr(f"'{name}' list_name", f"'{verdict}' verdict", f"'{kind}' kind", f"{value} value", f"'{action}' action",
                                       f"date_add(DATE '{START}', CAST({day} AS INT)) day")
        for name, verdict, kind, value, action, day, chosen in ENTRY_RULES
    ]
    everything = rows[0]
    for more in rows[1:]:
        everything = everything.unionByName(more)
    return everything


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_lists.judge(captures(spark, sf_dir), entries(spark, sf_dir))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "since")})


_ENTRIES = " UNION ALL ".join(
    f"SELECT '{name}' list_name, '{verdict}' verdict, '{kind}' kind, {value} AS value, '{action}' AS action, DATE '{START}' + CAST({day} AS INT) AS d FROM both_ WHERE {chosen}"
    for name, verdict, kind, value, action, day, chosen in ENTRY_RULES)

OP4_SQL = f"""
WITH seen AS (
  SELECT page_id, url, CAST(DATE '{START}' + CAST(page_id * 37 % 540 AS INT) AS DATE) AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2)), '.') AS host,
    trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS path, count(*) AS n_captures
  FROM pages GROUP BY ALL
), by_host AS (SELECT host, min(page_id) f, regexp_extract(host, '([^.]+[.])?[^.]+$') parent FROM seen WHERE host <> '' GROUP BY host),
both_ AS (SELECT h.*, g FROM by_host h JOIN (SELECT parent, min(f) g FROM by_host GROUP BY parent) p USING (parent)),
entry AS ({_ENTRIES}),
daily AS (SELECT list_name, verdict, kind, value, d, bool_or(action = 'add') AS is_on FROM entry GROUP BY ALL),
spans AS (SELECT *, lead(d) OVER (PARTITION BY list_name, verdict, kind, value ORDER BY d) AS until FROM daily),
hits AS (
  SELECT page_id, url, fetched_on, s.*,
    (SELECT min(d) FROM daily x WHERE x.list_name = s.list_name AND x.verdict = s.verdict AND x.kind = s.kind AND x.value = s.value AND x.is_on AND x.d <= s.d
       AND NOT EXISTS (SELECT 1 FROM daily y WHERE y.list_name = s.list_name AND y.verdict = s.verdict AND y.kind = s.kind AND y.value = s.value AND NOT y.is_on
                       AND y.d > x.d AND y.d < s.d)) AS since
  FROM seen JOIN spans s ON s.is_on AND fetched_on >= s.d AND (s.until IS NULL OR fetched_on < s.until)
   AND (s.kind = 'domain' AND (host = s.value OR ends_with(host, '.' || s.value))
     OR s.kind = 'prefix' AND path <> '' AND starts_with(host || '/' || path || '/', s.value || '/'))
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_on ORDER BY length(value) DESC, verdict = 'block' DESC, list_name, kind, value, since) rn,
    count(*) OVER (PARTITION BY page_id, url, fetched_on) n_rules FROM hits
)
SELECT s.page_id, s.url, s.host, CAST(s.fetched_on AS VARCHAR) AS fetched_on, s.n_captures, coalesce(b.verdict, 'allow') AS verdict, b.list_name, b.kind, b.value, CAST(b.since AS VARCHAR) AS since, coalesce(b.n_rules, 0) AS n_rules
FROM seen s LEFT JOIN best b ON b.rn = 1 AND b.page_id = s.page_id AND b.url = s.url AND b.fetched_on = s.fetched_on
"""
