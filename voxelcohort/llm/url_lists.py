"""URL filters as a temporal join: dated list entries become validity intervals, and every capture is judged by the
entries that were active on the day it was fetched.

Entries: (list_name, verdict "block" or "allow", kind "domain" or "prefix", value, action "add" or "remove", day).
A domain entry covers the host and its subdomains, a prefix entry covers host plus path on whole path segments. The
most specific active rule decides (longest value, then block before allow, then list name); without one the verdict
is "allow". Only DataFrame functions are used.

Defined results: of entries of one rule on one day "add" wins; entries with a null in any column are ignored; captures
without a readable host, or with a null url or day, match no rule and are kept; repeated captures are one row with their
number in ``n_captures``; empty tables give empty results or verdicts without rules; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Captures of one rule are spread over this many join keys a month, so that no single host fills a task.
SALTS = 16
ENTRY = ("list_name", "verdict", "kind", "value", "action", "day")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """(list_name, verdict, kind, value, since, until): maximal intervals, ``until`` exclusive and null while open.

    A rule has one state a day, so the ordered window over a rule holds at most one row a day.
    """
    rule = ["list_name", "verdict", "kind", "value"]
    daily = (
        entries.select(*ENTRY).dropna().groupBy(*rule, "day").agg(F.max(F.col("action") == "add").alias("on"))
    )
    order = Window.partitionBy(*rule).orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter(F.col("on") != F.col("was"))
    return (
        changes.withColumn("until", F.lead("day").over(order)).filter("on")
        .select(*rule, F.col("day").alias("since"), "until")
    )


def candidate_rules(host: Column, path: Column) -> Column:
    """Every (kind, value) that could cover the address: the host and its parents, the host with each leading path."""
    labels, steps = F.split(host, r"\."), F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(F.length(host) > 0, F.concat(domains, F.when(F.length(path) > 1, prefixes).otherwise(none)))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetched_on", salts: int = SALTS) -> DataFrame:
    """(key, url, host, day, n_captures, verdict, list_name, kind, value, since, n_rules) for every distinct capture."""
    month = lambda d: (F.year(d) * 12 + F.month(d)).cast("int")
    seen = (
        captures.select(F.col(key), F.col(url), F.col(day).cast("date").alias(day)).groupBy(key, url, day).agg(F.count("*").alias("n_captures"))
        .withColumn("host", host_of(F.col(url)))
    )
    asked = (
        seen.withColumn("rule", F.explode_outer(candidate_rules(F.col("host"), path_of(F.col(url)))))
        .select(key, url, day, "host", "n_captures", F.col("rule.kind").alias("_kind"), F.col("rule.value").alias("_value"), month(F.col(day)).alias("_month"),
                F.pmod(F.xxhash64(key, url), F.lit(salts)).alias("_salt"))
    )
    # open intervals end with the last capture, so that each rule is repeated only for the months that can be asked
    last = captures.agg(F.max(F.col(day).cast("date")).alias("last"))
    rules = (
        validity(entries).join(F.broadcast(last), F.col("since") <= F.col("last"))  # one row
        .withColumn("_month", F.explode(F.sequence(month(F.col("since")), month(F.least(F.coalesce("until", "last"), F.col("last"))))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("last")
    )
    active = (
        (asked["_kind"] == rules["kind"]) & (asked["_value"] == rules["value"]) & (asked["_month"] == rules["_month"]) & (asked["_salt"] == rules["_salt"])
        & (asked[day] >= rules["since"]) & (rules["until"].isNull() | (asked[day] < rules["until"]))
    )
    matched = asked.join(rules, active, "left").select(
        asked[key], asked[url], asked[day], asked["host"], asked["n_captures"],
        F.when(rules["value"].isNotNull(), F.struct(
            (-F.length(rules["value"])).alias("size"), (rules["verdict"] != "block").alias("soft"), rules["list_name"], rules["kind"], rules["value"], rules["since"],
            rules["verdict"])).alias("rule"))
    best = matched.groupBy(key, url, day, "host", "n_captures").agg(F.min("rule").alias("rule"), F.count("rule").alias("n_rules"))
    return best.select(
        key, url, "host", day, "n_captures", F.coalesce("rule.verdict", F.lit("allow")).alias("verdict"), F.col("rule.list_name").alias("list_name"),
        F.col("rule.kind").alias("kind"), F.col("rule.value").alias("value"), F.col("rule.since").alias("since"), "n_rules")
