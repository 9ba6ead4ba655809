"""URL filter: host-suffix x path-prefix expressions, short-hash equi-join, full-digest confirmation.

DataFrame functions only. A rule (host, path, verdict) fits its host and all its subdomains if the url's
path starts with the rule's path. The longest rule wins (host plus path); equal lengths go to the longer
host, then to block. Urls without a fitting rule get the default verdict.

Rows are expanded and brought together again by a number of their own, so neither null urls nor a url that many
rows share meet in one task; a row's expressions collapse before they are shuffled.

Defined cases: a null url, or one without "://", has host and path "" and the default verdict; repeated
rows each get their row; an empty table gives an empty one; a rule with a null part never fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join uses; the whole digest confirms.
SHORT = 8
RULES = "verdict string, host string, path string"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every host suffix of the given label counts joined to every path prefix of the given lengths."""
    parts = F.split(host, "\\.", -1)
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    suffixes = F.transform(F.filter(ints(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(ints(lengths), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df's rows with _host, _path, the winning rule's text _rule (or null) and the _verdict (named anew if df has such columns).

    Only the rules' distinct label counts and path lengths come to the driver; both are bounded by the
    longest host and path of a rule, not by the number of rules or urls.
    """
    rules = rules.where("verdict is not null and host is not null and path is not null").select(
        "verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")
    )
    shape = rules.agg(F.collect_set(F.size(F.split("r_host", "\\.", -1))).alias("n"), F.collect_set(F.length("r_path")).alias("l"), F.count("*").alias("c")).first()
    table = rules.select(
        F.sha2(F.concat("r_host", "r_path"), 256).alias("r_digest"),
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("verdict") == "block").alias("block"),
            F.concat("r_host", "r_path").alias("rule"), F.col("verdict"),
        ).alias("fit"),
    ).withColumn("short", F.substring("r_digest", 1, SHORT))
    if shape["c"] <= BROADCAST_ROWS:
        table = F.broadcast(table)
    own = F.col(f"own.`{url}`").cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"))
    rows = rows.withColumn("host", host_of(own)).withColumn("path", path_of(own))
    wide = rows.select("row", "own", "host", "path", F.explode_outer(expressions(F.col("host"), F.col("path"), sorted(shape["n"]), sorted(shape["l"]))).alias("expression"))
    keyed = wide.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    met = keyed.join(table, "short", "left").withColumn("fit", F.when(F.col("digest") == F.col("r_digest"), F.col("fit")))
    best = met.groupBy("row", "own", "host", "path").agg(F.max("fit").alias("fit"))
    told = {"_host": F.col("host"), "_path": F.col("path"), "_rule": F.col("fit.rule"), "_verdict": F.coalesce("fit.verdict", F.lit(default))}
    return best.select("own.*", *(c.alias(fresh(n, df.columns)) for n, c in told.items()))


def filter_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of df: key, host, path, rule, verdict."""
    out = judge(df.select(F.col(key).alias("key"), F.col(url).alias("url")), rules, "url", default)
    return out.select(F.col("key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
