"""URL filter (DataFrame functions only): host suffixes x path prefixes.

Each distinct url is expanded into the expressions a rule could be written as
(every suffix of its host at a dot, every prefix of its path at a length some
rule's path has). The expressions meet the rules by an equi-join on the first
bytes of their SHA-256 digest; the full digest confirms, and of the rules that
fit, the longest decides.

Defined results: a url that is null or lacks ``://`` has an empty host and
path and is given the default verdict; repeated pages are judged alike, each
row for itself; of equal rules with different verdicts the blocking one wins;
without rules all pages get the default; no other column is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_BYTES = 4


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(url, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(url, _URL, 2)


def make_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows (rule, host, path, verdict) from pairs like ("net/", "block")."""
    rows = [(r, r[: r.index("/")] if "/" in r else r, r[r.index("/"):] if "/" in r else "", v) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(urls: DataFrame, lengths: Column) -> DataFrame:
    """One row per (host, path) and expression; ``lengths`` is an array of the
    path lengths that occur among the rules."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return (
        urls.select("host", "path", F.explode(suffixes).alias("_suffix"))
        .select("host", "path", "_suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("_n"))
        .select("host", "path", _digest(F.col("_suffix"), F.substring(F.col("path"), F.lit(1), F.col("_n"))).alias("_full"))
        .withColumn("_short", F.substring("_full", 1, 2 * PREFIX_BYTES))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` (its columns in the struct ``page``) with host, path, rule, verdict."""
    p = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{url_col}`").alias("_u"))
    p = p.select("page", F.coalesce(host_of(F.col("_u")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("_u")), F.lit("")).alias("path"))
    r = rules.select(
        "rule", "verdict", (F.length("host") + F.length("path")).alias("_len"), F.length("path").alias("_n"),
        _digest(F.lower("host"), F.col("path")).alias("_rule_full"),
    ).withColumn("_short", F.substring("_rule_full", 1, 2 * PREFIX_BYTES))
    # distinct path lengths: bounded by the longest path a rule has
    lengths = [x["_n"] for x in r.select("_n").distinct().collect()]
    known = F.array(*[F.lit(int(n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")
    hits = (
        expressions(p.where("host <> ''").select("host", "path").distinct(), known)
        .join(r.drop("_n"), "_short")
        .where("_full = _rule_full")
        .groupBy("host", "path")
        .agg(F.max(F.struct("_len", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("_b"), "rule", "verdict")).alias("_best"))
    )
    return p.join(hits, ["host", "path"], "left").select(
        "page", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
