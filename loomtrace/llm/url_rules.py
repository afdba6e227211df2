"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # hexadecimal digits of a digest that the join compares
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first `://` up to `/ ? #`, and from there up to `? #`; empty without `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict of every page; rules(host, path, action).

    A rule fits its host and all subdomains when the page's path starts with the rule's path. The longest fitting rule
    wins (of two equally long ones, that with the longer host); of two rules that differ in the action only, `block`
    stands. Pages without a fitting rule get `default`. Work is done once per distinct url. Pages keep their number:
    repeated rows are judged alike, a null url counts as empty, null rules are ignored, and no rules at all mean
    `default` everywhere. Of other columns only page_id is returned.

    What the driver learns of the rules is their number of host labels and the set of path lengths, which are bounded by
    the longest legal url.
    """
    clean = rules.select("host", "path", "action").dropna()
    clean = clean.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
    shape = clean.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    expression = F.concat("host", "path")
    book = clean.groupBy(F.sha2(expression, 256).alias("digest"), expression.alias("rule")).agg(
        F.max("action").alias("action"), F.max(F.length("host")).alias("host_length")
    )
    book = book.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))

    source = pages.select(F.col("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    urls = source.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"] or 1))), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]) if shape["lengths"] else F.array(F.lit(0))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    looks = urls.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    looks = looks.select("url", "suffix", F.explode("prefixes").alias("prefix"))
    looks = looks.select("url", F.sha2(F.concat("suffix", "prefix"), 256).alias("seen"))
    looks = looks.withColumn("short", F.substring("seen", 1, PREFIX_DIGITS))
    fits = looks.join(book, "short").filter(F.col("seen") == F.col("digest"))
    best = fits.groupBy("url").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("host_length"), F.col("rule"), F.col("action"))).alias("best")
    )
    judged = source.join(best, "url", "left")
    host, path = url_parts(F.col("url"))
    return judged.select(
        "page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
