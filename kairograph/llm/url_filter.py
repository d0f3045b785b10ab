"""Operator 7: URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions ``<host suffix><path prefix>`` whose
shape (number of host labels, length of path) occurs among the rules, so the
expansion is linear in the URL and the shapes collected to the driver are
bounded by (labels x path lengths), not by rules or pages.  Expressions meet
the rules in an equi-join on a short hash prefix; the full digest confirms the
match and the longest rule wins.

Defined results: a null url, or one without ``://``, has empty host and path;
rows keep their multiplicity; a url of any length is expanded whole; an empty table gives an empty result; columns of
the input other than the id and the url are not read, so they cannot clash.
Rules of equal length: the smallest rule string wins, ``allow`` before ``block``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

PREFIX_HEX = 8
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def split_url(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col),
        ascii_lower(F.regexp_extract(url, _URL, 1)).alias("host"),
        F.regexp_extract(url, _URL, 2).alias("path"),
    )


def hashed_rules(rules: DataFrame) -> DataFrame:
    """``rules`` has host, path, verdict.  Adds the rule string, its digest and the short prefix."""
    rule = F.concat(ascii_lower(F.col("host")), F.col("path"))
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(
            rule.alias("rule"),
            F.col("verdict"),
            (F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1).alias("labels"),
            F.length("path").alias("path_len"),
            F.sha2(rule, 256).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict."""
    ruled = hashed_rules(rules)
    shapes = [(r.labels, r.path_len) for r in ruled.select("labels", "path_len").distinct().collect()]
    parts = split_url(pages, id_col, url_col)
    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    found = [
        F.when(
            (n_labels >= k) & (F.length("path") >= n),
            F.concat(F.substring_index("host", ".", -k), F.substring(F.col("path"), 1, n)),
        )
        for k, n in sorted(shapes)
    ]
    expressions = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    best = (
        parts.select("host", "path")
        .distinct()
        .withColumn("expression", F.explode(expressions))
        .withColumn("full", F.sha2("expression", 256))
        .join(ruled, F.substring("full", 1, PREFIX_HEX) == F.col("prefix"))
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("o"), "rule", "verdict")).alias("best"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
