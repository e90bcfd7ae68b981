"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a digest in the join key: 32 bits.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(host, path, action)`` as a table."""
    return spark.createDataFrame(rules, "host string, path string, action string")


def _digest(host: Column, folder: Column) -> Column:
    # a host holds no slash and a folder is empty or begins with one, so the text is unambiguous
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _folder(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def filter_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Judge each distinct URL of ``pages``: ``url, host, path, rule, verdict``.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest rule text wins, then the longest host, then
    ``block``, then the smaller path. Without a rule: ``rule`` null, ``default``.

    A URL becomes one expression per (host suffix, folder prefix); only shapes
    (labels in the host, slashes in the path) that some rule has are expanded,
    so a URL of a thousand folders stays small and no fit is lost. Expressions
    meet the rules by the first 32 bits of their SHA-256; the whole digest and
    the rule's path are then compared. URLs are judged once each, so a URL that
    fills the table costs a count, not a hot key.

    Null URL, or one without ``://``: host and path empty, and no rule fits.
    Rules with a null host or path never fit; repeated rules count once. An
    empty table of pages or of rules gives the empty result, or defaults only.
    """
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), "action"
    ).distinct()
    known = known.withColumn("_folder", _folder(F.col("rule_path")))
    known = known.select(
        "rule_host", "rule_path", "action",
        F.size(F.split("rule_host", r"\.")).alias("_labels"),
        (F.size(F.split("_folder", "/")) - 1).alias("_slashes"),
        _digest(F.col("rule_host"), F.col("_folder")).alias("_rule_digest"),
    )
    known = known.withColumn("_short", F.substring("_rule_digest", 1, PREFIX_DIGITS))
    # one row per shape: at most (labels of the longest rule host) x (slashes of the longest rule path)
    shapes = known.agg(F.collect_set(F.struct("_labels", "_slashes"))).scalar()

    urls = pages.select(F.col(url_col).alias("url")).distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    wide = urls.where(F.col("host") != "").select(
        "url", "path", F.split("host", r"\.").alias("_h"), F.split("path", "/").alias("_p"),
        F.explode(shapes).alias("_shape"),
    ).where(
        (F.col("_shape._labels") <= F.size("_h")) & (F.col("_shape._slashes") < F.size("_p"))
    )
    suffix = F.array_join(F.expr("slice(_h, size(_h) - _shape._labels + 1, _shape._labels)"), ".")
    folder = F.when(
        F.col("_shape._slashes") > 0,
        F.concat(F.array_join(F.expr("slice(_p, 1, _shape._slashes)"), "/"), F.lit("/")),
    ).otherwise(F.lit(""))
    expressions = wide.select("url", "path", _digest(suffix, folder).alias("_digest")).withColumn(
        "_short", F.substring("_digest", 1, PREFIX_DIGITS)
    )
    fits = expressions.join(known, "_short").where(
        (F.col("_digest") == F.col("_rule_digest")) & F.expr("startswith(path, rule_path)")
    )
    rank = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"),
        F.col("action"), F.col("rule_path").alias("p"), F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = fits.groupBy("url").agg(F.max(rank).alias("_best"))
    judged = urls.join(best.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
    return judged.select(
        "url", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
    )


def judge_pages(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: its id and the judgement of its URL (``filter_urls``).

    Repeated rows stay repeated; ids may be null; other columns are not read.
    """
    judged = filter_urls(pages, rules, url_col, default)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_page_url"))
    # null URLs never meet; what they get is fixed
    both = rows.join(judged, F.col("_page_url") == F.col("url"), "left")
    return both.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
