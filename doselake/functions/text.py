"""Text scalars: run keys, numbers, names, nested metric records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.schema import nan_to_null

# Fixed value: composite run key `network_min_n_7_algorithm`.
RUN_KEY_PATTERN = r"^(\w+)_min_n_(\d+)_(\w+)$"


def to_numeric_or_null(col: Column) -> Column:
    """Number in a text, NULL for anything else."""
    return nan_to_null(F.trim(col).try_cast("double"))


def parse_threshold(df: DataFrame, column: str, out: str = "min_n") -> DataFrame:
    """``network_min_n_7`` to 7; rows without a number are dropped."""
    part = F.get(F.split(F.col(column), "_"), F.lit(3))
    return df.withColumn(out, to_numeric_or_null(part).cast("int")).where(F.col(out).isNotNull())


def parse_run_key(df: DataFrame, column: str) -> DataFrame:
    """Adds lower-cased ``network`` and ``algorithm`` and ``min_n``; others dropped."""
    def part(i: int) -> Column:
        return F.regexp_extract(F.col(column), RUN_KEY_PATTERN, i)

    return (
        df.where(F.col(column).rlike(RUN_KEY_PATTERN))
        .withColumn("network", F.lower(part(1)))
        .withColumn("min_n", part(2).try_cast("int"))
        .withColumn("algorithm", F.lower(part(3)))
    )


def flatten_metrics(df: DataFrame, keys: list[str], column: str, sep: str = "/") -> DataFrame:
    """Nested JSON metrics to rows ``(keys, metric, value)``; non-numbers dropped.

    Descends as deep as the data goes: the number of levels is that of the
    deepest record, read off its brackets in one scan before the plan is built.
    """
    record = "map<string,string>"
    inside = F.regexp_replace(column, r'"(?:[^"\\\\]|\\\\.)*"', "")  # brackets in strings do not count
    walked = F.aggregate(
        F.split(F.regexp_replace(inside, "[^{}]", ""), ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            (s["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("at"),
            F.greatest(s["most"], s["at"] + F.when(c == "{", 1).otherwise(0)).alias("most"),
        ),
        lambda s: s["most"],
    )
    depth = df.agg(F.max(walked)).first()[0] or 1
    level = df.select(*keys, F.explode(F.from_json(column, record)).alias("metric", "_v"))
    for _ in range(depth - 1):
        inner = F.when(F.col("_v").startswith("{"), F.from_json("_v", record))
        nested = F.transform(
            F.map_entries(inner),
            lambda e: F.struct(
                F.concat(F.col("metric"), F.lit(sep), e["key"]).alias("metric"), e["value"].alias("_v")
            ),
        )
        same = F.array(F.struct(F.col("metric"), F.col("_v")))
        level = level.select(*keys, F.inline(F.coalesce(nested, same)))
    return level.select(*keys, "metric", to_numeric_or_null(F.col("_v")).alias("value")).where(
        F.col("value").isNotNull()
    )


def safe_name(col: Column) -> Column:
    """Every character that is not a letter or digit becomes ``_``."""
    return F.regexp_replace(col, r"[^\p{L}\p{N}]", "_")


def decode_text(col: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 are left out."""
    return F.replace(F.make_valid_utf8(col.cast("string")), F.lit("�"), F.lit(""))
