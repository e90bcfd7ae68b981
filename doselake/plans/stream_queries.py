"""Streaming queries: the events file as a stream, run until it is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.plans.catalog import query, r
from doselake.plans.standins import Tables
from doselake.session import scratch_path
from doselake.streaming import metrics as R


def _events(t: Tables, files: int = 4) -> DataFrame:
    """The events in ``files`` files by their order, each a micro-batch of its own."""
    path, events = scratch_path(t.spark, "events"), t.raw("events")
    last = events.agg(F.max("event_id")).first()[0]
    for i in range(files):  # one after the other, as files arrive
        low, high = last * i // files, last * (i + 1) // files
        part = events.where((F.col("event_id") <= high) & ((F.col("event_id") > low) if i else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    source = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return source.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value"
    )


def drain(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over what has arrived, into files, and read the result."""
    spark = df.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    with R.rocks_state(spark):
        q = (
            df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
            .trigger(availableNow=True).start(out)
        )
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


FRAME = "OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(f"""
SELECT user_id AS run, event_type AS metric, event_id AS step, round(avg(value) {FRAME}, 6) AS mean,
  round(stddev_pop(value) {FRAME}, 5) AS std, min(value) {FRAME} AS min, max(value) {FRAME} AS max, value AS last FROM events""")
def stream_moving_stats(t: Tables) -> DataFrame:
    s = drain(R.stream_moving_stats(_events(t), ["run", "metric"], window=10, groups=R.GROUPS), "moving")
    return s.select("run", "metric", "step", r("mean"), r("std", 5), "min", "max", "last")


HUNDRED = "OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


# The tiny shift keeps both engines' last bits from deciding how a mean that lies half way is rounded.
@query(f"""
SELECT event_type AS metric, event_id AS step, round(avg(value) {HUNDRED} + 1e-9::DOUBLE, 6) AS mean, round(stddev_pop(value) {HUNDRED}, 4) AS std,
  min(value) {HUNDRED} AS min, max(value) {HUNDRED} AS max, value AS last FROM events""")
def stream_moving_stats_hundred(t: Tables) -> DataFrame:
    """The latest hundred values of each metric, over all runs."""
    s = drain(R.stream_moving_stats(_events(t).drop("run"), ["metric"], window=100), "moving")
    return s.select("metric", "step", r(F.col("mean") + 1e-9).alias("mean"), r("std", 4), "min", "max", "last")


@query("""
WITH RECURSIVE h AS (SELECT user_id AS run, event_type AS metric, event_id, value,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
f AS (
  SELECT run, metric, n, event_id AS step, value AS best, event_id AS best_step, 0 AS wait FROM h WHERE n = 1
  UNION ALL
  SELECT h.run, h.metric, h.n, h.event_id, CASE WHEN h.value < f.best - 1 THEN h.value ELSE f.best END,
    CASE WHEN h.value < f.best - 1 THEN h.event_id ELSE f.best_step END,
    CASE WHEN h.value < f.best - 1 THEN 0 ELSE f.wait + 1 END
  FROM f JOIN h ON h.run = f.run AND h.metric = f.metric AND h.n = f.n + 1 WHERE f.wait < 5)
SELECT run, metric, step AS stop_step, best_step, best AS best_value FROM f WHERE wait >= 5""")
def stream_early_stop(t: Tables) -> DataFrame:
    return drain(R.stream_early_stop(_events(t), ["run", "metric"], patience=5, min_delta=1.0, groups=R.GROUPS), "stop")
