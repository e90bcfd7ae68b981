"""Metric histories: windows, records, stopping rules, top-k.

A history may hold one metric with most of the rows. Ordered work is done in
blocks of consecutive rows; block totals, a small table, carry what precedes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doselake.functions.orbits import next_lower, orbit
from doselake.functions.ranking import blocked_row_number, global_row_number
from doselake.session import cut_lineage

BLOCK = 1 << 18


def ordinals(df: DataFrame, keys: list[str], step: str = "step", block: int = BLOCK) -> DataFrame:
    """Adds ``rn``, the 1-based position of a row in its key's steps."""
    return blocked_row_number(df, keys, [F.col(step)], F.floor(F.col(step) / block), "rn")


COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column]], block: int = BLOCK,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``min``/``max`` in ``rn`` order, in blocks of ``block`` rows.

    ``exclusive`` leaves the current row out.
    """
    rows = df.withColumn("_blk", F.floor((F.col("rn") - 1) / block))
    totals = rows.groupBy(*keys, "_blk").agg(*[
        COMBINE[fn][0](e).alias(f"_p_{out}") for out, (fn, e) in aggs.items()
    ])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_kb"),
        *[COMBINE[fn][0](f"_p_{out}").over(before).alias(f"_p_{out}") for out, (fn, _) in aggs.items()],
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy("rn").rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    local = rows.select("*", *[
        COMBINE[fn][0](e).over(inside).alias(f"_i_{out}") for out, (fn, e) in aggs.items()
    ])
    cond = F.col("_blk") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, cond)
    return joined.select(*df.columns, *[
        COMBINE[fn][1](F.col(f"_p_{out}"), F.col(f"_i_{out}")).alias(out) for out, (fn, _) in aggs.items()
    ])


def moving_stats(
    df: DataFrame, keys: list[str], step: str = "step", value: str = "value", window: int = 100,
    block: int = BLOCK,
) -> DataFrame:
    """Mean, population std, min, max and last of the latest ``window`` values.

    Each block also receives the ``window - 1`` rows before it, so the frame is
    complete although no task sees a whole key.
    """
    if block < window:
        raise ValueError("block must not be smaller than window")
    rows = ordinals(df.select(*keys, step, value), keys, step, block)
    own = F.floor((F.col("rn") - 1) / block)
    follows = (F.pmod(F.col("rn") - 1, F.lit(block)) >= block - (window - 1))
    blocks = F.when(follows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    w = Window.partitionBy(*keys, "_blk").orderBy("rn").rowsBetween(-(window - 1), 0)
    return spread.select(
        "*", F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("std"),
        F.min(value).over(w).alias("min"), F.max(value).over(w).alias("max"),
        F.col(value).alias("last"),
    ).where(F.col("_blk") == F.col("_own")).drop("_blk", "_own", "rn")


def trend_corr(
    df: DataFrame, keys: list[str], step: str = "step", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Pearson of (step, value) over all points so far, from the third on."""
    # read three times below, hence numbered once
    rows = cut_lineage(ordinals(df.select(*keys, step, value), keys, step, block))
    mean = rows.groupBy(*keys).agg(F.avg(step).alias("_ms"), F.avg(value).alias("_mv"))
    # sums around the key's mean keep their digits
    x, y = F.col(step) - F.col("_ms"), F.col(value) - F.col("_mv")
    sums = running(rows.join(mean, keys), keys, {
        "_n": ("sum", F.lit(1.0)), "_x": ("sum", x), "_y": ("sum", y),
        "_xx": ("sum", x * x), "_yy": ("sum", y * y), "_xy": ("sum", x * y),
    }, block)
    n = F.col("_n")
    vx = F.greatest(F.col("_xx") - F.col("_x") * F.col("_x") / n, F.lit(0.0))
    vy = F.greatest(F.col("_yy") - F.col("_y") * F.col("_y") / n, F.lit(0.0))
    flat = F.lit(1e-12)
    r = F.when(
        (n >= 3) & (vy > flat * F.col("_yy")),
        F.try_divide(F.col("_xy") - F.col("_x") * F.col("_y") / n, F.sqrt(vx) * F.sqrt(vy)),
    )
    return sums.withColumn("pearson", r).select(*keys, step, value, "pearson")


def metric_history(df: DataFrame, metric: str, keys: list[str], name: str = "metric",
                   step: str = "step", value: str = "value") -> DataFrame:
    """The series of one metric per key as ordered rows ``(keys, rn, step, value)``."""
    one = df.where(F.col(name) == metric).select(*keys, step, value)
    return ordinals(one, keys, step)


def margin_records(records: DataFrame, keys: list[str], min_delta: float) -> DataFrame:
    """Of the record lows ``keys, rn, _v``, those that improve by more than ``min_delta`` on the last that did: ``keys, rn``.

    Each low points to the first later one beyond the margin; the chain that
    begins with a key's first low is what counts. Sorted by ranges, so a key of
    very many lows is worked on by many tasks.
    """
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("rn")]
    numbered = cut_lineage(
        records.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    )
    first = numbered.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("id").alias("kid"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = cut_lineage(numbered.join(first, same).select("kid", "id", F.col("_v").alias("v"), *keys, "rn"))
    kept = orbit(next_lower(rows.select("kid", "id", "v"), min_delta, tasks), rows.select(F.col("kid").alias("id")).distinct())
    return rows.join(kept, "id").select(*keys, "rn")


def improvements(
    df: DataFrame, keys: list[str], value: str, mode: str, min_delta: float, block: int = BLOCK
) -> DataFrame:
    """Rows (with ``rn``) plus ``_v`` (to be lowered) and the flag ``_better``.

    A row can improve on the best only if it is below every earlier value. With
    ``min_delta = 0`` that is the whole rule. Otherwise the best depends on the
    path, which is followed over those record lows alone.
    """
    sign = {"min": 1.0, "max": -1.0}.get(mode)
    if sign is None:
        raise ValueError(f"mode must be 'min' or 'max', not {mode}")
    v = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(F.col(value) * F.lit(sign))
    rows = df.withColumn("_v", v)
    low = running(rows, keys, {"_low": ("min", F.col("_v"))}, block, exclusive=True)
    record = (F.col("_v") < F.col("_low")) | (F.col("_low").isNull() & (F.col("_v") < float("inf")))
    flagged = low.withColumn("_better", record).drop("_low")
    if min_delta == 0:
        return flagged
    records = flagged.where("_better").select(*keys, "rn", "_v")
    kept = margin_records(records, keys, min_delta).withColumn("_kept", F.lit(True))
    return flagged.drop("_better").join(kept, [*keys, "rn"], "left").withColumn(
        "_better", F.coalesce("_kept", F.lit(False))
    ).drop("_kept")


def early_stop(
    df: DataFrame, keys: list[str], step: str = "step", value: str = "value", patience: int = 5,
    min_delta: float = 0.0, mode: str = "min", block: int = BLOCK,
) -> DataFrame:
    """Stopping step per key (NULL: never), best value and its step until then."""
    present = df.select(*keys, step, value).where(F.col(value).isNotNull())
    # each pass below reads its input twice, hence both are stored once
    rows = cut_lineage(ordinals(present, keys, step, block))
    flagged = cut_lineage(improvements(rows, keys, value, mode, min_delta, block))
    latest = F.when(F.col("_better"), F.struct("rn", F.col(step).alias("step"), F.col(value).alias("value")))
    seen = running(flagged, keys, {"_last": ("max", latest)}, block)
    late = F.col("rn") - F.coalesce(F.col("_last.rn"), F.lit(0)) >= patience
    return seen.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(step).alias("step"), "_last"), F.when(late, F.col("rn"))).alias("_stop"),
        F.max("_last").alias("_end"), F.count(F.lit(1)).alias("n_events"),
    ).withColumn(
        "_best", F.when(F.col("_stop").isNotNull(), F.col("_stop._last")).otherwise(F.col("_end"))
    ).select(
        *keys, F.col("_stop.step").alias("stop_step"), F.col("_best.step").alias("best_step"),
        F.col("_best.value").alias("best_value"), "n_events",
    )


def best_and_last(
    df: DataFrame, keys: list[str], step: str = "step", value: str = "value", mode: str = "min"
) -> DataFrame:
    """Best and last record per key, the earlier step winning ties."""
    sign = 1.0 if mode == "min" else -1.0
    x = F.col(value)
    order = F.struct((x * sign).alias("v"), F.col(step).alias("s"))
    return df.where(x.isNotNull()).groupBy(*keys).agg(
        F.min(order).alias("_b"), F.max(F.struct(F.col(step).alias("s"), x.alias("v"))).alias("_l")
    ).select(
        *keys, F.col("_b.s").alias("best_step"), (F.col("_b.v") * sign).alias("best_value"),
        F.col("_l.s").alias("last_step"), F.col("_l.v").alias("last_value"),
    )


def keep_top_k(
    df: DataFrame, keys: list[str], k: int, step: str = "step", value: str = "value", mode: str = "min"
) -> DataFrame:
    """The k best records per key; each map task passes on at most k of them."""
    x = F.col(value).asc_nulls_last() if mode == "min" else F.col(value).desc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(x, F.col(step))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_features(scores: DataFrame, k: int, feature: str = "feature", score: str = "score") -> DataFrame:
    """The k features of largest absolute score."""
    return scores.orderBy(F.abs(score).desc(), F.col(feature)).limit(k)


def rank_groups(metrics: DataFrame, group: str, metric: str, descending: bool = True) -> DataFrame:
    """Groups with their rank by a metric."""
    desc = {metric} if descending else set()
    return global_row_number(metrics.select(group, metric), [metric, group], "rank", desc)


def best_per_column(df: DataFrame, label: str, higher: list[str], lower: list[str]) -> DataFrame:
    """Per metric column the label of its best row and the value."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"),
                      F.lit(1.0 if c in lower else -1.0).alias("sign")) for c in [*higher, *lower]]
    long = df.select(F.col(label).alias("label"), F.inline(F.array(*cells))).where("value IS NOT NULL")
    best = F.min(F.struct((F.col("value") * F.col("sign")).alias("v"), F.col("label")))
    return long.groupBy("metric", "sign").agg(best.alias("_b")).select(
        "metric", F.col("_b.label").alias("best_label"),
        (F.col("_b.v") * F.col("sign")).alias("best_value"),
    )


def sort_within_group(df: DataFrame, group: str, by: str) -> DataFrame:
    """Rows range-partitioned and sorted by group and threshold."""
    return df.orderBy(group, by)


def limit_ensemble(predictions: DataFrame, member: str = "member", n: int = 5) -> DataFrame:
    """Predictions of the first ``n`` ensemble members."""
    first = predictions.select(member).distinct().orderBy(member).limit(n)
    return predictions.join(first, member, "left_semi")
