"""Exact ranks and cut points that never sort a whole key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doselake.session import cut_lineage

HASH_PREFIX = 4  # hex digits, so 65,536 buckets of equal expected size


def seeded_hash(seed: int | str | Column, key: str | Column) -> Column:
    """``md5(seed:key)`` as hex text: uniform, portable, and order-independent; a null key counts as empty."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), text).cast("binary"))


def blocked_row_number(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, out: str = "rn"
) -> DataFrame:
    """Exact ``row_number`` per key, one task per (key, block) instead of per key.

    ``block`` must rise with ``order``: all rows of a block precede those of the
    next. Block counts are a small table, and their running sum is the offset.
    """
    rows = df.withColumn("_blk", block)
    counts = rows.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_blk").orderBy(*order)
    local = rows.withColumn("_rn", F.row_number().over(within))
    o = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       F.col("_blk").alias("_kb"), "_off")
    cond = F.col("_blk").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(o, cond, "inner")
    return joined.withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop(
        "_blk", "_rn", "_off", "_kb", *[f"_k{i}" for i in range(len(keys))]
    )


def global_row_number(df: DataFrame, order: list[str], out: str = "rn", desc: set[str] = frozenset()) -> DataFrame:
    """Exact ``row_number`` over the whole table by a range-partitioned sort.

    The sorted table is checkpointed, so the per-partition counts and the rows
    come from the same partitions even when a task is run again.
    """
    cols = [F.col(c).desc_nulls_last() if c in desc else F.col(c).asc_nulls_first() for c in order]
    ordered = cut_lineage(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id keeps the partition in the bits above 33
    ordered = ordered.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per partition of the sort: bounded by the partition count
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_off") + F.col("_row") + 1).cast("bigint"))
        .drop("_mid", "_part", "_row", "_off")
    )


def hash_cuts(
    df: DataFrame,
    hash_col: str,
    targets: Callable[[Column], list[Column]],
    strata: list[str] | None = None,
    few: bool = False,
) -> DataFrame:
    """Hash values at given ranks: one row per stratum, maps ``cuts``, ``takes``, ``shared``.

    ``targets(n)`` gives the wanted ranks for a stratum of ``n`` rows. Of the
    ``shared`` rows with the hash of a cut, ``takes`` are within its rank. Pass
    one counts rows per hash prefix; pass two sorts only the distinct values of
    the buckets that hold a wanted rank, each about 1/65,536 of its stratum.
    ``few`` strata, whose number the caller bounds, are sent to all tasks.
    """
    strata = strata or []
    rows = df.select(*strata, F.col(hash_col).alias("_h")).withColumn(
        "_pre", F.substring("_h", 1, HASH_PREFIX)
    )
    hist = rows.groupBy(*strata, "_pre").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*strata).orderBy("_pre")
    whole = Window.partitionBy(*strata)
    hist = hist.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(whole))
    wanted = (
        hist.select(
            *strata, "_pre", "_c", "_cum",
            F.posexplode(F.array(*[t.cast("bigint") for t in targets(F.col("_n"))])).alias("_i", "_t"),
        )
        .where((F.col("_t") > F.col("_cum") - F.col("_c")) & (F.col("_t") <= F.col("_cum")))
        .select(*strata, "_pre", "_i", (F.col("_t") - F.col("_cum") + F.col("_c")).alias("_k"))
    )
    w = wanted.select(
        *[F.col(s).alias(f"_s{j}") for j, s in enumerate(strata)], F.col("_pre").alias("_wp"), "_i", "_k"
    )
    # one row per wanted rank and stratum: bounded by construction without strata
    w = w if strata and not few else F.broadcast(w)
    cond = F.col("_pre") == F.col("_wp")
    for j, s in enumerate(strata):
        cond = cond & F.col(s).eqNullSafe(F.col(f"_s{j}"))
    # equal values are counted before they meet, so a hot key is one row here
    inside = rows.join(w, cond, "inner").groupBy(*strata, "_pre", "_i", "_k", "_h").agg(
        F.count(F.lit(1)).alias("_c")
    )
    nth = Window.partitionBy(*strata, "_pre", "_i", "_k").orderBy("_h")
    take = F.col("_k") - F.col("_cum") + F.col("_c")
    found = inside.withColumn("_cum", F.sum("_c").over(nth)).where((take >= 1) & (take <= F.col("_c")))
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct(F.col("_i"), v)))
    return found.groupBy(*strata).agg(
        entries(F.col("_h")).alias("cuts"), entries(take).alias("takes"), entries(F.col("_c")).alias("shared")
    )


def beyond_cuts(
    df: DataFrame,
    hash_col: str,
    targets: Callable[[Column], list[Column]],
    strata: list[str] | None = None,
    out: str = "beyond",
    few: bool = False,
) -> DataFrame:
    """Adds how many of the wanted ranks a row lies beyond, in the order of ``hash_col``.

    Each rank is met exactly. Rows are compared with the cut values where they
    lie; only rows that share a value which a cut divides are numbered, in the
    order of their columns. Fully equal rows are interchangeable.
    """
    strata = strata or []
    cuts = cut_lineage(hash_cuts(df, hash_col, targets, strata, few))
    at = cuts.select(*[F.col(s).alias(f"_s{j}") for j, s in enumerate(strata)], F.struct("cuts", "takes", "shared").alias("_at"))
    if strata:
        same = F.lit(True)
        for j, s in enumerate(strata):
            same = same & F.col(s).eqNullSafe(F.col(f"_s{j}"))
        rows = df.join(F.broadcast(at) if few else at, same, "left").select(*df.columns, "_at")
    else:
        rows = df.withColumn("_at", at.scalar())

    h = F.col(hash_col)
    spots = range(len(targets(F.lit(1))))
    of = lambda name, i: F.try_element_at(F.col(f"_at.{name}"), F.lit(i))

    def count_beyond(number: Column) -> Column:
        each = [
            F.when((h < of("cuts", i)) | ((h == of("cuts", i)) & (number <= of("takes", i))), 0).otherwise(1)
            for i in spots
        ]
        return sum(each[1:], each[0])

    divided = F.exists(F.map_keys("takes"), lambda i: F.element_at("takes", i) < F.element_at("shared", i))
    if cuts.where(divided).isEmpty():
        return rows.withColumn(out, count_beyond(F.lit(0))).drop("_at")
    split = F.lit(False)
    for i in spots:
        split = split | F.coalesce((h == of("cuts", i)) & (of("takes", i) < of("shared", i)), F.lit(False))
    whole = rows.where(~split).withColumn(out, count_beyond(F.lit(0)))
    sortable = [
        f.name for f in df.schema if f.name not in (hash_col, *strata)
        and not any(t in f.dataType.simpleString() for t in ("map<", "variant", "void"))
    ]
    tied = rows.where(split).withColumn("_mid0", F.monotonically_increasing_id())
    tied = global_row_number(tied, [*strata, hash_col, *sortable, "_mid0"], "_no")
    first = tied.groupBy(*strata, hash_col).agg(F.min("_no").alias("_first")).select(
        *[F.col(s).alias(f"_s{j}") for j, s in enumerate(strata)], F.col(hash_col).alias("_h0"), "_first"
    )
    same = h == F.col("_h0")
    for j, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{j}"))
    # one row per divided value
    numbered = tied.join(first if strata else F.broadcast(first), same)
    numbered = numbered.withColumn(out, count_beyond(F.col("_no") - F.col("_first") + 1))
    return whole.drop("_at").unionByName(numbered.select(*df.columns, out))
