"""Mixing sources to target weights by Pfair scheduling of documents."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doselake.llm.common import stored


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole blocks of each source in one period: largest remainders, one at least.

    A period too short for one block of each source is doubled until it is not.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    names = sorted(n for n, w in weights.items() if w > 0)
    while period < 2 * len(names):
        period *= 2
    total = sum(weights[n] for n in names)
    exact = {n: weights[n] / total * period for n in names}
    units = {n: max(1, int(exact[n])) for n in names}
    left = period - sum(units.values())
    by_rest = sorted(names, key=lambda n: (int(exact[n]) - exact[n], n))
    while left:  # few rounds: each gives or takes at most one block a source
        for n in by_rest if left > 0 else sorted(names, key=lambda n: (-units[n], n)):
            if left == 0:
                break
            if left > 0 or units[n] > 1:
                units[n] += 1 if left > 0 else -1
                left -= 1 if left > 0 else -1
    return units


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportions; sources of weight 0 are left out."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    exact = {n: Fraction(w) for n, w in weights.items() if w > 0}
    scale = math.lcm(*[w.denominator for w in exact.values()])
    return {n: int(w * scale) for n, w in exact.items()}


def schedule(weights: dict[str, int], counts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, block, slot, release, deadline)``, earliest deadline first, until each source has its count of blocks.

    With ``w`` the share of a source in all weights, its block ``j`` is released
    at ``floor(j / w)`` and due at ``ceil((j + 1) / w)``, in exact whole numbers.
    The shares add to one, so each slot takes the released block that is due
    first (then by source), none is ever late, and after any number of slots a
    source is less than one block off its share. Holds one block a source.
    """
    names, total = sorted(weights), sum(weights.values())
    ahead: dict[int, list[int]] = {0: list(range(len(names)))}
    at, per = [0] * len(names), [weights[n] for n in names]
    need = [counts[n] for n in names]
    left = sum(n > 0 for n in need)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while left:
        for i in ahead.pop(slot, ()):
            heapq.heappush(ready, (-(-(at[i] + 1) * total // per[i]), i, slot))
        due, i, release = heapq.heappop(ready)
        j = at[i]
        yield names[i], j, slot, release, due
        at[i] = j + 1
        left -= j + 1 == need[i]
        release = (j + 1) * total // per[i]
        if release <= slot:  # may be released while the last one runs
            heapq.heappush(ready, (-(-(j + 2) * total // per[i]), i, release))
        else:
            ahead.setdefault(release, []).append(i)
        slot += 1


def period_schedule(units: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """``(source, block, slot, release, deadline)`` of one period."""
    return list(schedule(units, units))


SLOTS = "_source string, _j bigint, _epoch bigint, _slot bigint, _release bigint, _due bigint"
#: Slots a batch of the schedule holds.
BATCH = 50_000


def slot_table(weights: DataFrame, period: int | None = None) -> DataFrame:
    """The schedule of ``weights (source, weight, n)`` until each source has placed its ``n`` documents.

    A row per position: source, document number, epoch, slot, release and
    deadline. Each choice depends on all before it, so one task makes the
    rows; it holds one block a source and ``BATCH`` rows.
    """
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SLOTS.split(", ")])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [r for b in batches for r in b.to_pylist()]
        target = {r["source"]: r["weight"] for r in given}
        units = whole(target) if period is None else shares(target, period)
        n = {r["source"]: r["n"] for r in given}
        rows = schedule(units, n)
        while part := list(islice(rows, BATCH)):
            source, block, *times = zip(*part, strict=True)
            size = np.array([n[s] for s in source], np.int64)
            block = np.array(block, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(source, pa.string()), *[pa.array(x, pa.int64()) for x in (block % size, block // size, *times)]],
                schema=schema,
            )

    return weights.select("source", F.col("weight").cast("double"), "n").where("weight != 0").coalesce(1).mapInArrow(make, SLOTS)


def tempered(docs: DataFrame, power: float = 0.8, source_col: str = "source") -> DataFrame:
    """Target weights ``(source, weight)``: rows of each source, to the power, so small sources count for more."""
    counts = docs.groupBy(source_key(F.col(source_col)).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.pow("n", F.lit(power)).alias("weight"))


def source_key(source):  # a null source is a source of its own
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source.cast("string")))


def mix(
    docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17,
    period: int | None = None, keep: tuple[str, ...] | None = None, placed: bool = True,
) -> DataFrame:
    """Interleave the documents of all sources at the given weights; a block is one document.

    Columns of ``keep`` (default: id and source), then ``mix_position`` (from 0),
    ``mix_epoch`` (0 at the first use), ``mix_release`` and ``mix_deadline``, both in
    positions; without ``placed`` the columns of ``keep`` alone, whatever their
    names. Each source goes through its documents in a seeded order and
    begins again when it ends, until every source has ended once: no document is
    left out, and over any first n positions a source is less than one document
    off its weight. Equal rows are documents of their own. Only if ``period`` is
    given, the weights are first rounded to ``shares`` of so many positions.

    ``weights`` has ``source`` keys as ``source_key`` gives them. Sources with
    no weight, or weight 0, are left out: that is what the weight says; a source
    without documents can take no position, so the others share it. A null
    source is a source of its own; null ids and texts are kept; an empty table
    gives an empty result.

    A source's rows are dealt to as many hash bins as the root of the largest
    source, numbered inside each bin, and moved on by the counts of the bins
    before; their positions then meet them by source and number. So the rows are
    shuffled twice, and no source is in one task. The schedule is stored once.
    """
    keep = keep or (id_col, source_col)
    # fixed while the plan is built: one number
    most = docs.groupBy(source_col).count().agg(F.max("count")).first()[0] or 1
    bins = max(1, int(most ** 0.5))
    place = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), source_key(F.col(source_col)).alias("_source"),
        place.alias("_hash"),
    ).withColumn("_bin", F.pmod("_hash", F.lit(bins)))
    counts = docs.select(
        source_key(F.col(source_col)).alias("_s"), F.pmod(place, F.lit(bins)).alias("_b")
    ).groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_s")
    counts = counts.select(
        F.col("_s").alias("_source"), F.col("_b").alias("_bin"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(every).alias("_n"),
    )
    inside = Window.partitionBy("_source", "_bin").orderBy("_hash", F.xxhash64("_row"))
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1).join(counts, ["_source", "_bin"])
    sizes = counts.groupBy("_source").agg(F.max("_n").alias("n"))
    given = weights.join(sizes, weights["source"] == sizes["_source"]).select("source", "weight", "n")
    slots = stored(slot_table(given, period), "slots")
    used = numbered.withColumn("_j", F.col("_before") + F.col("_i")).join(slots, ["_source", "_j"])
    if not placed:
        return used.select("_row.*")
    return used.select(
        "_row.*", F.col("_slot").alias("mix_position"), F.col("_epoch").alias("mix_epoch"),
        F.col("_release").alias("mix_release"), F.col("_due").alias("mix_deadline"),
    )
