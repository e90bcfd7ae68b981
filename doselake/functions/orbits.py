"""Chains of "the first later one that is lower by a margin", followed in a logarithm of rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.session import cut_lineage

#: Bits of an id below its block's number.
BLOCK_BITS = 33


def next_lower(rows: DataFrame, margin: float, tasks: int) -> DataFrame:
    """``id, next`` of rows ``kid, id, v``, whose values fall with the id within a kid: the first of the kid below ``v - margin``.

    Values and what they ask for are sorted together, by ranges that split a
    kid wherever it is large; behind each question the next value is the
    answer. A range that ends with open questions gets the first value behind it.
    """
    spark = rows.sparkSession
    asked = rows.select("kid", (F.col("v") - margin).alias("x"), F.lit(1).alias("asks"), "id")
    both = rows.select("kid", F.col("v").alias("x"), F.lit(0).alias("asks"), "id").unionByName(asked)
    order = ["kid", F.desc("x"), "asks"]
    ordered = cut_lineage(
        both.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", BLOCK_BITS)
    firsts = ordered.where("asks = 0").groupBy(part.alias("part")).agg(F.min(F.struct("at", "kid", "id")).alias("f"))
    known = sorted((r.part, r.f.kid, r.f.id) for r in firsts.collect())  # one per range
    sent = spark.sparkContext.broadcast(known)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_kid, open_id, last = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def made(ids: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"id": ids, "next": pa.array(found, mask=found < 0)})

        for b in batches:
            if not b.num_rows:
                continue
            kid, asks, ids, at = (b.column(i).to_numpy() for i in range(4))
            last = at[0] >> BLOCK_BITS
            where = np.where(asks == 0, np.arange(len(ids)), len(ids))
            ahead = np.minimum.accumulate(where[::-1])[::-1]  # place of the next value
            if ahead[0] < len(ids):
                first = ahead[0]
                yield made(open_id, np.where(open_kid == kid[first], ids[first], -1))
                open_kid, open_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
            q = np.flatnonzero(asks == 1)
            done = q[ahead[q] < len(ids)]
            yield made(ids[done], np.where(kid[ahead[done]] == kid[done], ids[ahead[done]], -1))
            left = q[ahead[q] == len(ids)]
            open_kid, open_id = np.concatenate([open_kid, kid[left]]), np.concatenate([open_id, ids[left]])
        if len(open_id):
            behind = next(((k, i) for p, k, i in sent.value if p > last), (-1, -1))
            yield made(open_id, np.where(open_kid == behind[0], behind[1], -1))

    return ordered.select("kid", "asks", "id", "at").mapInArrow(answer, "id bigint, next bigint")


def _inside(ids: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Place of the next one within a block of sorted ids; its own place where that is elsewhere or nowhere."""
    place = np.searchsorted(ids, following).clip(max=len(ids) - 1)
    return np.where((following >= 0) & (ids[place] == following), place, np.arange(len(ids)))


def orbit(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """``id`` of all that ``starts`` (``id``) lead to along ``pointers`` (``id, next``, to greater ids or null), themselves included.

    Ways within a block of ids are followed where the block lies; what is left
    are jumps from block to block. Jumps are doubled each round, and so are the
    blocks known to be entered: rounds grow with the logarithm of the blocks.
    """
    block = F.shiftright("id", BLOCK_BITS)
    blocks = cut_lineage(pointers.withColumn("block", block))

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        t = t.sort_by("id")
        return t.column("id").to_numpy(), t.column("next").fill_null(-1).to_numpy(), t

    def leave(t: pa.Table) -> pa.Table:
        ids, following, _ = read(t)
        jump = _inside(ids, following)
        while (jump[jump] != jump).any():
            jump = jump[jump]
        out = following[jump]
        return pa.table({"id": ids[out >= 0], "next": out[out >= 0]})

    def mark(t: pa.Table) -> pa.Table:
        ids, following, t = read(t)
        step = _inside(ids, following).tolist()
        seen = np.zeros(len(ids), bool)
        for i in np.flatnonzero(t.column("entered").to_numpy(zero_copy_only=False)).tolist():
            while not seen[i]:
                seen[i] = True
                i = step[i]
        return pa.table({"id": ids[seen]})

    jumps = cut_lineage(blocks.groupBy("block").applyInArrow(leave, "id bigint, next bigint"))
    entered = cut_lineage(starts.select("id"))
    while True:
        more = cut_lineage(entered.join(jumps, "id").select(F.col("next").alias("id")))
        if more.isEmpty():
            break
        entered = cut_lineage(entered.unionByName(more).distinct())
        further = jumps.select(F.col("id").alias("next"), F.col("next").alias("_n"))
        jumps = cut_lineage(jumps.join(further, "next").select("id", F.col("_n").alias("next")))
    flagged = blocks.join(entered.withColumn("entered", F.lit(True)), "id", "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return flagged.groupBy("block").applyInArrow(mark, "id bigint")
