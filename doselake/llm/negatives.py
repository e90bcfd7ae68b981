"""Hard negatives by inner product, with segment summaries that decide which scores need computing.

A vector is cut into segments. With means ``m`` and deviations ``s`` of segments
of ``L`` components, the inner product of two vectors lies within
``sum L * (m * m' +- s * s')`` (the deviations' product bounds what is left of
each segment, by Cauchy-Schwarz). Coarse segments are tried first, finer ones
for what they leave open, and exact scores are computed for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from doselake.llm.common import stored

#: Segments of a vector, level by level; each level splits the segments before.
LEVELS = (1, 4, 16)
#: Vectors of a block at most; a block of rows meets a block of anchors in one task.
MOST_BLOCK = 32_768
#: Rows and anchors that are compared at once within a task.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2_048, 128

STORED = StructType([
    StructField("id", LongType()), StructField("label", LongType()), StructField("key", LongType()),
    StructField("anchor", BooleanType()), StructField("v", BinaryType()), StructField("sums", BinaryType()),
])
PAIRS = "anchor bigint, key bigint, id bigint, score bigint"
BANDS = "anchor bigint, key bigint, positive_score bigint, id bigint, score bigint"


def edges(dim: int, segments: int) -> np.ndarray:
    """First component of each segment; nested from level to level."""
    return np.arange(segments) * dim // segments


def summaries(v: np.ndarray) -> np.ndarray:
    """Of each vector, level by level: means, then deviations, of its segments, both times the root of their lengths.

    So the sums over segments are plain inner products of summaries. Empty
    segments (of vectors shorter than a level) have zeros.
    """
    v, out = v.astype(np.float64), []
    n, dim = v.shape
    for segments in LEVELS:
        starts = edges(dim, segments)
        length = np.diff(np.append(starts, dim))
        means, spread = np.zeros((n, segments)), np.zeros((n, segments))
        full = np.flatnonzero(length)
        if n and len(full):
            means[:, full] = np.add.reduceat(v, starts[full], axis=1) / length[full]
            rest = v - np.repeat(means, length, axis=1)
            spread[:, full] = np.add.reduceat(rest * rest, starts[full], axis=1)
        out += [means * np.sqrt(length), np.sqrt(spread)]
    return np.concatenate(out, axis=1)


@dataclass(frozen=True)
class Block:
    """Vectors of one length, in the order of their ids."""

    id: np.ndarray
    label: np.ndarray
    key: np.ndarray
    v: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Block:
        t = t.sort_by("id")
        n = t.num_rows
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.int64).reshape(n, -1)
        sums = np.frombuffer(b"".join(t.column("sums").to_pylist()), np.float64).reshape(n, -1)
        return cls(*(t.column(c).to_numpy() for c in ("id", "label", "key")), v, sums)

    def part(self, at: slice) -> Block:
        return Block(self.id[at], self.label[at], self.key[at], self.v[at], self.sums[at])

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations of the ``k``-th level."""
        first, n = 2 * sum(LEVELS[:k]), LEVELS[k]
        return self.sums[:, first:first + n], self.sums[:, first + n:first + 2 * n]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` and ``b``: in double precision where that is exact, else in integers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("a score may not fit 64 bits")
    return a @ b.T


def scores(anchors: Block, rows: Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``rows``, scores by anchor, and which of them are ``allowed`` and from ``low`` to ``high`` of the anchor.

    Pairs are dropped level by level, by the bounds of their summaries; rows
    that no anchor is left for leave with them.
    """
    at, open_ = np.arange(len(rows.id)), allowed
    low, high = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)  # they may have been rounded
    norms = [np.hypot(*(x[:, 0] for x in b.level(0))) for b in (anchors, rows)]
    for k in range(len(LEVELS)):
        some = open_.any(axis=0)
        at, open_ = at[some], open_[:, some]
        if not len(at):
            break
        (m, s), (m2, s2) = anchors.level(k), rows.level(k)
        middle, reach = m @ m2[at].T, s @ s2[at].T
        reach += 1e-9 * np.outer(norms[0], norms[1][at])  # rounding errors are far below this share
        open_ = open_ & (middle + reach >= low[:, None]) & (middle - reach <= high[:, None])
    some = open_.any(axis=0)
    at, open_ = at[some], open_[:, some]
    exact = exact_scores(anchors.v, rows.v[at])
    return at, exact, open_ & (exact >= low[:, None]) & (exact <= high[:, None])


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest of ``score``; of equal ones, the first places."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        some = np.sort(np.concatenate([above, np.flatnonzero(score == least)[:k - len(above)]]))
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")]


class Leaders:
    """The ``k`` best ``(score, id)`` of each of ``n`` lists so far; a better id is a smaller one."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.least = np.full(n, -np.inf)  # what the next score must reach to matter

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        have = self.kept[i]
        score, ids = np.concatenate([have[0], score]), np.concatenate([have[1], ids])
        some = best(score, self.k)  # ids rise from block to block, so first places are smaller ids
        self.kept[i] = score[some], ids[some]
        if len(some) == self.k:
            self.least[i] = score[some[-1]]


def blocked(df: DataFrame, n: int, others: int, own: str, other: str) -> DataFrame:
    """``df`` with its own block of ``n``, once for each of the ``others`` blocks of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def by_length(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[Block, Block]]:
    """The rows and anchors of a task in pairs of blocks of equal vector length."""
    lengths = [np.array(pc.binary_length(t.column("v"))) for t in (rows, anchors)]
    for n in np.intersect1d(*lengths):
        yield tuple(Block.of(t.filter(pa.array(x == n))) for t, x in zip((rows, anchors), lengths, strict=True))


def quantised(rows: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Valid rows, each once, as integer vectors with the summaries of their segments, and whether they are anchors."""
    x = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        is_anchor.alias("anchor"), F.col(vector_col).cast("array<double>").alias("x"),
    )
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound).select(
        "id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), "x"
    ).distinct()
    out = to_arrow_schema(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, anchor, x, key = (batch.column(i) for i in range(5))
            flat, sizes = x.flatten().to_numpy(), pc.list_value_length(x).to_numpy()
            scaled = np.floor(flat * scale)
            if (np.abs(scaled) >= 2**62).any():
                raise ValueError("a component does not fit 64 bits")
            ends = np.cumsum(sizes)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                v = scaled[(ends[at] - n)[:, None] + np.arange(n)].astype(np.int64).reshape(len(at), n)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), labels.take(take), key.take(take), anchor.take(take),
                    pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in summaries(v)], pa.binary()),
                ], schema=out)

    keyed = x.select("id", "label", "anchor", "x", F.xxhash64("label", "x").alias("key"))
    return stored(keyed.mapInArrow(run, STORED), "negatives-vectors")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    block_rows: int | None = None,
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component ``x`` becomes ``floor(scale * x)``; a score is the integer inner
    product with the anchor. Higher scores come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of its label; for
    each, the first ``negatives`` rows of another label whose score is from
    ``low`` to ``high`` percent of the positive's are given.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part; equal rows count once. Rows of an anchor's own id are never its
    positives. Several different rows of one id are an anchor each. Vectors of
    different lengths do not meet. Components whose scores may pass 64 bits are an
    error. Other columns are not read; an empty table gives no rows.

    Anchors are asked against all rows in blocks of up to ``MOST_BLOCK`` vectors
    (fewer on small tables, so that tasks have work), dealt by hash: a label, an
    id or a vector that is frequent is spread like any other. Each task gives
    the best few of an anchor only. Two passes: positives, then negatives in the
    bands their scores set.
    """
    spark = rows.sparkSession
    vectors = quantised(rows, is_anchor, id_col, label_col, vector_col, scale)
    sizes = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = block_rows or min(MOST_BLOCK, max(512, -(-sizes.rows // tasks)))
    row_blocks, anchor_blocks = max(1, -(-sizes.rows // most)), max(1, -(-sizes.anchors // (block_rows or MOST_BLOCK)))
    on = ["row_block", "anchor_block"]
    all_rows = blocked(vectors.drop("anchor"), row_blocks, anchor_blocks, *on).groupBy(*on)
    # columns of their own, so that the two sides of a cogroup can be told apart
    asked = vectors.where("anchor").select(*(F.col(c).alias(c) for c in STORED.names if c != "anchor"))

    def find_positives(rows_: pa.Table, anchors: pa.Table) -> pa.Table:
        made = []
        for block, who in by_length(rows_, anchors):
            for a in range(0, len(who.id), ANCHORS_AT_ONCE):
                some = who.part(slice(a, a + ANCHORS_AT_ONCE))
                led = Leaders(len(some.id), positives)
                for r in range(0, len(block.id), ROWS_AT_ONCE):
                    part = block.part(slice(r, r + ROWS_AT_ONCE))
                    allowed = (some.label[:, None] == part.label) & (some.id[:, None] != part.id)
                    at, score, fit = scores(some, part, allowed, led.least, np.full(len(some.id), np.inf))
                    for i in np.flatnonzero(fit.any(axis=1)):
                        led.add(i, score[i, fit[i]], part.id[at[fit[i]]])
                made += [(some.id[i], some.key[i], *kept) for i, kept in enumerate(led.kept) if len(kept[0])]
        return pa.table({
            "anchor": _repeat([m[0] for m in made], [m[2] for m in made]), "key": _repeat([m[1] for m in made], [m[2] for m in made]),
            "id": _joined([m[3] for m in made]), "score": _joined([m[2] for m in made]),
        })

    found = all_rows.cogroup(blocked(asked, anchor_blocks, row_blocks, *on[::-1]).groupBy(*on)).applyInArrow(find_positives, PAIRS)
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id")
    chosen = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives), "negatives-positives")

    bands = chosen.groupBy(F.col("anchor").alias("id"), "key").agg(F.array_sort(F.collect_set("score")).alias("bands"))
    banded = asked.join(bands, ["id", "key"])

    def find_negatives(rows_: pa.Table, anchors: pa.Table) -> pa.Table:
        made = []
        bands_of = {(a, k): b for a, k, b in zip(*(anchors.column(c).to_pylist() for c in ("id", "key", "bands")), strict=True)}
        for block, who in by_length(rows_, anchors):
            for a in range(0, len(who.id), ANCHORS_AT_ONCE):
                some = who.part(slice(a, a + ANCHORS_AT_ONCE))
                n = len(some.id)
                mine_ = [bands_of[x] for x in zip(some.id.tolist(), some.key.tolist(), strict=True)]
                lists = [(i, p, -(-low * p // 100), high * p // 100) for i, ps in enumerate(mine_) for p in ps]
                owner, floor, cap = (np.array([x[j] for x in lists]) for j in (0, 2, 3))
                led = Leaders(len(lists), negatives)
                top = np.full(n, -np.inf)
                np.maximum.at(top, owner, cap)
                for r in range(0, len(block.id), ROWS_AT_ONCE):
                    part = block.part(slice(r, r + ROWS_AT_ONCE))
                    bottom = np.full(n, np.inf)
                    np.minimum.at(bottom, owner, np.maximum(floor, led.least))
                    at, score, fit = scores(some, part, some.label[:, None] != part.label, bottom, top)
                    for j in np.flatnonzero(fit.any(axis=1)[owner]):
                        i = owner[j]
                        s, ids = score[i, fit[i]], part.id[at[fit[i]]]
                        inside = (s >= floor[j]) & (s <= cap[j])
                        if inside.any():
                            led.add(j, s[inside], ids[inside])
                made += [(some.id[x[0]], some.key[x[0]], *kept, x[1]) for x, kept in zip(lists, led.kept, strict=True) if len(kept[0])]
        scores_ = [m[2] for m in made]
        return pa.table({
            "anchor": _repeat([m[0] for m in made], scores_), "key": _repeat([m[1] for m in made], scores_),
            "positive_score": _repeat([m[4] for m in made], scores_), "id": _joined([m[3] for m in made]), "score": _joined(scores_),
        })

    near = all_rows.cogroup(blocked(banded, anchor_blocks, row_blocks, *on[::-1]).groupBy(*on)).applyInArrow(find_negatives, BANDS)
    order = Window.partitionBy("anchor", "key", "positive_score").orderBy(F.desc("score"), "id")
    kept = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = chosen.select("anchor", "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return kept.join(pairs, ["anchor", "key", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _repeat(values: list[int], parts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.array(values, np.int64), [len(p) for p in parts])
