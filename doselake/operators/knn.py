"""Exact nearest neighbours: pivots and distance rings decide which rows a query is compared with.

Rows are grouped by their nearest pivot and, within a group, by rings of
distance to it. Each such cell is stored once. By the triangle inequality a
cell's rows are at least as far from a query as the query's own distance to the
pivot is from the ring, so a block of queries reads the cells in the order of
that bound and stops when no query can gain. Within a cell distances are matrix
products; those that matter are then computed directly. A wide row is shuffled
once, to its cell or its block of queries, however many cells are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.functions.arrays import CELLS, as_block, blocks
from doselake.functions.parts import read_part, store_parts

#: Pivots, and rings around each, at most: what a task is told of the cells stays small.
PIVOTS, RINGS = 128, 256
#: Queries with gaps that read a cell together.
QUERIES = 4096


def minkowski(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``, directly."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        apart = np.abs(a[i:i + step, None, :] - b[None])
        out[i:i + step] = np.sqrt((apart * apart).sum(axis=2)) if p == 2 else (apart ** p).sum(axis=2) ** (1 / p)
    return out


def smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest finite numbers of each row; of equal ones, the first columns."""
    fit = np.isfinite(d)
    if d.shape[1] > k:
        least = np.partition(d, k - 1, axis=1)[:, k - 1:k]
        below = d < least
        same = (d == least) & fit
        fit = below | (same & (np.cumsum(same, axis=1) <= k - below.sum(axis=1, keepdims=True)))
    return np.nonzero(fit)


@dataclass
class Best:
    """The ``k`` nearest rows of each query so far: distances, keys, and one number each; order is by distance, then key."""

    distance: np.ndarray
    key: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, n: int, k: int, key_type: np.dtype) -> Best:
        return cls(np.full((n, k), np.inf), np.zeros((n, k), key_type) if key_type != object else np.full((n, k), "", object), np.zeros((n, k)))

    def add(self, at: np.ndarray, d: np.ndarray, keys: np.ndarray, value_of: np.ndarray) -> None:
        """Offers the columns of ``d`` (queries ``at`` x rows, in the order of their keys); ``value_of`` has a row per query or one for all."""
        k = self.distance.shape[1]
        row, column = smallest(d, k)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        new = Best.empty(len(at), k, self.key.dtype)
        new.distance[row, place], new.key[row, place] = d[row, column], keys[column]
        new.value[row, place] = value_of[column] if value_of.ndim == 1 else value_of[row, column]
        self.merge(at, new)

    def merge(self, at: np.ndarray, new: Best) -> None:
        """Takes the nearest of what queries ``at`` have and of ``new``."""
        k = self.distance.shape[1]
        both = [np.concatenate([x[at], y], axis=1) for x, y in ((self.distance, new.distance), (self.key, new.key), (self.value, new.value))]
        order = np.lexsort((both[1], both[0]), axis=-1)[:, :k]
        for have, all_ in zip((self.distance, self.key, self.value), both, strict=True):
            have[at] = np.take_along_axis(all_, order, axis=1)


@dataclass
class Cells:
    """Where the rows are stored, and of each cell (pivot x ring) the least and greatest distance to its pivot."""

    path: str
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gaps: int

    def read(self, cell: int, rows: int) -> Iterator[pa.RecordBatch]:
        """Rows of a cell by key, ``rows`` at a time."""
        return read_part(self.path, cell, rows)


def _trimmed(squares: np.ndarray, gaps: int) -> tuple[np.ndarray, np.ndarray]:
    """Root of each row's sum, without its ``gaps`` largest and with them: what a row can have less when cells are missing."""
    whole = squares.sum(axis=-1)
    if gaps:
        less = whole - np.partition(squares, -min(gaps, squares.shape[-1]), axis=-1)[..., -min(gaps, squares.shape[-1]):].sum(axis=-1)
        return np.sqrt(np.maximum(less, 0)), np.sqrt(whole)
    return np.sqrt(whole), np.sqrt(whole)


def _reach(x: np.ndarray, pivots: np.ndarray, gaps: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to pivots, from below and above, if up to ``gaps`` cells of a row do not count. Missing cells count nothing."""
    if not gaps and not np.isnan(x).any():
        d = minkowski(x, pivots, p)
        return d, d
    low, high = np.empty((len(x), len(pivots))), np.empty((len(x), len(pivots)))
    for j, pivot in enumerate(pivots):  # a bounded number of pivots
        low[:, j], high[:, j] = _trimmed(np.nan_to_num((x - pivot) ** 2), gaps)
    return low, high


def store_cells(data: DataFrame, key: str, values: str, extra: list[str], cell_rows: int, p: float, gaps: int) -> Cells:
    """Stores ``data`` by cells of about ``cell_rows`` rows (more where ``PIVOTS * RINGS`` cells are not enough, or rows are equally far).

    ``gaps`` is the most cells that any row lacks. Pivots are rows chosen by
    hash; their missing cells count as zero.
    """
    spark, n = data.sparkSession, data.count()
    count = int(np.clip(round((n / cell_rows) ** 0.5), 1, PIVOTS))
    rings = int(np.clip(-(-n // (cell_rows * count)), 1, RINGS))
    chosen = data.select(key, values).orderBy(F.xxhash64(key), key).limit(count).select(F.col(values).cast("array<double>").alias("v")).toArrow()
    pivots = np.nan_to_num(as_block(chosen.column("v").combine_chunks()))
    if not len(pivots):
        return Cells("", np.zeros((0, 0)), np.zeros(0), np.zeros(0), gaps)
    sent = spark.sparkContext.broadcast(pivots)  # PIVOTS rows at most
    rows = data.select(F.col(key).alias("key"), *extra, F.col(values).cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1 + len(extra)):
            low, high = _reach(x, sent.value, gaps, p)
            near = high.argmin(axis=1)
            at = np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(near.astype(np.int32)), pa.array(low[at, near]), pa.array(high[at, near])],
                names=[*part.schema.names, "pivot", "low", "high"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(assign, f"{schema}, pivot int, low double, high double")
    shares = [i / rings for i in range(1, rings)]
    cuts = np.full((len(pivots), rings - 1), np.inf)
    if shares:
        for r in placed.groupBy("pivot").agg(F.percentile_approx("high", shares, 1000).alias("q")).collect():
            cuts[r.pivot] = r.q
    bounds = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cuts)], "pivot int, cuts array<double>")
    ring = F.size(F.filter("cuts", lambda c: c < F.col("high")))
    celled = placed.join(F.broadcast(bounds), "pivot").withColumn("part", F.col("pivot") * rings + ring).drop("pivot", "cuts")
    # a cell of many equal rows is split over several tasks and files
    path = store_parts(celled.hint("rebalance", "part").sortWithinPartitions("part", "key"), "cells")
    low, high = np.full(len(pivots) * rings, np.inf), np.full(len(pivots) * rings, -np.inf)
    stored = spark.read.parquet(path).groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in stored.collect():  # a row a cell
        low[r.part], high[r.part] = r.low, r.high
    return Cells(path, pivots, low, high, gaps)


def visits(cells: Cells, x: np.ndarray, p: float) -> np.ndarray:
    """Queries x cells: no row of the cell is nearer than this; infinite for cells without rows."""
    low, high = _reach(x, cells.pivots, cells.gaps, p)
    rings = len(cells.low) // max(1, len(cells.pivots))
    low, high = np.repeat(low, rings, axis=1), np.repeat(high, rings, axis=1)
    near = np.maximum(np.maximum(low - cells.high, cells.low - high), 0)
    return np.where(cells.low <= cells.high, near * (1 - 1e-9) - 1e-9, np.inf)


def _searched(cells: Cells, x: np.ndarray, p: float, rows: int, tau, offer) -> int:
    """Reads the cells that matter for the queries ``x``, nearest first; ``offer(queries, batch)`` takes their rows.

    ``tau()`` is how far a row may be to matter to each query. Gives the number of cells read.
    """
    near, read = visits(cells, x, p), 0
    for cell in np.argsort(near.min(axis=0), kind="stable"):
        at = np.flatnonzero(near[:, cell] <= np.minimum(tau(), np.finfo(np.float64).max))
        if len(at):
            read += 1
            for batch in cells.read(int(cell), rows):
                offer(at, batch)
    return read


def _exact(d: np.ndarray, margin: np.ndarray, k: int, direct) -> np.ndarray:
    """``d`` with the entries that may be among the ``k`` smallest computed by ``direct(rows, columns)``, the rest infinite."""
    limit = np.partition(d, k - 1, axis=1)[:, k - 1:k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
    row, column = np.nonzero(np.isfinite(d) & (d <= limit + margin))
    out = np.full(d.shape, np.inf)
    for i in range(0, len(row), 4096):
        r, c = row[i:i + 4096], column[i:i + 4096]
        out[r, c] = direct(r, c)
    return out


def slice_rows(values: pa.Array, most: int) -> int:
    """How many rows of an array column are worked on at once: ``most``, fewer when they are wide."""
    width = max(1, pc.max(pc.list_value_length(values)).as_py() or 1) if len(values) else 1
    return max(1, min(most, 4 * CELLS // width))


def _by_home(queries: DataFrame, cells: Cells, key: str, values: str, p: float) -> DataFrame:
    """Queries ``key, v`` dealt by their nearest pivot, so that a block of them reads the same cells."""
    sent = queries.sparkSession.sparkContext.broadcast(cells.pivots)
    rows = queries.select(F.col(key).alias("key"), F.col(values).cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1):
            home = _reach(x, sent.value, 0, p)[1].argmin(axis=1) if len(sent.value) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32))], names=["key", "v", "home"])

    kind = queries.schema[key].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"key {kind}, v array<double>, home int")
    # a popular pivot's queries are spread by their hash, and sorted within each task
    return placed.repartition("home", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("home").select("key", "v")


def knn_regress(
    train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", p: float = 2.0,
    key: str = "sig_id", values: str = "values", target: str = "target", block: int = 2048,
) -> DataFrame:
    """Prediction per test row from its k nearest training rows (Minkowski ``p`` of 1 or more), ties by key.

    A neighbour at distance zero decides alone under ``distance`` weights. A
    training row with a missing value or target is nobody's neighbour; a test
    row with a missing value has a null prediction. ``block`` is the number of
    queries worked on at once, and of rows in a cell.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights: {weights}")
    if p < 1:
        raise ValueError("p must be 1 or more")
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))
    known = train.where(whole & F.col(target).isNotNull()).select(key, F.col(target).cast("double").alias("y"), values)
    cells = store_cells(known, key, values, ["y"], block, p, 0)
    sent = test.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in batches:
            at_once = slice_rows(batch.column(1), block)
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                x = as_block(part.column(1))
                sound = np.flatnonzero(~np.isnan(x).any(axis=1))
                x = x[sound]
                best = None

                def offer(at: np.ndarray, rows: pa.RecordBatch) -> None:
                    nonlocal best
                    keys, y = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy()
                    b, a = as_block(rows.column(2)), x[at]
                    if best is None:
                        best = Best.empty(len(x), k, keys.dtype)
                    if p == 2:
                        sizes = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
                        square = np.maximum(sizes[0] + sizes[1] - 2 * a @ b.T, 0)
                        margin = 1e-10 * (sizes[0] + sizes[1].max(initial=0))
                        d = _exact(square, margin, k, lambda r, c: np.sqrt(((a[r] - b[c]) ** 2).sum(axis=1)))
                    else:
                        d = minkowski(a, b, p)
                    best.add(at, d, keys, y)

                if len(x) and len(cells.pivots):
                    _searched(cells, x, p, at_once, lambda: np.full(len(x), np.inf) if best is None else best.distance[:, -1], offer)
                out = np.full(part.num_rows, np.nan)
                if best is not None:
                    out[sound] = _predicted(best, weights)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, mask=np.isnan(out))], names=[key, "prediction"])

    kind = test.schema[key].dataType.simpleString()
    return _by_home(test, cells, key, values, p).mapInArrow(run, f"`{key}` {kind}, prediction double")


def _predicted(best: Best, weights: str) -> np.ndarray:
    found = np.isfinite(best.distance)
    if weights == "uniform":
        w = found.astype(float)
    else:
        hit = best.distance == 0
        with np.errstate(divide="ignore"):
            w = np.where(hit.any(axis=1, keepdims=True), hit, np.where(found, 1 / best.distance, 0.0))
    with np.errstate(invalid="ignore"):
        return (w * best.value).sum(axis=1) / w.sum(axis=1)


def impute_knn(matrix: DataFrame, k: int = 5, key: str = "sig_id", block: int = 1024) -> DataFrame:
    """Missing genes from the k nearest rows that have them, ties by key.

    Distance is Euclidean over the genes both rows have, scaled up by the share
    they cover. A gene no neighbour has falls back to the gene mean. That
    distance is no metric; a cell's bound allows for as many missing genes as
    any row has, so nothing is missed, and prunes less the more there are.
    """
    from doselake.operators.matrix import gene_stats, per_gene_array

    x = F.transform("values", lambda v: F.when(~F.isnan(v), v.cast("double")))
    rows = matrix.withColumn("values", x)
    lacking = F.size(F.filter("values", lambda v: v.isNull()))
    gaps = rows.agg(F.max(lacking)).first()[0] or 0
    cells = store_cells(rows, key, "values", [], block, 2.0, gaps)
    sent = matrix.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_once = slice_rows(batch.column(1), block)
            queries = slice_rows(batch.column(1), max(block, QUERIES))  # a cell is read once for all of them
            for start in range(0, batch.num_rows, queries):
                yield _filled(sent.value, batch.slice(start, queries), k, at_once, key)

    kind = matrix.schema[key].dataType.simpleString()
    asked = _by_home(rows.where(lacking > 0), cells, key, "values", 2.0)
    fills = asked.mapInArrow(run, f"`{key}` {kind}, _fills map<int,double>")
    mean = per_gene_array(gene_stats(rows), F.col("mean"))
    filled = F.transform(
        F.arrays_zip(F.col("values").alias("v"), F.col("_mean").alias("m")), lambda c, i: F.coalesce(
            c["v"], F.try_element_at(F.col("_fills"), i), c["m"])
    )
    return (
        rows.join(fills, key, "left")
        .withColumn("_mean", mean.scalar())
        .withColumn("values", filled)
        .drop("_fills", "_mean")
    )


def _filled(cells: Cells, part: pa.RecordBatch, k: int, block: int, key: str) -> pa.RecordBatch:
    """Each row's missing positions and the mean of its neighbours there."""
    own, a = part.column(0).to_numpy(zero_copy_only=False), as_block(part.column(1))
    row, pos = np.nonzero(np.isnan(a))  # a search for each missing cell; those of a row share their distances
    best = Best.empty(len(row), k, own.dtype)
    width = a.shape[1]
    have = ~np.isnan(a)
    a0 = np.where(have, a, 0.0)
    # the squared distance over shared genes is one product: of these, and of a cell's rows arranged alike
    left = np.concatenate([a0 * a0, have, -2 * a0], axis=1)
    weight = (a0 * a0).sum(axis=1)

    def tau() -> np.ndarray:
        out = np.zeros(len(a))
        np.maximum.at(out, row, best.distance[:, -1])
        return out

    def offer(at: np.ndarray, rows: pa.RecordBatch) -> None:
        keys, b = rows.column(0).to_numpy(zero_copy_only=False), as_block(rows.column(1))
        have_b = ~np.isnan(b)
        b0 = np.where(have_b, b, 0.0)
        right = np.concatenate([have_b, b0 * b0, b0], axis=1).T
        limit, most = tau(), (b0 * b0).sum(axis=1).max(initial=0)
        step = max(1, CELLS // max(1, len(b)))
        for i in range(0, len(at), step):  # bounded blocks of queries
            q = at[i:i + step]
            apart = left[q] @ right
            # only pairs within a query's present limit can matter; few do once it has neighbours
            margin = 1e-10 * (weight[q] + most) * width
            with np.errstate(over="ignore", invalid="ignore"):
                near = limit[q] ** 2 * (1 + 1e-9) + margin
            bound, free = np.flatnonzero(np.isfinite(near)), np.flatnonzero(~np.isfinite(near))
            if len(bound):  # fewer shared genes only scale a distance up
                r, c = np.nonzero((apart if len(bound) == len(q) else apart[bound]) <= near[bound, None])
                if len(r):
                    _offer_pairs(q[bound[r]], c, keys, b0, have_b)
            if len(free):
                _offer_all(q[free], apart[free], margin[free], keys, b0, have_b)

    def _direct(q: np.ndarray, c: np.ndarray, b0: np.ndarray, have_b: np.ndarray) -> np.ndarray:
        both = have[q] & have_b[c]
        apart, shared = np.where(both, a0[q] - b0[c], 0.0), both.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.sqrt((apart * apart).sum(axis=1) * width / shared), np.inf)

    of_row = np.searchsorted(row, np.arange(len(a) + 1))  # the missing cells of each row

    def _offer_pairs(q: np.ndarray, c: np.ndarray, keys: np.ndarray, b0: np.ndarray, have_b: np.ndarray) -> None:
        """Offers single pairs of a query and a cell's row."""
        for i in range(0, len(q), 4096):
            qq, cc = q[i:i + 4096], c[i:i + 4096]
            d = _direct(qq, cc, b0, have_b)
            d[keys[cc] == own[qq]] = np.inf
            # a pair serves every cell that the query lacks and the other row has
            times = of_row[qq + 1] - of_row[qq]
            cell = np.repeat(of_row[qq] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            cc, d = np.repeat(cc, times), np.repeat(d, times)
            use = np.flatnonzero(have_b[cc, pos[cell]] & (d <= best.distance[cell, -1]) & np.isfinite(d))
            cell, cc, d = cell[use], cc[use], d[use]
            order = np.lexsort((keys[cc], d, cell))
            cell, cc, d = cell[order], cc[order], d[order]
            place = np.arange(len(cell)) - np.searchsorted(cell, cell)
            use = place < k
            cell, cc, d, place = cell[use], cc[use], d[use], place[use]
            if len(cell):
                asked, line = np.unique(cell, return_inverse=True)
                dense = Best.empty(len(asked), k, own.dtype)
                dense.distance[line, place], dense.key[line, place] = d, keys[cc]
                dense.value[line, place] = b0[cc, pos[cell]]
                best.merge(asked, dense)

    def _offer_all(q: np.ndarray, apart: np.ndarray, margin: np.ndarray, keys: np.ndarray, b0: np.ndarray, have_b: np.ndarray) -> None:
        """Offers every row of a cell, to queries that lack neighbours yet."""
        shared = have[q].astype(float) @ have_b.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            square = np.maximum(apart, 0) * width / shared
        square[(shared == 0) | (keys == own[q][:, None])] = np.inf
        of = np.full(len(a), -1)
        of[q] = np.arange(len(q))
        asked = np.flatnonzero(of[row] >= 0)
        step = max(1, CELLS // max(1, len(b0)))
        for i in range(0, len(asked), step):  # bounded blocks of missing cells
            some = asked[i:i + step]
            r, g = of[row[some]], pos[some]
            d = np.where(have_b[:, g].T, square[r], np.inf)
            exact = _exact(d, margin[r][:, None], k, lambda x, c: _direct(q[r[x]], c, b0, have_b))
            best.add(some, exact, keys, b0[:, g].T)

    if len(row) and len(cells.pivots):
        _searched(cells, a, 2.0, block, tau, offer)
    found = np.isfinite(best.distance)
    n = found.sum(axis=1)
    some = np.flatnonzero(n)
    mean = np.where(found, best.value, 0.0).sum(axis=1)[some] / n[some]
    counts = np.bincount(row[some], minlength=len(a))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    fills = pa.MapArray.from_arrays(offsets, pa.array(pos[some].astype(np.int32)), pa.array(mean))
    return pa.RecordBatch.from_arrays([part.column(0), fills], names=[key, "_fills"])
