"""Exact quantiles by radix selection: no sort, no sketch, no key gathered in one task.

Doubles are read as 64-bit integers of the same order. The range between the
least and the greatest is cut into equal cells, rows are counted per cell where
they lie, and the cell that holds the wanted rank is the next range. What moves
is counts. A range of few values ends the search: they are read out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.functions.arrays import blocks, number_lists, summed

#: Counters of a task at most, over all genes and ranks; decides how many cells a range is cut into.
COUNTERS = 1 << 21
#: A range with this many values or fewer is read out.
FEW = 64
#: Positions whose moments travel in one row.
GENES = 256
TOP = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles ``x`` (without NaN); both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ (bits >> 63)).view(np.uint64) ^ TOP ^ np.where(bits < 0, TOP, np.uint64(0))


def restored(keys: np.ndarray) -> np.ndarray:
    """The doubles that ``ordered`` gave ``keys`` for."""
    return np.where(keys >= TOP, keys ^ TOP, ~keys).view(np.float64)


# -- arrays: a quantile per position ---------------------------------------------------------------

def _moments_of(x: np.ndarray) -> np.ndarray:
    """Per position: count, mean, sum of squares about the mean, least, greatest; missing ignored."""
    there = ~np.isnan(x)
    n = there.sum(axis=0)
    mean = np.divide(np.where(there, x, 0.0).sum(axis=0), n, out=np.zeros(x.shape[1]), where=n > 0)
    rest = np.where(there, x - mean, 0.0)
    low, high = np.where(there, x, np.inf).min(axis=0, initial=np.inf), np.where(there, x, -np.inf).max(axis=0, initial=-np.inf)
    return np.stack([n, mean, (rest * rest).sum(axis=0), low, high])


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    if a is None:
        return b
    width = max(a.shape[1], b.shape[1])
    a, b = (np.concatenate([m, np.tile([[0.0], [0.0], [0.0], [np.inf], [-np.inf]], width - m.shape[1])], axis=1) for m in (a, b))
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(width), where=n > 0)
    apart = b[1] - a[1]
    return np.stack([
        n, a[1] + apart * share, a[2] + b[2] + apart * apart * a[0] * share, np.minimum(a[3], b[3]), np.maximum(a[4], b[4]),
    ])


def array_moments(df: DataFrame, values: str = "values") -> DataFrame:
    """Per position of the arrays ``pos, n, mean, m2, low, high``; NULL and NaN are missing.

    Tasks add up whole arrays; per task and ``GENES`` positions one row is
    shuffled. Positions that no row has any value for are there with ``n`` 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches):
            total = _merged(total, _moments_of(x))
        for start in range(0, 0 if total is None else total.shape[1], GENES):
            part = np.ascontiguousarray(total[:, start:start + GENES])
            yield pa.RecordBatch.from_pydict({"block": pa.array([start // GENES], pa.int32()), "part": [part.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            total = reduce(_merged, (np.frombuffer(p).reshape(5, -1) for p in b.column("part").to_pylist()), total)
            block = b.column("block")[0].as_py()
        n, mean, m2, low, high = total
        yield pa.RecordBatch.from_pydict({
            "pos": pa.array(block * GENES + np.arange(len(n)), pa.int32()), "n": pa.array(n.astype(np.int64)),
            **{k: pa.array(v, mask=n == 0) for k, v in (("mean", mean), ("m2", m2), ("low", low), ("high", high))},
        })

    parts = df.select(values).mapInArrow(run, "block int, part binary")
    return parts.groupBy("block").applyInArrow(merge, "pos int, n bigint, mean double, m2 double, low double, high double")


@dataclass
class Search:
    """Where the wanted ranks lie: per probability and position a range of keys, and a rank within it."""

    low: np.ndarray
    high: np.ndarray
    rank: np.ndarray
    count: np.ndarray

    def open(self) -> np.ndarray:
        return (self.low < self.high) & (self.count > FEW)

    def shifts(self, bits: int) -> np.ndarray:
        """How far keys are shifted, so that each range has ``2 ** bits`` cells at most."""
        span = self.high - self.low
        length = np.zeros(span.shape, np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            big = span >= np.uint64(1 << step)
            length[big] += np.uint64(step)
            span = np.where(big, span >> np.uint64(step), span)
        length += (span > 0).astype(np.uint64)
        return np.where(length > bits, length - np.uint64(bits), np.uint64(0))

    def narrow(self, at: np.ndarray, counts: np.ndarray, bits: int) -> None:
        """Moves the ranges of positions ``at`` to the cell of their rank; ``counts`` is probability x position x cell."""
        upto = counts.cumsum(axis=2)
        rank = self.rank[:, at]
        cell = (upto <= rank[:, :, None]).sum(axis=2)
        shift = self.shifts(bits)[:, at]
        move = self.open()[:, at]
        inside = np.take_along_axis(counts, cell[:, :, None].clip(max=counts.shape[2] - 1), axis=2)[:, :, 0]
        before = np.take_along_axis(upto, cell[:, :, None].clip(max=counts.shape[2] - 1), axis=2)[:, :, 0] - inside
        low = self.low[:, at] + (cell.astype(np.uint64) << shift)
        high = np.minimum(low + ((np.uint64(1) << shift) - np.uint64(1)), self.high[:, at])
        for have, new in ((self.low, low), (self.high, high), (self.rank, rank - before), (self.count, inside)):
            have[:, at] = np.where(move, new, have[:, at])


def _counted(df: DataFrame, values: str, state: Search, bits: int) -> DataFrame:
    """Rows ``block, counts``: how many values lie in each cell of each open range, by blocks of ``positions_a_row``."""
    sent = df.sparkSession.sparkContext.broadcast((state, state.shifts(bits), state.open()))  # a few numbers per position
    step = positions_a_row(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, shift, open_ = sent.value
        probs, width = s.low.shape
        total = np.zeros((probs, width, 1 << bits), np.int64)
        for _, x in blocks(batches):
            there, keys = ~np.isnan(x), ordered(x)
            g = x.shape[1]
            for t in range(probs):
                fit = there & open_[t, :g] & (keys >= s.low[t, :g]) & (keys <= s.high[t, :g])
                row, at = np.nonzero(fit)
                cell = (keys[row, at] - s.low[t, at]) >> shift[t, at]
                total[t] += np.bincount((at << bits) + cell.astype(np.int64), minlength=width << bits).reshape(width, -1)
        for start in range(0, width, step):
            part = total[:, start:start + step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([start // step], pa.int32()), "counts": number_lists([part])})

    return summed(df.select(values).mapInArrow(run, "block int, counts array<double>"), ["block"], "counts")


def positions_a_row(bits: int) -> int:
    """Positions whose counts travel in one row."""
    return max(1, (1 << 14) >> bits)


def _read_out(df: DataFrame, values: str, state: Search) -> tuple[np.ndarray, np.ndarray]:
    """The values at the ranks, and the next greater ones (the same again at the end).

    Tasks send the distinct keys of ranges of few values with their counts, and
    for every range the least key beyond it: ``FEW + 1`` rows a range at most.
    """
    sent = df.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        probs, width = s.low.shape
        beyond = np.full((probs, width), np.iinfo(np.uint64).max)
        spots, found = [], []
        for _, x in blocks(batches):
            there, keys = ~np.isnan(x), ordered(x)
            g = x.shape[1]
            for t in range(probs):
                above = np.where(there & (keys > s.high[t, :g]), keys, np.iinfo(np.uint64).max)
                beyond[t, :g] = np.minimum(beyond[t, :g], above.min(axis=0))
                row, at = np.nonzero(there & (s.low[t, :g] < s.high[t, :g]) & (keys >= s.low[t, :g]) & (keys <= s.high[t, :g]))
                spots.append(t * width + at)
                found.append(keys[row, at])
        some = np.flatnonzero(beyond.ravel() < np.iinfo(np.uint64).max)
        spot = np.concatenate([*spots, some]).astype(np.int64)
        key = np.concatenate([*found, beyond.ravel()[some]]).astype(np.uint64)
        past = np.arange(len(spot)) >= len(spot) - len(some)
        yield pa.RecordBatch.from_pydict({"spot": spot, "past": past, "k": key.view(np.int64) ^ np.int64(-(1 << 63))})

    rows = df.select(values).mapInArrow(run, "spot bigint, past boolean, k bigint")
    # of keys beyond a range only the least matters
    inside = rows.where("NOT past").groupBy("spot", "past", "k").agg(F.count(F.lit(1)).alias("n"))
    past = rows.where("past").groupBy("spot", "past").agg(F.min("k").alias("k")).withColumn("n", F.lit(1).cast("bigint"))
    got = inside.unionByName(past).toArrow()
    spot, over, n = (got.column(c).to_numpy() for c in ("spot", "past", "n"))
    key = (got.column("k").to_numpy() ^ np.int64(-(1 << 63))).view(np.uint64)
    order = np.lexsort((key, over, spot))
    spot, over, key, n = spot[order], over[order], key[order], n[order]
    at, following = state.low.ravel().copy(), state.low.ravel().copy()
    starts = np.searchsorted(spot, np.arange(state.low.size + 1))
    ranks, counts = state.rank.ravel(), state.count.ravel()
    for i in range(state.low.size):  # a range of few values each
        if not counts[i]:
            continue
        part = slice(starts[i], starts[i + 1])
        keys, many, last = key[part], n[part], over[part]
        inner, outer = keys[~last], keys[last]
        if state.low.flat[i] == state.high.flat[i]:
            inner, upto = state.low.ravel()[i:i + 1], counts[i:i + 1]
        else:
            upto = np.cumsum(many[~last])
        j = int(np.searchsorted(upto, ranks[i], "right"))
        at[i] = inner[j]
        if ranks[i] + 1 < upto[j]:
            following[i] = inner[j]
        elif j + 1 < len(inner):
            following[i] = inner[j + 1]
        else:
            following[i] = outer[0] if len(outer) else inner[j]
    return restored(at).reshape(state.low.shape), restored(following).reshape(state.low.shape)


def array_quantiles(df: DataFrame, probs: list[float], values: str = "values") -> pa.Table:
    """``array_moments`` with ``q``: linear-interpolated quantiles per position, equal to NumPy's, null without values.

    One pass for the ranges, one for every few bits of the keys that are needed
    to tell the ranks apart, and one to read out. A pass shuffles counts: per
    task at most ``COUNTERS``, whatever the number of rows. The driver holds a
    range per position and probability. Runs at once: the passes build on each other.
    """
    seen = array_moments(df, values).toArrow().sort_by("pos")
    n, width, ask = seen.column("n").to_numpy(), len(seen), np.asarray(probs, np.float64)
    low, high = (np.nan_to_num(seen.column(c).to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf) for c in ("low", "high"))
    wanted = ask[:, None] * np.maximum(n - 1, 0)
    first = np.floor(wanted)
    state = Search(
        *(np.tile(ordered(np.ascontiguousarray(x, np.float64)), (len(ask), 1)) for x in (low, high)),
        first.astype(np.int64), np.tile(n, (len(ask), 1)),
    )
    bits = int(np.clip(np.log2(COUNTERS / max(1, len(ask) * width)), 1, 16))
    while state.open().any():
        parts = _counted(df, values, state, bits).toArrow()
        counts = np.zeros((len(ask), width, 1 << bits), np.int64)
        step = positions_a_row(bits)
        for block, part in zip(parts.column("block").to_pylist(), parts.column("counts"), strict=True):
            at = slice(block * step, min(width, (block + 1) * step))
            # the sums are doubles made from means: whole numbers but for their last bits
            counts[:, at] = np.rint(part.values.to_numpy()).reshape(len(ask), -1, 1 << bits)
        state.narrow(np.arange(width), counts, bits)
    a, b = _read_out(df, values, state) if width and len(ask) else (np.zeros((len(ask), width)),) * 2
    with np.errstate(invalid="ignore"):
        out = np.where((a == b) | (wanted == first), a, a + (b - a) * (wanted - first)).T
    starts = np.arange(width + 1, dtype=np.int32) * len(ask)
    lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.ascontiguousarray(out).ravel()), mask=pa.array(n == 0))
    return seen.append_column("q", lists)


# -- keys: a quantile per group --------------------------------------------------------------------

#: Bits of a digit; a group has at most ``2 ** DIGIT`` counts a level.
DIGIT = 16


def _ordered_rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, _k``: the values as signed integers of the same order; missing ones left out."""
    x = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = ordered(b.column(len(keys)).to_numpy(zero_copy_only=False)).view(np.int64) ^ np.int64(-(1 << 63))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(k)], names=[*b.schema.names[:len(keys)], "_k"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:len(keys)]), "_k bigint"])
    return x.mapInArrow(run, schema)


def _joined(left: DataFrame, right: DataFrame, names: list[str], other: list[str] | None = None) -> DataFrame:
    """``left`` with the columns of ``right``; null keys match. No hint: Spark knows the sizes once keys are counted."""
    other = other or names
    right = right.withColumnsRenamed({g: f"_r{i}" for i, g in enumerate(other)})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(names)])
    return left.join(right, same).drop(*[f"_r{i}" for i in range(len(names))])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "q") -> DataFrame:
    """Linear-interpolated quantiles, equal to NumPy's, as ``keys, n, out ARRAY``; missing values do not count.

    Radix selection per key: the leading ``DIGIT`` bits of all values are
    counted by key, then the next bits of the values that share the digits of a
    wanted rank, and so on. A level is one aggregation that combines on the map
    side; a key's counts of a level are one array. Null keys are a key.
    """
    if not keys:
        seen = array_quantiles(df.select(F.array(F.col(value).cast("double")).alias("values")), probs)
        rows = [(r["n"], r["q"]) for r in seen.select(["n", "q"]).to_pylist() if r["n"]]
        return df.sparkSession.createDataFrame(rows, f"n bigint, `{out}` array<double>")
    rows = _ordered_rows(df, keys, value)
    probs = [float(p) for p in probs]
    digit = lambda level: F.shiftright("_k", 64 - DIGIT * (level + 1))  # noqa: E731  the first level + 1 digits
    names = [f"_g{i}" for i in range(len(keys))]

    def located(counts: DataFrame, wanted: Column) -> DataFrame:
        """The cell of each wanted rank: ``names, i, digits, rank`` (within the cell), ``count``, from ``names, i, d, c``."""
        cells = F.array_sort(F.collect_list(F.struct("d", "c")))
        start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("bigint").alias("c"))

        def step(acc: Column, cell: Column) -> Column:
            here = acc["d"].isNull() & (wanted < acc["before"] + cell["c"])
            done = acc["d"].isNotNull()
            return F.struct(
                F.when(here | done, acc["before"]).otherwise(acc["before"] + cell["c"]).alias("before"),
                F.when(here, cell["d"]).otherwise(acc["d"]).alias("d"), F.when(here, cell["c"]).otherwise(acc["c"]).alias("c"),
            )

        grouped = counts.groupBy(*names, "i").agg(F.first("want").alias("want"), cells.alias("cells"))
        hit = grouped.withColumn("_hit", F.aggregate("cells", start, step))
        return hit.select(*names, "i", F.col("_hit.d").alias("digits"), (F.col("want") - F.col("_hit.before")).alias("rank"))

    first = rows.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)], digit(0).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    totals = first.groupBy(*names).agg(F.sum("c").alias("n"))
    ranks = F.array(*[
        f(F.lit(p) * (F.col("n") - 1)).cast("bigint") for p in probs for f in (F.floor, F.ceil)
    ])
    asked = totals.select(*names, F.posexplode(ranks).alias("i", "want"))
    state = located(_joined(first, asked, names), F.col("want"))
    for level in range(1, 64 // DIGIT):
        held = state.groupBy(*names).agg(F.collect_list(F.struct("i", "digits", "rank")).alias("_cells"))
        near = _joined(rows, held, keys, names)
        own = F.filter("_cells", lambda c: c["digits"] == digit(level - 1))
        spread = near.select(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)], digit(level).alias("d"), F.inline(own))
        counts = spread.groupBy(*names, "i", "d").agg(F.count(F.lit(1)).alias("c"), F.first("rank").alias("want"))
        state = located(counts, F.col("want"))

    # digits are whole keys now
    per_key = state.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digits"))), lambda c: c["digits"]).alias("_at"))
    named = [F.col(g).alias(k) for g, k in zip(names, keys, strict=True)]
    done = _joined(totals, per_key, names).select(*named, "n", "_at")

    def interpolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(len(keys)).to_numpy()
            ends = restored((b.column(len(keys) + 1).flatten().to_numpy() ^ np.int64(-(1 << 63))).view(np.uint64)).reshape(len(n), -1, 2)
            wanted = np.asarray(probs) * (n[:, None] - 1)
            low, high = ends[:, :, 0], ends[:, :, 1]
            with np.errstate(invalid="ignore"):
                q = np.where((low == high) | (wanted == np.floor(wanted)), low, low + (high - low) * (wanted - np.floor(wanted)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(probs)), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys) + 1], lists], names=[*b.schema.names[:len(keys) + 1], out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields[:-1]), f"`{out}` array<double>"])
    return done.mapInArrow(interpolate, schema)
