"""Metric streams with bounded state per key, on ``transformWithState`` (needs the RocksDB state store)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Windows computed at a time.
FRAMES = 4096
#: Groups for many short keys. A call and its state cost the same for one key and for a group of them, so keys are
#: dealt to groups by their hash, and a group's state lists its keys. The number is fixed for the life of a checkpoint.
GROUPS = 4096
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; a cluster that sets it for all needs no more."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _as_text(df: DataFrame, name: str) -> Column:
    how = {"timestamp": F.unix_micros, "binary": F.base64}.get(df.schema[name].dataType.simpleString(), lambda c: c)
    return how(F.col(name)).cast("string")


def _from_text(df: DataFrame, name: str, text: Column) -> Column:
    kind = df.schema[name].dataType.simpleString()
    if kind == "timestamp":
        return F.timestamp_micros(text.cast("bigint")).alias(name)
    return (F.unbase64(text) if kind == "binary" else text.cast(kind)).alias(name)


def _grouped(
    df: DataFrame, keys: list[str], rest: list[Column], groups: int | None
) -> tuple[DataFrame, list[str], list[Column]]:
    """``_k`` (the keys as one text), ``rest`` and what state is kept by; the latter's names; and the columns that give the keys back."""
    for k in keys:
        kind = df.schema[k].dataType.simpleString()
        if not kind.isalpha() and not kind.startswith("decimal"):
            raise ValueError(f"key {k} must be a plain value, not {kind}")
    text = F.to_json(F.array(*[_as_text(df, k) for k in keys])).alias("_k")
    by = ["_group"] if groups else keys
    of = [F.pmod(F.xxhash64("_k"), F.lit(groups)).alias("_group")] if groups else [F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]
    named = df.select(text, *rest, *([] if groups else [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]))
    given = [c for c in named.columns if not c.startswith("_key")]
    parts = F.from_json("_k", "array<string>")
    return named.select(*given, *of), by, [_from_text(df, k, F.get(parts, i)) for i, k in enumerate(keys)]


def _in_order(batches: Iterator[pd.DataFrame], names: list[str], step: str) -> pd.DataFrame:
    """The rows of one group in one micro-batch, whose size the source limits. Computed columns come without their names."""
    parts = [b.set_axis(names, axis=1) for b in batches]
    return pd.concat(parts, ignore_index=True).sort_values(step, kind="stable") if parts else pd.DataFrame()


def _by_key(now: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows key by key, each key's in order; the number of each row's key; the keys, and how many rows they have."""
    code, names = pd.factorize(now["_k"].to_numpy(object))
    order = np.argsort(code, kind="stable")
    return now.iloc[order], code[order], names, np.bincount(code)


def _window_stats(v: np.ndarray, ok: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of full windows, one a row, over the values that are there."""
    n = ok.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(ok, v, 0.0).sum(axis=1) / n
        off = np.where(ok, v - mean[:, None], 0.0)
        std = np.sqrt((off * off).sum(axis=1) / n)
        real = ok & ~np.isnan(v)
        low = np.where(real.any(axis=1), np.where(real, v, np.inf).min(axis=1), np.nan)
        high = np.where(ok, v, -np.inf).max(axis=1)
    return {"mean": mean, "std": std, "min": low, "max": high, "_some": n > 0}


class MovingWindow(StatefulProcessor):
    """Holds the last ``window - 1`` rows of each key of a group: values, and whether they were there."""

    def __init__(self, names: list[str], step: str, window: int):
        self.names, self.step, self.window = names, step, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "k STRING, v ARRAY<DOUBLE>, there ARRAY<BOOLEAN>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = _in_order(rows, self.names, self.step)
        if now.empty:
            return
        before = {r[0]: (r[1], r[2]) for r in self.held.get()} if self.held.exists() else {}
        now, code, names, count = _by_key(now)
        # side by side, each key has window - 1 places for earlier rows, then its new ones
        w = self.window - 1
        end = np.cumsum(count + w)
        new = end - count
        place = new[code] + np.arange(len(now)) - (np.cumsum(count) - count)[code]
        v, ok = np.zeros(end[-1]), np.zeros(end[-1], bool)
        v[place], ok[place] = now["_v"].to_numpy("float64"), now["_there"].to_numpy(bool)
        for name, at in zip(names, new, strict=True):
            earlier = before.get(name)
            if earlier:
                v[at - len(earlier[0]):at], ok[at - len(earlier[0]):at] = earlier
        for at in range(0, len(now), FRAMES):
            some = now.iloc[at:at + FRAMES]
            frames = place[at:at + FRAMES, None] + np.arange(-w, 1)
            yield pd.DataFrame({
                "_k": some["_k"].to_numpy(object), self.step: some[self.step].to_numpy(),
                **_window_stats(v[frames], ok[frames]),
                "last": some["_v"].to_numpy("float64"), "_there": some["_there"].to_numpy(bool),
            })
        if w:
            for name, to, n in zip(names, end, count, strict=True):
                known = min(w, n + (len(before[name][0]) if name in before else 0))
                before[name] = v[to - known:to].tolist(), ok[to - known:to].tolist()
            self.held.put([(name, *rows) for name, rows in before.items()])


def stream_moving_stats(
    df: DataFrame, keys: list[str], step: str = "step", value: str = "value", window: int = 100,
    groups: int | None = None,
) -> DataFrame:
    """Mean, population std, min, max, last of the latest ``window`` rows per key.

    As in the batch operator, NULL takes a place in the window but no part in
    its statistics, and NaN counts as a value above all others. State is the
    last ``window - 1`` rows of each key. Rows of a key come in step order from one
    micro-batch to the next; within one they are sorted. State is kept by key,
    or by ``groups`` groups of keys, which many short keys need.
    """
    names = ["mean", "std", "min", "max", "last"]
    out = ("_k STRING, " + _types(df, [step]) + ", " + ", ".join(f"`{n}` DOUBLE" for n in names[:-1])
           + ", _some BOOLEAN, `last` DOUBLE, _there BOOLEAN")
    flagged, by, back = _grouped(df, keys, [
        F.col(step), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"), F.col(value).isNotNull().alias("_there"),
    ], groups)
    how = MovingWindow(flagged.columns, step, window)
    stats = flagged.groupBy(*by).transformWithStateInPandas(how, out, "Append", "none")
    # pandas hands NaN over as NULL; the flags tell them apart
    known = {n: F.col("_there" if n == "last" else "_some") for n in names}
    return stats.select(*back, step, *[
        F.when(known[n], F.coalesce(n, F.lit(float("nan")))).alias(n) for n in names
    ])


class Stopping(StatefulProcessor):
    """Best value, its step and the wait of each key of a group that still runs. A key that stopped keeps a flag alone."""

    def __init__(self, names: list[str], step: str, value: str, patience: int, min_delta: float, sign: float):
        self.names, self.step, self.value = names, step, value
        self.patience, self.min_delta, self.sign = patience, min_delta, sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getListState("progress", "k STRING, best DOUBLE, best_step BIGINT, wait BIGINT")
        self.stopped = handle.getListState("stopped", "k STRING")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = _in_order(rows, self.names, self.step)
        done = {r[0] for r in self.stopped.get()} if self.stopped.exists() else set()
        if done and not now.empty:
            now = now[~now["_k"].isin(done)]
        if now.empty:
            return
        running = {r[0]: tuple(r[1:]) for r in self.progress.get()} if self.progress.exists() else {}
        now, _, names, count = _by_key(now)
        steps, values = now[self.step].to_numpy(), now[self.value].to_numpy("float64") * self.sign
        ends = []
        for name, to, n in zip(names, np.cumsum(count), count, strict=True):
            at, state = self._followed(values[to - n:to], steps[to - n:to], *running.pop(name, (np.inf, None, 0)))
            if at is None:
                running[name] = state
            else:
                ends.append((name, int(steps[to - n + at]), *state[:2]))
        if running:
            self.progress.put([(name, *state) for name, state in running.items()])
        else:
            self.progress.clear()
        if ends:
            self.stopped.appendList([(e[0],) for e in ends])
            yield pd.DataFrame({
                "_k": [e[0] for e in ends], "stop_step": [e[1] for e in ends],
                "best_step": pd.array([e[3] for e in ends], "Int64"),
                "best_value": [e[2] * self.sign if e[3] is not None else None for e in ends],
            })

    def _followed(self, v: np.ndarray, steps: np.ndarray, best: float, best_step: int | None, wait: int) -> tuple:
        """Where among the new values of a key it stops, if it does; its best value, that one's step, and its wait."""
        at, lows = improved(v, best, self.min_delta)
        # rows since the last improvement, counted on from before this micro-batch
        last = np.full(len(v), -1 - wait)
        last[at] = at
        waited = np.arange(len(v)) - np.maximum.accumulate(last)
        late = waited >= self.patience
        end = int(np.argmax(late)) if late.any() else len(v) - 1
        kept = at[at <= end]
        if len(kept):
            best, best_step = float(lows[len(kept) - 1]), int(steps[kept[-1]])
        return (end if late.any() else None), (best, best_step, int(waited[-1]))


def improved(v: np.ndarray, best: float, min_delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of ``v`` that are lower than the last such one, at first ``best``, by more than ``min_delta``.

    Only values below all before them can be; without a margin all of those are.
    """
    real = np.where(np.isnan(v), np.inf, v)
    before = np.minimum.accumulate(np.concatenate([[best], real]))[:-1]
    at = np.flatnonzero(real < before)
    if min_delta:
        kept = []
        for i in at.tolist():
            if real[i] < best - min_delta:
                best = real[i]
                kept.append(i)
        at = np.array(kept, np.int64)
    return at, real[at]


def stream_early_stop(
    df: DataFrame, keys: list[str], step: str = "step", value: str = "value", patience: int = 5,
    min_delta: float = 0.0, mode: str = "min", groups: int | None = None,
) -> DataFrame:
    """One row per key, emitted when the key stops improving.

    As in the batch operator, NULL is skipped and NaN is a value that is no
    better. State is the best value, its step and the wait; all of it is dropped
    when the key stops, but for the flag that keeps later rows from starting anew.
    It is kept by key, or by ``groups`` groups of keys, which many short keys need.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', not {mode}")
    sign = 1.0 if mode == "min" else -1.0
    step_type = df.schema[step].dataType.simpleString()
    out = f"_k STRING, stop_step {step_type}, best_step {step_type}, best_value DOUBLE"
    known = df.where(F.col(value).cast("double").isNotNull())
    present, by, back = _grouped(known, keys, [F.col(step), F.col(value).cast("double").alias(value)], groups)
    how = Stopping(present.columns, step, value, patience, min_delta, sign)
    return present.groupBy(*by).transformWithStateInPandas(how, out, "Append", "none").select(
        *back, "stop_step", "best_step", "best_value")
