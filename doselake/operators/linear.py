"""Linear fits from cross products: all penalties and all folds from one set of sums.

Rows are read once (more often only where features are so many that their
products do not fit a task). Each fold's products are summed apart; those of a
training set are the total less its fold. They are stored by strips of features,
and solved where they are read: the driver sees coefficients and scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.functions.arrays import blocks, number_lists, summed
from doselake.functions.parts import read_part, store_parts
from doselake.operators.matrix import _OnValues, with_arrays

#: Cells of a strip of products, and of all that a task adds up at a time.
STRIP, HELD = 1 << 20, 1 << 24
#: Rounds of a solver at most, and the relative change that ends it.
ROUNDS, CLOSE = 10_000, 1e-12


class LinearTableModel(_OnValues, Model, DefaultParamsReadable, DefaultParamsWritable):
    """``intercept + coef . values`` as a column expression."""

    coef = Param(Params._dummy(), "coef", "per feature", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "", TypeConverters.toFloat)

    def __init__(self, coef: list[float] | None = None, bias: float = 0.0) -> None:
        super().__init__()
        if coef is not None:
            self._set(coef=[float(c) for c in coef], bias=float(bias))

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.coef))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.bias)

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = F.zip_with(F.col(self.values()), "_w", lambda x, w: x.cast("double") * w)
        dot = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return with_arrays(df, _w=self.getOrDefault(self.coef)).withColumn(
            "prediction", dot + F.lit(self.intercept)
        ).drop("_w")


@dataclass
class Products:
    """Sums over rows of ``z = (features, target)`` less a pivot: per fold counts and sums, and products by strips in storage."""

    path: str
    pivot: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    strip: int

    @property
    def width(self) -> int:
        return len(self.pivot) - 1

    @property
    def strips(self) -> int:
        return -(-len(self.pivot) // self.strip)

    def means(self, folds: list[int]) -> np.ndarray:
        return self.sums[folds].sum(axis=0) / self.n[folds].sum()

    def block(self, s: int, folds: list[int]) -> np.ndarray:
        """Rows of strip ``s`` of the centred products per row of the folds together."""
        total, m, n = 0.0, self.means(folds), self.n[folds].sum()
        for batch in read_part(self.path, s, 1):
            for fold, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if fold in folds:  # behind the count and the sums
                    total = total + part.values.to_numpy()[len(self.pivot) + 1:].reshape(-1, len(self.pivot))
        at = slice(s * self.strip, (s + 1) * self.strip)
        return total / n - np.outer(m[at], m)


def cross_sums(df: DataFrame, target: str, values: str = "values", fold: str | None = None, folds: int = 1) -> Products:
    """``Products`` of the complete rows of ``df``, by the column ``fold`` (numbers below ``folds``).

    Rows with a missing feature or target are left out.
    """
    z = F.concat(F.col(values).cast("array<double>"), F.array(F.col(target).cast("double")))
    rows = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), z.alias("z"))
    rows = rows.where(F.col("z").isNotNull() & F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v)))
    some = rows.first()
    if some is None:
        raise ValueError("no complete row to fit")
    pivot = np.array(some.z)
    width = len(pivot)
    strip = max(1, min(width, STRIP // width))
    at_once = max(1, HELD // (strip * width))  # strips that a pass adds up
    strips = list(range(-(-width // strip)))

    def partial(mine: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}

            def hand_over() -> Iterator[pa.RecordBatch]:
                for f, (n, s, products) in held.items():
                    for i, p in zip(mine, products, strict=True):
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([i], pa.int32()), "fold": pa.array([f], pa.int32()),
                            "p": number_lists([np.concatenate([[n], s, p.ravel()])]),
                        })
                held.clear()

            for part, z in blocks(batches, 1):
                if z.shape[1] != width:
                    raise ValueError(f"a row has {z.shape[1] - 1} features, others {width - 1}")
                z = z - pivot
                of = part.column(0).to_numpy()
                for f in np.unique(of):
                    x = z[of == f]
                    if f not in held:
                        if held and (len(held) + 1) * len(mine) * strip * width > HELD:
                            yield from hand_over()  # more folds than fit
                        held[f] = [0, np.zeros(width), [np.zeros((min(strip, width - i * strip), width)) for i in mine]]
                    sums = held[f]
                    sums[0] += len(x)
                    sums[1] += x.sum(axis=0)
                    for i, p in zip(mine, sums[2], strict=True):
                        p += x[:, i * strip:(i + 1) * strip].T @ x
            yield from hand_over()

        return run

    schema, parts = "part int, fold int, p array<double>", None
    for i in range(0, len(strips), at_once):
        made = rows.mapInArrow(partial(strips[i:i + at_once]), schema)
        parts = made if parts is None else parts.unionAll(made)
    path = store_parts(summed(parts, ["part", "fold"], "p").select("fold", "p", "part"), "products")
    n, sums = np.zeros(folds, np.int64), np.zeros((folds, width))
    for r in df.sparkSession.read.parquet(path).where("part = 0").select("fold", F.slice("p", 1, width + 1).alias("s")).collect():
        n[r.fold], sums[r.fold] = round(r.s[0]), r.s[1:]
    return Products(path, pivot, n, sums, strip)


@dataclass
class Strips:
    """The centred products of some folds, strip by strip; the last strips read are kept."""

    products: Products
    folds: list[int]
    kept: dict[int, np.ndarray] = field(default_factory=dict)

    def get(self, s: int) -> np.ndarray:
        if s not in self.kept:
            if len(self.kept) >= max(1, HELD // (self.products.strip * len(self.products.pivot))):
                self.kept.pop(next(iter(self.kept)))
            self.kept[s] = self.products.block(s, self.folds)
        return self.kept[s]

    def solve(self, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
        """Coefficients that minimise ``|y - xw|^2 / 2n + l1 |w| + l2/2 |w|^2``, strip by strip until nothing moves.

        With all other coefficients held, a strip is solved exactly: by a system
        of equations without ``l1``, else by descent along its coordinates.
        """
        w, width, step = start.copy(), self.products.width, self.products.strip
        for _ in range(ROUNDS):
            before = w.copy()
            for s in range(self.products.strips):
                g = self.get(s)
                lo, hi = s * step, min((s + 1) * step, width)
                if lo >= hi:
                    continue
                own = g[:hi - lo, lo:hi]
                rest = g[:hi - lo, width] - g[:hi - lo, :width] @ w + own @ w[lo:hi]
                w[lo:hi] = _plain(own, rest, l2) if not l1 else _descend(own, rest, l1, l2, w[lo:hi])
            if width <= step or np.abs(w - before).max(initial=0) <= CLOSE * max(1e-300, np.abs(w).max(initial=0)):
                break
        return w

    def quality(self, w: np.ndarray) -> tuple[float, float, float, float]:
        """Of the target and of ``xw`` on these folds: variances, covariance, and the mean of ``y - xw`` (about the pivot)."""
        width, step = self.products.width, self.products.strip
        vy = cov = var = 0.0
        for s in range(self.products.strips):
            g = self.get(s)
            lo, hi = s * step, min((s + 1) * step, width)
            var += w[lo:hi] @ (g[:hi - lo, :width] @ w)
            cov += w[lo:hi] @ g[:hi - lo, width]
            if (s + 1) * step > width:
                vy = g[width - lo, width]
        m = self.products.means(self.folds)
        return float(vy), float(var), float(cov), float(m[width] - m[:width] @ w)


def _plain(g: np.ndarray, b: np.ndarray, l2: float) -> np.ndarray:
    """Solution of ``(g + l2) w = b``; the shortest one where features depend on each other."""
    a = g + l2 * np.eye(len(g))
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    values, vectors = np.linalg.eigh(a / np.outer(size, size))
    good = values > 1e-13 * max(values.max(initial=0), 1e-300) * len(g)
    inverse = np.divide(1.0, values, out=np.zeros(len(values)), where=good)
    return vectors @ (inverse * (vectors.T @ (b / size))) / size


def _descend(g: np.ndarray, b: np.ndarray, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent on ``w'gw/2 - b'w + l1 |w| + l2/2 |w|^2``; sweeps over moving coordinates between full ones."""
    w, size = start.copy(), np.diag(g) + l2
    rest = b - g @ w
    usable = np.flatnonzero(size > 0)
    some = usable
    for _ in range(ROUNDS):
        most = 0.0
        for j in some:
            rho = rest[j] + (size[j] - l2) * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / size[j]
            if new != w[j]:
                most = max(most, abs(new - w[j]) * np.sqrt(size[j]))
                rest -= g[:, j] * (new - w[j])
                w[j] = new
        if most <= CLOSE * max(1e-300, np.abs(w * np.sqrt(size)).max(initial=0)):
            if len(some) == len(usable):
                break
            some = usable
        else:
            some = np.flatnonzero(w)
            if not len(some):
                some = usable
    return w


Penalty = Callable[[int], tuple[float, float]]


def fit_penalty(df: DataFrame, target: str, penalty: Penalty, values: str = "values") -> LinearTableModel:
    """The fit of one penalty, ``penalty(rows)`` as ``l1, l2``."""
    return fit_products(cross_sums(df, target, values), penalty, df, values)


def fit_products(products: Products, penalty: Penalty, df: DataFrame, values: str = "values") -> LinearTableModel:
    """A task reads the products and solves; the coefficients come back."""
    folds = list(range(len(products.n)))
    l1, l2 = penalty(int(products.n.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            w = Strips(products, folds).solve(l1, l2, np.zeros(products.width))
            yield pa.RecordBatch.from_pydict({"w": [w.tobytes()]})

    one = df.sparkSession.range(1).mapInArrow(run, "w binary").first()
    w, m = np.frombuffer(one.w), products.means(folds) + products.pivot
    return LinearTableModel(w.tolist(), float(m[-1] - m[:-1] @ w))._set(valuesCol=values)


SCORES = pa.schema([("group", pa.int32()), ("candidate", pa.int32()), ("fold", pa.int32()), ("r2", pa.float64()), ("pearson", pa.float64())])


def scores_of(products: Products, train: Strips, held: Strips, w: np.ndarray) -> tuple[float | None, float | None]:
    """R2 and Pearson on the folds of ``held`` of the model ``w`` with its intercept from ``train``; None for a constant side."""
    vy, var, cov, off = held.quality(w)
    m = products.means(train.folds)
    off -= m[-1] - m[:-1] @ w
    flat = 1e-13 * max(abs(vy), 1e-300)
    if vy <= flat:
        return None, None
    return 1 - (vy - 2 * cov + var + off * off) / vy, cov / float(np.sqrt(vy * var)) if var > flat else None


def product_scores(products: Products, fits: list[Penalty | Evidence], groups: list[tuple[list[int], list[int]]], df: DataFrame) -> DataFrame:
    """``group, candidate, fold, r2, pearson``: each of ``fits`` made on a group's first folds and scored on each of its second.

    No row is read again: the scores of a linear model on held-out rows follow
    from their products, too. A task takes a group and goes through the
    penalties from the strongest to the weakest, each starting where the last ended.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                train, made = Strips(products, groups[g][0]), []
                held = {f: Strips(products, [f]) for f in groups[g][1]}
                n = int(products.n[train.folds].sum())
                w = np.zeros(products.width)
                at = {i: (0.0, 0.0) if isinstance(f, Evidence) else f(n) for i, f in enumerate(fits)}
                for i in sorted(at, key=lambda i: [-x for x in at[i]]):
                    w = fits[i].solve(train, n) if isinstance(fits[i], Evidence) else train.solve(*at[i], w)
                    made += [dict(zip(SCORES.names, (g, i, f, *scores_of(products, train, held[f], w)), strict=True)) for f in held]
                yield pa.RecordBatch.from_pylist(made, SCORES)

    dealt = df.sparkSession.createDataFrame([(g,) for g in range(len(groups))], "g int").repartition(max(1, len(groups)))
    return dealt.mapInArrow(run, "group int, candidate int, fold int, r2 double, pearson double")


def fold_scores(products: Products, fits: list[Penalty | Evidence], df: DataFrame) -> DataFrame:
    """``candidate, fold, r2, pearson`` of each of ``fits``, made on all folds but one and scored on that one."""
    folds = [f for f in range(len(products.n)) if products.n[f]]
    groups = [([g for g in folds if g != f], [f]) for f in folds if len(folds) > 1]
    return product_scores(products, fits, groups, df).drop("group")


# -- evidence --------------------------------------------------------------------------------------

def times(products: Products, v: np.ndarray, df: DataFrame) -> np.ndarray:
    """Centred products of the features times ``v`` (features x columns), strip by strip in tasks."""
    spark, width, step = df.sparkSession, products.width, products.strip
    sent, folds = spark.sparkContext.broadcast(v), list(range(len(products.n)))
    count = -(-width // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                g = products.block(s, folds)[:min(step, width - s * step), :width]
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int64()), "p": [(g @ sent.value).tobytes()]})

    out = np.empty(v.shape)
    for r in spark.range(count).repartition(count).mapInArrow(run, "s bigint, p binary").collect():
        part = np.frombuffer(r.p).reshape(-1, v.shape[1])
        out[r.s * step:r.s * step + len(part)] = part
    sent.destroy()
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, steps: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Krylov bases and tridiagonal matrices of a symmetric operator, from each column of ``starts``; all share one product a step.

    Bases are kept orthogonal in full. A column ends early where its space is closed.
    """
    width, count = starts.shape
    norms = np.linalg.norm(starts, axis=0)
    bases = [[starts[:, i] / norms[i]] if norms[i] else [] for i in range(count)]
    diagonal: list[list[float]] = [[] for _ in range(count)]
    beside: list[list[float]] = [[] for _ in range(count)]
    live = [i for i in range(count) if norms[i]]
    for _ in range(min(steps, width)):
        if not live:
            break
        made = apply(np.stack([bases[i][-1] for i in live], axis=1))
        for column, i in enumerate(list(live)):
            r, q = made[:, column], np.stack(bases[i], axis=1)
            diagonal[i].append(float(q[:, -1] @ r))
            for _ in range(2):
                r = r - q @ (q.T @ r)
            size = float(np.linalg.norm(r))
            if size <= 1e-10 * max(map(abs, diagonal[i])) or len(diagonal[i]) == min(steps, width):
                live.remove(i)
            else:
                beside[i].append(size)
                bases[i].append(r / size)
    tri = [np.diag(d) + np.diag(b[:len(d) - 1], 1) + np.diag(b[:len(d) - 1], -1) if d else np.zeros((0, 0)) for d, b in zip(diagonal, beside, strict=True)]
    return [np.stack(b[:len(d)], axis=1) if d else np.zeros((width, 0)) for b, d in zip(bases, diagonal, strict=True)], tri


@dataclass(frozen=True)
class Evidence:
    """Ridge whose noise and weight precisions maximise the evidence.

    The Krylov space from the feature-target products gives the coefficients of
    every precision (what conjugate gradients would find for each); the
    effective number of weights is a trace, from the Krylov spaces of ``probes``
    orthogonal directions: exact where there are as many as features, an
    estimate beyond. All are found by the same ``steps`` products at most; the
    iteration over precisions needs none.
    """

    max_iter: int = 300
    tol: float = 1e-3
    probes: int = 64
    steps: int = 128
    seed: int = 42

    def solve(self, strips: Strips, n: int) -> np.ndarray:
        """Coefficients from products that are one strip."""
        g, width = strips.get(0), strips.products.width
        return self.coefficients(lambda v: g[:width, :width] @ v, g[:width, width], float(g[width, width]), n)

    def coefficients(self, apply: Callable[[np.ndarray], np.ndarray], xy: np.ndarray, yy: float, n: int) -> np.ndarray:
        """From products with the features, feature-target products and target variance, all per row, and the number of rows."""
        width = len(xy)
        # fewer directions where their bases would not fit
        k = max(1, min(self.probes, width, max(8, HELD // (width * min(self.steps, width)))))
        directions = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((width, k)))[0] * np.sqrt(width / k)
        bases, tri = lanczos(apply, np.column_stack([xy, directions]), self.steps)
        # sums over rows, as the evidence has them
        sums = [np.linalg.eigh(n * t) for t in tri]
        spectrum, share = [np.maximum(s[0], 0.0) for s in sums], [s[1][0] ** 2 if len(s[0]) else s[0] for s in sums]
        size, total = n * float(np.linalg.norm(xy)), n * yy
        prior = 1e-6  # fixed value: both gamma priors
        noise, weight = 1.0 / (yy + np.finfo(float).eps), 1.0
        old = None

        def best() -> np.ndarray:
            if not size:
                return np.zeros(width)
            return bases[0] @ (sums[0][1] @ (size * sums[0][1][0] / (spectrum[0] + weight / noise)))

        for _ in range(self.max_iter):
            coef = best()
            inside = bases[0].T @ coef
            sse = max(total - 2 * n * (coef @ xy) + inside @ (n * tri[0]) @ inside, 0.0)
            used = width / k * sum(float((w * lam / (lam + weight / noise)).sum()) for lam, w in zip(spectrum[1:], share[1:], strict=True))
            weight = (used + 2 * prior) / (coef @ coef + 2 * prior)
            noise = (n - used + 2 * prior) / (sse + 2 * prior)
            if old is not None and np.sum(np.abs(old - coef)) < self.tol:
                break
            old = coef
        return best()


def fit_evidence(df: DataFrame, target: str, values: str = "values", how: Evidence = Evidence()) -> LinearTableModel:
    """The evidence's ridge. Products of many strips are never brought together: each step multiplies them where they are read."""
    products = cross_sums(df, target, values)
    n, width = int(products.n.sum()), products.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if products.strips == 1:
                    made = how.solve(Strips(products, [0]), n)
                else:  # the target's column
                    made = np.ascontiguousarray(products.block(s, [0])[:, width])
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int64()), "c": [made.tobytes()]})

    parts = df.sparkSession.range(products.strips).mapInArrow(run, "s bigint, c binary").collect()
    flat = np.concatenate([np.frombuffer(r.c) for r in sorted(parts)])
    coef = flat if products.strips == 1 else how.coefficients(lambda v: times(products, v, df), flat[:width], float(flat[width]), n)
    m = products.means([0]) + products.pivot
    return LinearTableModel(coef.tolist(), float(m[-1] - m[:-1] @ coef))._set(valuesCol=values)
