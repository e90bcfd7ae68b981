"""Expression-matrix operators on ``(key, values ARRAY)`` rows.

Row-wise maths stays on the array. The long form is used only to aggregate per
gene, where map-side combining leaves one row per gene and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain as flatten

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake.functions.arrays import CELLS, as_block, blocks, number_lists, summed
from doselake.functions.quantiles import array_moments, array_quantiles, exact_quantiles
from doselake.operators.select import pick_genes
from doselake.schema import nan_to_null
from doselake.session import cut_lineage


def exploded(df: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Array cells as rows ``keys, pos, x``.

    Spark guards an inner explode with a filter on the array's size, which would
    compute a derived array twice; filtering the position afterwards is free.
    """
    return df.select(*keys, F.posexplode_outer(values).alias("pos", "x")).where("pos IS NOT NULL")


def to_long(matrix: DataFrame, key: str = "sig_id", values: str = "values") -> DataFrame:
    """One row per cell: ``key, pos, x``; NaN becomes NULL."""
    return exploded(matrix, [key], values).select(
        key, "pos", nan_to_null(F.col("x").cast("double")).alias("x")
    )


def to_wide(long: DataFrame, key: str = "sig_id") -> DataFrame:
    """One array per key in gene order; a group is one matrix row, never more."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return long.groupBy(key).agg(F.transform(cells, lambda c: c["x"]).alias("values"))


def gene_stats(
    matrix: DataFrame, probs: list[float] | None = None, values: str = "values"
) -> DataFrame:
    """Per gene count, mean, population std, and exact quantiles, missing ignored.

    Cells are added up as whole arrays where they lie; quantiles are found at
    once, by counting (``array_quantiles``).
    """
    if probs:
        stats = matrix.sparkSession.createDataFrame(array_quantiles(matrix, probs, values))
    else:
        stats = array_moments(matrix, values)
    variance = F.try_divide("m2", "n")
    return stats.select(
        "pos", F.col("n").alias("n_present"), "mean", F.sqrt(variance).alias("std"), variance.alias("variance"),
        *(["q"] if probs else []),
    )


def per_gene_array(stats: DataFrame, value: Column) -> DataFrame:
    """One row with one array: ``value`` per gene in gene order."""
    cells = F.array_sort(F.collect_list(F.struct(F.col("pos"), value.cast("double").alias("v"))))
    return stats.agg(F.transform(cells, lambda c: c["v"]).alias("a"))


def with_arrays(df: DataFrame, **arrays: list[float]) -> DataFrame:
    """Fitted per-gene arrays as columns, by way of a one-row subquery."""
    names = list(arrays)
    schema = ", ".join(f"{n} ARRAY<DOUBLE>" for n in names)
    row = tuple([None if v is None else float(v) for v in arrays[n]] for n in names)
    one = df.sparkSession.createDataFrame([row], schema)
    boxed = df.withColumn("_box", one.select(F.struct(*names)).scalar())
    return boxed.select("*", *[F.col(f"_box.{n}").alias(n) for n in names]).drop("_box")


def _double(values: str) -> Column:
    return F.transform(F.col(values), lambda x: nan_to_null(x.cast("double")))


class _OnValues(Params):
    """Shared parameter: the array column a stage reads and replaces."""

    valuesCol = Param(Params._dummy(), "valuesCol", "array column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(valuesCol="values")

    def values(self) -> str:
        return self.getOrDefault(self.valuesCol)


class AffineModel(_OnValues, Model, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - center) / scale`` per gene."""

    center = Param(Params._dummy(), "center", "per gene", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "per gene", TypeConverters.toListFloat)

    def __init__(self, center: list[float] | None = None, scale: list[float] | None = None) -> None:
        super().__init__()
        if center is not None:
            self._set(center=center, scale=scale)

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        both = with_arrays(
            df, _center=self.getOrDefault(self.center), _scale=self.getOrDefault(self.scale)
        )
        shifted = F.zip_with(_double(v), "_center", lambda x, c: x - c)
        return both.withColumn(v, F.zip_with(shifted, "_scale", lambda x, s: x / s)).drop("_center", "_scale")


def _collect(stats: DataFrame) -> list:
    # one row per gene: as wide as a single matrix row
    return stats.orderBy("pos").collect()


class StandardScaler(_OnValues, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean 0 and population std 1 per gene; a constant gene is divided by 1."""

    def _fit(self, df: DataFrame) -> AffineModel:
        rows = _collect(gene_stats(df, values=self.values()))
        return AffineModel([r["mean"] for r in rows], [r["std"] or 1.0 for r in rows])


class RobustScaler(_OnValues, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - median) / (upper - lower percentile)``, exact; zero range counts as 1."""

    lower = Param(Params._dummy(), "lower", "percent", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "percent", TypeConverters.toFloat)

    def __init__(self, quantile_range: tuple[float, float] = (25.0, 75.0)) -> None:
        super().__init__()
        self._set(lower=float(quantile_range[0]), upper=float(quantile_range[1]))

    def _fit(self, df: DataFrame) -> AffineModel:
        lo, hi = self.getOrDefault(self.lower) / 100, self.getOrDefault(self.upper) / 100
        q = array_quantiles(df, [lo, 0.5, hi], self.values()).column("q").to_pylist()
        return AffineModel([g[1] for g in q], [(g[2] - g[0]) or 1.0 for g in q])


class L2Normalizer(_OnValues, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Unit L2 length per row; a zero row is left alone."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        square = F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x * x)
        return df.withColumn("_norm", F.sqrt(square)).withColumn(
            v, F.transform(_double(v), lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x))
        ).drop("_norm")


class ImputeModel(_OnValues, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Missing genes replaced by the fitted value of the gene."""

    fill = Param(Params._dummy(), "fill", "per gene", TypeConverters.toListFloat)

    def __init__(self, fill: list[float] | None = None) -> None:
        super().__init__()
        if fill is not None:
            self._set(fill=fill)

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        return with_arrays(df, _fill=self.getOrDefault(self.fill)).withColumn(
            v, F.zip_with(_double(v), "_fill", lambda x, f: F.coalesce(x, f))
        ).drop("_fill")


class Imputer(_OnValues, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Gene mean or exact gene median."""

    strategy = Param(Params._dummy(), "strategy", "mean or median", TypeConverters.toString)

    def __init__(self, strategy: str = "mean") -> None:
        super().__init__()
        if strategy not in ("mean", "median"):
            raise ValueError(f"unknown imputation strategy: {strategy}")
        self._set(strategy=strategy)

    def _fit(self, df: DataFrame) -> ImputeModel:
        if self.getOrDefault(self.strategy) == "median":
            fill = [g and g[0] for g in array_quantiles(df, [0.5], self.values()).column("q").to_pylist()]
        else:
            fill = [r["mean"] for r in _collect(gene_stats(df, values=self.values()))]
        if any(f is None for f in fill):
            raise ValueError("a gene has no value at all")
        return ImputeModel(fill)


class NoisyRows(_OnValues, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian noise from an md5 of (seed, key, position): stable under retries, and the same in any engine."""

    mean = Param(Params._dummy(), "mean", "", TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "", TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "", TypeConverters.toString)

    def __init__(self, mean: float = 0.0, std: float = 0.01, seed: int = 42, key: str = "sig_id") -> None:
        super().__init__()
        self._set(mean=mean, std=std, seed=seed, key=key)

    def _transform(self, df: DataFrame) -> DataFrame:
        mean, std, seed = (self.getOrDefault(p) for p in (self.mean, self.std, self.seed))
        key = self.getOrDefault(self.key)

        def uniform(i: Column, salt: int) -> Column:
            named = F.concat(F.lit(f"{seed}:{salt}:"), F.col(key).cast("string"), F.lit(":"), i.cast("string"))
            h = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10)
            return (h.cast("double") + 0.5) / F.lit(float(1 << 52))

        def noisy(x: Column, i: Column) -> Column:
            z = F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(2 * math.pi * uniform(i, 2))
            return x + F.lit(mean) + F.lit(std) * z

        return df.withColumn(self.values(), F.transform(_double(self.values()), noisy))


class FeatureDropout(_OnValues, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Sets a seeded set of genes to zero, the same ones in every row."""

    prob = Param(Params._dummy(), "prob", "", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "", TypeConverters.toInt)

    def __init__(self, drop_prob: float = 0.1, seed: int = 42) -> None:
        super().__init__()
        self._set(prob=drop_prob, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        p, seed, v = self.getOrDefault(self.prob), self.getOrDefault(self.seed), self.values()

        def keep(i: Column) -> Column:
            h = F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string")).cast("binary"))
            u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
            return F.when(u < p, F.lit(0.0)).otherwise(F.lit(1.0))

        width = df.agg(F.max(F.size(v)).alias("w")).select(
            F.transform(F.sequence(F.lit(0), F.col("w") - 1), keep)
        )
        return df.withColumn("_mask", width.scalar()).withColumn(
            v, F.zip_with(_double(v), "_mask", lambda x, m: x * m)
        ).drop("_mask")


def chain(stages: list) -> Pipeline:
    """Stages composed in order; fitting passes each stage the previous output."""
    return Pipeline(stages=list(stages))


def impute_metadata(df: DataFrame, strategy: str = "mean") -> DataFrame:
    """Missing viability by mean or median (mean for ``knn``), missing dose by median."""
    if strategy not in ("mean", "median", "knn"):
        raise ValueError(f"unknown imputation strategy: {strategy}")
    how = {"viability": "median" if strategy == "median" else "mean", "pert_dose": "median"}
    for column, kind in how.items():
        if column not in df.columns:
            continue
        x = nan_to_null(F.col(column).cast("double"))
        if kind == "median":
            fill = exact_quantiles(df, [], column, [0.5]).select(F.col("q")[0])
        else:
            fill = df.agg(F.avg(x))
        df = df.withColumn(column, F.coalesce(x, fill.scalar()))
    return df


def outlier_bounds(matrix: DataFrame, threshold: float = 3.0) -> DataFrame:
    """One row: arrays ``lo`` and ``hi``, mean -+ threshold population stds."""
    s = gene_stats(matrix)
    cells = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return s.agg(cells.alias("c")).select(
        F.transform("c", lambda g: g["mean"] - threshold * g["std"]).alias("lo"),
        F.transform("c", lambda g: g["mean"] + threshold * g["std"]).alias("hi"),
    )


def clip_outliers(matrix: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Values beyond ``threshold`` stds of their gene are set to that bound.

    Adds ``n_clipped`` per row; its sum is the number reported overall.
    """
    out = matrix.withColumn(
        "_b", outlier_bounds(matrix, threshold).select(F.struct("lo", "hi")).scalar()
    ).withColumn("_x", _double("values"))
    clipped = F.zip_with(
        F.zip_with("_x", F.col("_b.lo"), lambda x, lo: F.when(x < lo, lo).otherwise(x)),
        F.col("_b.hi"), lambda x, hi: F.when(x > hi, hi).otherwise(x),
    )
    moved = F.zip_with("_x", "values", lambda a, b: (a != b).cast("int"))
    return out.withColumn("values", clipped).withColumn(
        "n_clipped", F.aggregate(moved, F.lit(0), lambda a, m: a + F.coalesce(m, F.lit(0)))
    ).drop("_b", "_x")


def variance_threshold(matrix: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Genes of population variance above the threshold, and their table."""
    kept = gene_stats(matrix).where(F.col("variance") > threshold).select("pos", "variance")
    return pick_genes(matrix, kept), kept


#: Cells of a strip of products, and of all that a task adds up at a time.
STRIP_CELLS, HELD_CELLS = 1 << 20, 1 << 24


def strip_sums(matrix: DataFrame, width: int, strip: int, pivot: np.ndarray | None = None) -> DataFrame:
    """``strip, p``: number of rows, sums, then products of the genes of a strip with all genes, of rows less ``pivot``.

    One scan adds up as many strips as ``HELD_CELLS`` allow: all of them up to
    some 4,000 genes. Each task gives one row a strip, which are added as they come.
    """
    strips, at_once = list(range(-(-width // strip))), max(1, HELD_CELLS // (strip * width))
    shift = np.zeros(width) if pivot is None else pivot

    def partial(mine: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, products = 0, np.zeros(width), [np.zeros((min(strip, width - i * strip), width)) for i in mine]
            for _, x in blocks(batches):
                x = x - shift
                n, sums = n + len(x), sums + x.sum(axis=0)
                for i, p in zip(mine, products, strict=True):
                    p += x[:, i * strip:(i + 1) * strip].T @ x
            if n:
                rows = [np.concatenate([[n], sums, p.ravel()]) for p in products]
                yield pa.RecordBatch.from_pydict({"strip": pa.array(mine, pa.int32()), "p": number_lists(rows)})
        return run

    rows, parts = matrix.select(_double("values").alias("values")), None
    for i in range(0, len(strips), at_once):
        made = rows.mapInArrow(partial(strips[i:i + at_once]), "strip int, p array<double>")
        parts = made if parts is None else parts.unionAll(made)
    return summed(parts, ["strip"], "p")


def cross_products(matrix: DataFrame, width: int, strip: int = 1024) -> DataFrame:
    """Sums of ``x_i * x_j`` over all rows of a complete matrix, as ``(i, row ARRAY)``."""
    first = 1 + width
    sums = strip_sums(matrix, width, strip)
    rows = F.transform(
        F.sequence(F.lit(0), ((F.size("p") - first) / width).cast("int") - 1), lambda k: F.slice("p", k * width + first + 1, F.lit(width))
    )
    return sums.select(F.col("strip"), F.posexplode(rows).alias("k", "row")).select((F.col("strip") * strip + F.col("k")).alias("i"), "row")


def matrix_width(matrix: DataFrame) -> int:
    return matrix.select(F.size("values").alias("w")).first()["w"]


def corr_matrix(matrix: DataFrame, width: int | None = None) -> DataFrame:
    """Pearson between all gene pairs ``i < j`` of a complete matrix; null with a constant gene.

    Products are taken about one row, so that they keep their digits, and
    centred where they are read.
    """
    some = matrix.select(_double("values").alias("values")).first()
    if some is None:
        return matrix.sparkSession.createDataFrame([], "i int, j int, r double")
    pivot = np.array(some["values"], np.float64)
    width = width or len(pivot)
    strip = max(1, min(width, STRIP_CELLS // width))
    sums = cut_lineage(strip_sums(matrix, width, strip, pivot))

    def centred(s: int, p: np.ndarray) -> np.ndarray:
        n, mean = p[0], p[1:width + 1] / p[0]
        c = p[width + 1:].reshape(-1, width) / n
        return c - np.outer(mean[s * strip:s * strip + len(c)], mean)

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = centred(s, p.values.to_numpy())
                yield pa.RecordBatch.from_pydict({"strip": pa.array([s], pa.int32()), "d": number_lists([c[np.arange(len(c)), s * strip + np.arange(len(c))]])})

    spread = np.concatenate([r["d"] for r in sorted(sums.mapInArrow(diagonal, "strip int, d array<double>").collect())])  # as wide as a row
    size = np.sqrt(np.maximum(spread, 0))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = centred(s, p.values.to_numpy())
                step = max(1, CELLS // width)
                for lo in range(0, len(c), step):
                    i, j = np.nonzero(np.arange(width) > (s * strip + lo + np.arange(len(c[lo:lo + step])))[:, None])
                    at = s * strip + lo + i
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r = c[lo + i, j] / (size[at] * size[j])
                    yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "j": pa.array(j, pa.int32()), "r": pa.array(r, mask=~np.isfinite(r))})

    return sums.mapInArrow(pairs, "i int, j int, r double")


def high_corr_pairs(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    return corr.where((F.abs("r") > threshold) & (F.col("r") != 1))


def leading_eigenvectors(
    apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, k: int, passes: int = 300, close: float = 1e-9
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric operator, by block Krylov iteration.

    Each pass applies the operator to one block of at most as many columns as
    ``start`` has: what the vectors found so far still lack, made orthogonal to
    all kept. Ends when that is ``close`` to nothing. Six blocks are kept, then
    the best two of them go on.
    """
    width, step = start.shape
    q, made = np.zeros((width, 0)), np.zeros((width, 0))
    block = start
    for _ in range(passes):
        for _ in range(2):
            block = block - q @ (q.T @ block)
            block, r = np.linalg.qr(block)
            block = block[:, np.abs(np.diag(r)) > 1e-12 * max(1e-300, np.abs(np.diag(r)).max(initial=0))]
        block = block[:, :width - q.shape[1]]
        if block.shape[1]:
            q, made = np.concatenate([q, block], axis=1), np.concatenate([made, apply(block)], axis=1)
        small = q.T @ made
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        lack = made @ turn - vectors * values
        missing = np.linalg.norm(lack[:, :k], axis=0)
        if q.shape[1] >= width or not block.shape[1] or missing.max(initial=0) <= close * max(abs(values[0]), 1e-300):
            break
        block = lack[:, np.argsort(-missing, kind="stable")[:step]] if len(missing) > step else lack[:, :step]
        if q.shape[1] + step > 6 * step:
            q, made = vectors[:, :2 * step], (made @ turn)[:, :2 * step]
    return np.maximum(values[:k], 0.0), vectors[:, :k]


class CenteredPCA:
    """Principal components of centred data, sign fixed by the largest loading; a missing value counts as the gene's mean.

    Found from products of the rows with a few columns at a time, summed in
    Spark: the driver holds genes x components, never genes x genes. With
    ``variance`` components are doubled until their share is reached.
    """

    def __init__(self, k: int | None = None, variance: float | None = None, seed: int = 42) -> None:
        if (k is None) == (variance is None):
            raise ValueError("give either k or the variance to retain")
        self.k, self.variance, self.seed = k, variance, seed

    def fit(self, matrix: DataFrame) -> CenteredPCAModel:
        seen = array_moments(matrix).toArrow().sort_by("pos")
        mean = np.nan_to_num(seen.column("mean").to_numpy())
        total, width = float(np.nan_to_num(seen.column("m2").to_numpy()).sum()), len(mean)
        spark, rng = matrix.sparkSession, np.random.default_rng(self.seed)

        def apply(v: np.ndarray) -> np.ndarray:
            sent, columns = spark.sparkContext.broadcast((mean, v)), v.shape[1]
            step = max(1, (1 << 14) // columns)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                middle, v = sent.value
                out = np.zeros(v.shape)
                for _, x in blocks(batches):
                    x = np.nan_to_num(x - middle[:x.shape[1]])
                    out[:x.shape[1]] += x.T @ (x @ v[:x.shape[1]])
                parts = [out[i:i + step] for i in range(0, len(out), step)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "part": number_lists(parts)})

            made = np.zeros(v.shape)
            for r in summed(matrix.select("values").mapInArrow(run, "block int, part array<double>"), ["block"], "part").collect():
                made[r.block * step:(r.block + 1) * step] = np.reshape(r.part, (-1, columns))
            sent.destroy()
            return made

        k = min(self.k or 8, width)
        vectors = np.zeros((width, 0))
        while True:
            start = np.concatenate([vectors, rng.standard_normal((width, min(k + 4, width) - vectors.shape[1]))], axis=1)
            values, vectors = leading_eigenvectors(apply, start, k)
            share = np.divide(values, total, out=np.zeros(len(values)), where=total > 0)
            if self.k or k == width or share.sum() >= self.variance - 1e-12:
                break
            k = min(2 * k, width)
        if self.variance is not None:
            keep = min(int(np.searchsorted(np.cumsum(share), self.variance - 1e-12) + 1), len(share))
            share, vectors = share[:keep], vectors[:, :keep]
        top = np.abs(vectors).argmax(axis=0)
        sign = np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        return CenteredPCAModel(mean, vectors * sign, share)


class CenteredPCAModel:
    def __init__(self, mean: np.ndarray, loadings: np.ndarray, ratio: np.ndarray) -> None:
        self.mean, self.loadings, self.ratio = mean, loadings, ratio

    def transform(self, matrix: DataFrame) -> DataFrame:
        """Adds ``components``, drops ``values``; works on any split with the fitted mean and loadings."""
        sent = matrix.sparkSession.sparkContext.broadcast((self.mean, self.loadings))  # genes x components

        @F.pandas_udf("array<double>")
        def project(values: pd.Series) -> pd.Series:
            mean, loadings = sent.value
            out: list[np.ndarray] = []
            step = max(1, CELLS // max(1, len(mean)))
            for i in range(0, len(values), step):
                x = as_block(pa.array(values.iloc[i:i + step], pa.list_(pa.float64())))
                out += list(np.nan_to_num(x - mean[:x.shape[1]]) @ loadings[:x.shape[1]])
            return pd.Series(out)

        return matrix.withColumn("components", project(F.col("values").cast("array<double>"))).drop("values")

    def explained_variance(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(r)) for i, r in enumerate(self.ratio)]
        return spark.createDataFrame(rows, "component INT, ratio DOUBLE")

    def top_loadings(self, spark: SparkSession, top: int = 10) -> DataFrame:
        """The ``top`` genes per component by absolute loading."""
        order = np.argsort(-np.abs(self.loadings), axis=0, kind="stable")[:top]
        rows = flatten.from_iterable(
            [(c, r + 1, int(g), float(self.loadings[g, c])) for r, g in enumerate(order[:, c])]
            for c in range(self.loadings.shape[1])
        )
        return spark.createDataFrame(list(rows), "component INT, rank INT, pos INT, loading DOUBLE")


def concat_features(df: DataFrame, parts: list[str], scalars: list[str], out: str = "features") -> DataFrame:
    """One vector per sample: the modality arrays, then the scalars."""
    arrays = [F.col(p).cast("array<double>") for p in parts]
    tail = F.array(*[F.col(s).cast("double") for s in scalars]) if scalars else F.array().cast("array<double>")
    return df.withColumn(out, F.concat(*arrays, tail))
