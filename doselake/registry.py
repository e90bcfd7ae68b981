"""Operators by name, and hooks for user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.functions import chem
from doselake.operators import matrix as M


def create_transform(kind: str, **kw) -> Estimator | Transformer:
    """``normalize``, ``scale``, ``robust``, or ``compound`` with nested specs."""
    if kind == "compound":
        specs = kw.get("transforms", [])
        return M.chain([
            create_transform(s["type"], **{k: v for k, v in s.items() if k != "type"}) for s in specs
        ])
    if kind == "normalize":
        return M.L2Normalizer()
    if kind == "scale":
        return M.StandardScaler()
    if kind == "robust":
        return M.RobustScaler(kw.get("quantile_range", (25.0, 75.0)))
    raise ValueError(f"unknown transform: {kind}")


def create_features(kind: str, **kw) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """``fingerprint`` or ``descriptors``: a function of (table, key, structure, dose)."""
    if kind == "fingerprint":
        return lambda df, key, s, d: chem.fingerprint_ngrams(df, s, d, **kw)
    if kind == "descriptors":
        return lambda df, key, s, d: chem.robust_descriptors(df, key, s, d, **kw)
    raise ValueError(f"unknown feature kind: {kind}")


def create_augmentation(kind: str, **kw) -> Transformer:
    """``noise`` or ``dropout``."""
    if kind == "noise":
        return M.NoisyRows(**kw)
    if kind == "dropout":
        return M.FeatureDropout(**kw)
    raise ValueError(f"unknown augmentation: {kind}")


def row_transform(df: DataFrame, column: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a column function, or a pandas UDF, to one column of every sample."""
    return df.withColumn(column, fn(F.col(column)))


def fit_transform(hook: object, df: DataFrame) -> DataFrame:
    """Run a hook: fit then transform, transform, or a plain function of the table."""
    if hasattr(hook, "fit"):
        return hook.fit(df).transform(df)
    if hasattr(hook, "transform"):
        return hook.transform(df)
    if callable(hook):
        return hook(df)
    raise TypeError("hook needs fit, transform, or to be callable")
