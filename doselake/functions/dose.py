"""Dose-response scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig3upper(center: Column, slope: Column, baseline: Column, x: Column, clip: bool = True) -> Column:
    """Three-parameter sigmoid with upper limit 1; a zero slope gives NULL."""
    exponent = F.try_divide(-(x - center), slope)
    if clip:
        exponent = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), exponent))
        exponent = F.when(slope != 0, exponent)
    return baseline + (1 - baseline) / (1 + F.exp(exponent))


def log2_dose(dose: Column) -> Column:
    """log2 of a positive dose, NULL otherwise."""
    return F.when(dose > 0, F.log2(dose))


def clip_unit(v: Column) -> Column:
    """Clip to [0, 1]; NULL stays NULL."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
