"""Array columns in Arrow tasks as NumPy blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

#: Cells handled at a time within a task, however many rows or genes a batch has.
CELLS = 1 << 20


def as_block(column: pa.Array) -> np.ndarray:
    """Rows x width as doubles; missing cells, null rows and the ends of shorter rows are NaN."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their array column as a block of about ``CELLS`` cells."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        width = max(1, pc.max(pc.list_value_length(batch.column(column))).as_py() or 1)
        step = max(1, CELLS // width)
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, as_block(part.column(column))


def summed(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sum of the arrays ``column`` (of one length per key) by ``keys``: one array is held at a time, however many there are."""
    return parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(column))).alias(column))


def number_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Flat arrays of doubles as one array column."""
    offsets = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.float64)))
