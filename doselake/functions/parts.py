"""Tables stored by a partition column, which tasks read part by part when they need them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame

from doselake.session import scratch_path


def store_parts(df: DataFrame, label: str) -> str:
    """Writes ``df`` by its column ``part`` below the shared folder; gives the path."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy("part").parquet(path)
    return path


def read_part(path: str, part: int, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The rows of a part, ``rows`` at a time; none if nothing was stored for it."""
    fs, at = FileSystem.from_uri(path)
    for info in fs.get_file_info(FileSelector(f"{at}/part={part}", allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows)
