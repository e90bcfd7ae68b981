"""Flat row-major matrices as a Spark data source, ``flat_matrix``.

A matrix is one file of ``rows x cols`` numbers, or a folder of parts that
follow each other. It is read by byte ranges that begin with a row, and written
as a part per task; files are reached through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

#: Bytes of a range, and of a batch within it.
RANGE, BATCH = 64 << 20, 4 << 20
#: Names the parts of a folder in order, with their rows; written last, so a folder without it is not complete.
PARTS = "_parts.json"


@dataclass
class Shape:
    """The options of a matrix: ``path``, ``cols``, ``dtype`` and, to be checked, ``rows``."""

    path: str
    cols: int
    dtype: str
    rows: int | None

    @classmethod
    def of(cls, options: dict[str, str]) -> Shape:
        missing = {"path", "cols"} - set(options)
        if missing:
            raise ValueError(f"flat_matrix needs the options {sorted(missing)}")
        if int(options["cols"]) < 1:
            raise ValueError("cols must be 1 or more")
        rows = options.get("rows")
        return cls(options["path"], int(options["cols"]), np.dtype(options.get("dtype", "float64")).str, None if rows is None else int(rows))

    @property
    def width(self) -> int:
        return self.cols * np.dtype(self.dtype).itemsize

    @cached_property
    def fs(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def parts(self) -> list[tuple[str, int]]:
        """Files in order with their rows; sizes that do not fit the shape are an error."""
        fs, at = self.fs
        if fs.get_file_info(at).type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        if fs.get_file_info(at).type == FileType.File:
            files = [at]
        else:
            with fs.open_input_stream(f"{at}/{PARTS}") as f:
                files = [f"{at}/{name}" for name in json.loads(f.read())]
        sizes = [i.size for i in fs.get_file_info(files)]
        if any(s % self.width for s in sizes) or (self.rows is not None and sum(sizes) != self.rows * self.width):
            raise ValueError(f"{self.path} holds {sum(sizes)} bytes, expected {'rows' if self.rows is None else self.rows} x {self.width}")
        return [(f, s // self.width) for f, s in zip(files, sizes, strict=True)]


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``first + rows`` of the matrix, which begin in ``file`` at row ``start``."""

    file: str
    start: int
    rows: int
    first: int


class FlatMatrix(DataSource):
    """``spark.read.format("flat_matrix").option("cols", n)``: rows ``row_no, values``.

    Options: ``cols``, ``dtype`` (NumPy's name, float64 by default) and ``rows``
    (checked if given). Values are 32-bit floats; NaN is kept. Writing takes
    rows ``values`` (an array column; others are left out) in the order of the
    DataFrame's partitions; a null cell becomes NaN, another width is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "flat_matrix"

    def schema(self) -> str:
        return "row_no bigint, values array<float>"

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(Shape.of(self.options))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(Shape.of(self.options), overwrite)


class Reader(DataSourceReader):
    def __init__(self, shape: Shape):
        self.shape = shape

    def partitions(self) -> list[Range]:
        step, out, first = max(1, RANGE // self.shape.width), [], 0
        for file, rows in self.shape.parts():
            for start in range(0, rows, step):
                out.append(Range(file, start, min(step, rows - start), first + start))
            first += rows
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a matrix without rows has no ranges
            return
        (fs, _), width, step = self.shape.fs, self.shape.width, max(1, BATCH // self.shape.width)
        with fs.open_input_file(partition.file) as f:
            f.seek(partition.start * width)
            for done in range(0, partition.rows, step):
                n = min(step, partition.rows - done)
                flat = np.frombuffer(f.read(n * width), self.shape.dtype).astype(np.float32)
                if len(flat) != n * self.shape.cols:
                    raise ValueError(f"{partition.file} became shorter")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.shape.cols)
                row_no = pa.array(partition.first + done + np.arange(n))
                yield pa.RecordBatch.from_arrays([row_no, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["row_no", "values"])


@dataclass
class Part(WriterCommitMessage):
    place: int
    file: str
    rows: int


class Writer(DataSourceArrowWriter):
    """Each task writes a part of a new name; the commit names those that count, in the order of the tasks."""

    def __init__(self, shape: Shape, overwrite: bool):
        self.shape, self.overwrite = shape, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, at = self.shape.fs
        fs.create_dir(at, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.bin", 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
            for batch in iterator:
                values = batch.column("values")
                sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy()
                if (sizes != self.shape.cols).any():
                    raise ValueError(f"a row does not have {self.shape.cols} values")
                f.write(values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(self.shape.dtype).tobytes())
                rows += batch.num_rows
        return Part(TaskContext.get().partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, at = self.shape.fs
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        if self.shape.rows is not None and sum(m.rows for m in parts) != self.shape.rows:
            raise ValueError(f"{sum(m.rows for m in parts)} rows were written, expected {self.shape.rows}")
        names = [m.file for m in parts if m.rows]
        if not self.overwrite:  # append
            if fs.get_file_info(f"{at}/{PARTS}").type == FileType.File:
                with fs.open_input_stream(f"{at}/{PARTS}") as f:
                    names = json.loads(f.read()) + names
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{PARTS}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Part | None]) -> None:
        """Parts of a broken write stay unnamed, so no reader sees them."""


def write_flat_matrix(matrix: DataFrame, path: str, cols: int, order: str = "row_no", dtype: str = "float64") -> str:
    """Writes ``values`` in the order of ``order``, by many tasks."""
    spark = matrix.sparkSession
    spark.dataSource.register(FlatMatrix)
    ordered = matrix.orderBy(order).select(matrix["values"].cast("array<double>").alias("values"))
    ordered.write.format("flat_matrix").option("cols", cols).option("dtype", dtype).mode("overwrite").save(path)
    return path


def read_flat_matrix(spark: SparkSession, path: str, rows: int | None, cols: int, dtype: str = "float64") -> DataFrame:
    """``row_no, values`` of a file or folder; a shape that does not fit is an error at once."""
    Shape.of({"path": path, "cols": str(cols), "dtype": dtype} | ({} if rows is None else {"rows": str(rows)})).parts()
    spark.dataSource.register(FlatMatrix)
    reader = spark.read.format("flat_matrix").option("cols", cols).option("dtype", dtype)
    return (reader if rows is None else reader.option("rows", rows)).load(path)

