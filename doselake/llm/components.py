"""Connected components of a graph given as edges, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doselake.llm.common import stored

EDGE = "a bigint, b bigint"


def forest(edges: DataFrame) -> DataFrame:
    """Per task, the edges of the components of its own edges: each node to the least of its component.

    At most one edge a node and task is left; a task holds its edges 100,000 at a time.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, at = np.unique(
                np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True
            )
            a, b = at[:batch.num_rows], at[batch.num_rows:]
            root = np.arange(len(nodes))
            while True:  # the least root of both ends wins; then paths are halved until flat
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, root[a], low)
                np.minimum.at(new, root[b], low)
                while (new[new] != new).any():
                    new = new[new]
                if (new == root).all():
                    break
                root = new
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], schema=schema)

    return edges.mapInArrow(run, EDGE)


def connect(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges (a, b)``: the least node of its component.

    Rounds of large-star and small-star: each node sends its larger neighbours,
    then its smaller ones, to the least neighbour it knows. A node's neighbours
    are never gathered: the least is a windowed minimum, which is spread by the
    sort and not held. Ends when a round changes nothing; each round is stored,
    so a lost executor repeats its own tasks only.
    """
    now = stored(forest(edges.where("a != b")).where("a != b").distinct(), "links")
    marked = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()
        low = F.min("b").over(Window.partitionBy("a"))
        starred = down.withColumn("m", low)
        small = starred.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            starred.select("a", F.col("m").alias("b"))
        )
        now = stored(small.where("a != b").distinct(), "links")
        sums = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
            F.countDistinct("a").alias("nodes"),
        ).first()
        if marked == (sums.n, sums.s):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        marked = (sums.n, sums.s)
