"""Regulatory networks: transcription-factor activity, degrees, weight grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.functions.arrays import CELLS, blocks
from doselake.functions.parts import read_part, store_parts
from doselake.functions.ranking import global_row_number
from doselake.schema import require_columns
from doselake.session import cut_lineage

METADATA = ("cell_mfc_name", "viability", "pert_dose")
EDGE = pa.schema([("source", pa.string()), ("pos", pa.int32()), ("weight", pa.float64())])
#: Blocks of weights that a task keeps, of 2 * CELLS cells each.
KEPT = 4


def _network_edges(genes: DataFrame, network: DataFrame) -> DataFrame:
    require_columns(network, ["source", "target", "weight"], ValueError, "network")
    at = genes.select("pos", F.col("gene_symbol").alias("target"))
    edges = network.join(at, "target").groupBy("source", "pos").agg(F.sum("weight").alias("weight"))
    if edges.isEmpty():
        raise ValueError("No shared genes found: no network target is a gene of the matrix")
    return edges


def _require_metadata(matrix: DataFrame, metadata: tuple[str, ...]) -> None:
    absent = set(metadata) - set(matrix.columns)
    if absent:
        raise ValueError(f"Missing expected metadata columns: {sorted(absent)}")


@dataclass
class Weights:
    """Edges ``source, pos, weight`` stored by blocks, which tasks read when they need them.

    ``genes`` are the positions that the network shares with the matrix: as wide
    as a row. Edges never meet in one place.
    """

    path: str
    genes: np.ndarray

    def edges(self, block: int) -> pa.Table:
        parts = list(read_part(self.path, block))
        return pa.Table.from_batches(parts) if parts else EDGE.empty_table()


def _stored_weights(edges: DataFrame, block: Column, genes: np.ndarray) -> Weights:
    blocked = edges.select("source", "pos", F.col("weight").cast("double").alias("weight"), block.cast("int").alias("part"))
    return Weights(store_parts(blocked.repartition("part"), "weights"), genes)


def _shared_genes(edges: DataFrame) -> np.ndarray:
    return np.sort(edges.select("pos").distinct().toArrow().column("pos").to_numpy())  # as wide as a row


def _at_genes(x: np.ndarray, genes: np.ndarray) -> np.ndarray:
    """The columns of a block at the shared genes; a row too short lacks them."""
    out = np.full((len(x), len(genes)), np.nan)
    inside = genes < x.shape[1]
    out[:, inside] = x[:, genes[inside]]
    return out


def _long(part: pa.RecordBatch, keys: int, names: pa.Array, t: np.ndarray) -> pa.RecordBatch:
    """A row per row of ``part`` and name: its first ``keys`` columns, the name, and the number (null if not finite)."""
    rows = pa.array(np.repeat(np.arange(part.num_rows), len(names)))
    flat = t.ravel()
    return pa.RecordBatch.from_arrays(
        [*(c.take(rows) for c in part.columns[:keys]), names.take(pa.array(np.tile(np.arange(len(names)), part.num_rows))),
         pa.array(flat, mask=~np.isfinite(flat))],
        names=[*part.schema.names[:keys], "source", "activity"],
    )


def tf_activity_ulm(
    matrix: DataFrame, genes: DataFrame, network: DataFrame, min_n: int = 1, key: str = "sig_id",
    metadata: tuple[str, ...] = METADATA,
) -> DataFrame:
    """t value of expression regressed on one factor's weights, per (row, factor).

    Genes are those the network shares with the matrix; a gene the factor does
    not regulate weighs 0. Factors with fewer than ``min_n`` targets are left
    out. A gene missing in a row is left out of that row's regressions; the
    value is NULL where too little is left.

    Rows are not shuffled and cells not listed: a task multiplies blocks of rows
    with blocks of factors, which it reads from where they are stored once.
    """
    _require_metadata(matrix, metadata)
    edges = cut_lineage(_network_edges(genes, network))
    kept = edges.groupBy("source").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_n)
    shared = _shared_genes(edges)
    per_block = max(1, 2 * CELLS // len(shared))
    count = max(1, -(-kept.count() // per_block))
    wide = edges.join(kept, "source", "left_semi")
    weights = _stored_weights(wide, F.pmod(F.xxhash64("source"), F.lit(count)), shared)
    sent = matrix.sparkSession.sparkContext.broadcast(weights)
    keys = [key, *metadata]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value

        @lru_cache(KEPT)
        def block(b: int) -> tuple[pa.Array, np.ndarray]:
            t = w.edges(b)
            named = t.column("source").combine_chunks().dictionary_encode()
            dense = np.zeros((len(w.genes), len(named.dictionary)))
            dense[np.searchsorted(w.genes, t.column("pos").to_numpy()), named.indices.to_numpy()] = t.column("weight").to_numpy()
            return named.dictionary, dense

        for part, x in blocks(batches, len(keys)):
            x = _at_genes(x, w.genes)
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x)
            n, sx, sxx = there.sum(axis=1)[:, None], x.sum(axis=1)[:, None], (x * x).sum(axis=1)[:, None]
            for b in range(count):
                names, dense = block(b)
                sw, sww, swx = there @ dense, there @ (dense * dense), x @ dense
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (n * swx - sw * sx) / (np.sqrt(n * sww - sw * sw) * np.sqrt(np.maximum(n * sxx - sx * sx, 0)))
                    yield _long(part, len(keys), names, r * np.sqrt((n - 2) / ((1 - r) * (1 + r))))

    rows = matrix.select(*keys, F.col("values").cast("array<double>").alias("values"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, source string, activity double")


def _independent(w: np.ndarray) -> list[int]:
    """Columns after the first that do not depend on earlier ones, in order."""
    basis = np.zeros((w.shape[0], w.shape[1]))
    first = np.linalg.norm(w[:, 0])
    basis[:, 0] = w[:, 0] / first
    kept = []
    for j in range(1, w.shape[1]):
        q, v = basis[:, :len(kept) + 1], w[:, j].copy()
        for _ in range(2):
            v -= q @ (q.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-9 * max(1.0, np.linalg.norm(w[:, j])):
            kept.append(j)
            basis[:, len(kept)] = v / size
    return kept


def _triangle(blocks_of: DataFrame, factor: Callable[[int], np.ndarray], fan: int = 8) -> np.ndarray:
    """R of the tall matrix whose row blocks ``factor(block)`` gives, by a tree of QR factorisations.

    Each task factors a block; ``fan`` triangles at a time are stacked and
    factored again, until one is left: columns x columns.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                r = np.linalg.qr(factor(block), mode="r")
                yield pa.RecordBatch.from_pydict({"node": [block // fan], "width": [r.shape[1]], "r": [r.tobytes()]})

    def merge(t: pa.Table) -> pa.Table:
        width = t.column("width")[0].as_py()
        stack = np.concatenate([np.frombuffer(r).reshape(-1, width) for r in t.column("r").to_pylist()])
        return pa.table({"node": [t.column("node")[0].as_py() // fan], "width": [width], "r": [np.linalg.qr(stack, mode="r").tobytes()]})

    schema, left = "node bigint, width bigint, r binary", blocks_of.count()
    nodes = blocks_of.mapInArrow(first, schema)
    while left > 1:
        left = -(-left // fan)
        nodes = nodes.groupBy("node").applyInArrow(merge, schema)
    last = nodes.first()
    return np.frombuffer(last.r).reshape(-1, last.width)


def tf_activity_mlm(
    matrix: DataFrame, genes: DataFrame, network: DataFrame, min_n: int = 1, key: str = "sig_id"
) -> DataFrame:
    """t values of all factors fitted jointly (with intercept), per row.

    Factors that depend linearly on earlier ones, in name order, are dropped. A
    gene missing in a row is left out of that row's fit, as in
    ``tf_activity_ulm``; values are NULL where too little is left.

    The weights are stored by blocks of genes. A tree of QR factorisations over
    the blocks gives R, factors by factors, which alone is held in one place.
    Rows are fitted block by block from R and the products with the weights, and
    corrected once by their residuals. A row with gaps adapts the inverse by the
    weights of the genes that it lacks.
    """
    edges = cut_lineage(_network_edges(genes, network))
    spark = matrix.sparkSession
    kept = edges.groupBy("source").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_n)
    names = sorted(r.source for r in kept.select("source").collect())  # R is as wide
    shared = _shared_genes(edges)
    per_block = max(1, 2 * CELLS // (len(names) + 1))
    count = -(-len(shared) // per_block)
    place = F.array_position(F.lit(shared.tolist()), F.col("pos")) - 1
    weights = _stored_weights(edges.join(kept, "source", "left_semi"), F.floor(place / per_block), shared)

    def design(block: int) -> np.ndarray:
        """Rows of a block of genes: 1, then the weight of each factor."""
        own = weights.genes[block * per_block:(block + 1) * per_block]
        t = weights.edges(block)
        out = np.zeros((len(own), len(names) + 1))
        out[:, 0] = 1
        column = pc.index_in(t.column("source"), pa.array(names)).to_numpy()
        out[np.searchsorted(own, t.column("pos").to_numpy()), 1 + column] = t.column("weight").to_numpy()
        return out

    r = _triangle(spark.range(count).repartition(min(count, 1000)), design)
    used = [0, *_independent(r)]
    if len(shared) - len(used) < 1:
        raise ValueError("a joint fit needs more shared genes than factors")
    inverse = np.linalg.inv(np.linalg.qr(r[:, used], mode="r"))
    sent = spark.sparkContext.broadcast((weights, used, inverse @ inverse.T, pa.array([names[j - 1] for j in used[1:]])))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, used, gram, labels = sent.value

        @lru_cache(KEPT)
        def block(b: int) -> np.ndarray:
            return design(b)[:, used]

        def onto(y: np.ndarray) -> np.ndarray:
            return sum(y[:, b * per_block:(b + 1) * per_block] @ block(b) for b in range(count))

        def fitted(beta: np.ndarray) -> np.ndarray:
            return np.concatenate([beta @ block(b).T for b in range(count)], axis=1)

        for part, x in blocks(batches, 1):
            x = _at_genes(x, w.genes)
            there = ~np.isnan(x)
            y = np.nan_to_num(x)
            solve, spread = _with_gaps(there, gram, lambda g: block(g // per_block)[g % per_block])
            beta = solve(onto(y))
            rest = np.where(there, y - fitted(beta), 0.0)
            beta = beta + solve(onto(rest))
            rest = np.where(there, y - fitted(beta), 0.0)
            free = there.sum(axis=1) - len(used)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.sqrt(np.where(free > 0, (rest * rest).sum(axis=1) / free, np.nan))
                t = beta / (s[:, None] * np.sqrt(spread))
            yield _long(part, 1, labels, t[:, 1:])

    kt = matrix.schema[key].dataType.simpleString()
    rows = matrix.select(key, F.col("values").cast("array<double>").alias("values"))
    return rows.mapInArrow(fit, f"`{key}` {kt}, source string, activity double")


def _with_gaps(
    there: np.ndarray, gram: np.ndarray, row_of: Callable[[int], np.ndarray]
) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """How each row's normal equations are solved, and the diagonal of its inverse, from the inverse ``gram`` without gaps.

    Rows that lack the same genes are solved together: the inverse is changed by
    a matrix as small as the number of those genes (Woodbury). NaN where the
    genes that are left do not determine the factors.
    """
    patterns, of = np.unique(np.packbits(~there, axis=1), axis=0, return_inverse=True)
    of = of.ravel()
    spread = np.empty((len(there), len(gram)))
    change: list[tuple[np.ndarray, np.ndarray] | None] = []
    for i in range(len(patterns)):
        missing = np.flatnonzero(~there[np.argmax(of == i)])
        if not len(missing):
            change.append(None)
            spread[of == i] = np.diag(gram)
            continue
        lost = np.stack([row_of(int(g)) for g in missing])
        c = gram @ lost.T
        left = np.eye(len(missing)) - lost @ c
        size = np.linalg.eigvalsh(left).min()  # 0 where a factor hangs on the missing genes alone
        inner = np.linalg.inv(left) if size > 1e-9 else np.full(left.shape, np.nan)
        change.append((c, inner))
        spread[of == i] = np.diag(gram) + ((c @ inner) * c).sum(axis=1)

    def solve(b: np.ndarray) -> np.ndarray:
        out = b @ gram
        for i, change_ in enumerate(change):
            if change_ is not None:
                c, inner = change_
                out[of == i] += (b[of == i] @ c) @ inner @ c.T
        return out

    return solve, spread


def min_targets(network: DataFrame, n: int) -> DataFrame:
    """Edges of factors with at least ``n`` targets."""
    keep = network.groupBy("source").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= n)
    return network.join(keep.select("source"), "source", "left_semi")


def min_targets_sweep(network: DataFrame, upto: int) -> DataFrame:
    """Factors and edges left at every threshold ``1..upto``."""
    k = network.groupBy("source").agg(F.count(F.lit(1)).alias("k"))
    per_k = k.groupBy("k").agg(F.count(F.lit(1)).alias("s"), F.sum("k").alias("e"))
    grid = per_k.select("s", "e", F.explode(F.sequence(F.lit(1), F.least(F.col("k"), F.lit(upto)).cast("int"))).alias("min_n"))
    return grid.groupBy("min_n").agg(F.sum("s").alias("n_sources"), F.sum("e").alias("n_edges"))


def gene_tf_weights(
    network: DataFrame, genes: list[str] | None = None, tfs: list[str] | None = None, order: str = "row_no"
) -> DataFrame:
    """Non-zero cells ``(target, source, weight)``; of duplicates the last row wins."""
    require_columns(network, ["source", "target", "weight"], ValueError, "network")
    if genes is not None:
        network = network.where(F.col("target").isin(genes))
    if tfs is not None:
        network = network.where(F.col("source").isin(tfs))
    return network.groupBy("target", "source").agg(F.max_by("weight", order).alias("weight"))


def gene_tf_rows(
    network: DataFrame, genes: list[str] | None = None, tfs: list[str] | None = None, order: str = "row_no"
) -> tuple[DataFrame, DataFrame]:
    """``target, weights`` (an array in the order of the factors, 0 where there is no edge) and ``place, source`` of the factors.

    The grid as a matrix: any number of factors, whose names stay in a table.
    """
    cells = gene_tf_weights(network, genes, tfs, order)
    present = network.select("source").distinct()
    present = present if tfs is None else present.where(F.col("source").isin(tfs))
    factors = cut_lineage(global_row_number(present, ["source"], "place").select((F.col("place") - 1).cast("int").alias("place"), "source"))
    width = factors.count()
    targets = network.select("target").distinct()
    targets = targets if genes is None else targets.where(F.col("target").isin(genes))
    held = cells.join(factors, "source").groupBy("target").agg(F.collect_list(F.struct("place", "weight")).alias("c"))

    @F.pandas_udf("array<double>")
    def dense(places: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for at, w in zip(places, weights, strict=True):
            row = np.zeros(width)
            if at is not None:
                row[np.asarray(at, np.int64)] = np.asarray(w, np.float64)
            out.append(row)
        return pd.Series(out, dtype=object)

    rows = targets.join(held, "target", "left")
    return rows.select("target", dense(F.col("c.place"), F.col("c.weight")).alias("weights")), factors


def gene_tf_matrix(
    network: DataFrame, genes: list[str] | None = None, tfs: list[str] | None = None, order: str = "row_no"
) -> DataFrame:
    """Genes by factors grid of weights, 0 where there is no edge; a column per factor (``gene_tf_rows`` has none)."""
    present = [r[0] for r in network.select("source").distinct().orderBy("source").collect()]
    columns = present if tfs is None else [t for t in tfs if t in set(present)]
    cells = gene_tf_weights(network, genes, tfs, order)
    targets = network.select("target").distinct()
    if genes is not None:
        targets = targets.where(F.col("target").isin(genes))
    grid = cells.groupBy("target").pivot("source", columns).agg(F.first("weight"))
    return targets.join(grid, "target", "left").na.fill(0.0, columns)


def degrees(network: DataFrame, side: str = "source") -> DataFrame:
    """Connections per node of one side."""
    return network.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def degree_rank(network: DataFrame, side: str = "source") -> DataFrame:
    """Nodes with their rank by degree, names breaking ties."""
    return global_row_number(degrees(network, side), ["degree", "node"], "rank", {"degree"})


def degree_distribution(network: DataFrame, below: int = 10) -> DataFrame:
    """Per side: nodes, edges, largest degree, and share of nodes below a degree."""
    ends = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source").alias("node")),
        F.struct(F.lit("target").alias("side"), F.col("target").alias("node")),
    )
    d = network.select(F.inline(ends)).groupBy("side", "node").agg(F.count(F.lit(1)).alias("degree"))
    return d.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("n_edges"), F.max("degree").alias("max_degree"),
        F.avg((F.col("degree") < below).cast("double")).alias("share_below"),
    )
