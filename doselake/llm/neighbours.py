"""Approximate nearest neighbours: a forest of random-projection trees and an exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Levels of a tree at most, so that the driver can hold the forest and its sample.
MOST_DEPTH = 12
#: Queries whose true neighbours choose the number of visits.
TRIED = 256
#: Rows that are compared as one group.
CELL_ROWS = 8_192


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays: the node after ``i`` is ``2i+1``, or ``2i+2`` beyond its cut."""

    directions: np.ndarray  # tree x inner node x dimension, unit vectors
    cuts: np.ndarray  # tree x inner node
    depth: int

    @property
    def trees(self) -> int:
        return len(self.cuts)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point in each tree: points x trees."""
        out = np.zeros((len(points), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", points, self.directions[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node
        return out

    def first(self, trees: int) -> Forest:
        return Forest(self.directions[:trees], self.cuts[:trees], self.depth)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Points x (tree, leaf) in order: the squared cuts that have to be crossed to reach the leaf, added up."""
        out = []
        for t in range(self.trees):
            margins = points @ self.directions[t].T - self.cuts[t]
            far = np.zeros((len(points), 1))
            for level in range(self.depth):
                m = margins[:, (1 << level) - 1:(2 << level) - 1]
                both = np.stack([far + np.where(m > 0, m * m, 0), far + np.where(m > 0, 0, m * m)], axis=2)
                far = both.reshape(len(points), -1)
            out.append(far)
        return np.concatenate(out, axis=1)

    def search(self, points: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest (tree, leaf) pairs of each point, over all trees, as tree * leaves + leaf."""
        return np.argsort(self.distances(points), axis=1, kind="stable")[:, :visits]


def fit_forest(sample: np.ndarray, depth: int, trees: int = 8, seed: int = 11) -> Forest:
    """Split each node of each tree at the sample's median along a random direction."""
    rng = np.random.default_rng(seed)
    inner, dim = (1 << depth) - 1, sample.shape[1] if sample.size else 1
    directions = rng.standard_normal((trees, inner, dim))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = members.pop(node, np.arange(0))
            if rows.size:
                along = sample[rows] @ directions[t, node]
                cuts[t, node] = np.median(along)
                members[2 * node + 1], members[2 * node + 2] = rows[along <= cuts[t, node]], rows[along > cuts[t, node]]
    return Forest(directions, cuts, depth)


def choose(forest: Forest, asked: np.ndarray, near: list[np.ndarray], recall: float, least: int) -> tuple[int, int, float]:
    """``trees, visits, recall`` that compare the fewest rows and still find ``recall`` of the true neighbours ``near``.

    ``least`` visits are made anyway. All leaves of one tree are all rows, so
    no choice compares more than that.
    """
    leaves = 1 << forest.depth
    best = (1, leaves, 1.0)
    options = [t for t in (1, 2, 4, 8, 16) if t <= forest.trees]
    ranks: dict[int, list[np.ndarray]] = {t: [] for t in options}
    for q, true in zip(asked, near, strict=True):
        far = forest.distances(q[None])[0]
        at = forest.leaves(true) - (leaves - 1) + leaves * np.arange(forest.trees)
        for t in options:
            rank = np.empty(t * leaves, np.int64)
            rank[np.argsort(far[:t * leaves], kind="stable")] = np.arange(t * leaves)
            ranks[t].append(rank[at[:, :t]].min(axis=1))
    for t in options:
        need = np.sort(np.concatenate(ranks[t])) if ranks[t] else np.zeros(0, np.int64)
        visits = int(need[max(0, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else leaves
        visits = max(visits, min(least, leaves))
        if visits < best[1]:
            best = (t, visits, float((need < visits).mean()))
    return best


def true_near(points: DataFrame, asked: np.ndarray, own: list[int], k: int) -> list[np.ndarray]:
    """Vectors of the ``k`` nearest ids of each of ``asked``, whose own id is left out, by comparing all rows.

    Each task keeps ``k + 1`` vectors a query. Distances are by a product of
    matrices, good enough to measure recall.
    """
    sent = points.sparkSession.sparkContext.broadcast(asked)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        q = sent.value
        for f in frames:
            for start in range(0, len(f), 4096):
                part = f.iloc[start:start + 4096]
                v = np.stack(part["v"].to_numpy())
                d = np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * q @ v.T, 0)
                best = np.argpartition(d, k, axis=1)[:, :k + 1] if len(v) > k + 1 else np.tile(np.arange(len(v)), (len(q), 1))
                new = pd.DataFrame({
                    "q": np.repeat(np.arange(len(q)), best.shape[1]), "d": np.take_along_axis(d, best, axis=1).ravel(),
                    "ids": part["ids"].to_numpy()[best.ravel()], "v": part["v"].to_numpy()[best.ravel()],
                })
                kept = new if kept is None else pd.concat([kept, new])
                kept = kept.sort_values("d", kind="stable").groupby("q").head(k + 1)
        if kept is not None:
            yield kept

    near = Window.partitionBy("q").orderBy("d", F.col("ids")[0])
    rows = points.select("ids", "v").mapInPandas(scan, "q int, d double, ids array<bigint>, v array<double>")
    rows = rows.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1).orderBy("q", "_n").toPandas()
    out = []
    for i, f in rows.groupby("q"):
        flat = [v for v, ids in zip(f["v"], f["ids"], strict=True) for x in ids if x != own[i]][:k]
        out.append(np.array(flat, np.float64).reshape(-1, asked.shape[1]))
    return out


def cells(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each leaf (tree x leaf), for cells of about ``most`` rows.

    Neighbouring leaves share a cell; a leaf of more rows is dealt to several.
    """
    first, blocks = np.zeros(sizes.shape, np.int32), np.ones(sizes.shape, np.int32)
    cell = -1
    for t in range(len(sizes)):
        room = 0
        for leaf, n in enumerate(sizes[t].tolist()):
            if n > room:
                blocks[t, leaf] = max(1, -(-n // most))
                first[t, leaf] = cell + 1
                cell += blocks[t, leaf]
                room = most - n if n <= most else 0
            else:
                first[t, leaf] = max(cell, 0)
                room -= n
    return first, blocks


FOUND = "qa bigint, qb bigint, vec_id bigint, score double"


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = 8, visits: int = 96, leaf_rows: int = 256, sample_rows: int = 20_000, recall: float = 0.95,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Nearness is Euclidean distance in double precision on the vectors as they
    are; ties go to the smaller id; a row is never its own neighbour. Vectors
    that are null, zero, or hold a null, NaN or infinity take no part, nor do
    those whose length is not the commonest. Rows of one id and one vector count
    once; a null id takes no part. Other columns are not read.

    The forest is fitted on at least ``sample_rows`` rows chosen by hash, more as
    the table grows, and kept by the driver; a tree has up to ``MOST_DEPTH``
    levels for leaves of ``leaf_rows`` distinct vectors, and larger leaves beyond.
    All rows are indexed. Equal vectors are indexed once, with their ``k + 1``
    smallest ids (no other can be among the nearest), and equal queries are
    searched once, so a vector that fills the table costs one entry.

    How many trees are used and how many leaves a query visits is chosen at each
    call: the true neighbours of ``TRIED`` queries are found by brute force, and
    the fewest rows are compared that give ``recall`` of them, ``visits`` leaves
    at least. Where no choice beats comparing all rows, all are compared.
    Leaves are compared exactly, in cells of at most about ``CELL_ROWS`` rows.
    """

    def valid(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return x.where(F.col("id").isNotNull() & sound & F.exists("v", lambda c: c != 0)).distinct()

    rows, asked = valid(vectors), valid(queries)
    first = Window.partitionBy("v").orderBy("id")
    points = (
        rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = common.d
    share = min(1.0, max(sample_rows, min(common.n / leaf_rows * 8, 8 << MOST_DEPTH)) / common.n)
    fair = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    points = points.where(F.size("v") == dim)
    # equal vectors share a hash, so the sample is of distinct vectors
    sample = rows.where(fair).select("v").distinct().toPandas()["v"]
    sample = np.array(sample.tolist(), np.float64).reshape(-1, dim)
    distinct = max(1.0, len(sample) / share)
    depth = int(np.clip(np.log2(max(1.0, min(distinct / leaf_rows, len(sample) / 8))), 0, MOST_DEPTH))
    forest = fit_forest(sample, depth, trees)
    heads = asked.groupBy("v").agg(F.min("id").alias("qa")).withColumn("qb", F.xxhash64("v"))
    tried = heads.orderBy(F.xxhash64("v", F.lit(9)), "qa").limit(TRIED).toPandas()
    tried_v = np.array(tried["v"].tolist(), np.float64).reshape(-1, dim)
    true = true_near(points, tried_v, tried["qa"].tolist(), k) if len(tried) and depth else []
    used, visits, _ = choose(forest, tried_v[:len(true)], true, recall, visits)
    forest, leaf_count, inner = forest.first(used), 1 << depth, (1 << depth) - 1
    sent = spark.sparkContext.broadcast(forest)  # trees x 2**depth x dim doubles: bounded by MOST_DEPTH

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(used * leaf_count, np.int64)
        for f in frames:
            if len(f):
                at = sent.value.leaves(np.stack(f["v"].to_numpy())) - inner + leaf_count * np.arange(used)
                n += np.bincount(at.ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"leaf": at, "n": n[at]})

    held = np.zeros(used * leaf_count, np.int64)
    for r in points.select("v").mapInPandas(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        held[r.leaf] = r.n  # a row a leaf
    placed = spark.sparkContext.broadcast(tuple(x.ravel() for x in cells(held.reshape(used, -1), CELL_ROWS)))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, blocks = placed.value
        for f in frames:
            leaves = sent.value.leaves(np.stack(f["v"].to_numpy())) - inner if len(f) else np.zeros((0, used), int)
            for t in range(used):
                leaf = leaves[:, t] + t * leaf_count
                cell = first[leaf] + f["h"].to_numpy() % blocks[leaf] if len(f) else leaf
                yield pd.DataFrame({"cell": cell, "leaf": leaf, "ids": f["ids"], "v": f["v"]})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, blocks = placed.value
        for whole in frames:
            for start in range(0, len(whole), 32):
                f = whole.iloc[start:start + 32]
                made = []
                for a, b, v, at in zip(f["qa"], f["qb"], f["v"], sent.value.search(np.stack(f["v"].to_numpy()), visits), strict=True):
                    at = at[held[at] > 0]
                    n = blocks[at]
                    leaf = np.repeat(at, n)
                    cell = np.repeat(first[at], n) + np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
                    order = np.argsort(cell, kind="stable")
                    names, starts = np.unique(cell[order], return_index=True)
                    made += [(c, part, a, b, v) for c, part in zip(names, np.split(leaf[order], starts[1:]), strict=True)]
                yield pd.DataFrame(made, columns=["cell", "leaves", "qa", "qb", "v"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            m, leaf = np.stack(left["v"].to_numpy()), left["leaf"].to_numpy()
            n_ids = left["ids"].map(len).to_numpy()
            flat, starts = np.concatenate(left["ids"].to_numpy()), np.cumsum(n_ids) - n_ids
            for a, b, v, visited in zip(right["qa"], right["qb"], right["v"], right["leaves"], strict=True):
                rows = np.flatnonzero(np.isin(leaf, visited))
                d = np.sqrt(((m[rows] - v) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    some = np.flatnonzero(d <= np.partition(d, k)[k])
                    rows, d = rows[some], d[some]
                n = n_ids[rows]
                ids = flat[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                d = np.repeat(d, n)
                some = np.lexsort((ids, d))[:k + 1]
                out.append((np.full(len(some), a), np.full(len(some), b), ids[some], d[some]))
        made = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("qa", "qb", "vec_id", "score"), made, strict=True)))

    indexed = points.withColumn("h", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30))).mapInPandas(
        index, "cell int, leaf int, ids array<bigint>, v array<double>"
    )
    probes = heads.select("qa", "qb", "v").mapInPandas(
        probe, "cell int, leaves array<int>, qa bigint, qb bigint, v array<double>"
    )
    found = indexed.groupBy("cell").cogroup(probes.groupBy("cell")).applyInPandas(compare, FOUND).distinct()
    best = Window.partitionBy("qa", "qb").orderBy("score", "vec_id")
    top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = top.groupBy("qa", "qb").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")
    )
    who = asked.join(heads, "v").select("id", "qa", "qb")
    own = who.join(lists, ["qa", "qb"]).select(
        F.col("id").alias("query_id"),
        F.expr(f"slice(filter(near, x -> x.vec_id != id), 1, {k})").alias("near"),
    )
    flat = own.select("query_id", F.posexplode("near").alias("_p", "x"))
    return flat.select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
        F.col("x.score").alias("score"),
    )
