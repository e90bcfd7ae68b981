"""Ontology DAGs as edge tables, walked by repeated joins.

Each round joins only what the last round found and is checkpointed, so shared
descendants are visited once and lineage stays short. Sets of genes are bitmaps,
merged from the leaves up.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.session import cut_lineage, scratch_path


def nodes(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array("parent", "child"))
    return edges.select(both.alias("node")).distinct()


def ontology_leaves(edges: DataFrame) -> DataFrame:
    """Nodes without children."""
    children = edges.select(F.col("child").alias("node")).distinct()
    return children.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def ontology_summary(edges: DataFrame) -> DataFrame:
    """Node, edge and leaf counts."""
    parents = edges.agg(F.countDistinct("parent"))
    return nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes")).withColumn(
        "n_edges", edges.select("parent", "child").distinct().agg(F.count(F.lit(1))).scalar()
    ).withColumn("n_leaves", F.col("n_nodes") - parents.scalar())


def genes_below(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """All pairs ``(term, gene)`` where the known gene is a descendant of the term."""
    links = edges.select("parent", F.col("child").alias("term")).distinct()
    known = genes.select(F.col("node").alias("gene")).distinct()
    found = cut_lineage(
        links.join(known, links["term"] == known["gene"]).select(F.col("parent").alias("term"), "gene")
    )
    frontier = found
    while True:  # every round but the last adds a pair
        step = frontier.join(links, "term").select(F.col("parent").alias("term"), "gene").distinct()
        frontier = cut_lineage(step.join(found, ["term", "gene"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut_lineage(found.unionByName(frontier))


def filter_ontology(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges whose child is a known gene or has one among its descendants.

    Only the set of useful nodes is walked upwards, never (term, gene) pairs.
    """
    links = edges.select("parent", "child").distinct()
    useful = cut_lineage(genes.select(F.col("node").alias("child")).distinct())
    frontier = useful
    while True:  # every round but the last adds a node
        step = frontier.join(links, "child").select(F.col("parent").alias("child")).distinct()
        frontier = cut_lineage(step.join(useful, "child", "left_anti"))
        if frontier.isEmpty():
            return edges.join(useful, "child", "left_semi").select(edges.columns)
        useful = cut_lineage(useful.unionByName(frontier))


def _peeled(edges: DataFrame, weight: str | None = None) -> Iterator[DataFrame]:
    """The nodes with all children done, round by round: ``node, layer``.

    ``edges`` are distinct ``parent, child`` in storage; a round joins the edges of its
    nodes only, so each edge is handled once. A parent that still waits for
    children is carried as a count. Nodes of a cycle, and above, never come.
    ``layer`` is the greatest of the children's plus 1, or plus ``weight``.
    """
    links = edges.select("parent", "child", (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w"))
    degree = links.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    children = links.select(F.col("child").alias("node")).distinct()
    now = cut_lineage(children.join(degree, "node", "left_anti").withColumn("layer", F.lit(0).cast("bigint")))
    degree, waiting = cut_lineage(degree), None
    while not now.isEmpty():
        yield now
        arrived = links.join(now.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("layer") + F.col("w")).alias("layer")
        )
        if waiting is not None:
            arrived = arrived.unionByName(waiting).groupBy("node").agg(F.sum("n").alias("n"), F.max("layer").alias("layer"))
        state = cut_lineage(arrived.join(degree, "node").withColumn("done", F.col("n") == F.col("degree")).drop("degree"))
        now, waiting = state.where("done").select("node", "layer"), state.where("NOT done").select("node", "n", "layer")


BITS = "node STRING, chunk BIGINT, bits BINARY"


def descendant_bits(edges: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, chunk, bits``: the known genes below each inner node as bitmaps by chunks of the gene numbers; and the nodes found.

    Children come first, and a node's set is the union of theirs and of its own
    genes, chunk by chunk: a term above all genes is many rows, not one. Each
    set is written once, to a folder that only grows; codecs of shuffle and
    storage keep thin bitmaps small. Nodes of a cycle, and above, are not found.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.select("parent", "child").distinct())
    known = cut_lineage(genes.select(F.col("node").alias("child")).distinct().withColumn("id", F.monotonically_increasing_id() + 1))
    direct = cut_lineage(
        links.join(known, "child").groupBy(F.col("parent").alias("node"), F.bitmap_bucket_number("id").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    )
    inner = links.select(F.col("parent").alias("node")).distinct()
    path, found = scratch_path(spark, "descendants"), None
    for r, now in enumerate(_peeled(links)):
        own = now.select("node")
        if r:  # the first are leaves
            sets = direct.join(own, "node", "left_semi")
            if r > 1:
                below = spark.read.schema(BITS).parquet(path).withColumnRenamed("node", "child")
                mine = links.join(own.withColumnRenamed("node", "parent"), "parent", "left_semi")
                sets = sets.unionByName(mine.join(below, "child").select(F.col("parent").alias("node"), "chunk", "bits"))
            merged = sets.groupBy("node", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
            merged.write.mode("append").parquet(path)
        found = own if found is None else found.unionByName(own)
    empty = spark.createDataFrame([], "node STRING")
    found = empty if found is None else found
    if found.join(inner, "node", "left_semi").isEmpty():
        return spark.createDataFrame([], BITS), found
    return spark.read.schema(BITS).parquet(path), found


def term_sizes(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Number of known genes below every node."""
    bits, found = descendant_bits(edges, genes)
    sizes = bits.groupBy("node").agg(F.sum(F.bitmap_count("bits")).alias("n_genes"))
    every = nodes(edges)
    rest = cut_lineage(every.join(found, "node", "left_anti"))
    if not rest.isEmpty():  # a cycle: sets that are their own parts have no order, so pairs are followed to the end
        pairs = genes_below(edges, genes).withColumnRenamed("term", "node").join(rest, "node", "left_semi")
        sizes = sizes.unionByName(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n_genes")))
    return every.join(sizes, "node", "left").select("node", F.coalesce("n_genes", F.lit(0)).cast("bigint").alias("n_genes"))


def direct_genes(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs ``(term, gene)`` where the known gene is a child of the term.

    Rows, not a list per term: a term may hold a large share of the genes.
    """
    known = genes.select(F.col("node").alias("gene")).distinct()
    return edges.select(F.col("parent").alias("term"), F.col("child").alias("gene")).distinct().join(
        known, "gene", "left_semi"
    ).select("term", "gene")


def _chains(links: DataFrame) -> DataFrame:
    """``node, bottom, up``: nodes that lie ``up`` steps above ``bottom`` in a chain without branches.

    A step of a chain joins a node's only child with that child's only parent.
    Steps are doubled until all end at a bottom, so long chains take few rounds.
    Rings, which have none, are left out.
    """
    only_child = links.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.first("child").alias("child")).where("n = 1")
    only_parent = links.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    steps = cut_lineage(
        only_child.join(only_parent.select("child"), "child").select(F.col("parent").alias("node"), F.col("child").alias("bottom"), F.lit(1).cast("bigint").alias("up"))
    )
    n, reach = steps.count(), 1
    while reach <= n:
        further = steps.select(F.col("node").alias("bottom"), F.col("bottom").alias("_b"), F.col("up").alias("_u"))
        joined = steps.join(further, "bottom", "left")
        if joined.where("_b IS NOT NULL").isEmpty():
            return steps
        steps = cut_lineage(joined.select("node", F.coalesce("_b", "bottom").alias("bottom"), (F.col("up") + F.coalesce("_u", F.lit(0))).alias("up")))
        reach *= 2
    return steps.join(steps.select(F.col("node").alias("bottom")), "bottom", "left_anti") if n else steps


def ontology_layers(edges: DataFrame) -> DataFrame:
    """Layer per node when leaves are peeled off again and again: its longest way down to a leaf.

    Chains without branches count as one node with a length; then nodes are
    peeled by the number of children that are not yet done, which handles each
    edge once. What never comes to zero is a cycle, an error.
    """
    links = cut_lineage(edges.select("parent", "child").distinct())
    chains = _chains(links)
    # other edges go from the bottom of a chain to the top of one
    top = chains.select(F.col("node").alias("child"), F.col("bottom").alias("_b"), "up")
    between = links.join(chains.select(F.col("node").alias("parent")), "parent", "left_anti").join(top, "child", "left")
    between = between.select("parent", F.coalesce("_b", "child").alias("child"), (F.coalesce("up", F.lit(0)) + 1).alias("w"))
    lone = links.select("child").join(links.select(F.col("parent").alias("child")), "child", "left_anti").distinct()
    layers = lone.select(F.col("child").alias("node"), F.lit(0).cast("bigint").alias("layer"))
    for r, now in enumerate(_peeled(cut_lineage(between), "w")):
        if r:
            layers = layers.unionByName(now)
    upper = chains.join(layers.withColumnRenamed("node", "bottom"), "bottom").select("node", (F.col("layer") + F.col("up")).alias("layer"))
    whole = cut_lineage(layers.unionByName(upper))
    if whole.count() != nodes(edges).count():
        raise ValueError("the edges contain a cycle")
    return whole.select("node", F.col("layer").cast("int").alias("layer"))
