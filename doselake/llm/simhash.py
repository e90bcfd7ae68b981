"""SimHash near-duplicates: fingerprints, and links found by multi-index hashing.

``h`` is the XXH64 of a shingle with seed 42; a fingerprint bit is 1 if it is
set in more than half of them. Fingerprints link at ``DISTANCE`` bits or fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from doselake.llm.common import arrow_map, stored, text_or_empty
from doselake.llm.components import connect

WORDS = 4
SEED = 42
DISTANCE = 4
#: Segments of a fingerprint: lowest bit, bits, radius of the Hamming ball under
#: which a fingerprint is stored, and of the ball it looks up. Segments are found
#: to differ by up to the sum of both radii, 2 and 1: fingerprints that differ
#: more in both differ in 3 + 2 bits. Halves are used because a table of 32 bits
#: keeps chance meetings few in very large corpora.
SEGMENTS = ((0, 32, 1, 1), (32, 32, 0, 1))
#: Orders of the first pass: lowest bit and bits of the leading part.
ORDERS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text, as a signed number; 0 without words."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) < WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1:].tolist())]
    set_ = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        block = np.array(hashes[k:k + 4096], np.uint64)
        set_ += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_ > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``fp`` (bigint) of every whole text; null text is empty. Map-only."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("fp", LongType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, lambda b: {"id": b.column(0), "fp": [fingerprint(t) for t in b.column(1).to_pylist()]}, schema)


def segment(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def near_in_order(prints: DataFrame, reach: int = 24) -> DataFrame:
    """Links between fingerprints that are close in the order of some segment: edges ``a, b``.

    A cheap first pass: in each segment's order every fingerprint is compared
    with the next ``reach``, and linked to the first within the distance. It
    joins dense groups with one edge a fingerprint; it need not find all links.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            to = np.full(len(fp), -1)
            for step in range(min(reach, len(fp) - 1), 0, -1):
                close = np.bitwise_count((fp[:-step] ^ fp[step:]).view(np.uint64)) <= DISTANCE
                to[:-step][close] = np.flatnonzero(close) + step
            has = np.flatnonzero(to >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(fp[has]), pa.array(fp[to[has]])], schema=schema)

    out = None
    for low, bits in ORDERS:
        key = segment(F.col("fp"), low, bits)
        turned = F.shiftleft("fp", (64 - low - bits) % 64).bitwiseOR(F.shiftrightunsigned("fp", low + bits)) if low + bits < 64 else F.col("fp")
        ordered = prints.select("fp").repartition(key).sortWithinPartitions(key, turned)
        edges = ordered.mapInArrow(run, "a bigint, b bigint")
        out = edges if out is None else out.unionByName(edges)
    return out


def table_links(prints: DataFrame) -> DataFrame:
    """All links between different groups of ``prints (fp, root)``: edges ``a, b`` of roots.

    Multi-index hashing: in one table per segment each fingerprint is stored
    under the values of a small Hamming ball around its own bits, and looks up
    those of another. A value where all that meet are of one group cannot give a
    link between groups and is dropped before the join, so a dense group costs
    its size, not its pairs. Whole distances verify the rest.
    """

    def ball(s: int, low: int, bits: int, radius: int) -> DataFrame:
        masks = [0] + [1 << i for i in range(bits)] * radius
        return prints.select(
            "fp", "root", segment(F.col("fp"), low, bits).alias("own"),
            F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("x"),
        ).select(F.lit(s).cast("tinyint").alias("s"), F.col("own").bitwiseXOR(F.col("x")).alias("v"), "fp", "root")

    kept, asked = None, None
    for s, (low, bits, held, reach) in enumerate(SEGMENTS):
        a, b = ball(s, low, bits, held), ball(s, low, bits, reach)
        kept, asked = (a, b) if kept is None else (kept.unionByName(a), asked.unionByName(b))
    # a value is worth a visit if a fingerprint is stored there and two groups meet
    ends = lambda df, p: df.groupBy("s", "v").agg(F.min("root").alias(f"{p}0"), F.max("root").alias(f"{p}1"))
    mixed = ends(kept, "k").join(ends(asked, "q"), ["s", "v"]).where("k0 != k1 OR q0 != q1 OR k0 != q0").select("s", "v")
    mixed = stored(mixed, "values")
    left = kept.join(mixed, ["s", "v"], "left_semi")
    right = asked.join(mixed, ["s", "v"], "left_semi").select(
        "s", "v", F.col("fp").alias("other"), F.col("root").alias("other_root")
    )
    # one side of each pair suffices: a link is found from either fingerprint
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE
    return left.join(right, ["s", "v"]).where((F.col("root") < F.col("other_root")) & close).select(
        F.col("root").alias("a"), F.col("other_root").alias("b")
    ).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """``fp, root`` for each distinct fingerprint: a fingerprint that names its component."""
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    first = connect(near_in_order(distinct))
    rooted = stored(_rooted(distinct, first), "rooted")
    more = connect(table_links(rooted))
    final = rooted.join(more, rooted["root"] == more["node"], "left")
    return final.select("fp", F.coalesce(more["root"], rooted["root"]).alias("root"))


def _rooted(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` of every document.

    ``component_id`` is the least id among the documents whose fingerprints are
    linked by steps of 4 bits or fewer, its own included; null if all of those
    ids are null. Null or wordless text has fingerprint 0, linked like any other.
    Repeated rows stay, in one component. Other columns are not read.

    Exact copies are one fingerprint from the start. Links are found exactly: a
    first pass joins dense groups cheaply, the tables then find every link
    between what is still apart.
    """
    prints = stored(fingerprint_texts(docs, id_col, text_col), "prints")
    rooted = groups(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = stored(rooted.join(least, "fp").select("fp", "root", "least"), "named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates stays, whole: the one of least id.

    Rows that share that id and are in the group count as one document; the row
    of least text hash stays. Of a group without ids the least text hash stays.
    All columns are kept. Near means linked as in ``near_duplicates``: most copies
    whose five-word similarity is 0.8 to 0.9 are farther apart, and stay (README).
    """
    names = docs.columns
    key = F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("text"),
    )
    keyed = docs.select(F.struct(*names).alias("row"), key.alias("key"))
    prints = stored(
        fingerprint_texts(keyed.select("key", F.col(f"row.{text_col}").alias("text")), "key", "text"), "prints"
    )
    rooted = groups(prints)
    stay = prints.join(rooted, "fp").groupBy("root").agg(F.min("doc_id").alias("key")).select("key")
    # one shuffle of the rows by key serves the join and the choice among equal rows
    parts = [F.col("key.no_id"), F.coalesce(F.col("key.id"), F.lit(0).cast(docs.schema[id_col].dataType)), F.col("key.text")]
    cols = ["_k0", "_k1", "_k2"]
    left = keyed.select("row", *[p.alias(c) for p, c in zip(parts, cols, strict=True)])
    right = stay.select(*[p.alias(c) for p, c in zip(parts, cols, strict=True)])
    return left.join(right, cols).dropDuplicates(cols).select("row.*")
