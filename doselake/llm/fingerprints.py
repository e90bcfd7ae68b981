"""Document fingerprints by content-defined chunking with a normalised gear hash."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from doselake.llm.common import text_or_empty

#: Bytes of the gear window; a 32-bit hash forgets a byte after 32 shifts.
WINDOW = 32
#: Bytes of a chunk: least, normal, most. Least is not below the window, so a
#: boundary depends on bytes of its own chunk only.
LEAST, NORMAL, MOST = 32, 64, 256
#: Zero bits asked of the hash before and after the normal size.
STRICT = np.uint32(0x0000007F << 20)
LOOSE = np.uint32(0x0000000F << 20)


def gear_table(seed: int = 7) -> np.ndarray:
    """256 numbers of 32 bits, from a digest of the seed and the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear numbers of the last 32 bytes, each shifted by its distance.

    Doubling: sums over 1, 2, 4, 8, 16, 32 bytes, each from two of the shorter.
    """
    h, span = gear[data], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def fingerprints(texts: list[bytes], gear: np.ndarray) -> list[dict[str, int]]:
    """Per text its chunk digests (12 hex digits) and how many bytes each covers."""
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    h = gear_hashes(data, gear)
    # a cut lies behind the byte whose hash fits
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    out, start, i, j = [], 0, 0, 0
    digest = xxhash.xxh64_hexdigest
    for text in texts:
        end, at, made = start + len(text), start, Counter()
        while at < end:
            if end - at <= LEAST:
                cut = end
            else:
                low = at + LEAST
                while i < len(strict) and strict[i] < low:
                    i += 1
                cut = strict[i] if i < len(strict) else end
                if cut > at + NORMAL:
                    low = at + NORMAL + 1
                    while j < len(loose) and loose[j] < low:
                        j += 1
                    cut = loose[j] if j < len(loose) else end
                cut = min(cut, at + MOST, end)
            made[digest(whole[at:cut])[:12]] += cut - at
            at = cut
        out.append(made)
        start = end
    return out


def as_text(prints: dict[str, int]) -> str:
    """``digest:bytes`` of each chunk digest, sorted, so equal texts have equal fingerprints."""
    return ",".join(f"{d}:{n}" for d, n in sorted(prints.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of the bytes of ``a`` in chunks that ``b`` has too; two empty ones are equal."""
    if not a:
        return 0.0 if b else 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values())


SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
])


def _with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows ``r, ahead, k, id, text`` by ranges of ids; those with ``ahead`` only show a range what comes next.

    Cut points come from a sketch of the ids, and the least id of each range
    from a count over the ids alone: both at most ``ranges`` numbers. Rows of
    that id are sent to the range before, too (the first range's to the last).
    """
    keys = docs.select("k")
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(keys.agg(F.percentile_approx("k", shares, 10_000).alias("q")).first().q or []))
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    r = F.size(F.filter(bounds, lambda c: c <= F.col("k")))
    firsts = sorted((x.least, x.r) for x in keys.groupBy(r.alias("r")).agg(F.min("k").alias("least")).collect())
    before = {least: firsts[i - 1][1] for i, (least, _) in enumerate(firsts)}
    pairs = [F.lit(x) for pair in before.items() for x in pair]
    shown = F.create_map(*pairs)[F.col("k")] if pairs else F.lit(None).cast("int")
    own = F.struct(r.alias("r"), F.lit(False).alias("ahead"))
    copy = F.struct(shown.cast("int").alias("r"), F.lit(True).alias("ahead"))
    places = F.when(shown.isNull(), F.array(own)).otherwise(F.array(own, copy))
    return docs.withColumn("_at", F.explode(places)).select("_at.r", "_at.ahead", "k", "id", "text")


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_share: int = 4
) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness.

    Columns ``doc_id, n_chars`` (code points) ``, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. The edited text has its last
    ``n_chars // edit_share`` code points replaced by the first as many of the
    next document by id (after the last: the first). Likeness is the share of
    the first fingerprint's bytes whose chunks the second has.

    Ids are numbers; a null one comes first. Rows of one id follow each other by
    text; a lone row is its own next. Null text is empty: empty fingerprint,
    likeness 1 to another empty one, else 0. Other columns are not read; an
    empty table gives an empty result. One shuffle, by ranges of ids; sorted
    rows then stream through, so a task holds a few hundred texts.
    """
    least = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(least)).alias("k"),
        F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"),
    )
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _with_next(rows, ranges)
    ordered = placed.repartition("r").sortWithinPartitions("r", "ahead", "k", "text").drop("k")
    gear, schema = gear_table(), to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose next one has not been seen: range, id, text, fingerprint
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(3).to_pylist()
                prints = fingerprints([t.encode() for t in texts], gear)
                pairs = []
                for r, ahead, id_, text, print_ in zip(
                    *(part.column(c).to_pylist() for c in range(3)), texts, prints, strict=True
                ):
                    if last is not None and last[0] == r:
                        pairs.append((last, text, print_))
                    last = None if ahead else (r, id_, text, print_)
                yield pa.RecordBatch.from_pylist(_likeness(pairs, edit_share, gear), schema=schema)

    return ordered.mapInArrow(run, SCHEMA)


def _likeness(pairs: list[tuple], edit_share: int, gear: np.ndarray) -> list[dict]:
    edited = []
    for (_, _, text, _), following, _ in pairs:
        q = len(text) // edit_share
        edited.append((text[:len(text) - q] + following[:q]).encode())
    out = []
    for ((_, id_, text, own), _, following), raw, other in zip(pairs, edited, fingerprints(edited, gear), strict=True):
        out.append({
            "doc_id": id_, "n_chars": len(text), "edited_sha256": hashlib.sha256(raw).hexdigest(),
            "fingerprint": as_text(own), "edited_fingerprint": as_text(other),
            "near_edited": containment(own, other), "near_next": containment(own, following),
        })
    return out
