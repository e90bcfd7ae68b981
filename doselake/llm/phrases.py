"""Phrase collocations: exact counts of frequent phrases from depth-truncated suffix trees, and their scores.

Texts are split into pieces and pieces into words. The suffixes that begin at
each word are partitioned vertically: first words that occur often enough, then
word pairs, decide which suffixes are built at all; the rest are grouped by
prefix, so that a group fits a memory budget, and each group's tree is built
alone. Word and pair filters may let too much through and never too little, so
every count that reaches ``least`` is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doselake.llm.common import batches_of, stored, text_or_empty

#: Words of a phrase at most: the depth at which trees are cut.
DEPTH = 5
#: Bytes of text worked on at a time; a piece without end may pass it.
CHUNK = 8 << 20
#: Texts that a task receives at a time.
TEXTS = 1_000
#: Bits of a filter at most. A fuller filter prunes less and changes no result.
FILTER_BITS = 1 << 27
#: Rows of a filter's block, in bytes.
BLOCK = 1 << 13
#: Groups of prefixes at most, so that what names them stays small; beyond, the budget grows.
MOST_GROUPS = 50_000

#: Fixed by the task: bytes that end a piece, and bytes between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"

SUFFIX = pa.schema([("lang", pa.string()), ("phrase", pa.large_string()), ("n", pa.int64())])

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, so that any of their bits can name a place."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Words:
    """The words of a chunk in order: places in ``names``, and the piece each lies in."""

    codes: np.ndarray
    pieces: np.ndarray
    names: pa.LargeStringArray

    def hashes(self, lang: str) -> np.ndarray:
        """A 64-bit hash of each name, other in each language; used by filters only."""
        _, offsets, data = self.names.buffers()
        at = np.frombuffer(offsets, np.int64)[self.names.offset:self.names.offset + len(self.names) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
        sizes, at = np.diff(at), at[:-1] - at[0]
        place = np.arange(len(raw)) - np.repeat(at, sizes)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_BYTE[raw] * _PLACE[place % len(_PLACE)], at) if len(at) else np.zeros(0, np.uint64)
            return mixed(sums ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))


def chunks(texts: pa.Array) -> Iterator[Words]:
    """Words of texts without nulls, about ``CHUNK`` bytes at a time; texts are cut between pieces only."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or at[0] == at[-1]:
        return
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    begins = np.unique(at[:-1] - at[0])
    begins = begins[begins < len(raw)]
    start = 0
    while start < len(raw):
        end = start + CHUNK
        if end >= len(raw):
            end = len(raw)
        else:  # the last text or piece that begins in the chunk, else the first one behind it
            later = begins[np.searchsorted(begins, start, "right"):]
            inside = later[later <= end]
            low = inside[-1] if len(inside) else start
            stops = np.flatnonzero(_KIND[raw[low:end]] == 2)
            if len(stops):
                end = low + stops[-1] + 1
            elif low > start:
                end = low
            else:
                limit = later[0] if len(later) else len(raw)
                while end < limit and _KIND[raw[end - 1]] != 2:
                    step = np.flatnonzero(_KIND[raw[end:min(end + CHUNK, limit)]] == 2)
                    end = end + step[0] + 1 if len(step) else min(end + CHUNK, limit)
        yield split(raw[start:end], begins[(begins >= start) & (begins < end)] - start)
        start = end


def split(raw: np.ndarray, begins: np.ndarray) -> Words:
    """Words of the bytes of texts that begin at ``begins`` (and at 0)."""
    kind = _KIND[raw]
    word = kind == 0
    first = np.zeros(len(raw), bool)
    first[begins] = True
    before = np.concatenate([[False], word[:-1]]) & ~first
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([before[1:] & word[1:], [False]])
    ends = np.flatnonzero(word & ~after) + 1
    pieces = np.cumsum((kind == 2) | first, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    spelt = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[raw[word]]))
    coded = spelt.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), pieces, coded.dictionary)


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    """Chunks of a batch ``lang, text``, each of one language."""
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        for words in chunks(batch.column(1).filter(pc.equal(langs, lang))):
            yield lang, words


# -- filters ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Filter:
    """A set of 64-bit hashes as bits: never says no to a member."""

    bits: np.ndarray

    @staticmethod
    def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(size - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h, 8 * len(self.bits)):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def build_filter(hashes: DataFrame) -> Filter:
    """Filter of the column ``h``. Tasks send blocks of bits, which are united by block: 16 MB at most reach the driver."""
    n = hashes.count()
    size = min(FILTER_BITS, max(8 * BLOCK, 1 << (16 * max(1, n) - 1).bit_length()))
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in Filter.places(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for block, part in enumerate(bits.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "bits": [part.tobytes()]}, schema)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, block = np.zeros(BLOCK, np.uint8), None
        for batch in batches:
            block = batch.column("block")[:1]
            for x in batch.column("bits").to_pylist():
                bits |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_pydict({"block": block, "bits": [bits.tobytes()]}, schema)

    marked = hashes.select("h").mapInArrow(mark, "block int, bits binary")
    whole = np.zeros(size // 8, np.uint8)
    for row in marked.groupBy("block").applyInArrow(unite, "block int, bits binary").toLocalIterator():
        whole[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(row.bits, np.uint8)
    return Filter(whole)


# -- vertical partitioning -------------------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` for every word, and a row without word for each language's total."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.large_string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in by_lang(batch):
                names = pa.concat_arrays([words.names, pa.array([None], pa.large_string())])
                n = np.append(np.bincount(words.codes, minlength=len(words.names)), len(words.codes))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), names, pa.array(n)], schema=schema)

    return texts.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hashes(words: DataFrame) -> DataFrame:
    """``h`` of each ``lang, word``, as chunks hash them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                names = batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.large_string())
                h = Words(np.zeros(0), np.zeros(0), names).hashes(lang)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64)})

    return words.select("lang", "word").mapInArrow(run, "h bigint")


def pair_hashes(words: Words, lang: str, known: Filter) -> np.ndarray:
    """At each word but the last, a hash of it and the next, or 0 if they are in two pieces or one is not ``known``."""
    h = words.hashes(lang)
    known = known.has(h)[words.codes]
    h = h[words.codes]
    with np.errstate(over="ignore"):
        pairs = mixed(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) | np.uint64(1)
    return np.where(known[:-1] & known[1:] & (words.pieces[:-1] == words.pieces[1:]), pairs, np.uint64(0))


def windows(words: Words, pairs: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
    """The distinct suffixes of a chunk, cut at ``DEPTH`` words and before any pair that is not in ``pairs``, and their counts.

    Suffixes of one word are left out. Columns are the words, null beyond the end.
    """
    good = np.concatenate([pairs, np.zeros(DEPTH, bool)])
    starts = np.flatnonzero(pairs)
    inside = np.ones(len(starts), bool)
    ids, columns = np.zeros(len(starts), np.int64), []
    base = len(words.names) + 1
    codes = np.concatenate([words.codes, np.zeros(DEPTH, np.int64)])
    for d in range(DEPTH):
        if d:
            inside &= good[starts + d - 1]
        column = np.where(inside, codes[starts + d] + 1, 0)
        columns.append(column)
        ids = np.unique(ids * base + column, return_inverse=True)[1]  # ranks stay below the number of starts
    _, first, n = np.unique(ids, return_index=True, return_counts=True)
    names = pa.concat_arrays([words.names, pa.array([None], pa.large_string())])  # place -1 + 1 = 0 is the null
    return [names.take(pa.array((c[first] - 1) % base)) for c in columns], n


def frequent_windows(texts: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, n``: distinct truncated suffixes of two words or more, with their totals over all texts.

    Suffixes end before a word or pair that occurs fewer than ``least`` times
    (or a little later, as the filters err to that side). Repeats are added up
    in the chunk, in the task, and after one shuffle by the whole suffix.
    """
    sc = texts.sparkSession.sparkContext
    known = sc.broadcast(build_filter(word_hashes(frequent)))  # FILTER_BITS at most

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in by_lang(batch):
                h = pair_hashes(words, lang, known.value)
                h, n = np.unique(h[h != 0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n})

    # most pairs of a task are seen once there, so they are dealt first and added up where they meet
    counted = texts.mapInArrow(pairs, "h bigint, n bigint").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))
    common = stored(counted.where(F.col("n") >= least).select("h"), "phrase-pairs")
    paired = sc.broadcast(build_filter(common))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in by_lang(batch):
                h = pair_hashes(words, lang, known.value)
                columns, n = windows(words, (h != 0) & paired.value.has(h))
                phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()), null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n)], schema=SUFFIX)

    rows = texts.mapInArrow(suffixes, "lang string, phrase string, n bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def first_words(phrase: Column, k: int | Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), F.lit(k))


def heavy_prefixes(rows: DataFrame, budget: int) -> DataFrame:
    """``lang, prefix, words, n`` of the prefixes under which more than ``budget`` rows lie.

    Each number of words has at most rows / budget of them. A longer one is
    never heavier than its own beginning, so the search ends with the first
    number of words that has none.
    """
    spark, out = rows.sparkSession, None
    for k in range(1, DEPTH):
        prefix = first_words(F.col("phrase"), k)
        counts = rows.groupBy("lang", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
        found = [tuple(r) for r in counts.where(F.col("rows") > budget).select("lang", "prefix", F.lit(k), "n").collect()]
        level = spark.createDataFrame(found, "lang string, prefix string, words int, n bigint")
        out = level if out is None else out.unionByName(level)
        if not found:
            break
    return out


def grouped(rows: DataFrame, heavy: DataFrame, budget: int, total: int) -> DataFrame:
    """``rows`` with ``own``, the words of the prefix that is theirs, and ``group``.

    A row's prefix is one word longer than its longest heavy one. Prefixes are
    dealt to buckets, and buckets in order to groups of at most ``budget`` rows
    (or one bucket): about 4 buckets a group are named.
    """
    own = rows.withColumn("own", F.lit(1))
    for k in range(1, DEPTH):
        level = heavy.where(F.col("words") == k).select("lang", F.col("prefix").alias("_p"), F.lit(k + 1).alias("_own"))
        own = (
            own.withColumn("_p", first_words(F.col("phrase"), k)).join(F.broadcast(level), ["lang", "_p"], "left")
            .withColumn("own", F.coalesce("_own", "own")).drop("_p", "_own")
        )
    buckets = 4 * -(-total // budget) + 1
    own = own.withColumn("bucket", F.pmod(F.xxhash64("lang", first_words(F.col("phrase"), F.col("own"))), F.lit(buckets)).cast("int"))
    groups, held, group = [], 0, 0
    for r in sorted(own.groupBy("bucket").count().collect()):
        if held and held + r["count"] > budget:
            group, held = group + 1, 0
        held += r["count"]
        groups.append((r.bucket, group))
    placed = rows.sparkSession.createDataFrame(groups, "bucket int, group int")
    return own.join(F.broadcast(placed), "bucket").select("group", "lang", "phrase", "n", "own")


# -- trees -----------------------------------------------------------------------------------------

NODE = "lang string, phrase string, words int, n bigint"


def subtree(rows: pa.Table, least: int) -> pa.Table:
    """Nodes of two words or more, at or below each row's own prefix, with at least ``least`` occurrences.

    Rows are the leaves: distinct word sequences and their totals. In the order
    of their words the leaves below a node are consecutive, and its count is
    the sum of their totals.
    """
    lists = pc.split_pattern(rows.column("phrase").combine_chunks().cast(pa.large_string()), " ")
    sizes = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    words = np.full((len(sizes), DEPTH), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    words[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = coded.indices.to_numpy()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    lang, own, n = langs.indices.to_numpy(), rows.column("own").to_numpy(), rows.column("n").to_numpy()
    order = np.lexsort([*words.T[::-1], lang])
    words, lang, own, n, sizes = words[order], lang[order], own[order], n[order], sizes[order]
    new = np.ones(len(n), bool)
    new[1:] = lang[1:] != lang[:-1]
    made = []
    for d in range(DEPTH):
        new[1:] |= words[1:, d] != words[:-1, d]
        if d == 0:
            continue
        starts = np.flatnonzero(new)
        total = np.add.reduceat(n, starts)
        keep = (sizes[starts] > d) & (own[starts] <= d + 1) & (total >= least)
        at = starts[keep]
        spelt = [coded.dictionary.take(pa.array(words[at, k])) for k in range(d + 1)]
        made.append(pa.table({
            "lang": langs.dictionary.take(pa.array(lang[at])).cast(pa.string()),
            "phrase": pc.binary_join_element_wise(*spelt, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            "words": pa.array(np.full(len(at), d + 1, np.int32)), "n": pa.array(total[keep]),
        }))
    return pa.concat_tables(made)


def phrase_counts(rows: DataFrame, least: int, memory_rows: int) -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of 2 to ``DEPTH`` words in the suffixes ``rows`` that occur ``least`` times or more."""
    spark = rows.sparkSession
    total = rows.count()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(1, min(memory_rows, max(1_000, -(-total // tasks))), -(-total // MOST_GROUPS))
    heavy = heavy_prefixes(rows, budget)
    trees = grouped(rows, heavy, budget, total).groupBy("group").applyInArrow(lambda t: subtree(t, least), NODE)
    above = heavy.where((F.col("words") > 1) & (F.col("n") >= least)).select("lang", F.col("prefix").alias("phrase"), "words", "n")
    return stored(trees.unionByName(above), "phrase-counts")


# -- scores ----------------------------------------------------------------------------------------

def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, covered: int = 100, text_col: str = "text",
    lang_col: str = "lang", memory_rows: int = 500_000,
) -> DataFrame:
    """The ``top`` best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases of 2 to ``DEPTH`` words within pieces that occur ``a >= least``
    times are candidates. A cut into first words (``l`` occurrences) and rest
    (``r``) scores ``1000 * a * n // (l * r)``, with ``n`` words in all; the
    lowest cut counts, then the shortest first part. A candidate goes if a
    longer one that contains it has ``covered`` percent of its occurrences or
    more. Order is by score, then ``a``, both falling, then phrase by UTF-8 bytes.

    A null text is empty, a null language ``und``; texts are taken whole, A-Z
    lower-cased. Repeated rows count each time. Other columns are not read; an
    empty table gives no rows. ``least`` is 1 or more. ``memory_rows`` is the
    budget of a tree, in distinct suffixes.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    with batches_of(docs.sparkSession, TEXTS):
        counts = stored(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= least)), "phrase-words")
        frequent = counts.where("word IS NOT NULL")
        rows = stored(frequent_windows(texts, frequent, least), "phrase-suffixes")
    totals = counts.where("word IS NULL").select("lang", F.col("n").alias("total"))
    nodes = phrase_counts(rows, least, memory_rows)

    # what covers a phrase is at least as frequent one word longer, so looking there is enough
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " "))
    cover = nodes.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "n")
    cover = cover.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = nodes.join(cover, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("n").cast("decimal(20,0)") * covered)
    )

    parts = frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(
        nodes.where(F.col("words") < DEPTH).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    )
    cuts = kept.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stored(cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    ), "phrase-cuts")
    for side, name in (("left", "l"), ("right", "r")):
        # a part is there once; Spark splits what a common word makes too large
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("l", "r", "total")}
    cuts = cuts.join(totals, "lang").withColumns({
        "over": (F.col("a") * 1000).cast("decimal(19,0)") * exact["total"], "under": exact["l"] * exact["r"],
    }).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.select("lang", "phrase", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
