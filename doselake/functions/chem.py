"""Numeric features from structure strings: built-in expressions, and n-grams in Arrow tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake.functions.arrays import CELLS
from doselake.functions.parts import read_part, store_parts

# Substrings counted per descriptor, in output order.
BASIC_COUNTS = [
    ["C"], ["N"], ["O"], ["F", "Cl", "Br", "I"], ["="], ["#"], ["(", ")"], ["[", "]"],
    None,  # the string length
    ["c", "n", "o"],
]
ROBUST_COUNTS = [
    None,  # the string length
    ["C"], ["N"], ["O"], ["F", "Cl", "Br", "I"], ["S", "P"], ["["], ["("], ["="], ["#"], ["@"],
    ["1"], ["2"], ["3"], ["4"], ["5"], ["6"], ["7"], ["8"], ["9"],
    ["c", "n", "o", "s", "p"],
]
# Fixed value: the widely published token pattern for structure strings.
TOKEN_PATTERN = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|"
    r"%[0-9]{2}|[0-9])"
)


def count_of(s: Column, text: str) -> Column:
    """Number of non-overlapping occurrences of a literal substring.

    Counted in bytes, whose number is stored with the string: no further scan.
    """
    gone = F.octet_length(s) - F.octet_length(F.replace(s, F.lit(text), F.lit("")))
    size = len(text.encode())
    return gone if size == 1 else (gone / F.lit(size)).cast("int")


def _features(s: Column, spec: list) -> list[Column]:
    out = []
    for parts in spec:
        one = F.length(s) if parts is None else reduce(lambda a, b: a + b, [count_of(s, p) for p in parts])
        out.append(F.coalesce(one, F.lit(0)).cast("double"))
    return out


def basic_descriptors(s: Column, dose: Column) -> Column:
    """Ten counts and the dose; a missing string counts as zeros."""
    return F.array(*_features(s, BASIC_COUNTS), dose.cast("double"))


def is_valid_structure(s: Column) -> Column:
    """At least two characters, balanced brackets, and no ``1PS``."""
    ok = (
        (F.length(s) >= 2)
        & (count_of(s, "(") == count_of(s, ")"))
        & (count_of(s, "[") == count_of(s, "]"))
        & ~F.contains(s, F.lit("1PS"))
    )
    return F.coalesce(ok, F.lit(False))


def robust_descriptors(
    df: DataFrame, key: str, structure: str, dose: str, size: int = 64, out: str = "features"
) -> DataFrame:
    """21 counts, zero-padded to ``size - 1``, then the dose; invalid rows dropped.

    When no row is valid, one row of zeros with a NULL key is returned.
    """
    if size < 12:
        raise ValueError("size must be at least 12")
    feats = _features(F.col(structure), ROBUST_COUNTS)[: size - 1]
    pad = F.array_repeat(F.lit(0.0), size - 1 - len(feats))
    valid = df.where(is_valid_structure(F.col(structure))).select(
        key, F.concat(F.array(*feats), pad, F.array(F.col(dose).cast("double"))).alias(out)
    )
    blank = (
        valid.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
        .select(
            F.lit(None).cast(df.schema[key].dataType).alias(key),
            F.array_repeat(F.lit(0.0), size).alias(out),
        )
    )
    return valid.unionByName(blank)


#: Tokens of a stored part of a vocabulary, and parts that a task keeps.
PART_TOKENS, KEPT_PARTS = 1 << 16, 16


def _token_ids(vocabulary: DataFrame, unknown_id: int) -> Callable[[Column], Column]:
    """A function from token arrays to id arrays. The vocabulary is stored by hash of its tokens; tasks read the parts they meet."""
    count = max(1, -(-vocabulary.count() // PART_TOKENS))
    part = (F.crc32(F.col("token").cast("binary")) % count).cast("int").alias("part")
    path = store_parts(vocabulary.select("token", F.col("id").cast("int").alias("id"), part).repartition("part"), "vocabulary")

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @lru_cache(KEPT_PARTS)
        def known(part: int) -> dict[str, int]:
            tables = list(read_part(path, part))
            return {t: i for b in tables for t, i in zip(b.column("token").to_pylist(), b.column("id").to_pylist(), strict=True)}

        for rows in batches:
            met = {t for row in rows if row is not None for t in row}
            by_part: dict[int, list[str]] = {}
            for t in met:
                by_part.setdefault(zlib.crc32(t.encode()) % count, []).append(t)
            of = {t: known(p).get(t, unknown_id) for p, tokens in sorted(by_part.items()) for t in tokens}
            yield pd.Series([None if row is None else [of[t] for t in row] for row in rows], dtype=object)

    return ids


def tokenize_fixed(
    df: DataFrame,
    structure: str,
    vocabulary: dict[str, int] | DataFrame,
    max_length: int,
    pattern: str = TOKEN_PATTERN,
    unknown_id: int = 0,
) -> DataFrame:
    """Adds ``token_ids`` (cut or zero-padded to ``max_length``) and ``mask``.

    A vocabulary is a dictionary, or a table ``(token, id)`` of any size, which
    is looked up where it is stored; only the tokens that are kept are looked up.
    """
    tokens = F.slice(F.regexp_extract_all(F.col(structure), F.lit(pattern), F.lit(0)), 1, max_length)
    if isinstance(vocabulary, DataFrame):
        kept = _token_ids(vocabulary, unknown_id)(tokens)
    else:
        table = F.create_map(*[F.lit(v) for kv in vocabulary.items() for v in kv])
        kept = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown_id)))
    pad = F.array_repeat(F.lit(0), F.lit(max_length) - F.size("_ids"))
    return (
        df.withColumn("_ids", kept)
        .withColumn("token_ids", F.concat(F.col("_ids"), pad))
        .withColumn("mask", F.concat(F.transform("_ids", lambda _: F.lit(1)), pad))
        .drop("_ids")
    )


def char_indices(df: DataFrame, structure: str, alphabet: str, out: str = "char_ids") -> DataFrame:
    """Character positions in ``alphabet``, padded to the longest string of the table."""
    if len(set(alphabet)) != len(alphabet) or "?" not in alphabet or " " not in alphabet:
        raise ValueError("alphabet needs distinct characters, among them '?' and ' '")
    unknown, blank = alphabet.index("?"), alphabet.index(" ")
    longest = df.agg(F.max(F.length(structure)))
    ids = F.transform(
        F.filter(F.split(F.col(structure), ""), lambda c: c != ""),
        lambda c: F.when(
            F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1
        ).otherwise(F.lit(unknown)),
    )
    return (
        df.withColumn("_max", longest.scalar())
        .withColumn(
            out,
            F.concat(ids, F.array_repeat(F.lit(blank), F.col("_max") - F.length(structure))),
        )
        .drop("_max")
    )


def _gram_bits(texts: pa.Array, lengths: np.ndarray, size: int, n: int) -> np.ndarray:
    """Rows x ``size``: 1 where a gram of the row has its place. A gram that occurs in many rows is hashed once."""
    bits, whole = np.zeros((len(texts), size)), "".join(t or "" for t in texts.to_pylist())
    row = np.repeat(np.arange(len(texts)), lengths)
    fits = np.arange(len(whole)) + n <= np.cumsum(lengths)[row]
    letters, known = pd.factorize(np.frombuffer(whole.encode("utf-32-le"), np.uint32))
    at = np.flatnonzero(fits)
    gram, most = letters[at].astype(np.int64), len(known)
    for j in range(1, n):
        if most * len(known) >= 1 << 62:  # numbers that would not fit are dealt anew
            gram, seen = pd.factorize(gram)
            gram, most = gram.astype(np.int64), len(seen)
        gram, most = gram * len(known) + letters[at + j], most * len(known)
    gram, seen = pd.factorize(gram)
    first = np.empty(len(seen), np.int64)
    first[gram[::-1]] = at[::-1]
    place = [int.from_bytes(md5(whole[i:i + n].encode()).digest()[:4], "big") % size for i in first.tolist()]
    bits[row[at], np.array(place, np.int64)[gram]] = 1.0
    return bits


def fingerprint_ngrams(
    df: DataFrame, structure: str, dose: str, size: int = 1024, n: int = 3, out: str = "features"
) -> DataFrame:
    """0/1 vector of character n-grams, then the dose; blank strings dropped.

    A gram's place is the number of the first eight hex digits of its md5,
    modulo ``size``, so any engine gives the same vector. A task works on some
    ``CELLS`` characters, and makes as many cells, at a time.
    """

    @F.arrow_udf("array<double>")
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < len(texts):
                upto = np.searchsorted(np.cumsum(lengths[start:]), CELLS, side="right")
                stop = start + max(1, min(int(upto), CELLS // size))
                bits = _gram_bits(texts.slice(start, stop - start), lengths[start:stop], size, n)
                ends = np.arange(len(bits) + 1, dtype=np.int32) * size
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bits.ravel()))
                start = stop

    kept = df.where(F.length(F.trim(F.col(structure))) > 0)
    return kept.withColumn(out, F.concat(dense(F.col(structure)), F.array(F.col(dose).cast("double"))))
