"""Byte-level BPE: merges chosen by a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from doselake.llm.common import arrow_map, text_or_empty

#: Pieces remembered per worker; the table is emptied when it is full.
MEMO = 150_000
#: Bytes of a piece up to which trees are worked side by side.
LONG = 256
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairRanks:
    """Rank of two neighbouring tokens, looked up for whole arrays of id pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.rank = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0)

    def at(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``rank << 32 | place`` per pair, or ``NONE``: equal ranks go to the left."""
        want = left << 32 | right
        i = np.searchsorted(self.keys, want)
        return np.where(self.keys[i] == want, self.rank[i] << 32 | place, NONE)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> bytes:
    """As ``merge_pieces`` for one long piece: O(n log n) with plain integers."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> int:
        j = after[i]
        rank = ranks.get(piece[i:after[j]]) if j < n else None
        return NONE if rank is None else rank << 32 | i

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    tree[size:size + n - 1] = [key(i) for i in range(n - 1)]
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] != NONE:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, NONE)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return struct.pack(f"<{len(out)}I", *out)


def merge_pieces(pieces: list[bytes], byte_ids: np.ndarray, ranks: PairRanks) -> list[bytes]:
    """Ids of each piece (little-endian, unsigned, 32 bits): always merge the leftmost pair of least rank.

    Pieces of like length are worked side by side, each with a segment tree of
    its own: leaf ``i`` holds the rank of the pair that begins at live byte
    ``i``, an inner node the least of its children. A merge changes three
    leaves, the pair at the merged token, the pair before it, and the pair that
    is gone, and mends the three paths to the root.
    """
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for w in np.unique(widths):
        chosen = np.flatnonzero(widths == w)
        side = max(1, (1 << 19) // int(w))  # bounds the memory of one go
        for k in range(0, len(chosen), side):
            some = chosen[k:k + side]
            for i, ids in zip(some, _merge_side([pieces[i] for i in some], lengths[some], int(w), byte_ids, ranks),
                              strict=True):
                out[i] = ids
    return out


def _merge_side(pieces: list[bytes], n: np.ndarray, w: int, byte_ids: np.ndarray, ranks: PairRanks) -> list[bytes]:
    raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(-1, w)
    place, p = np.arange(w), len(pieces)
    ids = np.full((p, w + 1), (1 << 20), np.int64)  # beyond the end: an id that pairs with nothing
    ids[:, :w][place < n[:, None]] = byte_ids[raw[place < n[:, None]]]
    after, before = np.tile(np.minimum(place + 1, w), (p, 1)), np.tile(place - 1, (p, 1))
    after[place + 1 >= n[:, None]] = w
    tree = np.empty((p, 2 * w), np.int64)
    tree[:, w:] = ranks.at(ids[:, :-1], ids[:, 1:], place)
    level = w // 2
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level //= 2
    live = np.ones((p, w), bool) & (place < n[:, None])

    def mend(rows: np.ndarray, leaf: np.ndarray) -> None:
        node = leaf + w >> 1
        while node.size and node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    rows = np.arange(p)
    while True:
        least = tree[rows, 1]
        go = least != NONE
        rows, least = rows[go], least[go]
        if not rows.size:
            break
        at = least & 0xFFFFFFFF
        gone = after[rows, at]
        then = after[rows, gone]
        ids[rows, at] = least >> 32
        live[rows, gone] = False
        after[rows, at] = then
        inner = then < w
        before[rows[inner], then[inner]] = at[inner]
        tree[rows, gone + w] = NONE
        tree[rows, at + w] = ranks.at(ids[rows, at], ids[rows, then], at)
        prior = before[rows, at]
        has = prior >= 0
        r, q = rows[has], prior[has]
        tree[r, q + w] = ranks.at(ids[r, q], ids[r, at[has]], q)
        mend(rows, gone)
        mend(rows, at)
        mend(r, q)
    flat = ids[:, :w][live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class ByteBPE:
    """Encoder and decoder for one rank file; remembers the ids of pieces it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairRanks(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        memo, made = self.memo, []
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in memo})
        raw = [p.encode() for p in new]
        whole = [self.ranks.get(r) for r in raw]
        rest = [i for i, w in enumerate(whole) if w is None and len(raw[i]) <= LONG]
        merged = merge_pieces([raw[i] for i in rest], self.byte_ids, self.pairs)
        for p, r, w in zip(new, raw, whole, strict=True):
            if w is not None:
                memo[p] = struct.pack("<I", w)
            elif len(r) > LONG:
                memo[p] = merge_long(r, self.ranks)
        for i, ids in zip(rest, merged, strict=True):
            memo[new[i]] = ids
        made = [b"".join(map(memo.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > 64:  # long pieces hardly come again
                del memo[p]
        return made

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file, loaded once per worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _coders[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """Encode and decode every whole text: id, ``n_tokens, token_ids, ids_sha256, decoded_sha256``.

    ``token_ids`` (only with ``ids``) holds little-endian unsigned 32-bit
    integers. ``path`` must be readable on the executors. Null text is empty: no
    tokens and the digest of nothing. Rows are kept one for one, in any order,
    and no other column is read. A map-only job: no shuffle, and memory of a few
    hundred texts; a piece of n bytes takes O(n log n), so long runs are no trap.
    """
    fields = [StructField(id_col, docs.schema[id_col].dataType), StructField("n_tokens", LongType())]
    fields += [StructField("token_ids", BinaryType())] * ids
    fields += [StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(path, pattern)
        made = c.encode(batch.column(1).to_pylist())
        return {
            "id": batch.column(0), "n": [len(m) // 4 for m in made], **({"ids": made} if ids else {}),
            "a": [hashlib.sha256(m).hexdigest() for m in made],
            "b": [hashlib.sha256(c.decode(m)).hexdigest() for m in made],
        }

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, run, StructType(fields), rows=256)
