"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from doselake.llm.common import arrow_map, text_or_empty

BITS = 18
#: Labelled rows the model is fitted on at most, chosen by a hash of the id.
TRAIN_ROWS = 8_000
MEMO = 100_000
#: Words, and runs of signs other than letters, digits and white space.
WORDS = re.compile(r"\w+|[^\w\s]+").findall
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = zlib.crc32(word.encode())
        return got


_hashes = _Hashes()


def buckets(text: str) -> np.ndarray:
    """Bucket of each word, of each pair of neighbours, and of each four words' pattern; repeats included.

    The pattern of four words is which of the three earlier the last one equals.
    """
    words = WORDS(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    one = (h + np.uint64(1)) * _PRIMES[0]
    two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * _PRIMES[1]
    same = np.zeros(max(0, len(h) - 1), np.uint64)
    for back in (1, 2, 3):
        same[back - 1:] += (h[back:] == h[:-back]) * np.uint64(1 << back)
    three = (same + np.uint64(3)) * _PRIMES[1]
    return (np.concatenate([one, two, three]) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


class FTRL:
    """Follow-the-regularised-leader with per-coordinate rates; the last weight is the bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(len(self.z))[at] == 1 << BITS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text: n-gram counts over the root of their number, and the bias."""
    b = buckets(text)
    at, count = np.unique(b, return_counts=True)
    x = np.append(count / np.sqrt(max(1, len(b))), 1.0)
    return np.append(at, 1 << BITS).astype(np.int32), x.astype(np.float32)


def fit(training: DataFrame, passes: int = 3) -> np.ndarray:
    """Weights learnt from rows ``id, text, label`` in one task; the caller bounds the rows.

    Only these rows are moved: what makes them stays parallel.
    """

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f.assign(x=[features(t) for t in f["text"]]).drop(columns="text") for f in frames])
        model = FTRL()
        rng = np.random.default_rng(3)
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                model.learn(*rows["x"].iat[i], rows["label"].iat[i])
        w = model.weights()
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at, "w": w[at]})

    out = np.zeros((1 << BITS) + 1)
    got = training.repartition(1).sortWithinPartitions("id", "text").mapInPandas(train, "at bigint, w double").toPandas()
    out[got["at"].to_numpy(np.int64)] = got["w"]
    return out


def held_out(id_: Column) -> Column:
    """True for ids whose CRC-32 (as text) leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from labelled documents that are not held out.

    At most ``rows`` ids are used, those of least hash; their ids are the one
    broadcast. Repeated labels of an id are averaged; of its documents the text
    of least hash counts, so ``rows`` bounds the texts too; null ids and labels
    are skipped. Without any label all weights are zero and every score is 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("label"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text"))
    joined = texts.join(F.broadcast(some), "id")
    one = joined.groupBy("id").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label")
    )
    return fit(one)


def score_texts(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Score of every whole text, 0 to 1: id, the columns of ``keep``, ``score``.

    Null text is empty and gets the bias alone. Rows are kept one for one; a
    map-only job. The model has 2**18 weights and travels with the tasks.
    """
    names = [id_col, *keep]
    schema = StructType([StructField(n, docs.schema[n].dataType) for n in names] + [StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> dict:
        w = sent.value
        out = []
        for text in batch.column(len(names)).to_pylist():
            b = buckets(text)
            out.append(w[b].sum() / np.sqrt(max(1, len(b))) + w[-1])
        return {**{n: batch.column(i) for i, n in enumerate(names)}, " score": sigmoid(np.array(out, np.float64))}

    rows = docs.select(*names, text_or_empty(text_col).alias(" text"))
    return arrow_map(rows, run, schema, rows=256)
