"""Collocations against brute force: hard texts, tiny memory budgets and chunks, big numbers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doselake.llm import phrases

DOCS = "doc_id bigint, text string, lang string"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER))]


def brute(rows, least, top, covered):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, min(5, len(ws) - i) + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    cand = {c: a for c, a in f.items() if len(c[1]) > 1 and a >= least}
    covers = Counter()
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                part = (lang, ws[i:i + k])
                covers[part] = max(covers[part], a)
    out = []
    for (lang, ws), a in cand.items():
        if 100 * covers[lang, ws] >= covered * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, score, a, " ".join(ws), left, right, n[lang]))
    made = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        made += [(lang, i + 1, p, a, left, right, total, s) for i, (_, s, a, p, left, right, total) in enumerate(mine[:top])]
    return sorted(made)


def run(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["a", "b", "c", "A", "the", "é", "É", "日本", "x\x00", "z" * 3000, "a\x01", "new", "york", "(a"]
    glue = [" ", "  ", "\t", " ", " ", " ", ", ", ".", "\n", "\r\n", "!?", "\x0b"]
    out = [("".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    out += [("the same line again and again here", "en")] * 40 + [(None, "en"), ("", "de"), (" . ", "fr"), ("one", None), ("new york " * 2000, "en")]
    return out


@pytest.mark.parametrize(("memory", "chunk", "least", "covered"), [(500_000, 8 << 20, 3, 100), (3, 50, 2, 100), (20, 1, 5, 60), (1, 400, 1, 100)])
def test_equals_brute_force(spark, rows, monkeypatch, memory, chunk, least, covered):
    few = rows if least > 1 else rows[:20]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(few)], DOCS).withColumns({"n": F.lit(1), "phrase": F.lit("p"), "_p": F.lit(2), "rank": F.lit(3)})
    sliced = phrases.by_lang

    def small(batch):  # chunk sizes are read in the workers, so they travel with the function
        phrases.CHUNK = chunk
        yield from sliced(batch)

    monkeypatch.setattr(phrases, "by_lang", small)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    got = run(df.repartition(3), least=least, top=7, covered=covered, memory_rows=memory)
    assert got == brute(few, least, 7, covered)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], DOCS)) == []


def test_chunks_cut_between_pieces_only(rows, monkeypatch):
    texts = pa.array(["", *[t or "" for t, _ in rows], ""])[1:]
    want = [ws for t in texts.to_pylist() for ws in pieces(t) if ws]
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(phrases, "CHUNK", size)
        got = []
        for c in phrases.chunks(texts):
            names = c.names.to_pylist()
            cut = np.flatnonzero(np.diff(c.pieces)) + 1
            got += [[names[i] for i in part] for part in np.split(c.codes, cut) if len(part)]
        assert got == want


def test_filter_never_misses(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    made = phrases.build_filter(spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(4))
    assert made.has(h.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 5000).view(np.uint64)
    assert made.has(others).mean() < 0.05
    empty = phrases.build_filter(spark.createDataFrame([], "h bigint"))
    assert not empty.has(others).any()


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**14, 10**16, 10**14, 10**14 + 1)], "a bigint, n bigint, l bigint, r bigint")
    d = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "l", "r")}
    got = row.withColumns({"over": (F.col("a") * 1000).cast("decimal(19,0)") * d["n"], "under": d["l"] * d["r"]}).selectExpr("over div under AS s").first().s
    assert got == 1000 * 10**14 * 10**16 // (10**14 * (10**14 + 1))
