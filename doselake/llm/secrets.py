"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Built-in column functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doselake.llm.common import text_or_empty

#: Kind, pattern, group that is measured, least length of it. Kinds in the order of ties.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is the whole run: shorter runs fail anyway
)
#: Strings that the tests judge.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
CANDIDATE_RANK = len(BASE)
#: Inferred encodings, the first that fits: pattern, size of the alphabet.
ENCODINGS = (
    (r"^[0-9]+$", 10), (r"^(?=.*[0-9])[0-9a-f]+$", 16), (r"^(?=.*[0-9])[0-9A-F]+$", 16), (r"^[a-z]+$|^[A-Z]+$", 26),
    (r"^[A-Z2-7]+$", 32), (r"^[a-z0-9]+$|^[A-Z0-9]+$", 36), (r"^[A-Za-z]+$", 52), (r"^[A-Za-z0-9]+$", 62),
    (r"", 64),
)
BINS_PER_UNIT, MOST_BINS = 20, 600


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal: Zelen and Severo's polynomial, good to 1e-7."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def spans_of(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Array of ``start, rank, end, kind, hit`` of the leftmost non-overlapping matches that are long enough.

    The text between matches and the matches themselves, in turn, give the positions.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, 0).alias("hit"),
        F.regexp_extract_all(text, p, group).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        found = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            x["hit"].alias("hit"),
        )
        long = x["hit"].isNotNull() & (F.length(x["part"]) >= least)
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"),
            F.when(long, F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"),
        )

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(*[spans_of(text, p, g, n, i, kind) for i, (kind, p, g, n) in enumerate(BASE)])


def candidate_spans(text: Column) -> Column:
    return spans_of(text, CANDIDATE, 0, 20, CANDIDATE_RANK, "random")


def randomness_p(s: Column) -> Column:
    """How well structure explains a string: small if it looks drawn at random from its alphabet.

    Three tests, each of the hypothesis that the string is structured by at
    least a set margin, each a normal deviate at the string's own length:
    symbols collide at twice the uniform rate or more (the chi-squared
    statistic as an index of coincidence); runs of a character class are off
    their expected number by half or more; the correlation of neighbours is a
    half or more. The deviates are combined by Stouffer's sum; a string that
    lies beyond the margin in any one test gets 1.
    """
    # one value after the other, each bound once: fields of nested one-element transforms
    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def with_body(body: Column) -> Column:
        size = F.lit(0)
        for pattern, n in reversed(ENCODINGS):
            size = F.when(body.rlike(pattern), F.lit(n)).otherwise(size)
        letters = body.rlike("^[a-z]+$|^[A-Z]+$")
        # classes: vowels and other letters where only letters of one case occur, else digits, letters by case, signs
        classes = F.when(
            letters, F.translate(F.lower(body), "abcdefghijklmnopqrstuvwxyz", "01110111011111011111011111")
        ).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
            body, "[+/_-]", "!"), "[0-9]", "0"), "[a-z]", "1"), "[A-Z]", "2"))
        codes = F.transform(F.split(body, ""), lambda c: F.ascii(c).cast("double"))
        facts = F.struct(
            F.length(body).cast("double").alias("n"), (2.0 / size).alias("share"), classes.alias("classes"),
            codes.alias("codes"),
            F.aggregate(
                F.transform(F.array_distinct(F.split(body, "")), lambda c: F.length(body) - F.length(F.replace(body, c, F.lit("")))),
                F.lit(0.0), lambda a, c: a + c * (c - 1),
            ).alias("pairs"),
        )
        return bind(facts, with_facts)

    def with_facts(x: Column) -> Column:
        n = x["n"]
        parts = F.transform(
            F.array(*map(F.lit, "012!")), lambda c: (n - F.length(F.replace(x["classes"], c, F.lit("")))) / n
        )
        more = F.struct(
            n.alias("n"), x["share"].alias("share"), x["codes"].alias("codes"), x["pairs"].alias("pairs"),
            (1.0 - F.aggregate(parts, F.lit(0.0), lambda a, c: a + c * c)).alias("change"),
            # a run ends where the next sign differs
            ((F.length(F.regexp_replace(x["classes"], r"(.)(?=\1)", "")) - 1) / (n - 1)).alias("runs"),
            (F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c) / n).alias("mean"),
        )
        return bind(more, with_more)

    def with_more(x: Column) -> Column:
        n, share, change, mean = x["n"], x["share"], x["change"], x["mean"]
        spread = F.sqrt(2 * share * (1 - share) / (n * (n - 1)) + 4 * share * share / n)
        uniform = (share - x["pairs"] / (n * (n - 1))) / spread
        # one class throughout says nothing about runs: the other two tests decide
        steady = F.when(change <= 1e-9, F.lit(0.0)).otherwise(
            (change / 2 - F.abs(x["runs"] - change)) / F.sqrt(F.greatest(change, F.lit(1e-9)) * (1 - change) / (n - 1))
        )
        around = F.transform(x["codes"], lambda c: c - mean)
        var = F.aggregate(around, F.lit(0.0), lambda a, c: a + c * c)
        lag = F.aggregate(
            F.zip_with(F.slice(around, 1, F.size(around) - 1), F.slice(around, 2, F.size(around) - 1), lambda a, b: a * b),
            F.lit(0.0), lambda a, c: a + c,
        )
        free = F.when(var <= 1e-9, F.lit(-9.0)).otherwise((0.5 - F.abs(lag / F.greatest(var, F.lit(1e-9)))) * F.sqrt(n))
        least = F.least(uniform, steady, free)
        return F.when(least < 0, F.lit(1.0)).otherwise(normal_tail((uniform + steady + free) / math.sqrt(3)))

    return bind(F.rtrim(s, F.lit("=")), with_body)


def stratum(s: Column) -> Column:
    """Lengths that are compared with each other: doublings from 20 on, halves apart."""
    return F.floor(2 * F.log2(F.length(s) / 20.0)).cast("int")


def p_bin(p: Column) -> Column:
    """Rounded up, so a bin never claims a smaller p-value than its strings have."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_UNIT), F.lit(MOST_BINS)).cast("int")


def cutoffs(candidates: DataFrame, q: float) -> DataFrame:
    """Benjamini-Hochberg per length stratum over the distinct strings of column ``hit``.

    One row: a map from stratum to the least bin that is a discovery. Strings
    are counted by bin, so at most bins x strata rows meet in the sums.
    """
    tested = candidates.select("hit").distinct().select(
        stratum(F.col("hit")).alias("s"), p_bin(randomness_p(F.col("hit"))).alias("b")
    )
    bins = tested.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("s").orderBy(F.desc("b"))
    ranked = bins.withColumn("k", F.sum("n").over(upto)).withColumn("m", F.sum("n").over(Window.partitionBy("s")))
    fine = ranked.where(F.pow(F.lit(10.0), -F.col("b") / F.lit(float(BINS_PER_UNIT))) <= F.lit(q) * F.col("k") / F.col("m"))
    cut = fine.groupBy("s").agg(F.min("b").alias("b"))
    return cut.agg(F.map_from_entries(F.collect_list(F.struct("s", "b"))).alias("cuts"))


def find_secrets(docs: DataFrame, text_col: str = "text", q: float = 0.05, keep: tuple[str, ...] = ("doc_id",), out: str = "secrets") -> DataFrame:
    """Columns of ``keep`` and ``out``: array of ``start, rank, end, kind`` sorted by start, then kind.

    Kinds are ``assign, access, hex`` (fixed patterns, each with its own
    leftmost non-overlapping matches) and ``random``: strings of 20 or more
    characters that the battery finds random, at false-discovery rate ``q``
    among the distinct strings of like length in the whole table.

    Null text is empty: no spans. Rows stay one for one; other columns are not
    read. Two scans of the texts and no shuffle of them: the first gathers the
    candidates' p-values, the second looks each candidate up in a small map.
    """
    text = text_or_empty(text_col)
    found = docs.select(F.explode(candidate_spans(text)).alias("c")).select(F.col("c.hit").alias("hit"))
    cuts = cutoffs(found, q).scalar()
    rows = docs.select(*keep, text.alias(" text")).select(
        *keep, base_spans(F.col(" text")).alias(" base"), candidate_spans(F.col(" text")).alias(" more"),
        cuts.alias(" cuts"),
    )
    random = F.when(F.size(" more") > 0, F.filter(
        " more", lambda c: p_bin(randomness_p(c["hit"])) >= F.coalesce(F.col(" cuts")[stratum(c["hit"])], F.lit(MOST_BINS + 1))
    )).otherwise(F.col(" more"))
    return rows.select(*keep, F.transform(
        F.array_sort(F.concat(F.col(" base"), random)),
        lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")),
    ).alias(out))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digests of the output of ``find_secrets``."""
    base = F.filter("secrets", lambda c: c["rank"] < CANDIDATE_RANK)

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda c: c["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind, *_ in BASE], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"),
        number("random"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", q: float = 0.05) -> DataFrame:
    """The documents with each secret, or overlapping group of secrets, replaced by ``mask``.

    All columns of ``docs`` are kept; ``text`` is rewritten, and ``n_chars``
    follows where a secret was found. Rows without a secret stay as they are.
    """
    names = docs.columns
    found = find_secrets(docs, q=q, keep=tuple(names), out=" secrets")  # a name that no column of docs has
    none = F.array().cast("array<string>")

    def step(state: Column, c: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, c["start"] - state["at"])
        ahead = c["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], c["end"]).alias("at"),
            F.when(ahead, F.concat(state["out"], F.array(gap, F.lit(mask)))).otherwise(state["out"]).alias("out"),
        )

    clean = F.aggregate(
        " secrets", F.struct(F.lit(0).alias("at"), none.alias("out")), step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    hit = F.size(" secrets") > 0
    made = found.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    size = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", size).select(*names)
