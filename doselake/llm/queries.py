"""The registered queries of this subpackage, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake.llm import (
    bytebpe, chat, fingerprints, mixing, negatives, neighbours, phrases, quality, secrets, simhash, tokencount, urls, warc,
)
from doselake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]

URL_SQL = r"""
WITH rules(rule_host, rule_path, action) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (SELECT row_number() OVER () AS n, page_id,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
best AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  arg_max(action, length(rule_host || rule_path)) AS action
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""


@query(URL_SQL)
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_pages(table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


@query()
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    weights = quality.train_on_labels(docs, labels)
    scored = quality.score_texts(docs, weights)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


PROBE = "</s>[INST] ok [/INST]"


@query()
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], own.schema)
    return chat.read_back(chat.format_conversations(own.unionByName(more)))


@query()
def op5_token_count(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return tokencount.count_tokens(table(spark, folder, "documents"), model, limit=4096)


@query()
def op7_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


@query()
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


@query()
def op10_ann(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


@query()
def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, mixing.tempered(docs))


@query()
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest_columns(secrets.find_secrets(table(spark, folder, "documents")))


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


#: Five hex digits of the SHA-1 at a time are four base32 digits.
WARC_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages),
lasts AS (SELECT body, max(page_id) AS last FROM p GROUP BY body),
digits AS (SELECT p.*, last, list_transform(range(8), lambda g: CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)) AS fives
  FROM p JOIN lasts USING (body))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM digits
"""


@query(WARC_SQL)
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    normalised = warc.archive_pages(table(spark, folder, "pages"), least_bytes=0)
    read = warc.read_archives(normalised, whole=False)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lines AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lines),
f AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS n
  FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(len(ws)) AS n FROM lines GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS m WHERE m.lang = c.lang AND m.k > c.k
  AND contains(' ' || m.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * m.a >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS j, ws FROM kept),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, x.n AS l, y.n AS r, CAST(totals.n AS BIGINT) AS n,
  CAST(CAST(1000 AS HUGEINT) * a * totals.n // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score FROM cuts JOIN totals USING (lang)
  JOIN f AS x ON x.lang = cuts.lang AND x.k = j AND x.phrase = array_to_string(list_slice(ws, 1, j), ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.k = cuts.k - j AND y.phrase = array_to_string(list_slice(ws, j + 1, cuts.k), ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


@query(PHRASES_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=100, top=2000, covered=100)


NEGATIVES_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query(NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(
        rows.withColumn("label", moved), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256
    )
