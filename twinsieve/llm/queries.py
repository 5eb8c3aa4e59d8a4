"""The queries of this subpackage's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bitslice, bpe, hardneg, mixing, rpforest, runs, simhash, substrings, tagpath, token_store, toxicity, urlrules, warc
from .common import fresh_dir, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_store(table(spark, sf_dir, "documents"), TOKENIZER, fresh_dir(spark, "tokens"), end_id=1)
    return token_store.read_store(spark, files, ids=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs).select("doc_id", "source", "lang", "text", F.col("copy").cast("long").alias("copy"), "shuffle_key")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_rpforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"))


def op9_tagpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extracted(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mined(table(spark, sf_dir, "embeddings").withColumn("label", label), positives=5, negatives=3, every=50)


def op12_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), window=20)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), loops=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_warc, op3_token_store, op4_mixing, op5_bpe, op6_bitslice, op7_rpforest, op8_urlrules, op9_tagpath, op10_simhash, op11_balltree, op12_suffixtree, op13_runs)
}

ORACLE: dict[str, str] = {
    "op4_mixing": """
WITH size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source HAVING sum(length(coalesce(text, ''))) > 0),
rate AS (SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS r FROM size),
draws AS (SELECT source, r, greatest(1, ceil(r / 64.0))::BIGINT AS m FROM rate),
steps AS (SELECT source, m, r / m AS l, unnest(range(0, (ceil(r / m) + ceil(12 * sqrt(r / m)) + 41)::BIGINT)) AS k FROM draws),
cdf AS (SELECT source, m, k, sum(exp(k * ln(l) - l - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
list AS (SELECT source, m, list(c) AS cs FROM cdf GROUP BY source, m),
drawn AS (
  SELECT d.doc_id, d.source, d.lang, d.text,
    list_sum(list_transform(range(1, m + 1), lambda j: len(list_filter(cs, lambda z: z < (('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0))))::BIGINT AS n
  FROM documents d JOIN list ON d.source IS NOT DISTINCT FROM list.source),
copies AS (SELECT doc_id, source, lang, text, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)
SELECT doc_id, source, lang, text, copy, md5('42-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key FROM copies
""",
    "op6_bitslice": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op11_balltree": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
    "op12_suffixtree": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM place),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS pos FROM win WHERE nth > 1),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word.word, ' ' ORDER BY word.pos) AS text FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
}
