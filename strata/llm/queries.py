"""The queries opN_* and pipeline over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .byte_bpe import encoded
from .common import parquet
from .exact_dedup import exact_duplicates
from .hard_negatives import hard_negatives
from .mixture_packing import mixture_packed
from .ngram_join import near_duplicates
from .packing import packed_sequences
from .pii import personal_data
from .pseudo_likelihood import pseudo_likelihood
from .quality import quality_scores
from .syncmers import fingerprints
from .toxicity import toxicity
from .warc import warc_round_trip
from .whitening import whitened


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(parquet(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(parquet(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(parquet(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(parquet(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(parquet(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(parquet(spark, sf_dir, "documents"), keep="largest")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(parquet(spark, sf_dir, "pages"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(parquet(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(parquet(spark, sf_dir, "embeddings"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packed(parquet(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(parquet(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_lm_scoring, op3_best_fit_packing, op4_byte_bpe, op5_ngram_jaccard_join, op6_quality_classifier, op7_exact_dedup, op8_warc, op9_document_fingerprints, op10_toxicity, op11_embedding_whitening, op12_mixture_packing, op13_hard_negatives)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op13_hard_negatives": OP13_SQL}
