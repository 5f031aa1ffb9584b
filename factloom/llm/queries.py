"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import media, mixing, neardup, packing, preference, quality, sharding, substring, topk, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_media_columns(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark, sf_dir):
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op3_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_preference_format(spark, sf_dir):
    return preference.preference_digest(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark, sf_dir):
    return packing.pack_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_substring_dedup(spark, sf_dir):
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark, sf_dir):
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_exact_top_k, op3_source_mix, op4_preference_format, op5_toxicity, op6_packing, op7_substring_dedup, op8_near_duplicates, op9_quality, op10_sharding)}

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

ORACLE_SQL = {"op2_exact_top_k": TOP_K_SQL, "op3_source_mix": mixing.mix_sql(), "op4_preference_format": preference.PREFERENCE_SQL, "op7_substring_dedup": substring.SUBSTRING_SQL, "op8_near_duplicates": neardup.NEAR_SQL}
