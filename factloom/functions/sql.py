"""The term helpers as SQL functions, so that spark.sql can work on statements. They stay in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HELPERS = {
    "term_kind(k STRING) RETURNS STRING": "substring(k, 1, 1)",
    "term_num(k STRING) RETURNS DOUBLE": "CASE WHEN substring(k, 1, 1) IN ('i', 'd', 'm') THEN try_cast(substring(k, 3) AS DOUBLE) END",
    "term_text(k STRING) RETURNS STRING": "CASE WHEN substring(k, 1, 1) IN ('l', 'x') THEN substring(k, instr(k, '|') + 1) ELSE substring(k, 3) END",
    "term_lang(k STRING) RETURNS STRING": "CASE WHEN substring(k, 1, 1) = 'l' THEN substring_index(substring(k, 3), '|', 1) END",
    "term_millis(k STRING) RETURNS BIGINT": "CASE WHEN substring(k, 1, 1) = 't' THEN try_cast(substring_index(substring(k, 3), '|', 1) AS BIGINT) END",
    "term_iri(x STRING) RETURNS STRING": "concat('I:', x)",
    "lang_matches(tag STRING, r STRING) RETURNS BOOLEAN": "CASE WHEN r = '*' THEN length(tag) > 0 ELSE lower(tag) = lower(r) OR startswith(lower(tag), concat(lower(r), '-')) END",
    "round_half_up(x DOUBLE) RETURNS DOUBLE": "floor(x + 0.5D)",
}


def register(spark: SparkSession, statements: DataFrame | None = None, name: str = "statement") -> None:
    """The helpers as temporary functions, and the statements as a view."""
    for head, body in HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    if statements is not None:
        statements.createOrReplaceTempView(name)
