"""Preference formatting of conversation pairs: the common prompt once, and two masked completions.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINED = "assistant"


def safe_role(role: Column) -> Column:
    return F.replace(role, F.lit("|>"), F.lit("| >"))


def rendered(role: Column, text: Column) -> Column:
    """A turn with its marks; marks inside are parted: "|>" of the role and "<|" of the text."""
    return F.concat(F.lit("<|"), safe_role(role), F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns in order, from 0, as they are but for nulls."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = F.coalesce(F.col("role"), F.lit("unknown")), F.coalesce(F.col("text"), F.lit(""))
    return turns.where(F.col("conv_id").isNotNull()).select("conv_id", (F.row_number().over(order) - 1).alias("pos"), role.alias("role"), text.alias("text"))


def preference_examples(turns: DataFrame, pairs: Column | None = None, rejected: Column | None = None) -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and the trained spans of each completion.

    pairs names the pair of a conversation and rejected tells its second member; by default
    conversations 2n and 2n + 1 are chosen and rejected of pair n. The prompt is the longest
    run of first turns, equal in role and text as given, that both have. Rendering then parts
    marks inside a turn: "<|" of a text becomes "< |", and "|>" of a role "| >". A span is (begin, length) in
    characters of the completion, of an assistant turn's text and end mark; the rest is masked.
    A conversation without its partner forms a pair whose other completion and id are null and
    whose prompt is empty. Turns without conv_id belong to none. Turns with equal numbers are
    ordered by role and text, and repeated turns count as often as they stand there. Null
    texts are empty, null roles "unknown". Only conv_id, turn, role and text are read.
    """
    pairs = F.shiftright("conv_id", 1) if pairs is None else pairs
    second = F.col("conv_id") % 2 != 0 if rejected is None else rejected
    t = numbered(turns).withColumns({"pair_id": pairs.cast("bigint"), "side": second.cast("int")})
    # a position belongs to the prompt if both sides have it equal, there and everywhere before
    sides = F.array_sort(F.collect_list(F.struct("side", "role", "text")))
    same = t.groupBy("pair_id", "pos").agg(sides.alias("s")).select(
        "pair_id", "pos",
        F.coalesce((F.size("s") == 2) & (F.try_element_at("s", F.lit(1))["side"] != F.try_element_at("s", F.lit(2))["side"]) & (F.try_element_at("s", F.lit(1))["role"] == F.try_element_at("s", F.lit(2))["role"]) & (F.try_element_at("s", F.lit(1))["text"] == F.try_element_at("s", F.lit(2))["text"]), F.lit(False)).alias("same"),
    )
    prefix = same.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))), F.max("pos") + 1).alias("prefix_turns"))
    t = t.join(prefix, "pair_id").withColumn("shared", F.col("pos") < F.col("prefix_turns"))
    t = t.select("pair_id", "side", "conv_id", "pos", "role", "prefix_turns", "shared", rendered(F.col("role"), F.col("text")).alias("piece"), F.length(safe_role(F.col("role"))).alias("role_chars"))
    own = Window.partitionBy("pair_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.when(~F.col("shared"), F.length("piece"))).over(own), F.lit(0)))
    head = F.col("role_chars") + 5
    span = F.struct((F.col("at") + head).cast("bigint").alias("begin"), (F.length("piece") - head - 1).cast("bigint").alias("length"))

    def joined(keep: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "piece")))), lambda x: x["piece"]), "")

    def spans(side: int) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("side") == side) & ~F.col("shared") & (F.col("role") == TRAINED), span)))

    def own_id(side: int) -> Column:
        return F.min(F.when(F.col("side") == side, F.col("conv_id")))

    out = t.groupBy("pair_id").agg(
        own_id(0).alias("chosen_id"), own_id(1).alias("rejected_id"), F.max("prefix_turns").alias("prefix_turns"),
        joined(F.col("shared") & (F.col("side") == 0)).alias("prompt"),
        joined(~F.col("shared") & (F.col("side") == 0)).alias("chosen"), joined(~F.col("shared") & (F.col("side") == 1)).alias("rejected"),
        spans(0).alias("chosen_train"), spans(1).alias("rejected_train"),
    )
    blank = lambda c, by: F.when(F.col(by).isNotNull(), F.col(c)).alias(c)
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("prefix_turns").cast("int").alias("prefix_turns"), "prompt", blank("chosen", "chosen_id"), blank("rejected", "rejected_id"), "chosen_train", "rejected_train")


def preference_digest(turns: DataFrame) -> DataFrame:
    """The examples with spans as text (begin+length, comma between)."""
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["begin"], s["length"])), ",").alias(c)
    x = preference_examples(turns)
    return x.select("pair_id", "chosen_id", "rejected_id", "prefix_turns", "prompt", "chosen", "rejected", flat("chosen_train"), flat("rejected_train"))


PREFERENCE_SQL = r"""
WITH t AS (
  SELECT conv_id, conv_id // 2 AS pair_id, abs(conv_id % 2) AS side,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
same AS (
  SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT side) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM t GROUP BY ALL),
prefix AS (
  SELECT pair_id, coalesce(min(pos) FILTER (NOT same), max(pos) + 1) AS prefix_turns FROM same GROUP BY ALL),
r AS (
  SELECT t.* REPLACE (replace(role, '|>', '| >') AS role), role = 'assistant' AS trained, prefix_turns, pos < prefix_turns AS shared,
    '<|' || replace(role, '|>', '| >') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS piece
  FROM t JOIN prefix USING (pair_id)),
a AS (
  SELECT *, coalesce(sum(CASE WHEN NOT shared THEN length(piece) END) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
g AS (
  SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id, max(prefix_turns)::INT AS prefix_turns,
    coalesce(string_agg(piece, '' ORDER BY pos) FILTER (shared AND side = 0), '') AS prompt,
    coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT shared AND side = 0), '') AS chosen,
    coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT shared AND side = 1), '') AS rejected,
    coalesce(string_agg((start + length(role) + 5)::BIGINT || '+' || (length(piece) - length(role) - 6), ',' ORDER BY pos) FILTER (NOT shared AND side = 0 AND trained), '') AS chosen_train,
    coalesce(string_agg((start + length(role) + 5)::BIGINT || '+' || (length(piece) - length(role) - 6), ',' ORDER BY pos) FILTER (NOT shared AND side = 1 AND trained), '') AS rejected_train
  FROM a GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, prefix_turns, prompt,
  CASE WHEN chosen_id IS NOT NULL THEN chosen END AS chosen, CASE WHEN rejected_id IS NOT NULL THEN rejected END AS rejected, chosen_train, rejected_train FROM g
"""
