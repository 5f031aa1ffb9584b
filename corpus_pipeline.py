"""The corpus pipeline: each stage takes what the one before it kept, as written Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from factloom.llm import mixing, neardup, packing, quality, substring
from factloom.llm.common import stored, table


def reject_low_quality(spark, docs, sf_dir):
    return quality.kept(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    return neardup.one_of_each(docs)


def drop_repeated_passages(spark, docs, sf_dir):
    """Texts that lose words become the words left, joined by one space; the others stay as they are."""
    others = [c for c in docs.columns if c != "doc_id"]
    out = substring.repeats(docs.select("doc_id", "text", F.struct(*others).alias("others")), keep=("others",))
    now = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("others.text"))}
    if "n_chars" in others:
        now["n_chars"] = F.length(now["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select("doc_id", *[now.get(c, F.col("others").getField(c)).alias(c) for c in others]).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The trees, the seeded signatures and the tokenizer have no SQL form. tests/llm compares each stage with a
#: plain version: co-training with one that holds all rows in memory, classes and passages with loops over all
#: pairs and windows, the mix with its own counts, and the packed ids with the tokenizer's.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
