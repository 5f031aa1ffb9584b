"""The pipeline on the smallest documents, stage by stage."""

import collections
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import mixing

from ..conftest import DATA
from .conftest import CLASHES
from .test_operators import TOKENIZER, brute_classes, brute_repeats, targets, words


def test_stages(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name] = (docs, spark.read.parquet(path))
        docs = kept[name][1]
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    a, b = kept["quality"]
    left = {r.doc_id for r in b.collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in left for d in good) >= 0.95 * len(good)
    a, b = ([(r.doc_id, r.text) for r in x.collect()] for x in kept["near_duplicates"])
    assert sorted(b) == sorted((d, t) for d, t in a if brute_classes(a)[d] == d)
    a, b = ([(r.doc_id, r.text) for r in x.collect()] for x in kept["repeated_passages"])
    given = dict(a)
    assert sorted(b) == sorted((d, rest if gone else given[d]) for d, _, gone, rest in brute_repeats(a))
    a, b = (x.collect() for x in kept["mix"])
    size, taken, whole = collections.Counter(), collections.Counter(), {r.doc_id: words(r.text) for r in a}
    for r in a:
        size[r.source] += len(words(r.text))
    for r in b:
        taken[r.source] += len(words(r.text))
        it = iter(whole[r.doc_id])
        assert all(w in it for w in words(r.text)) and r.n_chars == len(r.text)
    for s, n in targets(dict(size)).items():
        assert abs(taken[s] - n) <= 2 * mixing.BLOCK_WORDS
    a, b = (x.collect() for x in kept["pack"])
    lib, ids = Tokenizer.from_file(TOKENIZER), collections.defaultdict(list)
    for r in a:
        ids[r.doc_id].append([*lib.encode(r.text, add_special_tokens=False).ids, 1])
    assert sum(len(x) for rows in ids.values() for x in rows) == sum(r.length for r in b)
    for r in b:
        pieces = [np.array(x[r.start : r.start + r.length], "<u4").tobytes() for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(p) for p in pieces}


def test_run(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_nulls_repeats_and_clashing_columns(corpus, nothing, spark):
    """Rows go through all stages with columns named like those that stages work with; empty tables do too."""
    labels = f"{DATA}/sf0.001"
    for docs in (corpus, nothing):
        given = docs
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, labels).cache()
            if name != "pack":
                assert docs.columns == given.columns
                assert all(r[c] == c for r in docs.collect() for c in CLASHES)
        assert docs.count() > 0 or given.count() == 0
