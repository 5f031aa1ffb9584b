"""Every operator against brute force on a small corpus, and its defined results at the edges."""

import collections
import hashlib
import io
import itertools
import re
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import gbt, media, mixing, neardup, packing, preference, quality, queries, sharding, substring, topk, toxicity

from ..conftest import DATA
from ..oracle import same

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, f"{DATA}/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- 1 media ---


def test_media_holds_the_text(corpus):
    stored = {(r.doc_id, r.media) for r in media.store_wav(corpus).collect()}
    texts = [(r.doc_id, r.text) for r in corpus.collect()]
    assert len(stored) == len(set(texts))
    for doc, m in stored:
        w = wave.open(io.BytesIO(m))
        payload = w.readframes(w.getnframes())
        assert w.getsampwidth() == 1 and len(payload) % 576 == 0 and len(payload) > 0
        assert any(payload.startswith((t or "").encode()) and set(payload[len((t or "").encode()) :]) <= {255} for d, t in texts if d == doc)


def test_media_digest(corpus):
    text = collections.defaultdict(set)
    for r in corpus.collect():
        text[r.doc_id].add(r.text or "")
    by_text = collections.defaultdict(set)
    rows = media.media_digest(corpus).collect()
    assert len(rows) == corpus.count()
    for r in rows:
        (t,) = text[r.doc_id]
        raw = t.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_bytes == len(media.to_wav(payload))
        by_text[t].add(r.feature)
    assert all(len(f) == 1 for f in by_text.values())


def test_peaks_against_plain_loops():
    x = np.frombuffer(b"some bytes that repeat and vary, 0123456789 " * 60, np.uint8)[: 576 * 4]
    best = []
    for lo in range(0, len(x) - media.FRAME + 1, media.HOP):
        power = np.abs(np.fft.rfft((x[lo : lo + media.FRAME].astype(np.float32) - 128) * np.hanning(media.FRAME).astype(np.float32)))
        best.append([(power[a:b].argmax() + a, power[a:b].max()) for a, b in media.BANDS])
    want = [(t, best[t][k][0]) for t in range(len(best)) for k in range(len(media.BANDS)) if (t == 0 or best[t][k][1] > best[t - 1][k][1]) and (t == len(best) - 1 or best[t][k][1] >= best[t + 1][k][1])]
    t, f = media.band_peaks(x)
    assert list(zip(t.tolist(), f.tolist())) == want
    times, codes = media.fingerprint(x)
    pairs = sorted((t, a << 14 | b << 5 | u - t) for i, (t, a) in enumerate(want) for u, b in want[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)
    assert list(zip(times.tolist(), codes.tolist())) == pairs


def test_the_last_bytes_reach_the_feature(spark):
    ends = [("!" * k + "~" * k) * (32 // k) for k in (1, 2, 4, 8)]
    rows = media.media_digest(spark.createDataFrame([(i, "~" * (2 * 576 - 64) + e) for i, e in enumerate(ends)], "doc_id bigint, text string")).collect()
    assert {r.payload_bytes for r in rows} == {2 * 576} and len({r.feature for r in rows}) == len(ends)


def test_media_of_nothing_and_of_slices(corpus, nothing, monkeypatch):
    assert media.media_digest(nothing).count() == 0
    whole = sorted(map(str, media.media_digest(corpus).collect()))
    monkeypatch.setattr(media, "SLICE", 1000)
    assert sorted(map(str, media.media_digest(corpus).collect())) == whole


# --- 2 top-k ---


def brute_top(vectors, k):
    out = []
    for q, a in vectors.items():
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0)), i) for i, b in vectors.items() if i != q)
            out += [(q, n, i, -v) for n, (v, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n,scale", [(3, 256), (130, 256), (260, 1 << 22), (120, 1 << 27)])
def test_top_k(spark, n, scale, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 2)
    rnd = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6)]) for i in range(n)]
    rows[1:3] = [(1, rows[0][1]), (2, rows[0][1])]
    rows = [(i, rows[7][1]) if n > 100 and i % 3 == 0 else (i, v) for i, v in rows]  # a third are one vector
    want = {i: [int(np.floor(scale * x)) for x in v] for i, v in rows}
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    v = topk.whole_vectors(df, scale=scale)
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(want, 5)


def test_top_k_of_repeated_rows(spark):
    """Rows that share an id are candidates each on their own, and none is its own query's."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [2.0, 1.0]), (51, [2.0, 1.0]), (51, [0.0, 3.0]), (52, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "c", "r") for r in rows], "vec_id bigint, embedding array<double>, copies string, rid string")
    v = topk.whole_vectors(df, scale=1)
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 3).collect()]
    a, b = [(50, 1, 51, 2), (50, 2, 51, 2), (50, 3, 52, 1)], [(50, 1, 51, 3), (50, 2, 51, 1), (50, 3, 51, 1)]
    assert sorted(got) == sorted(a + b)


def test_products_beyond_64_bits_raise(spark):
    v = spark.createDataFrame([(0, [1 << 40, 1 << 40]), (1, [1 << 40, 5])], "vec_id bigint, v array<bigint>")
    with pytest.raises(OverflowError):
        topk.top_k(v, v)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    v = topk.whole_vectors(df)
    assert topk.top_k(v, v, 5).count() == 0


# --- 3 mixing ---


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(corpus):
    rows = mixing.mix(corpus).collect()
    docs = corpus.collect()
    assert len(rows) == len(docs)
    size = collections.Counter()
    for r in docs:
        size[r.source] += len(words(r.text))
    want, taken = targets(dict(size)), collections.Counter()
    where = {r.doc_id: r.source for r in docs}
    for r in rows:
        s = where[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(corpus).collect()))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64):
        x = spark.range(n).select(F.lit(3).alias("rank"), F.lit(0).alias("epoch"), F.lit(n).alias("blocks"), F.col("id").alias("x"))
        assert sorted(r.x for r in mixing.permuted(x).collect()) == list(range(n))


def test_draws_meet_every_quota(spark, corpus):
    plan = mixing.settled(mixing.source_plan(mixing.settled(mixing.with_sizes(corpus.select("doc_id", "text", "source")).drop("text")), 4))
    quota = {r["rank"]: r["quota"] for r in plan.collect() if r["quota"]}
    got = collections.Counter(r["rank"] for r in mixing.draw(plan, 16).collect())
    assert got == quota
    blocks = collections.Counter((r["rank"], r["block"]) for r in mixing.draw(plan, 16).collect())
    assert max(blocks.values()) <= 3


def test_mixed_documents_are_the_taken_words(corpus):
    out = mixing.mixed_documents(corpus)
    assert out.columns == corpus.columns
    taken = collections.Counter()
    for r in mixing.mix(corpus).collect():
        taken[r.doc_id] += r.taken
    got = collections.Counter()
    whole = {r.doc_id: words(r.text) for r in corpus.collect()}
    for r in out.collect():
        w = words(r.text)
        got[r.doc_id] += len(w)
        it = iter(whole[r.doc_id])
        assert all(x in it for x in w)  # in order
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed_documents(nothing)
    assert out.columns == nothing.columns and out.count() == 0


def test_sums_over_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 4)
    rows = spark.range(50).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 7 % 5).alias("v"))
    got = {r.id: r.base for r in mixing.so_far(rows, ["k"], "id", "v").collect()}
    assert got == {i: sum(j * 7 % 5 for j in range(i) if j % 3 == i % 3) for i in range(50)}


# --- 4 preference ---


def test_preference(spark):
    c = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "x"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "x"), (1, 3, "assistant", "<|bad"), (2, 0, "user", "alone"), (4, 0, None, None), (5, 1, "user", "b"), (5, None, "system", "a"), (None, 0, "user", "lost"), (6, 0, "user", "s"), (7, 0, "user", "s"), (8, 0, "user", "t"), (8, 0, "user", "t"), (9, 0, "user", "t")]
    df = spark.createDataFrame([(*r, "x") for r in c], "conv_id bigint, turn bigint, role string, text string, pair_id string")
    got = {r.pair_id: r for r in preference.preference_examples(df).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    r = got[0]
    assert (r.prefix_turns, r.prompt) == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\nx<|end|>\n")
    assert r.chosen == "<|assistant|>\ngood<|end|>\n" and r.rejected == "<|assistant|>\n< |bad<|end|>\n"
    for text, spans in ((r.chosen, r.chosen_train), (r.rejected, r.rejected_train)):
        assert [text[s.begin : s.begin + s.length] for s in spans] == [text.split("\n", 1)[1][:-1]]
    assert (got[1].chosen_id, got[1].rejected_id, got[1].rejected, got[1].prompt) == (2, None, None, "")
    assert got[2].rejected.startswith("<|system|>\na") and got[2].chosen == "<|unknown|>\n<|end|>\n"
    assert (got[3].prefix_turns, got[3].chosen, got[3].rejected) == (1, "", "")
    assert (got[4].prefix_turns, got[4].chosen) == (1, "<|user|>\nt<|end|>\n")
    assert preference.preference_examples(df.limit(0)).count() == 0


def test_turns_are_compared_as_given(spark):
    c = [(0, 0, "user", "a<|b"), (0, 1, "assistant", "x"), (1, 0, "user", "a< |b"), (1, 1, "assistant", "x"), (2, 0, "a|>", "q"), (3, 0, "a| >", "q")]
    got = {r.pair_id: r for r in preference.preference_examples(spark.createDataFrame(c, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert (got[0].prefix_turns, got[0].prompt) == (0, "") and (got[1].prefix_turns, got[1].prompt) == (0, "")
    assert got[0].chosen == got[0].rejected == "<|user|>\na< |b<|end|>\n<|assistant|>\nx<|end|>\n"


def test_very_long_conversations(spark):
    turns = spark.range(6000).select((F.col("id") % 2).alias("conv_id"), F.expr("id div 2").alias("turn"), F.when(F.expr("id div 2 % 2 = 0"), "user").otherwise("assistant").alias("role"), F.concat(F.lit("t" * 50), F.when(F.col("id") >= 5000, F.col("id")).otherwise(F.expr("id div 2")).cast("string")).alias("text"))
    (r,) = preference.preference_examples(turns).collect()
    assert r.prefix_turns == 2500 and len(r.chosen_train) == 250
    assert all(r.chosen[s.begin : s.begin + s.length].endswith("<|end|>") for s in r.chosen_train)


# --- 5 and 9 classifiers ---


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_trees_and_curve():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    m = gbt.fit_calibrated(x[:400], y[:400])
    assert auc(y[400:], m(x[400:])) > 0.97
    raw = np.array([0.0, 1, 2, 3, 4, 5])
    c = gbt.fit_isotonic(raw, np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(c(np.linspace(-1, 6, 50))) >= 0).all() and c(np.array([9.0]))[0] == 1
    assert gbt.fit_calibrated(np.zeros((0, 3)), np.zeros(0))(np.zeros((2, 3))).tolist() == pytest.approx([0.5, 0.5])


def test_toxicity_on_rows_held_out(spark):
    d = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).cache()
    assert got.count() == 10_000
    r = got.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(x.doc_id).encode()) % 4 == 2) == x.held_out for x in got.collect())
    assert auc([x.toxic for x in r], [x.score for x in r]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in r)


def test_labels_of_held_out_rows_are_not_seen(spark):
    d = f"{DATA}/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_classifiers_at_the_edges(spark, corpus, nothing):
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for docs in (corpus, nothing):
        for lab in (labels, labels.limit(0)):
            t, q = toxicity.toxicity(docs, lab).collect(), quality.quality(docs, lab).collect()
            assert len(t) == len(q) == docs.count()
            assert all(0 <= r.score <= 1 for r in [*t, *q])
    assert quality.quality(corpus, labels.limit(0)).where("keep = 0").count() == 0
    assert quality.kept(corpus, labels.limit(0)).columns == corpus.columns


def test_quality_keeps_the_good(spark):
    d = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    r = quality.quality(docs, labels, where=~toxicity.held_out("id")).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert auc([x.quality for x in r], [x.score for x in r]) > 0.95
    assert np.mean([x.keep for x in r if x.quality]) > 0.95


def plain_co_training(xt, xm, y, pt, pm, tie):
    """Co-training with all rows in memory: (weights, [{pool row: label given}, ...]) of the views."""
    views, pool, got = [xt, xm], [pt, pm], [{}, {}]
    models = [gbt.fit_calibrated(x, y) for x in views]
    for _ in range(quality.ROUNDS):
        said = [m(p) for m, p in zip(models, pool)]
        for teacher, learner in ((0, 1), (1, 0)):
            new = {}
            for label in (0, 1):
                far = abs(said[teacher] - label)
                sure = sorted((far[i], tie[i], i) for i in range(len(pt)) if far[i] < quality.SURE and i not in got[learner])
                new |= {i: float(label) for _, _, i in sure[: int(quality.SHARE * len(y) * (y == label).mean())]}
            got[learner] |= new
        models = [gbt.fit_calibrated(x, y, taught=(p[list(g)], np.array(list(g.values())))) for x, p, g in zip(views, pool, got)]
    return models, got


def test_co_training_against_all_rows_in_memory(spark):
    d = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    numbers = quality.with_numbers(spark.read.parquet(f"{d}/documents.parquet"), "row.doc_id").cache()
    model = quality.fit(numbers, "row", labels)
    rows = numbers.join(labels.withColumnRenamed("doc_id", "row"), "row", "left").select("row", "xt", "xm", "quality", F.xxhash64("row").alias("tie")).orderBy("row").collect()
    own, rest = [r for r in rows if r.quality is not None], [r for r in rows if r.quality is None]
    y = np.array([r.quality for r in own], float)
    (t, m), got = plain_co_training(*[np.array([r[c] for r in own]) for c in ("xt", "xm")], y, *[np.array([r[c] for r in rest]) for c in ("xt", "xm")], [r.tie for r in rest])
    assert max(len(g) for g in got) > 20
    for a, b, c in ((model.of_text, t, "xt"), (model.of_meta, m, "xm")):
        x = np.array([r[c] for r in rows])
        assert len(a.unseen) == len(y) and np.allclose(a(x), b(x))  # curves rest on true labels alone
    gains = [quality.gain(k, y) for k in (t, m)]
    assert np.allclose(model.weight, np.array(gains) / sum(gains))


def test_views_against_plain_loops():
    texts = ["Good words, good WORDS! and http://x.y |a 123 %%", "", None, "one", "a b a b a b.", "x" * 30 + " *wow*"]
    got = quality.TextView()(pa.array(texts))
    for row, t in zip(got, texts):
        w = words(t)
        if not w:
            assert not row.any()
            continue
        marks = quality.MARKS
        tests = [
            len, lambda x: sum(c.isalpha() for c in x), lambda x: sum(c.isdigit() for c in x), lambda x: sum(c in marks for c in x), lambda x: x[-1] in marks, lambda x: x[0] in marks,
            lambda x: sum(c.isalpha() for c in x) > 1 and x.isupper(), lambda x: x[0].isupper(), lambda x: x[-1] in ".!?", lambda x: "|" in x, lambda x: "!" in x, lambda x: len(x) > 18, lambda x: not any(c.isalpha() for c in x), lambda x: "http" in x or "www" in x,
        ]
        want = [np.mean([float(f(x)) for x in w]) for f in tests] + [len(set(w)) / len(w), len(set(zip(w, w[1:]))) / max(1, len(w) - 1), np.std([len(x) for x in w]), np.log1p(len(w))]
        assert np.allclose(row, want)
    strings, ints = pa.array(["en", None], pa.string()), pa.array([10, None], pa.int64())
    got = quality.metadata_view(strings, strings, ints, ints, ints, ints)
    cell = lambda v: zlib.crc32(v.encode()) % quality.CELLS
    assert got.shape == (2, 6 + 2 * quality.CELLS) and got[0, 6 + cell("en")] == got[0, 6 + quality.CELLS + cell("en")] == got[1, 6 + cell("")] == 1
    assert np.allclose(got[:, :6], [[np.log1p(10), np.log1p(10), 1, 1, np.log1p(10), 1], [0] * 6])


def test_co_training_where_all_rows_are_labelled(spark):
    docs = spark.createDataFrame([(i, ("%% ## " if i % 2 else "good words here ") * (i % 5 + 1), "en", "a", None) for i in range(60)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"))
    rows = quality.quality(docs, labels).collect()
    assert all(r.keep == 1 - r.doc_id % 2 for r in rows)


def test_one_round_of_boosting_against_plain_loops():
    rnd = np.random.default_rng(5)
    x, y = rnd.integers(0, 6, (200, 3)).astype(float), rnd.integers(0, 2, 200).astype(float)
    got = gbt.fit_trees(x, y, trees=1, depth=1, rate=0.15, l2=2.0)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))
    best = max((g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2), -j, -v) for j in range(3) for v in range(5) for left in [x[:, j] <= v])
    j, v = -best[1], -best[2]
    left = x[:, j] <= v
    want = np.where(left, -0.15 * g[left].sum() / (h[left].sum() + 2), -0.15 * g[~left].sum() / (h[~left].sum() + 2)) + np.log(p / (1 - p))
    assert got.feature[0, 0] == j and np.allclose(got.raw(x), want)


def plain_features(text, lex):
    """The numbers of a text by loops over its words."""
    w = words(text)
    if not w:
        return [0.0] * toxicity.NAMES
    m = [lex.marks(x) for x in w]
    toxic = [max(r[0], r[2]) for r in m]
    near = lambda flag, i, reach: float(any(flag[max(0, i - reach) : i + reach + 1]))
    you = [r[5] for r in m]
    rows = [[*r, t, t * near(you, i, 3), t * near(you, i, 8), float(r[1] > 2.5), r[5] * near(toxic, i, 3)] for i, (r, t) in enumerate(zip(m, toxic))]
    sums = [sum(c) for c in zip(*rows)]
    return [s / len(w) for s in sums] + [max(r[k] for r in m) for k in (1, 3, 11)] + [np.log1p(sums[k]) for k in (0, 2, 4, 12, 15)] + [np.log1p(len(w))]


def test_toxicity_features_and_lexicon_against_plain_loops():
    lex = toxicity.Lexicon({"grr": 3.0, "bad": 1.6}, {"nast": 2.0})
    texts = ["You are an 1d1ot, you GRR nasty thing!", "", None, "grr", "a b c d e f g h you i j k bad!!! soooo b.a.d", "plain words of a page"]
    got = toxicity.features(pa.array(texts), lex)
    assert np.allclose(got, [plain_features(t, lex) for t in texts])
    assert lex.marks("1d1ot,")[0] == 1 and lex.marks("GRR")[1:3] == (3.0, 1.0) and lex.marks("nasty")[3:5] == (2.0, 1.0)
    held = ["zork you fool", "zork again", "Zork! now", "zork here", "so zork", "kind words", "kind again", "words here", "calm", "calm now"]
    y = np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 0.0])
    got = toxicity.Vocabulary(pa.array(held)).lexicon(np.arange(10), y)
    seen = [{x.strip(toxicity.EDGES).lower() for x in words(t)} for t in held]
    count = lambda w, k: sum(w in s for s, l in zip(seen, y) if l == k)
    want = {}
    for w in set().union(*seen):
        odds = np.log((count(w, 1) + 0.5) / 6) - np.log((count(w, 0) + 0.5) / 6)
        if count(w, 1) >= toxicity.SEEN and odds > 1.5:
            want[w] = odds
    assert got.words == pytest.approx(want) and set(want) == {"zork"} and set(got.starts) == {"zork"}


# --- 6 packing ---


def test_packing_is_lossless(corpus):
    lib = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(corpus, TOKENIZER).collect()
    want = collections.Counter((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in corpus.collect())
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        by_seq[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, tuple(ids.tolist()), p.doc_tokens))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    for (doc, ids), n in want.items():
        got = by_doc[doc]
        assert sum(len(i) for _, i, _ in got) == n * len(ids) and all(t == len(ids) for *_, t in got)
        for start, part, _ in got:
            assert ids[start : start + len(part)] == part
    assert {d for d, _ in want} == set(by_doc)


def test_windows_hold_the_mix():
    r = packing.Robin(1000)
    rnd = np.random.default_rng(2)
    docs = [(s, np.zeros(rnd.integers(1, 2000), np.uint32)) for s, n in (("a", 60), ("b", 30), ("c", 10)) for _ in range(n)]
    total = {s: sum(len(ids) for t, ids in docs if t == s) for s in "abc"}
    everything, done, own = sum(total.values()), 0, collections.Counter()
    for s, ids in docs:
        r.put(s, total[s] / everything, 0, done, own[s], s, ids)
        done, own[s] = done + len(ids), own[s] + len(ids)
    served = {s: 0 for s in "abc"}
    k = 0
    while r.waiting >= 1000:
        k += 1
        for doc, _, b, e in r.fill():
            served[doc] += e - b
        for s in "abc":
            assert abs(served[s] - k * 1000 * r.share[s]) <= 3


def test_deficits_carry_over_parts_wherever_a_task_begins():
    """A task that reads parts 1 and 3 of the order ends where one that reads all of it does."""
    rnd = np.random.default_rng(3)
    docs = [(int(k), "ab"[int(rnd.random() < 0.3)], int(rnd.integers(1, 50))) for k in np.repeat(range(4), 100)]
    share = {s: sum(n for _, t, n in docs if t == s) / sum(n for *_, n in docs) for s in "ab"}
    r, done, own = packing.Robin(100), 0, collections.Counter()
    for part, s, n in docs:
        if part in (1, 3):
            r.put(s, share[s], part, done, own[s], s, np.zeros(n, np.uint32))
            assert abs(r.deficit["a"] - share["a"] * (done - r.waiting + n) + own["a"] - r.held["a"] + n * (s == "a")) < 1e-6 or r.part["a"] == part
            while r.waiting >= 100:
                r.fill()
        done, own[s] = done + n, own[s] + n
    left = {s: share[s] * (done - r.waiting) - (own[s] - r.held.get(s, 0)) for s in "ab"}
    assert abs(r.deficit["a"] + r.deficit["b"]) < 1e-6 and abs(r.deficit["a"] - left["a"]) < 100


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_windows_of_a_table_stored_by_source_hold_the_mix(spark):
    rows = [(i, f"some words of document {i} and more of them", "abc"[i // 500]) for i in range(1500)]
    held = collections.defaultdict(set)
    for p in packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1), TOKENIZER, 4).collect():
        held[p.sequence_id // packing.WINDOW].add(rows[p.doc_id][2])
    assert len(held) > 50 and sum(len(x) == 3 for x in held.values()) > 0.9 * len(held)


# --- 7 substrings ---


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, (1 << 63)), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_substring(corpus, monkeypatch):
    rows = [(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is not None]
    got = sorted(tuple(r) for r in substring.repeats(corpus.where("doc_id is not null")).collect())
    assert got == brute_repeats(rows)
    assert sum(r[2] for r in got) > 500


def test_substring_with_repeated_ids_and_nulls(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (5, "x " + t), (None, t + " tail"), (2, " ".join(f"w{i}" for i in range(20))), (9, t)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(5, 40, 20), (5, 41, 20), (None, 41, 40), (2, 20, 0), (9, 40, 40)], key=str)


def test_substring_keeps_columns(corpus, nothing):
    got = substring.repeats(corpus, keep=("row", "key", "n_chars"))
    assert got.columns == ["doc_id", "row", "key", "n_chars", "n_words", "n_removed", "kept"] and got.count() == corpus.count()
    assert substring.repeats(nothing).count() == 0
    with pytest.raises(TypeError):
        substring.repeats(corpus.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_a_passage_of_all_documents_is_one_entry_a_part(spark):
    """A passage in every document: each part sends and is told its windows once, and all but one document lose it."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(3000)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(i, 30 if i else 0) for i in range(3000)]
    words = substring.Words(pa.record_batch([pa.array([0, 1]), pa.array([passage, passage])], ["doc_id", "text"]))
    assert len(np.unique(words.runs(7, 5)[words.inside(7)])) == 24


# --- 8 near duplicates ---


def brute_classes(rows):
    s = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else t or "" for d, t in rows}
    root = {d: d for d in s}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(s, 2):
        x, y = s[a], s[b]
        if x == y if isinstance(x, str) or isinstance(y, str) else len(x & y) >= 0.8 * len(x | y):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {d: top(d) for d in s}


def test_near_duplicates(corpus):
    rows = {(r.doc_id, r.text) for r in corpus.collect() if r.doc_id is not None}
    got = neardup.near_classes(corpus).collect()
    assert len(got) == corpus.count()
    want = brute_classes(rows) | {None: None}
    assert all(r.class_id == want[r.doc_id] for r in got)
    kept = neardup.one_of_each(corpus)
    assert kept.columns == corpus.columns
    assert {r.doc_id for r in kept.collect()} == {c for c in want.values()}


def test_near_copies_without_their_base(spark, monkeypatch):
    """Members that are near each other in chains only, in blocks of a few rows."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 5)
    base = [f"w{i}" for i in range(100)]
    rows = [(100 + i, " ".join(base[: 3 * i] + [f"x{i}"] * (i % 2) + base[3 * i :][: 97 - i % 3])) for i in range(25)]
    rows += [(200 + i, " ".join(base[:50] + [f"y{i}_{j}" for j in range(i)] + base[50:])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == brute_classes(rows)


def test_near_copies_that_repeat_a_passage(spark):
    rows = []
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(120))
        rows += [(2 * i, text), (2 * i + 1, text + f" {' '.join(f'f{i}x{j}' for j in range(20))}" * (50 if i % 2 else 200))]
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_a_bucket_of_near_copies_with_strays(spark, monkeypatch):
    """One large group of near copies, strays that share buckets with it, and hot groups dealt by broadcast."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neardup, "frequent", lambda counts, rows: F.broadcast(counts.where("n >= 20")))
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: i % 100] + [f"x{i}"] + base[i % 100 + 1 :])) for i in range(300)]
    rows += [(1000 + i, " ".join(base[: 60 + i] + [f"s{i}_{j}" for j in range(60 - i)])) for i in range(0, 60, 4)]
    rows += [(2000 + i, "the same text of a few words here") for i in range(60)]
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == brute_classes(rows)


def test_near_classes_of_nothing(nothing):
    assert neardup.near_classes(nothing).count() == 0


def test_registers_estimate_probability_jaccard():
    rnd = np.random.default_rng(4)
    h = rnd.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = rnd.uniform(0.5, 3, 300), rnd.uniform(0.5, 3, 300)
    a = neardup.prob_minhash(np.zeros(300, int), h, wa, 1, 2000)[0]
    b = neardup.prob_minhash(np.zeros(300, int), h, wb, 1, 2000)[0]
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(300))
    assert abs((a == b).mean() - exact) < 0.05
    plain = {}
    for x, w in zip(h[:20], wa[:20]):  # early termination changes nothing
        t = 0.0
        for r in range(1, 4000):
            with np.errstate(over="ignore"):
                z = neardup.mix64(np.array([x + np.uint64(r) * neardup.GOLDEN]))[0]
                k = int(neardup.mix64(np.array([x ^ (np.uint64(r) * np.uint64(neardup.FACTOR))]))[0] % np.uint64(16))
            t -= np.log((float(z >> np.uint64(11)) + 0.5) * 2.0**-53) / w
            plain[k] = min(plain.get(k, (np.inf, 0)), (t, int(x)))
    got = neardup.prob_minhash(np.zeros(20, int), h[:20], wa[:20], 1, 16)[0]
    assert [int(v) for v in got] == [plain[k][1] for k in range(16)]


# --- 10 sharding ---


def test_shards(corpus, nothing):
    rows = sharding.shard_digest(corpus).collect()
    docs = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in corpus.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == docs
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(nothing).count() == 0


def test_shards_are_even(spark):
    rows = sharding.shard(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    n = [r.n for r in rows]
    assert len(n) == 24 and max(n) - min(n) < 0.05 * sum(n) / 24


def test_equal_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 700)
    docs = spark.range(10_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("b" * 992).alias("text")).union(spark.range(100, 200).select("id", F.lit("a" * 992)))
    rows = sharding.shard(docs).collect()
    held = collections.Counter(r.shard for r in rows)
    assert len(rows) == 10_100 and max(held.values()) - min(held.values()) < 0.05 * 10_100 / 24
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(held[s])) for s in range(24))


def test_slots_are_numbered_in_parts(corpus, monkeypatch):
    whole = {(r.doc_id, r.size, r.text_crc32, r.shard) for r in sharding.shard(corpus, slots=64).collect()}
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    rows = sharding.shard(corpus, slots=8).collect()
    assert len(rows) == corpus.count() and len(whole) <= len(rows)
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_a_given_map_is_used_as_it_is(corpus):
    rows = sharding.shard(corpus, 5, 16, sharding.SlotMap(5, (3,) * 16)).collect()
    assert {r.shard for r in rows} == {3} and sorted(r.slot for r in rows) == list(range(len(rows)))
    with pytest.raises(ValueError):
        sharding.shard(corpus, 5, 32, sharding.SlotMap(5, (3,) * 16))


def test_a_stored_map_is_edited(corpus, spark, tmp_path):
    path = str(tmp_path / "map")
    sharding.SlotMap.even(6, 64).save(spark, path)
    sharding.shard(corpus, 6, 64, path=path).count()
    sharding.shard(corpus, 7, 64, path=path).count()
    two, three = sharding.SlotMap.load(spark, path, 2), sharding.SlotMap.load(spark, path)
    assert (two.shards, three.shards, three.version) == (6, 7, 3) and max(three.of) == 6
    assert three.moves == tuple((i, a, b) for i, (a, b) in enumerate(zip(two.of, three.of)) if a != b)


def test_maps_have_versions(spark, tmp_path):
    loads = [int(x) for x in np.random.default_rng(0).integers(1, 100, 256)]
    a = sharding.rebalanced(sharding.SlotMap.even(8, 256), loads)
    a = sharding.SlotMap(8, a.of)
    b = sharding.rebalanced(a, loads, 9)
    held = [sum(x for x, s in zip(loads, b.of) if s == k) for k in range(9)]
    assert b.version == 2 and max(held) - min(held) <= 100
    assert len(b.moves) < 0.25 * 256 and all(b.of[i] == t and a.of[i] == s for i, s, t in b.moves)
    c = sharding.rebalanced(b, loads, 8)
    assert max(c.of) == 7
    path = str(tmp_path / "map")
    a.save(spark, path)
    b.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == b and sharding.SlotMap.load(spark, path, 1) == a
    with pytest.raises(Exception, match="exist"):
        b.save(spark, path)
    empty = sharding.SlotMap(9, (0,) * 256, 3)
    empty.save(spark, path)
    assert sharding.SlotMap.load(spark, path).shards == 9


def test_the_query_stores_edits_and_reads_the_map(corpus, spark, monkeypatch):
    read, load = [], sharding.SlotMap.load
    monkeypatch.setattr(sharding.SlotMap, "load", staticmethod(lambda spark, path: read.append(path) or load(spark, path)))
    used = collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in sharding.shard_digest(corpus).collect())
    assert len(read) == 2 and len(set(read)) == 1
    of = load(spark, read[0], 2).of
    homes = collections.Counter((r.doc_id, r.size, r.text_crc32, of[r.vslot]) for r in sharding.with_slots(corpus).collect())
    assert used == homes and load(spark, read[0], 1).of == sharding.SlotMap.even(24).of
