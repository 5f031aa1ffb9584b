"""Text, vector and hybrid recall, evidence, and embeddings of statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery
from ..plans.settle import numbered, settled

K1, B = 1.2, 0.75
#: Latin letters with marks, and the letters they fold to.
MARKED, PLAIN = "àáâãäåāăąçćčďèéêëēėęěìíîïīłñńňòóôõöøōřśšťùúûüūůýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, Latin marks folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: str, phrase: bool) -> list[tuple[str, bool]]:
    """(token, whether it is a prefix). A word without a letter or digit is none."""
    import re

    out = []
    for w in text.split():
        prefix = w.endswith("*") and not phrase
        plain = w.lower().translate(str.maketrans(MARKED, PLAIN))
        found = [t for t in re.split(r"[\W_]+", plain) if t]
        out += [(t, prefix and i == len(found) - 1) for i, t in enumerate(found)]
    if not out:
        raise InvalidQuery("the text query has no word")
    return out


def matching(word: str, prefix: bool):
    return (lambda t: F.startswith(t, F.lit(word))) if prefix else (lambda t: t == word)


def text_search(values: DataFrame, query: str, mode: str = "all", visible: DataFrame | None = None, limit: int | None = None, key: str = "eid", text: str = "text") -> DataFrame:
    """(key, score, rank) by BM25; modes all, any and phrase; ties by key.

    N and the mean length are over all indexed values, visible or not; a phrase counts as one
    word, held by the values that hold the phrase.
    """
    words = query_words(query, mode == "phrase")
    toks = values.select(key, tokens(F.col(text)).alias("toks")).select(key, "toks", F.size("toks").alias("len"))
    if mode == "phrase":
        # every token between spaces of its own; a phrase that overlaps itself counts once
        line = F.concat(F.lit(" "), F.array_join("toks", "  "), F.lit(" "))
        phrase = " " + "  ".join(w for w, _ in words) + " "
        counts = [((F.length(line) - F.length(F.replace(line, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")]
    else:
        counts = [F.size(F.filter("toks", matching(w, p))) for w, p in words]
    x = toks.select(key, "len", *[c.alias(f"f{i}") for i, c in enumerate(counts)])
    stats = x.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(counts))])
    return scored(x, stats, len(counts), mode, visible, limit, key)


def scored(x: DataFrame, stats: DataFrame, n: int, mode: str, visible: DataFrame | None, limit: int | None, key: str) -> DataFrame:
    """BM25 of (key, len, f0 .. f(n-1)), the times that each of n words stands there; stats is one row (N, avgdl, n0 ..)."""
    x = x.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        f, have = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.ln((F.col("N") - have + 0.5) / (have + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))).otherwise(F.lit(0.0))

    hit = [F.col(f"f{i}") > 0 for i in range(n)]
    test = hit[0]
    for h in hit[1:]:
        test = test | h if mode == "any" else test & h
    x = x.where(test)
    if visible is not None:
        x = x.join(visible.select(key).distinct(), key, "left_semi")
    score = part(0)
    for i in range(1, n):
        score = score + part(i)
    return ranked(x.select(key, score.alias("score")), key, limit)


@dataclass(frozen=True)
class TextIndex:
    """postings (token, key, tf, len, places), and the number and mean length of the values behind them (one row)."""

    postings: DataFrame
    stats: DataFrame
    key: str

    @staticmethod
    def over(values: DataFrame, key: str = "eid", text: str = "text") -> TextIndex:
        toks = values.select(key, tokens(F.col(text)).alias("toks")).withColumn("len", F.size("toks"))
        each = toks.select(key, "len", F.posexplode("toks").alias("pos", "token"))
        postings = each.groupBy("token", key, "len").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("places"))
        return TextIndex(postings, toks.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl")), key)

    def save(self, path: str) -> None:
        """As files sorted by token, so that a search reads the row groups of its words alone."""
        self.postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("errorifexists").parquet(f"{path}/postings")
        self.stats.withColumn("key", F.lit(self.key)).write.mode("errorifexists").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        stats = spark.read.parquet(f"{path}/stats")
        return TextIndex(spark.read.parquet(f"{path}/postings"), stats.drop("key"), stats.first()["key"])

    def search(self, query: str, mode: str = "all", visible: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """What text_search gives of the same values, from the postings of the query's words."""
        words = query_words(query, mode == "phrase")
        match = [F.startswith("token", F.lit(w)) if prefix else F.col("token") == w for w, prefix in words]
        some = match[0]
        for m in match[1:]:
            some = some | m
        x = self.postings.where(some)
        if mode == "phrase":
            at = [F.flatten(F.collect_list(F.when(m, F.col("places")))).alias(f"p{i}") for i, m in enumerate(match)]
            x = x.groupBy(self.key, "len").agg(*at)
            begins = F.array_sort(F.filter("p0", lambda p: F.forall(F.array(*[F.array_contains(f"p{i}", p + i) for i in range(len(words))]), lambda t: t)))
            # a phrase that overlaps itself counts once
            step = lambda acc, p: F.when(p >= acc["next"], F.struct((p + len(words)).alias("next"), (acc["n"] + 1).alias("n"))).otherwise(acc)
            count = F.aggregate(begins, F.struct(F.lit(0).alias("next"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
            x, n = x.select(self.key, "len", count.alias("f0")), 1
        else:
            x = x.groupBy(self.key, "len").agg(*[F.sum(F.when(m, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, m in enumerate(match)])
            n = len(words)
        stats = self.stats.crossJoin(x.agg(*[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(n)]))
        return scored(x, stats, n, mode, visible, limit, self.key)


def ranked(hits: DataFrame, key: str, limit: int | None, by: list[Column] | None = None) -> DataFrame:
    """Hits with their rank; all of them are numbered by ranges, at most ``limit`` in one task."""
    order = by or [F.desc("score"), F.col(key)]
    if limit is None:
        return numbered(settled(hits), order, "rank")  # settled first, as sorting by ranges reads its input twice
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def evidence(statements: DataFrame, view: M.View = M.NOW) -> DataFrame:
    """(eid, confidence, confirmations, authors): what is said about each statement."""
    x = M.seen(statements, view).where(M.kind(F.col("s")) == "S").select(M.body(F.col("s")).try_cast("bigint").alias("eid"), "p", "o")
    return x.where(F.col("p").isin(M.CONFIDENCE, M.CONFIRMED_BY, M.AUTHOR)).groupBy("eid").agg(
        F.max(F.when(F.col("p") == M.CONFIDENCE, M.num(F.col("o")))).alias("confidence"),
        F.count(F.when(F.col("p") == M.CONFIRMED_BY, 1)).alias("confirmations"),
        F.count_distinct(F.when(F.col("p") == M.AUTHOR, F.col("o"))).alias("authors"),
    )


def with_evidence(hits: DataFrame, about: DataFrame, statements: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits ranked by score, confidence, confirmations, authors, newest, then eid."""
    x = hits.drop("rank").join(about, "eid", "left").join(statements.select("eid", "t_add"), "eid", "left").fillna(0, ["confirmations", "authors"])
    return ranked(x, "eid", limit, [F.desc("score"), F.desc_nulls_last("confidence"), F.desc("confirmations"), F.desc("authors"), F.desc("t_add"), F.col("eid")])


# --- vectors ---------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine, dot, or the negative Euclidean distance; greater is nearer."""
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        return F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "l2":
        return F.lit(0.0) - F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    raise InvalidQuery(f"unknown metric {metric}")


def vector_search(vectors: DataFrame, query: list[float], metric: str = "cosine", limit: int = 10, key: str = "vec_id", vector: str = "embedding", visible: DataFrame | None = None) -> DataFrame:
    """(key, score, rank) of the nearest vectors, exactly; filters come before ranking."""
    if not query or any(x != x or abs(x) == float("inf") for x in query):
        raise InvalidQuery("a query vector is finite and not empty")
    x = vectors.where(F.size(vector) == len(query))
    x = x if visible is None else x.join(visible.select(key).distinct(), key, "left_semi")
    q = F.array(*[F.lit(float(v)) for v in query])
    return ranked(x.select(key, similarity(F.col(vector), q, metric).alias("score")), key, limit)


def sign_bits(vector: Column, dims: int) -> Column:
    """Whether components are positive, 32 a number."""
    words = []
    for lo in range(0, dims, 32):
        bits = [F.when(vector[i] > 0, F.lit(1 << (i - lo)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(lo, min(dims, lo + 32))]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        words.append(total)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def prefiltered_search(vectors: DataFrame, query: list[float], metric: str = "cosine", limit: int = 10, candidates: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest of the ``candidates`` vectors whose signs are most like the query's; not exact."""
    x = vectors.where(F.size(vector) == len(query))
    q = [sum(1 << (i - lo) for i in range(lo, min(len(query), lo + 32)) if query[i] > 0) for lo in range(0, len(query), 32)]
    far = hamming(sign_bits(F.col(vector), len(query)), F.array(*[F.lit(w).cast("bigint") for w in q]))
    near = x.withColumn("far", far).orderBy("far", key).limit(candidates)
    return vector_search(near, query, metric, limit, key, vector)


def with_embeddings(embeddings: DataFrame | None, model: str, vectors: DataFrame, dims: int) -> DataFrame:
    """(model, eid, vec) with a model's vectors (eid, vec) added; a wrong length or a non-finite number refuses all."""
    bad = vectors.where((F.size("vec") != dims) | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if bad.take(1):
        raise InvalidQuery(f"vectors of {model} have {dims} finite numbers")
    new = vectors.select(F.lit(model).alias("model"), "eid", "vec")
    return new if embeddings is None else embeddings.join(new.select("model", "eid"), ["model", "eid"], "left_anti").select("model", "eid", "vec").unionByName(new)


def without_model(embeddings: DataFrame, model: str) -> DataFrame:
    return embeddings.where(F.col("model") != model)


def unembedded(statements: DataFrame, embeddings: DataFrame, model: str, view: M.View = M.NOW) -> DataFrame:
    """Visible statements that have no vector of a model."""
    return M.seen(statements, view).join(embeddings.where(F.col("model") == model).select("eid"), "eid", "left_anti")


def fused(rankings: list[DataFrame], limit: int, key: str = "eid", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over rankings that have the hit."""
    both = None
    for r in rankings:
        x = r.select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("score"))
        both = x if both is None else both.unionByName(x)
    return ranked(both.groupBy(key).agg(F.sum("score").alias("score")), key, limit)


def recall(values: DataFrame, query: str, vectors: DataFrame, vector: list[float], limit: int, key: str = "eid", **how) -> DataFrame:
    """Text and vector rankings, each to max(4 * limit, 50), fused."""
    depth = max(4 * limit, 50)
    return fused([text_search(values, query, how.get("mode", "any"), limit=depth, key=key), vector_search(vectors, vector, how.get("metric", "cosine"), depth, key)], limit, key)


def expanded(hits: DataFrame, statements: DataFrame, view: M.View = M.NOW) -> DataFrame:
    """Hits and the statements about the same subject."""
    x = M.seen(statements, view)
    mine = hits.select(F.col("eid").alias("hit"), "rank").join(x.select(F.col("eid").alias("hit"), F.col("s").alias("subject")), "hit")
    return mine.join(x.select("eid", "s", "p", "o"), F.col("subject") == F.col("s")).select("rank", "hit", "eid", "s", "p", "o")


def to_half(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, half): vectors as little-endian 16-bit floats, a quarter of doubles' bytes."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            packed = [None if v is None else np.asarray(v, "<f2").tobytes() for v in b.column(vector).to_pylist()]
            yield pa.record_batch([b.column(key), pa.array(packed, pa.binary())], [key, "half"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"{key} {kind}, half binary")


def from_half(packed: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            vectors = [None if h is None else np.frombuffer(h, "<f2").astype(np.float32) for h in b.column("half").to_pylist()]
            yield pa.record_batch([b.column(key), pa.array(vectors, pa.list_(pa.float32()))], [key, vector])

    kind = packed.schema[key].dataType.simpleString()
    return packed.select(key, "half").mapInArrow(run, f"{key} {kind}, {vector} array<float>")
