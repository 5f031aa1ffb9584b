"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's components are cut into LISTS runs; a list holds each candidate's inner product
over its run. Phase 1 gathers the heads of the local lists and scores those rows fully: the
k-th best such score tau is reached by k rows. Phase 2 broadcasts the cutoff tau / LISTS; a
row below it in every list sums to less than tau, so the entries at or above it are enough.
Phase 3 drops entries whose bound (seen parts, and the cutoff for unseen ones) is below tau
and scores the rest exactly, where they lie: only ids and scores are gathered, of each tile the
k best of a query and what ties with them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reachable, settled

LISTS = 2
CHUNK = 2048  #: queries broadcast at once; the rest follow in more rounds
TILE = 1024  #: candidates scored at once


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v) of every row: floor(scale * x) of each component.

    Vectors that are null or hold a null or non-finite component, and null ids, take no part.
    """
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    ints = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return rows.where(F.col(key).isNotNull() & ok).select(F.col(key).cast("bigint").alias("vec_id"), ints.alias("v"))


def dense(column, dims: int) -> np.ndarray:
    """A list column as a matrix; vectors shorter than the longest count as ending in zeros."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat, sizes = np.asarray(column.values)[offsets[0] : offsets[-1]], np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def exact_type(top: int, dims: int):
    """The fastest type in which no product sum rounds; raises where 64 bits may not hold it."""
    most = top * top * max(dims, 1)
    if most >= 1 << 63:
        raise OverflowError(f"inner products of {dims} components up to {top} may not fit 64 bits")
    return np.float32 if most <= 1 << 24 else np.float64 if most <= 1 << 53 else np.int64


def tiles(batches, dims: int, k: int):
    """(ids, rids, copies, matrix) of up to TILE rows. Of equal vectors in a batch the k + 1 smallest ids stay:
    no query's k best can hold more of them, even after its own row is left out."""
    for b in batches:
        ids, rids, copies, m = np.asarray(b.column("vec_id")), np.asarray(b.column("rid")), np.asarray(b.column("copies")), dense(b.column("v"), dims)
        if not len(ids):
            continue
        order = np.argsort(ids, kind="stable")
        ids, rids, copies, m = ids[order], rids[order], copies[order], np.ascontiguousarray(m[order])
        _, group = np.unique(m.view(np.dtype((np.void, m.dtype.itemsize * max(dims, 1)))).reshape(-1) if dims else np.zeros(len(ids)), return_inverse=True)
        by = np.argsort(group, kind="stable")
        g = group[by]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        nth = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        kept = np.sort(by[nth <= k])
        for lo in range(0, len(kept), TILE):
            at = kept[lo : lo + TILE]
            yield ids[at], rids[at], copies[at], m[at]


def partials(q: np.ndarray, m: np.ndarray, kind, cuts) -> list[np.ndarray]:
    q, m = q.astype(kind), m.astype(kind)
    return [q[:, a:b] @ m[:, a:b].T for a, b in cuts]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query, ties to smaller ids.

    rows and queries are (vec_id, v) as whole_vectors gives them; a query with fewer than k
    other rows gets them all, and an empty table gives none. Rows that repeat are candidates each on their own; none
    with the query's id is one. Queries that repeat an id and vector are one; those that repeat
    an id with other vectors each have their own k rows. Scores are 64-bit integers; components
    so large that one might not fit raise. Any number of queries: CHUNK of them are broadcast at a time.
    """
    spark = rows.sparkSession
    reachable(spark)
    # equal rows are one from here on, and n of them at the end
    rows = settled(rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("rid", F.monotonically_increasing_id()))
    size = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dims, top = size[0] or 0, size[1] or 0
    kind = exact_type(int(top), dims)
    edges = [dims * i // LISTS for i in range(LISTS + 1)]
    cuts = list(zip(edges, edges[1:]))
    queries = queries.select("vec_id", "v").distinct()
    chunks = max(1, math.ceil(queries.count() / CHUNK))
    queries = settled(queries.select("vec_id", "v", F.monotonically_increasing_id().alias("query"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)).alias("chunk")))
    found = None
    for chunk in range(chunks):
        mine = queries.where(F.col("chunk") == chunk).select("query", "vec_id", "v")
        part = one_chunk(spark, rows, mine, k, dims, kind, cuts)
        part = settled(part) if chunks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def one_chunk(spark, rows, mine, k, dims, kind, cuts) -> DataFrame:
    held = mine.toArrow()
    qids = held.column("vec_id").to_numpy()
    order = np.argsort(qids, kind="stable")
    qids, numbers = qids[order], held.column("query").to_numpy()[order]
    q = dense(held.column("v").combine_chunks(), dims)[order] if held.num_rows else np.zeros((0, dims), np.int64)
    shared = spark.sparkContext.broadcast((qids, q))
    low = -(1 << 62)

    def own(ids, qids):
        """(query, row) pairs of one id."""
        lo, hi = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")  # ids rise
        n = hi - lo
        return np.repeat(np.arange(len(qids)), n), np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)

    def heads(batches):
        """Phase 1: the k largest of every local list, with their scores over all lists."""
        qids, q = shared.value
        best = {}  # list -> (partial, total, row) of the heads so far
        for ids, rids, _, m in tiles(batches, dims, k):
            parts = [p.astype(np.float64) for p in partials(q, m, kind, cuts)]
            total = sum(parts)
            at, hit = own(ids, qids)
            for j, p in enumerate(parts):
                p[at, hit] = -np.inf
                n = min(k, p.shape[1])
                take = np.argpartition(-p, n - 1, axis=1)[:, :n]
                new = [np.take_along_axis(p, take, 1), np.take_along_axis(total, take, 1), rids[take]]
                if j in best:
                    new = [np.concatenate([a, b], 1) for a, b in zip(best[j], new)]
                    pick = np.argsort(-new[0], axis=1, kind="stable")[:, :k]
                    new = [np.take_along_axis(x, pick, 1) for x in new]
                best[j] = new
        for part, total, rids in best.values():
            r, c = np.nonzero(part > -np.inf)
            yield pa.record_batch([pa.array(numbers[r]), pa.array(rids[r, c]), pa.array(total[r, c])], ["query", "rid", "score"])

    gathered = rows.mapInArrow(heads, "query bigint, rid bigint, score double").distinct()
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "rid")
    tau = gathered.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k).groupBy("query").agg(F.min("score").alias("tau"), F.count("*").alias("n")).toArrow()
    reach = np.full(len(qids), float(low))
    if tau.num_rows:
        full = tau.column("n").to_numpy() >= k
        # a little below, for the rounding of double sums; it only lets more entries through
        least = tau.column("tau").to_numpy()[full]
        place = np.argsort(numbers)
        reach[place[np.searchsorted(numbers, tau.column("query").to_numpy()[full], sorter=place)]] = least - np.abs(least) * 1e-12 - 1
    cutoff = spark.sparkContext.broadcast(reach)

    def entries(batches):
        """Phases 2 and 3: entries at or above the uniform cutoff in some list, bounded by the parts seen, then scored."""
        qids, q = shared.value
        tau = cutoff.value[:, None]
        level = tau / len(cuts)
        for ids, _, copies, m in tiles(batches, dims, k):
            parts = partials(q, m, kind, cuts)
            seen = np.zeros((len(qids), len(ids)))
            missing = np.full(seen.shape, len(cuts), np.int8)
            for p in parts:
                over = p >= level
                seen[over] += p[over]
                missing -= over
            keep = (missing < len(cuts)) & (seen + missing * level >= tau)
            at, hit = own(ids, qids)
            keep[at, hit] = False
            score = np.where(keep, sum(p.astype(np.int64) for p in parts), np.iinfo(np.int64).min)
            if len(ids) > k:
                keep &= score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None]
            r, c = np.nonzero(keep)
            if len(r):
                yield pa.record_batch([pa.array(numbers[r]), pa.array(qids[r]), pa.array(ids[c]), pa.array(copies[c]), pa.array(score[r, c])], ["query", "query_id", "vec_id", "copies", "score"])

    scored = rows.mapInArrow(entries, "query bigint, query_id bigint, vec_id bigint, copies bigint, score bigint")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank")
    every = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
