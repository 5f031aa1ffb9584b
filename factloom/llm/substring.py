"""Substring dedup by fixed-block anchors.

A repeat of 13 words or more holds a whole aligned block of 7 words of the document it repeats,
for 13 = 2 * 7 - 1. Every document is indexed by its non-overlapping blocks (words 0-6, 7-13,
...) and probed with every rolling window of 7 words. Around each hit the windows of 13 words
that hold the block are extended to and compared by 96-bit hashes; runs of repeated windows
are the maximal exact repeats.

Documents are dealt to parts by a hash of id and text. A part sends every distinct window once,
however many of its documents hold it and how often, and is told once which of them matter, so
a passage that all documents share costs one entry a part. Windows travel packed: a part sends
each hash bucket one blob, of some 4 bytes a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from .common import reachable, settled
from .words import give_back, rolling, split_words, word_hashes

REPEAT = 13  #: words
BLOCK = (REPEAT + 1) // 2
BUCKET_BYTES = 9 << 20  #: of text for each hash bucket
PART_BYTES = 12 << 20  #: of text for each part
NOBODY = np.iinfo(np.int64).max  #: stands for a null doc_id: no document comes after it
LOW = np.uint64(0xFFFFFFFF)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ALIGNED, SEVERAL = 1, 2  #: marks of a run of words: it is a block of some document; it stands in two


def ids_of(column) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), int(NOBODY)))


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    n = len(keys[0])
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if n else np.zeros(0, np.int64)


def blobs_of(group: np.ndarray, columns: list[np.ndarray]):
    """(group, blob) for entries that stand together by group: their number, then one column after another.

    A uint32 column is kept as the planes of its steps' bytes: where it rises, the upper ones compress well.
    """
    starts = runs_of(group)
    for lo, hi in zip(starts, np.r_[starts[1:], len(group)]):
        out = [np.uint32(hi - lo).tobytes()]
        for c in columns:
            part = np.ascontiguousarray(c[lo:hi])
            if c.dtype == np.uint32:
                part = np.diff(part, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
            out.append(part.tobytes())
        yield int(group[lo]), b"".join(out)


def columns_of(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The entries of blobs, and which blob each comes from, last."""
    sizes = [int(np.frombuffer(b, "<u4", 1)[0]) for b in blobs]
    out, at = [], [4] * len(blobs)
    for kind in kinds:
        width, parts = np.dtype(kind).itemsize, []
        for b, n, i in zip(blobs, sizes, at):
            if kind == "<u4":
                steps = np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * n, i).reshape(4, n).T).view("<u4").reshape(-1)
                parts.append(np.cumsum(steps, dtype=np.uint32))
            else:
                parts.append(np.frombuffer(b, kind, n, i))
        out.append(np.concatenate(parts or [np.zeros(0, kind)]))
        at = [i + n * width for i, n in zip(at, sizes)]
    return [*out, np.repeat(np.arange(len(blobs)), sizes)]


def sent(rows, names: tuple[str, str, str] = ("to", "of", "blob")) -> pa.Table:
    """A table of (to, from, blob) rows."""
    to, of, blob = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(to, pa.int32()), pa.array(of, pa.int32()), pa.array(blob, pa.large_binary()).cast(pa.binary())], list(names))


class Words:
    """The words of a batch of documents, by number, and the hashes of their runs."""

    def __init__(self, batch):
        self.ids = ids_of(batch.column("doc_id"))
        self.flat, self.offsets = split_words(batch.column("text"))
        self.hashes = word_hashes(self.flat)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))

    def inside(self, width: int) -> np.ndarray:
        """Words that begin a run of width words which ends in the same document."""
        return np.flatnonzero(np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(len(self.doc)) >= width)

    def runs(self, width: int, factor: int) -> np.ndarray:
        return rolling(self.hashes, width, factor)


def repeats(docs: DataFrame, repeat: int = REPEAT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, n_words, n_removed, kept: each document without its repeats.

    A word goes if a window of ``repeat`` words that covers it also starts in a document with
    a smaller doc_id, which must be of an integer type (else raises). kept is the words left, joined by one space (repeats removed or not). Null
    and empty texts have no words; an empty table gives no rows. Null doc_ids count as larger than all, and rows that share
    a doc_id as one document, which does not repeat itself. Texts are taken whole. Columns other
    than doc_id, text and those of keep are not read; keep must not name doc_id or a column that is added.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type")
    reachable(docs.sparkSession)
    block = (repeat + 1) // 2
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, nparts = max(12, math.ceil(size / BUCKET_BYTES)), max(12, math.ceil(size / PART_BYTES))
    part = F.pmod(F.xxhash64("doc_id", text), F.lit(nparts)).cast("int")
    rows = docs.select(part.alias("part"), F.col("doc_id").alias("doc_id"), text.alias("text"))
    blobs = "to int, of int, blob binary"

    def key_of(h: np.ndarray) -> np.ndarray:
        """A run's bucket, and 32 bits that tell runs apart within: a mistake only has a window looked at in vain."""
        return (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & LOW

    def probe(key, group):
        """Blocks and probes: every distinct run of ``block`` words of a part, to its bucket."""
        runs, marks = [], []
        for b in group.to_batches():
            w = Words(b)
            at = w.inside(block)
            h, doc = key_of(w.runs(block, FACTORS[0])[at]), w.ids[w.doc[at]]
            aligned = (at - w.offsets[w.doc[at]]) % block == 0
            order = np.argsort(h)
            h, doc, aligned = h[order], doc[order], aligned[order]
            starts = runs_of(h)
            if len(starts):
                some = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
                runs.append(h[starts])
                marks.append((ALIGNED * np.logical_or.reduceat(aligned, starts) + SEVERAL * some).astype(np.uint8))
        if len(runs) > 1:  # in two batches of the part: in two documents, or it does no harm to say so
            h, m = np.concatenate(runs), np.concatenate(marks)
            order = np.argsort(h)
            h, m = h[order], m[order]
            starts = runs_of(h)
            more = np.diff(np.r_[starts, len(h)]) > 1
            runs, marks = [h[starts]], [np.bitwise_or.reduceat(m, starts) | (SEVERAL * more).astype(np.uint8)]
        out = []
        if runs:
            h = runs[0]
            out = [(bucket, key[0].as_py(), blob) for bucket, blob in blobs_of((h >> np.uint64(32)).astype(np.int64), [(h & LOW).astype(np.uint32), marks[0]])]
        give_back()
        return sent(out)

    def hits(key, group):
        """For each part, its runs of words that are a block of some document and stand in two or more."""
        low, mark, blob = columns_of(group.column("blob").to_pylist(), ("<u4", "u1"))
        of = group.column("of").to_numpy()[blob]
        order = np.argsort(low, kind="stable")
        m = mark[order]
        starts = runs_of(low[order])
        out = []
        if len(starts):
            size = np.diff(np.r_[starts, len(m)])
            both = np.bitwise_or.reduceat(m, starts) | (SEVERAL * (size > 1)).astype(np.uint8)
            take = order[np.repeat(both == ALIGNED | SEVERAL, size)]
            take = take[np.argsort(of[take], kind="stable")]
            out = [(p, key[0].as_py(), blob) for p, blob in blobs_of(of[take], [low[take]])]
        del low, mark, blob, order
        give_back()
        return sent(out)

    def extend(key, left, right):
        """The windows of ``repeat`` words that hold a hit: each distinct one of the part, with its smallest doc_id."""
        low, blob = columns_of(right.column("blob").to_pylist(), ("<u4",))
        hit = np.sort(low.astype(np.uint64) | right.column("of").to_numpy()[blob].astype(np.uint64) << np.uint64(32))
        found: list[list[np.ndarray]] = [[], [], []]
        for b in left.to_batches() if len(hit) else []:
            w = Words(b)
            at = w.inside(block)
            h = key_of(w.runs(block, FACTORS[0])[at])
            at = at[hit[np.minimum(np.searchsorted(hit, h), len(hit) - 1)] == h]
            n = len(w.doc)
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, np.maximum(at - (repeat - block), w.offsets[w.doc[at]]), 1)
            np.add.at(mark, at + 1, -1)
            near = np.zeros(n, bool)
            near[w.inside(repeat)] = True
            at = np.flatnonzero((np.cumsum(mark)[:n] > 0) & near)
            if len(at):
                for to, x in zip(found, (w.runs(repeat, FACTORS[0])[at], (w.runs(repeat, FACTORS[1])[at] & LOW).astype(np.uint32), w.ids[w.doc[at]])):
                    to.append(x)
        out = []
        if found[0]:
            a, c, ids = (np.concatenate(x) for x in found)
            order = np.lexsort((ids, c, a))
            a, c, ids = a[order], c[order], ids[order]
            starts = runs_of(a, c)
            several = ids[np.r_[starts[1:], len(ids)] - 1] > ids[starts]
            bucket = ((a >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[starts]
            order = np.lexsort((ids[starts], bucket))
            some = starts[order]
            out = [(b, key[0].as_py(), blob) for b, blob in blobs_of(bucket[order], [a[some], c[some], ids[some], several[order].astype(np.uint8)])]
        give_back()
        return sent(out)

    def later(key, group):
        """For each part, its windows that a document with a smaller doc_id has too: elsewhere (all of them go),
        or in the part itself (all but those of its smallest doc_id go)."""
        a, c, first, several, blob = columns_of(group.column("blob").to_pylist(), ("<u8", "<u4", "<i8", "u1"))
        of = group.column("of").to_numpy()[blob]
        order = np.lexsort((first, c, a))
        starts = runs_of(a[order], c[order])
        least = np.repeat(first[order][starts], np.diff(np.r_[starts, len(order)])) if len(starts) else first
        elsewhere = first[order] > least
        some = elsewhere | (several[order] > 0)
        take, elsewhere = order[some], elsewhere[some]
        by = np.lexsort((elsewhere, of[take]))
        take, elsewhere = take[by], elsewhere[by]
        out = [(p, key[0].as_py(), blob) for p, blob in blobs_of(of[take], [a[take], c[take], elsewhere.astype(np.uint8)])]
        give_back()
        return sent(out)

    found = settled(rows.groupBy("part").applyInArrow(probe, blobs).groupBy("to").applyInArrow(hits, blobs).withColumnRenamed("to", "part"))
    gone = settled(rows.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(extend, blobs).groupBy("to").applyInArrow(later, blobs).withColumnRenamed("to", "part"))
    kept_row = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    rows = docs.select(part.alias("part"), F.col("doc_id").alias("doc_id"), text.alias("text"), kept_row.alias("row"))

    def remove(key, left, right):
        out = []
        a, c, elsewhere, _ = columns_of(right.column("blob").to_pylist(), ("<u8", "<u4", "u1"))
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        least = np.where(elsewhere[order] > 0, np.iinfo(np.int64).min, NOBODY)
        batches, found = left.to_batches(), []
        for b in batches:  # windows that are told to go, and the smallest doc_id where it is of this part
            w = Words(b)
            at, k = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(a):
                at = w.inside(repeat)
                h = w.runs(repeat, FACTORS[0])[at]
                k = np.minimum(np.searchsorted(a, h), len(a) - 1)
                same = np.flatnonzero(a[k] == h)
                at, k = at[same], k[same]
                same = (w.runs(repeat, FACTORS[1])[at] & LOW).astype(np.uint32) == c[k]
                at, k = at[same], k[same]
                np.minimum.at(least, k, w.ids[w.doc[at]])
            w.hashes = None
            found.append((w, at, k))
        for b, (w, at, k) in zip(batches, found):
            n = len(w.doc)
            mark = np.zeros(n + 1, np.int32)
            at = at[w.ids[w.doc[at]] > least[k]]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + repeat, -1)
            stay = np.cumsum(mark)[:n] == 0
            at = np.concatenate(([0], np.cumsum(stay)))[w.offsets]
            words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), (w.flat if stay.all() else w.flat.filter(pa.array(stay))).cast(pa.string()))
            sizes = np.diff(w.offsets)
            out.append(pa.record_batch([b.column("doc_id"), b.column("row"), pa.array(sizes), pa.array(sizes - np.diff(at)), pc.binary_join(words, " ")], ["doc_id", "row", "n_words", "n_removed", "kept"]))
        give_back()
        return pa.Table.from_batches(out) if out else pa.table({"doc_id": pa.array([], left.schema.field("doc_id").type), "row": pa.array([], left.schema.field("row").type), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    schema = StructType([StructField(c, rows.schema[c].dataType) for c in ("doc_id", "row")]).add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType())
    out = rows.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(remove, schema)
    return out.select("doc_id", *[F.col("row").getField(c).alias(c) for c in keep], "n_words", "n_removed", "kept")


def substring_digest(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN m USING (gram) WHERE doc_id > first GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n, CASE WHEN gone IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(gone, j))) END AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
