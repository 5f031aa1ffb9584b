"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Distinct shingles of five words carry the weight 1, however often a text repeats them. Each is a
Poisson process with its weight as rate, whose arrivals fall on random registers; a register
keeps the element that arrives first. An element stops once its next arrival is later than
every register of its document. With equal weights two documents agree in a register with the
Jaccard similarity of their shingle sets, the one that links are verified by on whole texts.
Bands of registers give candidates, and classes are the components of the links.

Exact copies are one node from the start. In a band's bucket every text is first compared with
the bucket's smallest and largest id alone. Only buckets that then still hold
different classes are looked at again: their texts are dealt to blocks of bounded size, once
each, and the texts outside the bucket's largest class, which are few after the stars, go to
every block. There they are compared with all others by counting shared shingles, and the links
that join classes are kept. So groups of near copies never make all their pairs, one stray text
costs its own copies alone, and no class is split but by chance of the signatures: a pair of similarity 0.8 shares none of the 24 bands with probability 3e-6, and
falls below the estimate asked of a star's pair with probability 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, has_rows, reachable, settled, stored
from .words import GOLDEN, give_back, mix64, pieces, rolling, split_words, word_hashes

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
ESTIMATE = 0.55  #: agreeing registers that a pair of SIMILAR surely has
BLOCK_ROWS, BLOCK_BYTES = 1500, 4 << 20  #: texts of a bucket compared in one task, of all of it and of those outside its largest class
PAIR_BYTES = 2 << 20  #: of texts of pairs verified at once
LISTED = 100_000  #: ids broadcast at most (under 2 MB)
FACTOR = 0xD6E8FEB86659FD93


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles of a batch. A text of fewer words is one shingle."""
    flat, offsets = split_words(texts)
    hashes, sizes = word_hashes(flat), np.diff(offsets)
    n, doc = int(offsets[-1]), np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(n)
    at = np.flatnonzero(left >= WORDS)
    h, d = rolling(hashes, WORDS, FACTOR)[at], doc[at]
    brief = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(brief):
        own = [int(mix64(rolling(hashes[offsets[i] : offsets[i + 1]], int(sizes[i]), FACTOR) + np.uint64(sizes[i]))[0]) for i in brief]
        h, d = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([d, brief])
    return d, h


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return doc[starts], h[starts], np.diff(np.r_[starts, len(h)])


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """The element in each register of each document (0 for documents without elements)."""
    first, who = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    latest = np.full(docs, np.inf)
    at, active, r = np.zeros(len(h)), np.arange(len(h)), 0
    with np.errstate(over="ignore"):
        while len(active):
            r += 1
            z = mix64(h[active] + np.uint64(r) * GOLDEN)
            at[active] -= np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
            active = active[at[active] < latest[doc[active]]]
            slot = doc[active] * m + (mix64(h[active] ^ (np.uint64(r) * np.uint64(FACTOR))) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, slot, at[active])
            won = first[slot] == at[active]
            who[slot[won]] = h[active][won]
            latest = first.reshape(docs, m).max(axis=1)
    return who.reshape(docs, m)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, size, keys, sig) of the documents that have words: bytes, band keys, and 16 bits of each register."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in pieces(batches, 3 << 19):
            d, h, _ = counted(*shingles(b.column("text")))
            who = prob_minhash(d, h, np.ones(len(h)), b.num_rows)
            has = np.zeros(b.num_rows, bool)
            has[d] = True
            who = who[has]
            key = np.zeros((len(who), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(ROWS):
                    key = mix64(key * np.uint64(FACTOR) + who[:, i::ROWS])
                key = mix64(key + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN)
            sig = (mix64(who) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]) for x in (key.view(np.int64), sig)]
            size = pc.binary_length(b.column("text")).cast(pa.int64())
            yield pa.record_batch([b.column("doc_id").filter(pa.array(has)), size.filter(pa.array(has)), lists[0].cast(pa.list_(pa.int64())), lists[1].cast(pa.list_(pa.int16()))], ["doc_id", "size", "keys", "sig"])
        give_back()

    return docs.mapInArrow(run, f"doc_id {kind}, size bigint, keys array<bigint>, sig array<smallint>")


def verified(edges: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b) whose texts have SIMILAR shingle sets or more."""
    alike = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    e = edges.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    edges = settled(e.where(alike >= int(ESTIMATE * REGISTERS)).select("a", "b"))
    need = settled(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    if need.count() <= LISTED:
        texts = texts.join(F.broadcast(need), texts["doc_id"] == need["id"], "left_semi")
    both = edges.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for p in pieces(batches, PAIR_BYTES, "ta", "tb"):
            n = p.num_rows
            d, h, _ = counted(*shingles(pa.concat_arrays([p.column("ta"), p.column("tb")])))
            cut = np.searchsorted(d, np.arange(2 * n + 1))
            keep = np.zeros(n, bool)
            for i in range(n):
                x, y = h[cut[i] : cut[i + 1]], h[cut[n + i] : cut[n + i + 1]]
                if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = common >= SIMILAR * (len(x) + len(y) - common)
            yield pa.record_batch([p.column("a"), p.column("b")], ["a", "b"]).filter(pa.array(keep))
        give_back()

    kind = edges.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def joining(label: np.ndarray, asks: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents of different labels with SIMILAR shingle sets, enough to join their labels.

    (doc, h) are the distinct shingles by document. Every document that asks is compared with
    all others at once, by counting its shingles' postings.
    """
    n = len(label)
    names, code = np.unique(label, return_inverse=True)
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = np.bincount(doc, minlength=n)
    by = np.argsort(h, kind="stable")
    posted, hashes = doc[by], h[by]
    cut = np.searchsorted(doc, np.arange(n + 1))
    first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    a, b = [], []
    for i in np.flatnonzero(asks):
        lo, hi = first[cut[i] : cut[i + 1]], last[cut[i] : cut[i + 1]]
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        if not len(lo):
            continue
        runs = hi - lo
        at = np.arange(runs.sum()) + np.repeat(lo - (np.cumsum(runs) - runs), runs)
        common = np.bincount(posted[at], minlength=n)
        near = np.flatnonzero((common >= SIMILAR * (size + size[i] - common)) & (code != code[i]))
        for j in near:
            x, y = top(code[i]), top(code[j])
            if x != y:
                root[x] = y
                a.append(i)
                b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, class_id) of linked ids: the smallest id each can reach.

    Every round takes the least label among an id and its neighbours, and then that label's
    own label, so that chains shorten by half; labels stay in the cluster.
    """
    both = settled(links.select("a", "b").union(links.select("b", "a")))
    label = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l"))
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        top = step.select(F.col("id").alias("t"), F.col("l").alias("tl"))
        new = settled(step.join(top, step["l"] == top["t"]).select("id", "old", F.least("l", "tl").alias("l")))
        done = not has_rows(new.where("l < old"))
        label = new.select("id", "l")
        if done:
            return label.select(F.col("id").alias("doc_id"), F.col("l").alias("class_id"))


def with_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to their group (a row a key with its size n); hot groups by broadcast, so no task gets their rows."""
    hot = frequent(groups, total).withColumnRenamed(key, "hot_key")
    split = rows.join(hot, rows[key] == hot["hot_key"])
    rest = rows.join(hot.select("hot_key"), rows[key] == hot["hot_key"], "left_anti").join(groups, key)
    return split.drop("hot_key").unionByName(rest)


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every document: the smallest doc_id of its class.

    Equal texts are one class; so are all texts without words that are equal. Null texts count as
    empty. Rows that share a doc_id share its class; a null doc_id has the class null. An empty
    table gives no rows. Only doc_id and text are read.
    """
    reachable(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = settled(texts.select("doc_id", F.sha2("text", 256).alias("same")))
    firsts = settled(ids.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    reps = firsts.select(F.col("rep").alias("id")).distinct()
    sigs = stored(signatures(texts).join(reps, F.col("doc_id") == F.col("id"), "left_semi"), "signatures")
    bands = sigs.select("doc_id", "size", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("n > 1")
    bands = settled(bands.join(shared, "key").select("key", "doc_id", "size", "first", "last"))
    star = lambda center: bands.where(F.col("doc_id") != F.col(center)).select(F.least("doc_id", center).alias("a"), F.greatest("doc_id", center).alias("b"))
    links = settled(verified(settled(star("first").union(star("last")).distinct()), sigs, texts))
    label = components(links)
    # what the stars left apart within a bucket: a bucket's texts stand in one block each, and those outside its
    # largest class go to every block
    own = bands.join(label, "doc_id", "left").select("key", "doc_id", "size", F.coalesce("class_id", "doc_id").alias("l"))
    sizes = own.groupBy("key", "l").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    most, blocks = F.max(F.struct("n", "l", "bytes")), lambda n, b: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(b / BLOCK_BYTES)).cast("int")
    sizes = sizes.groupBy("key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("most.n < n and n > 2")
    sizes = sizes.select("key", F.col("most.l").alias("most"), blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("asking"))
    rest = settled(own.drop("size").join(sizes, "key"))
    need = settled(rest.select(F.col("doc_id").alias("id")).distinct())
    some = texts.join(F.broadcast(need), texts["doc_id"] == need["id"], "left_semi") if need.count() <= LISTED else texts
    numbers = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    here = rest.select("key", "doc_id", "l", F.lit(False).alias("asks"), place("blocks").alias("block"), F.explode(numbers("asking")).alias("ask"))
    there = rest.where("l <> most").select("key", "doc_id", "l", F.lit(True).alias("asks"), F.explode(numbers("blocks")).alias("block"), place("asking").alias("ask"))
    rest = here.unionByName(there).join(some, "doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def apart(key, group):
        """Links between asking texts of a bucket and one of its blocks, as many as join their classes."""
        t = group.combine_chunks()
        ids, l, asks = (t.column(c).to_numpy() for c in ("doc_id", "l", "asks"))
        text = t.column("text").combine_chunks()
        a, b = joining(l, asks, *counted(*shingles(text))[:2])
        give_back()
        kind = t.schema.field("doc_id").type
        return pa.table({"a": pa.array(np.minimum(ids[a], ids[b]), kind), "b": pa.array(np.maximum(ids[a], ids[b]), kind)})

    found = settled(rest.groupBy("key", "block", "ask").applyInArrow(apart, f"a {kind}, b {kind}").distinct())
    if has_rows(found):
        links = settled(links.union(found))
        label = components(links)
    classes = firsts.join(label, firsts["rep"] == label["doc_id"], "left").select("same", F.coalesce("class_id", "rep").alias("class_id"), "n")
    classes = with_group(ids, settled(classes), "same", ids.count()).select("doc_id", "class_id")
    nobody = docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return classes.unionByName(nobody)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of smallest doc_id of every class; rows without doc_id stay."""
    first = near_classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)
  UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id
"""
