"""Mixture-controlled packing: deficit round-robin over source queues fills windows of sequences.

Every source has a queue and a deficit counter. A window adds each source's share of the
window to its counter and takes that many tokens from its queue, cutting documents freely. A
queue that runs dry keeps its deficit for later windows; what it leaves open is lent to the
fuller queues, whose counters go negative. Counters carry over windows and partitions: every
document knows how many tokens, and how many of its source, stand before it in the whole order
of parts, so whichever documents a task reads, its counters start as the documents before them
leave those (shares of all tokens so far, less the source's tokens so far). Windows hold whole
sequences, so only a task's last tokens can fall short of one; they become sequences of powers
of two, which need no padding.
"""

from __future__ import annotations

import os
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reachable, settled, stored
from .words import give_back, pieces, split_words

SEQUENCE = 2048
WINDOW = 32  #: sequences a window
AHEAD = 8  #: windows whose tokens a task reads ahead, so that its queues hold several sources
CACHE = 400_000  #: stems and words a worker remembers
END_ID = 1
#: Words of Latin letters and trailing ASCII marks: the tokenizer's own rules split them there.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[!-&(-/:-@\\[-`{-~]*"


class WordTokenizer:
    """Ids of whole texts from ids of their words, each kept once known.

    Right for tokenizers that lower case, drop white space, never join across it, and end every
    word with a token marked so, as word_bpe_49k does. A plain word is a stem and its marks;
    stems that are not known yet are encoded together, as one text, and told apart by the
    tokens that end words. Other words are encoded one by one.
    """

    made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def alone(self, w: str) -> bytes:
        return np.array(self.lib.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, stems: list[str]) -> None:
        ids = np.array(self.lib.encode(" ".join(stems), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(stems) and (not len(cuts) or cuts[-1] == len(ids)):
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(stems, (cuts * 4).tolist()):
                self.known[w] = raw[lo:hi]
                lo = hi
        else:
            for w in stems:
                self.known[w] = self.alone(w)

    def units(self, names: list[str], plain: np.ndarray) -> list[bytes]:
        """Ids of stems (plain), marks and other words."""
        if len(self.known) > CACHE // 2:  # what was used since the last change stays known
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        got = [known.get(w) for w in names]
        missing = []
        for i, k in enumerate(got):
            if k is None:
                w = names[i]
                k = old.get(w)
                if k is None:
                    missing.append(i)
                else:
                    known[w] = got[i] = k
        self.learn([names[i] for i in missing if plain[i]])
        for i in missing:
            w = names[i]
            if w not in known:
                known[w] = self.alone(w)
            got[i] = known[w]
        return got

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, and each text's offsets into them."""
        flat, offsets = split_words(texts)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary, np.asarray(coded.indices)
        plain = pc.match_substring_regex(words, f"^{LETTERS}{MARKS}$")
        stem = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(words), f"{MARKS}$", ""), words).dictionary_encode()
        marks = pc.if_else(plain, pc.replace_substring_regex(words, f"^{LETTERS}", ""), "").dictionary_encode()
        first, then = np.asarray(stem.indices), np.asarray(marks.indices)
        is_plain = np.zeros(len(stem.dictionary), bool)
        is_plain[first] = np.asarray(plain)
        held = self.units(stem.dictionary.to_pylist(), is_plain) + [self.known.get(m) or self.known.setdefault(m, self.alone(m)) if m else b"" for m in marks.dictionary.to_pylist()]
        own = np.frombuffer(b"".join(held), np.uint32)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts = np.cumsum(sizes) - sizes
        two = np.column_stack([first, then + len(stem.dictionary)])[codes].reshape(-1)
        counts = sizes[two]
        ends = np.cumsum(counts)
        from_here = np.repeat((starts[two] - (ends - counts)).astype(np.int32), counts)  # a batch has far fewer than 2^31 ids
        ids = own[np.arange(ends[-1], dtype=np.int32) + from_here]
        return ids, np.concatenate(([0], ends[1::2]))[offsets]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, part, before, own_before, tokens, ids): ids as little-endian unsigned 16 or 32 bits, end_id last.

    part numbers the task that wrote the document, before and own_before count the tokens in
    front of it there, of all sources and of its own. Null texts are empty: end_id alone. Documents
    are dealt to tasks, and stand there, by a hash of their row, so that a task meets all sources
    at their shares even where the table is stored by source.
    """
    reachable(docs.sparkSession)
    src = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    src = src.withColumn("dealt", F.xxhash64("doc_id", "text", "source")).repartition("dealt").sortWithinPartitions("dealt").drop("dealt")

    def run(batches):
        t = WordTokenizer.at(tokenizer)
        kind = "<u2" if max(t.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        part, own, done = TaskContext.get().partitionId(), {}, 0
        for b in pieces(batches, 3 << 20):
            ids, at = t.batch(b.column("text"))
            sizes, own_before = np.diff(at) + 1, []
            for source, n in zip(b.column("source").to_pylist(), sizes.tolist()):
                own_before.append(own.get(source, 0))
                own[source] = own_before[-1] + n
            before = done + np.cumsum(sizes) - sizes
            done += int(sizes.sum())
            whole = [np.append(ids[i:j], np.uint32(end_id)).astype(kind) for i, j in zip(at, at[1:])]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("source"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(before), pa.array(own_before, pa.int64()), pa.array(sizes), pa.array([x.tobytes() for x in whole], pa.binary())],
                ["doc_id", "source", "part", "before", "own_before", "tokens", "ids"],
            )
        give_back()

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, source string, part int, before bigint, own_before bigint, tokens bigint, ids binary")


class Robin:
    """Deficit round-robin over the queues of one task."""

    def __init__(self, window: int):
        self.window, self.turn, self.waiting = window, 0, 0
        self.queues: dict = {}
        self.held: dict = {}
        self.share: dict = {}
        self.deficit: dict = {}
        self.part: dict = {}

    def put(self, source, share: float, part, done: int, own_done: int, doc, ids: np.ndarray) -> None:
        """Queues a document; done and own_done count the tokens before it in the whole order.

        The first document of a source in a part sets its counter to what all tokens before it,
        but for those that still wait here, leave to it.
        """
        if source not in self.queues:
            self.queues[source], self.held[source], self.part[source] = deque(), 0, None
        if self.part[source] != part:
            self.part[source], self.share[source] = part, share
            self.deficit[source] = share * (done - self.waiting) - (own_done - self.held[source])
        self.queues[source].append([doc, ids, 0])
        self.held[source] += len(ids)
        self.waiting += len(ids)

    def take(self, source, n: int, out: list) -> None:
        """Moves n tokens from a queue's head to out, as (document, ids, begin, end)."""
        self.held[source] -= n
        self.waiting -= n
        self.deficit[source] -= n
        q = self.queues[source]
        while n:
            doc, ids, at = q[0]
            step = min(n, len(ids) - at)
            out.append((doc, ids, at, at + step))
            n -= step
            if at + step == len(ids):
                q.popleft()
            else:
                q[0][2] = at + step

    def fill(self) -> list:
        """The pieces of the next window, full if enough tokens wait."""
        names = sorted(self.queues, key=lambda s: (s is None, s))
        names = names[self.turn % len(names) :] + names[: self.turn % len(names)]
        self.turn += 1
        size = room = min(self.window, self.waiting)
        out: list = []
        for s in names:
            self.deficit[s] += self.share[s] * size
        for s in names:
            n = int(max(0, min(self.held[s], round(self.deficit[s]), room)))
            self.take(s, n, out)
            room -= n
        while room:  # lent to the queues that hold most
            s = max(names, key=lambda s: (self.held[s], s is not None))
            n = min(self.held[s], room)
            self.take(s, n, out)
            room -= n
        return out


def cut(window: list, length: int, first: int, tail: bool):
    """Pieces of a window as (document, ids, begin, end, sequence, offset); the number of sequences.

    tail: what does not fill a sequence makes sequences of the powers of two it adds up to.
    """
    total = sum(e - b for _, _, b, e in window)
    sizes = [length] * (total // length)
    rest = total % length
    sizes += [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1] if tail else []
    out, k, at = [], 0, 0
    for doc, ids, b, e in window:
        while b < e:
            step = min(e - b, sizes[k] - at)
            out.append((doc, ids, b, b + step, first + k, at))
            b, at = b + step, at + step
            if at == sizes[k]:
                k, at = k + 1, 0
    return out, len(sizes)


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    Null texts and null sources are packed like others (a null source is a source), repeated
    rows each on their own; an empty table gives no rows. Only doc_id, text and source are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(tokenized(docs, tokenizer, end_id), "tokens")
    sums = tokens.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("all_n"))
    by_part = sums.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("done"))
    total = by_part.agg(F.sum("part_n")).first()[0] or 1
    carry = sums.select("part", "source", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("own_done"))
    carry = carry.join(parts, "part").join(by_source, carry["source"].eqNullSafe(by_source["source"])).select(
        F.col("part").alias("p"), carry["source"].alias("s"), (F.col("all_n") / F.lit(total)).alias("share"), "done", "own_done",
    )
    carry = settled(carry)
    if carry.count() <= 100_000:  # some 6 MB at most; beyond that Spark joins by shuffle
        carry = F.broadcast(carry)
    queued = tokens.join(carry, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    queued = queued.select("doc_id", "source", "share", "part", (F.col("done") + F.col("before")).alias("done"), (F.col("own_done") + F.col("own_before")).alias("own_done"), "tokens", "ids")

    def run(batches):
        robin, made = Robin(length * WINDOW), TaskContext.get().partitionId() << 33
        kept: list = []

        def emit(window, tail):
            nonlocal made
            out, n = cut(window, length, made, tail)
            made += n
            kept.extend(out)

        def flush():
            doc, ids, b, e, seq, at = zip(*kept) if kept else ((),) * 6
            cols = [pa.array([d for d, _ in doc], doc_type), pa.array(b, pa.int64()), pa.array([y - x for x, y in zip(b, e)], pa.int64()), pa.array([i[x:y].astype("<u4").tobytes() for i, x, y in zip(ids, b, e)], pa.binary()), pa.array([n for _, n in doc], pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64())]
            kept.clear()
            return pa.record_batch(cols, names)

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        doc_type = pa.int64()
        for b in batches:
            doc_type = b.column("doc_id").type
            cols = [b.column(c).to_pylist() for c in ("doc_id", "source", "share", "part", "done", "own_done", "tokens", "ids")]
            for doc, source, share, part, done, own_done, n, raw in zip(*cols):
                robin.put(source, share, part, done, own_done, (doc, n), np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                if robin.waiting >= AHEAD * robin.window:
                    while robin.waiting >= (AHEAD - 1) * robin.window:
                        emit(robin.fill(), False)
                    yield flush()
        while robin.waiting >= robin.window:
            emit(robin.fill(), False)
        if robin.waiting:
            emit(robin.fill(), True)
        yield flush()
        give_back()

    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return queued.mapInArrow(run, schema)


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    p = pack(docs, tokenizer)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
