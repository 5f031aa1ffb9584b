"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated isotonically.

Features are densities of a lexicon (general insults, and words and word beginnings that mark
toxic documents among the training labels), how near these stand to second-person words,
capitals, punctuation, and obfuscation (digits and signs inside words, stretched letters).
Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reachable
from .gbt import Calibrated, fit_calibrated
from .words import by_slices, give_back, pieces, split_words

FIT_ROWS = 4_000  #: labelled rows that are fitted on, at most
LEARNT = 1500  #: entries of the learnt lexicon, at most
STARTS = (4, 5, 6, 7, 8)  #: letters of word beginnings that may become entries
SEEN = 4  #: toxic documents that an entry stands in, at least
CACHE = 150_000
THRESHOLD = 0.3
#: General insults, and second-person words of English, German, French and Spanish.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "fool", "jerk", "garbage", "vermin", "filth", "creep", "freak", "coward", "liar")
YOU = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
INSIDE = re.compile(r"[^\W\d_][\d@$!*_.\-]+[^\W\d_]")
STRETCHED = re.compile(r"(.)\1\1")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„’…"
PER_WORD = 12


@dataclass
class Lexicon:
    """Weights of words and of word beginnings (kept with their length)."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"words": self.words, "starts": self.starts, "known": {}}

    def marks(self, word: str) -> tuple:
        """The PER_WORD numbers of a word that do not depend on its neighbours."""
        got = self.known.get(word)
        if got is None:
            bare = word.strip(EDGES)
            low = bare.lower()
            plain = low.translate(LEET) if not low.isalpha() else low
            plain = "".join(c for c in plain if c.isalpha()) if not plain.isalpha() else plain
            insult = float(plain in INSULT_SET or (plain[:-1] in INSULT_SET and plain[-1:] == "s"))
            learnt = max(self.words.get(low, 0.0), self.words.get(plain, 0.0))
            start = max((self.starts.get(low[:n], 0.0) for n in STARTS if len(low) >= n), default=0.0)
            letters = sum(c.isalpha() for c in word)
            got = (
                insult, learnt, float(learnt > 0), start, float(start > 0), float(low in YOU),
                float(letters > 1 and bare.isupper()), float(len(word) - letters), float("!" in word or "?" in word),
                float(bool(INSIDE.search(bare))), float(bool(STRETCHED.search(low))), float(len(word)),
            )
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[word] = got
        return got


INSULT_SET = frozenset(INSULTS)
NAMES = 26


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of NAMES numbers for each whole text; a null or empty text has zeros."""
    return by_slices(texts, lambda part: slice_features(part, lexicon))


def slice_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    flat, offsets = split_words(texts)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), NAMES))
    if not len(flat):
        return out
    coded = flat.dictionary_encode()
    own = np.array([lexicon.marks(w) for w in coded.dictionary.to_pylist()], np.float64)
    m = own[np.asarray(coded.indices)]
    toxic = np.maximum(m[:, 0], m[:, 2])
    you = m[:, 5]

    def close(x: np.ndarray, reach: int) -> np.ndarray:
        """Whether x stands within reach words in the same text (over its edges: not)."""
        c = np.concatenate(([0], np.cumsum(x)))
        n = np.arange(len(x))
        lo = np.maximum(n - reach, np.repeat(offsets[:-1], sizes))
        hi = np.minimum(n + reach + 1, np.repeat(offsets[1:], sizes))
        return (c[hi] - c[lo] > 0).astype(np.float64)

    many = (m[:, 1] > 2.5).astype(np.float64)
    cols = np.column_stack([m, toxic, toxic * close(you, 3), toxic * close(you, 8), many, you * close(toxic, 3)])
    full = sizes > 0
    sums = np.zeros((len(sizes), cols.shape[1]))
    tops = np.zeros((len(sizes), 3))
    at = offsets[:-1][full]
    sums[full] = np.add.reduceat(cols, at, axis=0)
    tops[full] = np.maximum.reduceat(m[:, [1, 3, 11]], at, axis=0)
    n = np.maximum(sizes, 1)[:, None]
    rate = sums / n
    out[:, :17] = rate
    out[:, 17:20] = tops
    out[:, 20:25] = np.log1p(sums[:, [0, 2, 4, 12, 15]])
    out[:, 25] = np.log1p(sizes)
    return out


class Vocabulary:
    """The distinct bare words of sampled documents and their beginnings, as numbers.

    words and starts are (names, documents, numbers): the pairs of a document and a word (or
    beginning) that it has, each once.
    """

    def __init__(self, texts: pa.Array):
        flat, offsets = split_words(texts)
        coded = flat.dictionary_encode()
        names, starts, own, firsts = {}, {}, [], []
        for w in coded.dictionary.to_pylist():
            low = w.strip(EDGES).lower()
            own.append(names.setdefault(low, len(names)))
            firsts.append([starts.setdefault(low[:n], len(starts)) if len(low) >= n else -1 for n in STARTS])
        doc, code = np.repeat(np.arange(len(texts)), np.diff(offsets)), np.asarray(coded.indices)
        key = np.unique(doc * max(1, len(own)) + code)
        doc, code = key // max(1, len(own)), key % max(1, len(own))
        self.words = self.pairs(names, doc, np.array(own, np.int64)[code] if len(own) else code)
        at = np.array(firsts, np.int64).reshape(-1, len(STARTS))[code]
        some = at >= 0
        self.starts = self.pairs(starts, np.repeat(doc, len(STARTS)).reshape(at.shape)[some], at[some])

    @staticmethod
    def pairs(names: dict, doc: np.ndarray, number: np.ndarray):
        key = np.unique(doc * max(1, len(names)) + number)
        return list(names), key // max(1, len(names)), key % max(1, len(names))

    def lexicon(self, rows: np.ndarray, y: np.ndarray) -> Lexicon:
        """Words and beginnings that stand in far more toxic than other documents among rows, by log odds."""
        label = np.full(len(y), -1)
        label[rows] = y[rows]
        pos, neg = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))

        def best(names, doc, number) -> dict[str, float]:
            toxic, other = (np.bincount(number[label[doc] == k], minlength=len(names)) for k in (1, 0))
            odds = np.log((toxic + 0.5) / (pos + 1)) - np.log((other + 0.5) / (neg + 1))
            some = np.flatnonzero((toxic >= SEEN) & (odds > 1.5))
            top = sorted(some, key=lambda i: (-odds[i] * np.sqrt(toxic[i]), names[i]))[:LEARNT]
            return {names[i]: float(odds[i]) for i in top if names[i]}

        return Lexicon(best(*self.words), best(*self.starts))


@dataclass
class Model:
    lexicon: Lexicon
    scorer: Calibrated

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return self.scorer(features(texts, self.lexicon))


def fit(held: pa.Array, y: np.ndarray) -> Model:
    """The entries that a row's features count are learnt from other rows of the sample."""
    vocabulary = Vocabulary(held)

    def seen(train: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return features(held.take(pa.array(rows)), vocabulary.lexicon(train, y))

    scorer = fit_calibrated(np.zeros((len(y), NAMES)), y, features=seen, trees=120, depth=3)
    return Model(vocabulary.lexicon(np.arange(len(y)), y), scorer)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, where=None) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents, picked by a hash of their ids."""
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    own = own if where is None else own.where(where)
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    few = F.broadcast(own.orderBy(F.xxhash64("id"), "id").limit(rows))  # bounded by rows
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = texts.join(few, texts["doc_id"] == few["id"]).select("id", "text", "y").toArrow()
    got = got.take(pa.array(np.argsort(got.column("id").to_numpy(), kind="stable"))).combine_chunks()
    text = got.column("text").cast(pa.large_string()).combine_chunks() if got.num_rows else pa.array([], pa.large_string())
    return text, got.column("y").to_numpy().astype(np.float64)


def score(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """doc_id and the model's score of each whole text; every row gets one."""
    reachable(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in pieces(batches, 2 << 20):
            yield pa.record_batch([b.column("doc_id"), pa.array(m(b.column("text")))], ["doc_id", name])
        m.lexicon.known.clear()
        give_back()

    src = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, {name} double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Fitted on at most ``rows`` labels whose crc32(doc_id) mod 4 is not 2. Null texts score like
    empty ones, and rows with a null doc_id are not held out. Without any label every score is
    one half. Only doc_id and text of docs, and doc_id and toxic of labels are read.
    """
    texts, y = labelled(docs, labels, "toxic", rows, ~held_out("id"))
    out = score(docs, fit(texts, y))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
