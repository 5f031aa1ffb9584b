"""Quality by co-training: a text view and a page-metadata view teach each other.

The text view sees what the words are like, the metadata view what is known about the page and
its layout (language, source, length, lines). Each is a calibrated tree model. In every round
both views score all unlabelled documents, each labels those it is surest of, and the other
view learns from them. The calibrated scores of both are then combined to score every document.

The numbers of both views are computed once, in one pass over the texts, and stored; rounds and
scores read them alone. Only the rows that are fitted on reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from .common import reachable, settled, stored
from .gbt import Calibrated, fit_calibrated, fit_isotonic
from .words import by_slices, give_back, pieces, split_words

FIT_ROWS = 8_000  #: labelled rows that are fitted on, at most
ROUNDS = 3
SURE = 0.03  #: a view labels a row if its score is so near 0 or 1
SHARE = 0.1  #: rows that a view labels in a round, as a part of the fitted ones, at most
CELLS = 16  #: hashed cells of source and of language
KEEP = 0.5  #: documents below this combined score are rejected
CACHE = 100_000
NUMBERS = ArrayType(FloatType())
MARKS = set("%#*&$!|~^=<>{}[]\\@_+")


@dataclass
class TextView:
    """Counts of what words are like."""

    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> tuple:
        got = self.known.get(w)
        if got is None:
            letters = sum(c.isalpha() for c in w)
            digits = sum(c.isdigit() for c in w)
            marks = sum(c in MARKS for c in w)
            got = (len(w), letters, digits, marks, w[-1] in MARKS, w[0] in MARKS, letters > 1 and w.isupper(), w[0].isupper(), w[-1] in ".!?", "|" in w, "!" in w, len(w) > 18, letters == 0, "http" in w or "www" in w)
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[w] = got
        return got

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return by_slices(texts, self.numbers)

    def numbers(self, texts: pa.Array) -> np.ndarray:
        flat, offsets = split_words(texts)
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), 18))
        if not len(flat):
            return out
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        own = np.array([self.word(w) for w in coded.dictionary.to_pylist()], np.float64)
        full = sizes > 0
        at, n = offsets[:-1][full], sizes[full]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out[full, :14] = np.add.reduceat(own[codes], at, axis=0) / n[:, None]
        seen = np.unique(doc * len(own) + codes)
        out[:, 14] = np.bincount(seen // len(own), minlength=len(sizes)) / np.maximum(sizes, 1)
        pair = codes[:-1] * len(own) + codes[1:]
        inside = doc[:-1] == doc[1:]
        key = np.unique(np.column_stack([doc[:-1][inside], pair[inside]]), axis=0)[:, 0] if inside.any() else np.zeros(0, int)
        out[:, 15] = np.bincount(key, minlength=len(sizes)) / np.maximum(sizes - 1, 1)
        lengths = own[codes, 0]
        out[full, 16] = np.sqrt(np.maximum(np.add.reduceat(lengths**2, at) / n - out[full, 0] ** 2, 0))
        out[:, 17] = np.log1p(sizes)
        return out


def metadata_view(lang: pa.Array, source: pa.Array, n_chars: pa.Array, lines: pa.Array, distinct_lines: pa.Array, longest: pa.Array) -> np.ndarray:
    """Numbers of the page: language and source in hashed cells, length and layout of lines."""
    import zlib

    def cells(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), CELLS))
        for i, v in enumerate(column.to_pylist()):
            out[i, zlib.crc32(("" if v is None else v).encode()) % CELLS] = 1
        return out

    num = [np.asarray(pc.fill_null(c, 0).cast(pa.float64())) for c in (n_chars, lines, distinct_lines, longest)]
    chars, count, distinct, top = num
    shape = np.column_stack([np.log1p(np.maximum(chars, 0)), np.log1p(count), chars / np.maximum(count, 1), distinct / np.maximum(count, 1), np.log1p(top), top / np.maximum(chars, 1)])
    return np.hstack([shape, cells(lang), cells(source)])


def with_metadata(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text and the page's metadata; columns that docs lacks count as null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    lines = F.split("text", "\n", -1)
    x = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), have("lang", "string"), have("source", "string"), have("n_chars", "bigint"))
    return x.withColumn("rows", lines).select("row", "text", "lang", "source", F.coalesce("n_chars", F.length("text").cast("bigint")).alias("n_chars"), F.size("rows").alias("lines"), F.size(F.array_distinct("rows")).alias("distinct_lines"), F.array_max(F.transform("rows", F.length)).alias("longest"))


META = ("lang", "source", "n_chars", "lines", "distinct_lines", "longest")


@dataclass
class Views:
    of_text: Calibrated
    of_meta: Calibrated
    weight: tuple[float, float]

    def scores(self, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.of_text(matrix(b.column("xt"))), self.of_meta(matrix(b.column("xm")))
        return t, m, combined(t, m, self.weight)


def combined(t: np.ndarray, m: np.ndarray, weight: tuple[float, float]) -> np.ndarray:
    """Weighted mean of the views' log odds, as a probability."""
    odds = lambda p: np.log(np.clip(p, 0.005, 0.995)) - np.log1p(-np.clip(p, 0.005, 0.995))
    return 1 / (1 + np.exp(-(weight[0] * odds(t) + weight[1] * odds(m))))


def matrix(column) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    n = len(column)
    flat = np.concatenate([np.asarray(c.flatten()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])] or [np.zeros(0)])
    return flat.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))


def with_numbers(docs: DataFrame, keep: str) -> DataFrame:
    """(row, xt, xm), stored: what the expression keep makes of each row, and the numbers of both views."""
    reachable(docs.sparkSession)
    x = with_metadata(docs).withColumn("row", F.expr(keep))
    schema = StructType([x.schema["row"]]).add("xt", NUMBERS).add("xm", NUMBERS)

    def run(batches):
        view = TextView()
        for b in pieces(batches, 2 << 20):
            yield pa.record_batch([b.column("row"), lists(view(b.column("text"))), lists(metadata_view(*[b.column(c) for c in META]))], ["row", "xt", "xm"])
        give_back()

    return stored(x.mapInArrow(run, schema), "numbers").withColumn("rid", F.monotonically_increasing_id())


def surest(pool: DataFrame, models, most: dict, taught: tuple[set, set]) -> list[list[tuple]]:
    """For each learner, rows (rid, label, numbers) that the other view is surest of among all of the pool.

    A task hands on no more rows of a kind than are wanted at all. Ties go to the smaller hash of the id.
    """
    shared = pool.sparkSession.sparkContext.broadcast((models, taught, most))

    def run(batches):
        models, taught, most = shared.value
        best: dict = {}
        for b in batches:
            rid, tie = np.asarray(b.column("rid")), np.asarray(b.column("tie"))
            for teacher, learner in ((0, 1), (1, 0)):
                p = models[teacher](matrix(b.column(("xt", "xm")[teacher])))
                new = ~np.isin(rid, list(taught[learner]))
                for label, far in ((0, p), (1, 1 - p)):
                    at = np.flatnonzero((far < SURE) & new)
                    at = at[np.lexsort((rid[at], tie[at], far[at]))][: most[label]]
                    if len(at):
                        rows = zip(far[at].tolist(), tie[at].tolist(), rid[at].tolist(), b.column(("xt", "xm")[learner]).take(pa.array(at)).to_pylist())
                        best[learner, label] = sorted(best.get((learner, label), []) + list(rows))[: most[label]]
        out = [(learner, label, *r) for (learner, label), rows in best.items() for r in rows]
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float32())))], ["learner", "label", "far", "tie", "rid", "x"])

    found = settled(pool.mapInArrow(run, "learner int, label int, far double, tie bigint, rid bigint, x array<float>"))
    return [[(r["rid"], float(r["label"]), r["x"]) for label in (0, 1) for r in found.where((F.col("learner") == learner) & (F.col("label") == label)).orderBy("far", "tie", "rid").limit(most[label]).collect()] for learner in (0, 1)]


def gain(model: Calibrated, y: np.ndarray) -> float:
    """Likelihood gain over the base rate, a fitted row: by trees that have not seen it, and a curve of the other half."""
    base = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    null = -(base * np.log(base) + (1 - base) * np.log1p(-base))
    half = np.random.default_rng(3).permutation(len(y)) % 2 == 0
    if not half.any() or half.all():
        return 1.0
    p = np.zeros(len(y))
    for own in (half, ~half):
        p[own] = fit_isotonic(model.unseen[~own], y[~own])(model.unseen[own])
    p = np.clip(p, 0.005, 0.995)
    return max(0.0, null + float(np.mean(y * np.log(p) + (1 - y) * np.log1p(-p))))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ask, rounds: int = ROUNDS) -> tuple[Calibrated, Calibrated, tuple[float, float]]:
    """Models of both views from labelled rows (xt, xm, y) and rows that the views label for each other.

    ask(models, most, taught) gives, for each view, the rows (id, label, numbers) that the other
    one is surest of. Pseudo-labels enter the trees of the other view only; its curve is fitted
    to true labels, and the views are weighted by how well their models do on those.
    """
    views = [xt, xm]
    got: list[list] = [[], []]
    models = [fit_calibrated(x, y) for x in views]
    most = {k: int(SHARE * len(y) * (y == k).mean()) if len(y) else 0 for k in (0, 1)}
    for _ in range(rounds if any(most.values()) else 0):
        new = ask(models, most, tuple({r[0] for r in g} for g in got))
        if not any(new):
            break
        got = [g + n for g, n in zip(got, new)]
        models = [fit_calibrated(x, y, taught=(np.array([r[2] for r in g], np.float64).reshape(len(g), x.shape[1]), np.array([r[1] for r in g]))) for x, g in zip(views, got)]
    gains = [gain(m, y) for m in models]
    total = sum(gains)
    return models[0], models[1], (gains[0] / total, gains[1] / total) if total else (0.5, 0.5)


def fit(numbers: DataFrame, doc_id: str, labels: DataFrame, rows: int = FIT_ROWS, where=None) -> Views:
    """Fits both views on at most ``rows`` labelled documents, picked by hash, and on all documents without a label.

    doc_id names the id within numbers, as with_numbers gives them.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y is not null")
    own = own if where is None else own.where(where)
    few = F.broadcast(own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows))  # bounded by rows
    x = numbers.withColumn("id", F.expr(doc_id))
    got = x.join(few, "id").select("id", "rid", "xt", "xm", "y").orderBy("id", "rid").toArrow()
    pool = x.where("id is not null").join(labels.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti").select("rid", F.xxhash64("id").alias("tie"), "xt", "xm")
    y = got.column("y").to_numpy().astype(np.float64)
    xt, xm = (matrix(got.column(c)) if len(y) else np.zeros((0, 1)) for c in ("xt", "xm"))
    return Views(*co_train(xt, xm, y, lambda models, most, taught: surest(pool, models, most, taught)))


def scored(numbers: DataFrame, model: Views) -> DataFrame:
    schema = StructType([numbers.schema["row"]]).add("text_score", DoubleType()).add("page_score", DoubleType()).add("score", DoubleType())
    shared = numbers.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            t, m, s = shared.value.scores(b)
            yield pa.record_batch([b.column("row"), pa.array(t), pa.array(m), pa.array(s)], ["row", "text_score", "page_score", "score"])

    return numbers.select("row", "xt", "xm").mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, where=None) -> DataFrame:
    """doc_id, text_score, page_score, score, keep (1 or 0) of every row of docs; high is good.

    Null and empty texts are scored as texts without words. Nulls of other columns count as
    empty or zero. Without any label every document is kept; where all documents are labelled
    the views have nothing to label for each other and learn from true labels alone. Rows that
    repeat get equal scores; rows without doc_id are scored but not learnt from. An empty table
    gives no rows. where limits the labels that are fitted on.
    """
    numbers = with_numbers(docs, "row.doc_id")
    out = scored(numbers, fit(numbers, "row", labels, rows, where)).withColumnRenamed("row", "doc_id")
    return out.withColumn("keep", (F.col("score") >= KEEP).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose text and metadata the fitted model keeps; texts are read once."""
    numbers = with_numbers(docs, "row")
    return scored(numbers, fit(numbers, "row.doc_id", labels, rows)).where(F.col("score") >= KEEP).select("row.*")
