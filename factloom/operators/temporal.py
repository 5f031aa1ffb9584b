"""Operators over transaction time and valid time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..plans.settle import spread

ALLEN = ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "finishedBy", "contains", "startedBy", "overlappedBy", "metBy", "after")
CONVERSE = dict(zip(ALLEN, reversed(ALLEN)))


def begin(c: Column) -> Column:
    return F.coalesce(c, F.lit(M.EVER_FROM))


def end(c: Column) -> Column:
    return F.coalesce(c, F.lit(M.EVER_TO))


def overlaps(af: Column, at: Column, bf: Column, bt: Column) -> Column:
    """Whether two half-open intervals share an instant; null bounds are open."""
    return (begin(af) < end(bt)) & (begin(bf) < end(at))


def relate(af: Column, at: Column, bf: Column, bt: Column) -> Column:
    """Which of Allen's thirteen relations [af, at) has to [bf, bt)."""
    a0, a1, b0, b1 = begin(af), end(at), begin(bf), end(bt)
    return (
        F.when(a1 < b0, "before").when(a1 == b0, "meets").when(b1 < a0, "after").when(b1 == a0, "metBy")
        .when((a0 == b0) & (a1 == b1), "equals").when((a0 == b0) & (a1 < b1), "starts").when(a0 == b0, "startedBy")
        .when((a1 == b1) & (a0 > b0), "finishes").when(a1 == b1, "finishedBy")
        .when((a0 > b0) & (a1 < b1), "during").when((a0 < b0) & (a1 > b1), "contains")
        .when(a0 < b0, "overlaps").otherwise("overlappedBy")
    )


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], bounds=("v_from", "v_to", "v_from", "v_to")) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap; columns of a and b get suffixes _a and _b."""
    left = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in a.columns if c not in on])
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in on])
    test = overlaps(*[F.col(c) for c in (f"{bounds[0]}_a", f"{bounds[1]}_a", f"{bounds[2]}_b", f"{bounds[3]}_b")])
    return left.join(right, on).where(test)


def bucket_overlap_join(a: DataFrame, b: DataFrame, width: int, lo: int, hi: int) -> DataFrame:
    """Overlapping pairs without any key: both sides are dealt to buckets of time, which are the key.

    Only the bucket in which a pair's later begin lies reports it. Open ends are capped at lo
    and hi, which must hold all bounded times.
    """

    def dealt(x: DataFrame, suffix: str) -> DataFrame:
        y = x.select(*[F.col(c).alias(f"{c}_{suffix}") for c in x.columns])
        f, t = F.greatest(begin(F.col(f"v_from_{suffix}")), F.lit(lo)), F.least(end(F.col(f"v_to_{suffix}")), F.lit(hi))
        y = y.withColumn(f"f_{suffix}", f).withColumn(f"t_{suffix}", t).where(F.col(f"f_{suffix}") < F.col(f"t_{suffix}"))
        return y.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"f_{suffix}") / width), F.floor((F.col(f"t_{suffix}") - 1) / width))))

    x = dealt(a, "a").join(dealt(b, "b"), "bucket").where("f_a < t_b and f_b < t_a")
    return x.where(F.floor(F.greatest("f_a", "f_b") / width) == F.col("bucket")).drop("bucket", "f_a", "t_a", "f_b", "t_b")


def coalesced(df: DataFrame, keys: list[str], f: str = "v_from", t: str = "v_to") -> DataFrame:
    """Maximal intervals of each key: overlapping and touching ones merge (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("f_", "t_")
    x = df.select(*keys, begin(F.col(f)).alias("f_"), end(F.col(t)).alias("t_")).where("f_ < t_")
    x = x.withColumn("top", F.max("t_").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("isle", F.sum(F.when(F.col("top").isNull() | (F.col("f_") > F.col("top")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*keys, "isle").agg(F.min("f_").alias("f_"), F.max("t_").alias("t_"))
    return x.select(*keys, F.when(F.col("f_") > M.EVER_FROM, F.col("f_")).alias(f), F.when(F.col("t_") < M.EVER_TO, F.col("t_")).alias(t))


def segments(df: DataFrame, keys: list[str], value: Column, kind: str = "count", f: str = "v_from", t: str = "v_to") -> DataFrame:
    """An aggregate at every instant: count, sum, min or max of the rows valid then, as maximal intervals.

    Counts and sums are running totals of changes at the end points. min and max cannot be undone:
    there a row is laid on the few nodes of a binary tree over a key's segments that make up its
    time, and a segment takes the least or greatest of the nodes above it. So work grows with
    rows times the logarithm of a key's segments, however much of its time a key's rows share.
    """
    x = df.select(*keys, value.alias("x"), begin(F.col(f)).alias("f_"), end(F.col(t)).alias("t_")).where("f_ < t_")
    ends = x.select(*keys, F.col("f_").alias("at"), F.lit(1).alias("d"), F.col("x").alias("dx")).union(x.select(*keys, "t_", F.lit(-1), -F.col("x") if kind in ("count", "sum") else F.col("x")))
    ends = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum("dx").alias("dx"))
    ends = spread(ends, *keys)
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(w) - 1
    seg = ends.select(*keys, F.col("at").alias("f_"), place.alias("i"), F.lead("at").over(w).alias("t_"), F.sum("d").over(run).alias("n"), F.sum("dx").over(run).alias("total"))
    if kind in ("count", "sum"):
        seg = seg.where("t_ is not null and n > 0").withColumn("value", F.col("n") if kind == "count" else F.col("total"))
    else:
        pick = F.min if kind == "min" else F.max
        same = lambda side: [F.col(k).eqNullSafe(F.col(f"{k}_{side}")) for k in keys]
        at = lambda side: seg.select(*[F.col(k).alias(f"{k}_{side}") for k in keys], F.col("f_").alias(f"at_{side}"), F.col("i").alias(side))
        y = x.join(at("lo"), [*same("lo"), F.col("f_") == F.col("at_lo")]).join(at("hi"), [*same("hi"), F.col("t_") == F.col("at_hi")])
        nodes = y.select(*keys, "x", F.explode(covering(F.col("lo"), F.col("hi"))).alias("node")).groupBy(*keys, "node").agg(pick("x").alias("x"))
        above = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: node_of(k, F.call_function("shiftright", F.col("i").cast("bigint"), k)))
        seg = seg.where("t_ is not null and n > 0").withColumn("node", F.explode(above))
        seg = seg.alias("s").join(nodes.alias("o"), [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "node"]]).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "f_", "t_").agg(pick("x").alias("value"))
    out = seg.select(*keys, "value", F.when(F.col("f_") > M.EVER_FROM, F.col("f_")).alias(f), F.when(F.col("t_") < M.EVER_TO, F.col("t_")).alias(t))
    return coalesced(out, [*keys, "value"], f, t)


LEVELS = 31  #: of the tree over a key's segments


def node_of(level: Column, place: Column) -> Column:
    return F.call_function("shiftleft", place.cast("bigint"), F.lit(6)) + level


def covering(lo: Column, hi: Column) -> Column:
    """The nodes, at most two a level, that make up the places from lo to before hi."""
    none = F.array().cast("array<bigint>")

    def step(acc, k):
        i, j = acc["i"], acc["j"]
        odd_i, odd_j = (i < j) & (i % 2 == 1), (i < j) & (j % 2 == 1) & ~((i % 2 == 1) & (j == i + 1))
        first = F.when(odd_i, F.array(node_of(k, i))).otherwise(none)
        last = F.when(odd_j, F.array(node_of(k, j - 1))).otherwise(none)
        ni, nj = F.when(odd_i, i + 1).otherwise(i), F.when((i < j) & (j % 2 == 1), j - 1).otherwise(j)
        half = lambda c: F.call_function("shiftright", c, F.lit(1))
        return F.struct(half(ni).alias("i"), half(nj).alias("j"), F.concat(acc["out"], first, last).alias("out"))

    start = F.struct(lo.cast("bigint").alias("i"), hi.cast("bigint").alias("j"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda acc: acc["out"])


def conflicts(statements: DataFrame, view: M.View = M.NOW) -> DataFrame:
    """Pairs of statements with one subject and predicate, other objects, and a common valid time."""
    if view.mode == "history":
        raise ValueError("conflicts are of one state of the store, not of its history")
    x = M.seen(statements, view).select("eid", "s", "p", "o", "v_from", "v_to")
    y = overlap_join(x, x, ["s", "p"]).where((F.col("o_a") < F.col("o_b")))
    f, t = F.greatest(begin(F.col("v_from_a")), begin(F.col("v_from_b"))), F.least(end(F.col("v_to_a")), end(F.col("v_to_b")))
    return y.select("s", "p", "eid_a", "eid_b", "o_a", "o_b", F.when(f > M.EVER_FROM, f).alias("v_from"), F.when(t < M.EVER_TO, t).alias("v_to"))


def conflict_windows(statements: DataFrame, view: M.View = M.NOW) -> DataFrame:
    """Maximal intervals in which a (s, p) has two or more different objects, and the most at once."""
    x = coalesced(M.seen(statements, view), ["s", "p", "o"])
    n = segments(x, ["s", "p"], F.lit(1), "count").where("value > 1")
    w = coalesced(n, ["s", "p"])
    most = w.alias("w").join(n.alias("n"), ["s", "p"]).where(overlaps(F.col("w.v_from"), F.col("w.v_to"), F.col("n.v_from"), F.col("n.v_to")))
    return most.groupBy("s", "p", F.col("w.v_from").alias("v_from"), F.col("w.v_to").alias("v_to")).agg(F.max("value").alias("objects"))


def events(statements: DataFrame, since: int | None = None) -> DataFrame:
    """The log: an assert at t_add and a retract at t_ret of every statement, after ``since``."""
    cols = ["eid", "s", "p", "o"]
    log = statements.select(F.col("t_add").alias("t"), F.lit("assert").alias("op"), *cols).unionByName(statements.where("t_ret is not null").select(F.col("t_ret").alias("t"), F.lit("retract").alias("op"), *cols))
    return log if since is None else log.where(F.col("t") > since)


def replayed(log: DataFrame, t: int) -> DataFrame:
    """The eids alive after replaying the log up to and with t."""
    return log.where(F.col("t") <= t).groupBy("eid").agg(F.sum(F.when(F.col("op") == "assert", 1).otherwise(-1)).alias("n")).where("n > 0").select("eid")


def changed(statements: DataFrame, old: M.View, new: M.View) -> DataFrame:
    """What a later view has that an earlier one has not (added), and the other way (removed), as facts."""
    a, b = (M.seen(statements, v).select("s", "p", "o").distinct() for v in (old, new))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def unchanged(statements: DataFrame, old: M.View, new: M.View) -> DataFrame:
    """The facts that both views have."""
    a, b = (M.seen(statements, v).select("s", "p", "o").distinct() for v in (old, new))
    return a.intersectAll(b)


def as_of_join(left: DataFrame, statements: DataFrame, on: str, at: str) -> DataFrame:
    """Each row of left with the statements about its subject that were visible at its own time.

    left has columns ``on`` (a subject key) and ``at``. Statements of a subject have disjoint or
    few lifetimes, so the equality on the subject keeps candidates small.
    """
    x = statements.select(F.col("s").alias("s_"), "eid", "p", "o", "t_add", "t_ret")
    return left.join(x, (F.col(on) == F.col("s_")) & (F.col("t_add") <= F.col(at)) & (F.col("t_ret").isNull() | (F.col("t_ret") > F.col(at))), "left").drop("s_")
