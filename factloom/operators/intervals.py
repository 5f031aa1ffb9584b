"""Interval sets as sorted arrays of half-open (f, t) structs, and metric temporal operators on rows.

Small sets are arrays, combined with higher-order functions that stay in the JVM; relations of
facts keep an interval a row and coalesce by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from .temporal import begin, coalesced, end

SET = "array<struct<f:bigint,t:bigint>>"


def interval(f, t) -> Column:
    return F.array(F.struct(F.lit(f).cast("bigint").alias("f"), F.lit(t).cast("bigint").alias("t")))


def normal(x: Column) -> Column:
    """Sorted, coalesced, without empty parts."""
    parts = F.array_sort(F.filter(x, lambda i: i["f"] < i["t"]))
    none = F.array().cast(SET)

    def step(acc, i):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["f"].alias("f"), F.greatest(last["t"], i["t"]).alias("t"))))
        return F.when(F.coalesce(i["f"] <= last["t"], F.lit(False)), joined).otherwise(F.concat(acc, F.array(i)))

    return F.aggregate(parts, none, step)


def union(a: Column, b: Column) -> Column:
    return normal(F.concat(a, b))


def intersect(a: Column, b: Column) -> Column:
    cut = lambda i, j: F.struct(F.greatest(i["f"], j["f"]).alias("f"), F.least(i["t"], j["t"]).alias("t"))
    return normal(F.flatten(F.transform(a, lambda i: F.transform(b, lambda j: cut(i, j)))))


def complement(a: Column) -> Column:
    n = normal(a)
    starts = F.concat(F.array(F.lit(M.EVER_FROM)), F.transform(n, lambda i: i["t"]))
    ends = F.concat(F.transform(n, lambda i: i["f"]), F.array(F.lit(M.EVER_TO)))
    return F.filter(F.zip_with(starts, ends, lambda f, t: F.struct(f.alias("f"), t.alias("t"))), lambda i: i["f"] < i["t"])


def subtract(a: Column, b: Column) -> Column:
    return intersect(a, complement(b))


def clip(a: Column, lo: int, hi: int) -> Column:
    return intersect(a, interval(lo, hi))


def _shift(f: Column, low: int, t: Column, high: int) -> tuple[Column, Column]:
    """Bounds moved, open ends left open."""
    nf = F.when(f > M.EVER_FROM, f + low).otherwise(f)
    nt = F.when(t < M.EVER_TO, t + high).otherwise(t)
    return nf, nt


def metric(df: DataFrame, keys: list[str], op: str, low: int, high: int, f: str = "v_from", t: str = "v_to") -> DataFrame:
    """Where a metric operator over [low, high] holds of each key's facts, with integer instants.

    past: at some instant between high and low ago; always_past: at all of them; future and
    always_future alike, ahead.
    """
    x = coalesced(df, keys, f, t).select(*keys, begin(F.col(f)).alias("f_"), end(F.col(t)).alias("t_"))
    a, b = F.col("f_"), F.col("t_")
    moved = {"past": (low, high), "always_past": (high, low), "future": (-high, -low), "always_future": (-low, -high)}[op]
    nf, nt = _shift(a, moved[0], b, moved[1])
    x = x.select(*keys, nf.alias("f_"), nt.alias("t_")).where("f_ < t_")
    return coalesced(x, keys, "f_", "t_").withColumnsRenamed({"f_": f, "t_": t})


def since(a: DataFrame, b: DataFrame, keys: list[str], low: int, high: int, f: str = "v_from", t: str = "v_to") -> DataFrame:
    """Instants x with an instant y of b, low to high before x, and a at all instants after y up to x.

    Within one maximal run [af, at) of a, y may be from af - 1 on (a is asked only after y) and
    x is in the run; x = y needs no a at all, if low is 0.
    """
    return _between(a, b, keys, low, high, f, t, 1)


def until(a: DataFrame, b: DataFrame, keys: list[str], low: int, high: int, f: str = "v_from", t: str = "v_to") -> DataFrame:
    """Instants x with an instant y of b, low to high after x, and a at all instants from x to before y."""
    return _between(a, b, keys, low, high, f, t, -1)


def _between(a: DataFrame, b: DataFrame, keys: list[str], low: int, high: int, f: str, t: str, way: int) -> DataFrame:
    x = coalesced(a, keys, f, t).select(*keys, begin(F.col(f)).alias("af"), end(F.col(t)).alias("at"))
    y = coalesced(b, keys, f, t).select(*keys, begin(F.col(f)).alias("bf"), end(F.col(t)).alias("bt"))
    j = x.join(y, keys)
    if way == 1:
        bf, bt = F.greatest("bf", F.when(F.col("af") > M.EVER_FROM, F.col("af") - 1).otherwise(F.col("af"))), F.least("bt", "at")
        nf, nt = _shift(bf, low, bt, high)
        nf, nt = F.greatest(nf, "af"), F.least(nt, "at")
    else:
        bf, bt = F.greatest("bf", "af"), F.least("bt", F.when(F.col("at") < M.EVER_TO, F.col("at") + 1).otherwise(F.col("at")))
        nf, nt = _shift(bf, -high, bt, -low)
        nf, nt = F.greatest(nf, "af"), F.least(nt, "at")
    out = j.where(bf < bt).select(*keys, nf.alias(f), nt.alias(t)).where(F.col(f) < F.col(t))
    if low == 0:
        out = out.unionByName(y.select(*keys, F.col("bf").alias(f), F.col("bt").alias(t)))
    return coalesced(out, keys, f, t)
