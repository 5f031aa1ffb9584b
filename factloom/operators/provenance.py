"""Which statements an answer rests on, and answers saved with that knowledge."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..plans import ir
from ..plans.lower import Lowering
from .temporal import events


def tracked(op, names=None):
    """op with an eid variable on every pattern, and their names; paths and goals leave gaps."""
    names = names if names is not None else []
    if isinstance(op, ir.Triple):
        e = op.eid or ir.Var(f"_e{len(names)}")
        names.append(e.name)
        return replace(op, eid=e), names
    if isinstance(op, (ir.Join, ir.Union)):
        return replace(op, parts=tuple(tracked(p, names)[0] for p in op.parts)), names
    if isinstance(op, ir.LeftJoin):
        return ir.LeftJoin(tracked(op.left, names)[0], tracked(op.right, names)[0], op.on), names
    if isinstance(op, (ir.Filter, ir.Extend, ir.Unnest)):
        return replace(op, op=tracked(op.op, names)[0]), names
    return op, names


def gaps(op) -> list[str]:
    """Parts of a plan whose statements are not tracked."""
    if isinstance(op, (ir.PathMatch, ir.Table)):
        return [type(op).__name__]
    parts = getattr(op, "parts", None) or [x for x in (getattr(op, "op", None), getattr(op, "left", None), getattr(op, "right", None)) if x is not None]
    return [g for p in parts for g in gaps(p)]


def with_provenance(op, statements: DataFrame, view: M.View = M.NOW, semantics: ir.Semantics = ir.SPARQL) -> DataFrame:
    """The rows of op's variables, each with the sorted eids behind it (``eids``).

    Equal rows, and the rows of a group, join their eids.
    """
    if isinstance(op, ir.Project):
        keep, inner = list(op.vars), op.op
    else:
        keep, inner = None, op
    agg = inner if isinstance(inner, ir.Aggregate) else None
    plan, names = tracked(agg.op if agg else inner)
    low = Lowering(statements, semantics, view)
    rel = low.lower(plan)
    eids = F.array_sort(F.array_distinct(F.array_compact(F.array(*[M.body(F.col(n)).try_cast("bigint") for n in names]))))
    rows = rel.df.withColumn("eids", eids)
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("eids")))).alias("eids")
    if agg:
        cols = [low._agg(a, rel)[0].alias(n) for n, a in agg.aggs]
        return rows.groupBy(*agg.keys).agg(*cols, merged)
    keep = keep or [v for v in rel.vars if v not in names]
    return rows.groupBy(*keep).agg(merged)


@dataclass(frozen=True)
class Saved:
    """An answer as it was, the eids it rests on (eid), the transaction it was made at, and its plan."""

    rows: DataFrame
    depends: DataFrame
    predicates: tuple
    cursor: int
    op: object = None


def save(op, statements: DataFrame, cursor: int, predicates: tuple = ()) -> Saved:
    rows = with_provenance(op, statements, M.as_of(cursor))
    return Saved(rows, rows.select(F.explode("eids").alias("eid")).distinct(), predicates, cursor, op)


def refreshed(saved: Saved, statements: DataFrame, cursor: int) -> Saved:
    """The answer made again at a later transaction."""
    return save(saved.op, statements, cursor, saved.predicates)


def compared(old: Saved, new: Saved) -> DataFrame:
    """Rows that a refresh brought (added) and took away (removed), without their eids."""
    a, b = (x.rows.drop("eids") for x in (old, new))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def status(saved: Saved, statements: DataFrame, until: int) -> DataFrame:
    """One row: fresh, recheck (statements of its predicates came) or stale (one it rests on went), with counts."""
    log = events(statements, saved.cursor).where(F.col("t") <= until)
    lost = log.where(F.col("op") == "retract").join(saved.depends, "eid", "left_semi").agg(F.count("*").alias("lost"))
    came = log.where(F.col("op") == "assert")
    came = came.where(F.col("p").isin(*saved.predicates)) if saved.predicates else came
    x = lost.crossJoin(came.agg(F.count("*").alias("came")))  # one row each
    return x.select(F.when(F.col("lost") > 0, "stale").when(F.col("came") > 0, "recheck").otherwise("fresh").alias("status"), "lost", "came")
