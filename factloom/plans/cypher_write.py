"""Cypher's writing clauses over the write verbs: CREATE, MERGE, SET, REMOVE, DELETE, DETACH DELETE.

A reading part (MATCH .. WHERE ..) gives rows; each writing clause then is one batch over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery, Unsupported
from ..operators import writes
from . import ir
from .cypher import Parser
from .lower import Lowering
from .settle import settled

NONE = F.lit(None).cast("bigint")


class WriteParser(Parser):
    def reading(self):
        """The part up to the first writing clause, as an algebra (None without one)."""
        op = None
        while self.sees("MATCH", "OPTIONAL"):
            optional = self.word("OPTIONAL")
            op = self.matched(op, optional)
        return op

    def made(self) -> list:
        """The triples of a CREATE or MERGE pattern."""
        out = []
        while True:
            out += self.pattern_to_write()
            if not self.word(","):
                return out

    def pattern_to_write(self) -> list:
        out: list = []
        left = self.node(out)
        while self.sees("-", "<"):
            back = self.word("<")
            self.need("-")
            self.need("[")
            name = self.name() if self.peek()[0] == "word" else self.new()
            self.need(":")
            kind = self.name()
            props = self.properties()
            self.need("]")
            self.need("-")
            self.word(">")
            right = self.node(out)
            a, b = (right, left) if back else (left, right)
            out.append(ir.Triple(a, kind, b, ir.Var(name)))
            out += [ir.Triple(ir.Var(name), k, v) for k, v in props]
            left = right
        return out


def write(store: writes.Store, text: str, params: dict | None = None) -> writes.Store:
    p = WriteParser(text, params)
    store = store.begin()
    op = p.reading()
    low = Lowering(store.statements, ir.CYPHER, language="cypher")
    spark = store.statements.sparkSession
    rows = settled(low.run(op)) if op is not None else spark.range(1).select(F.lit(1).alias("__one"))
    while p.peek()[0]:
        if p.word("CREATE"):
            store, rows = created(store, rows, p.made())
        elif p.word("MERGE"):
            pattern = p.made()
            low = Lowering(store.statements, ir.CYPHER, language="cypher")
            known = [c for c in rows.columns if not c.startswith("__")]
            found = settled(low.run(ir.Join((ir.Table(rows), *pattern)))) if known else settled(low.run(ir.Join(tuple(pattern))))
            missing = rows.join(found.select(*known).distinct(), known, "left_anti") if known else rows.where(F.lit(not found.take(1)))
            store, new = created(store, settled(missing), pattern)
            rows = found.unionByName(new, allowMissingColumns=True)
        elif p.word("SET"):
            while True:
                var = p.name()
                if p.word(":"):
                    facts = rows.select(F.col(var).alias("s"), F.lit(M.RDF_TYPE).alias("p"), F.lit(f"I:{p.name()}").alias("o"), NONE.alias("v_from"), NONE.alias("v_to"))
                    store, _ = writes.assert_(store, facts.distinct())
                else:
                    p.need(".")
                    key = p.name()
                    p.need("=")
                    e = p.expression()
                    rel = Lowering(store.statements, ir.CYPHER, language="cypher").lower(p.looked(ir.Table(rows)))
                    value = low.value(e, rel).term
                    facts = settled(rel.df.select(F.col(var).alias("s"), F.lit(key).alias("p"), value.alias("o"), NONE.alias("v_from"), NONE.alias("v_to")).distinct())
                    store, _ = writes.upsert(store, facts.where("o is not null"))
                    store = ended(store, facts.where("o is null").select("s"), key)
                if not p.word(","):
                    break
        elif p.word("REMOVE"):
            while True:
                var = p.name()
                label = p.word(":")
                if not label:
                    p.need(".")
                key = p.name()
                store = ended(store, rows.select(F.col(var).alias("s")), M.RDF_TYPE if label else key, f"I:{key}" if label else None)
                if not p.word(","):
                    break
        elif p.sees("DELETE", "DETACH"):
            detach = p.word("DETACH")
            p.need("DELETE")
            while True:
                store = deleted(store, rows.select(F.col(p.name()).alias("x")).distinct(), detach)
                if not p.word(","):
                    break
        else:
            raise Unsupported(f"{p.peek()[1]!r} is not offered in a writing query")
    return store


def created(store: writes.Store, rows: DataFrame, triples: list) -> tuple[writes.Store, DataFrame]:
    """New statements a row; variables that rows do not have become new anonymous nodes or the new statements."""
    known = {c for c in rows.columns if not c.startswith("__")}
    rels = {t.eid.name for t in triples if t.eid is not None and not (isinstance(t.o, str) or t.p == M.RDF_TYPE)}
    fresh = sorted({x.name for t in triples for x in (t.s, t.o) if isinstance(x, ir.Var)} - known - rels)
    rows = rows.withColumns({v: F.concat(F.lit("N:"), F.uuid()) for v in fresh}) if fresh else rows
    rows = settled(rows)
    for t in sorted(triples, key=lambda t: isinstance(t.s, ir.Var) and t.s.name in rels):
        cell = lambda x: F.col(x.name) if isinstance(x, ir.Var) else F.lit(x)
        facts = rows.select(cell(t.s).alias("s"), F.lit(t.p).alias("p"), cell(t.o).alias("o"), NONE.alias("v_from"), NONE.alias("v_to"))
        edge = t.eid is not None and t.eid.name in rels
        store, new = writes.create(store, facts if edge else facts.distinct())
        if edge:  # a relationship a row: of rows with the same ends, the n-th gets the n-th
            nth = lambda s, o, by: F.row_number().over(Window.partitionBy(s, o).orderBy(by))
            ids = new.select(F.col("s").alias("__s"), F.col("o").alias("__o"), nth("s", "o", "eid").alias("__k"), M.statement_ref("eid").alias(t.eid.name))
            rows = rows.withColumns({"__a": cell(t.s), "__b": cell(t.o), "__row": F.monotonically_increasing_id()})
            rows = rows.withColumn("__n", nth("__a", "__b", "__row"))
            rows = settled(rows.join(ids, (F.col("__a") == F.col("__s")) & (F.col("__b") == F.col("__o")) & (F.col("__n") == F.col("__k"))).drop("__s", "__o", "__k", "__a", "__b", "__row", "__n"))
    return store, rows


def ended(store: writes.Store, subjects: DataFrame, p: str, o: str | None = None) -> writes.Store:
    live = store.live().where(F.col("p") == p)
    live = live if o is None else live.where(F.col("o") == o)
    gone = settled(live.join(subjects.distinct(), "s", "left_semi").select("eid"))
    return writes.retract(store, gone) if gone.take(1) else store


def deleted(store: writes.Store, things: DataFrame, detach: bool) -> writes.Store:
    """Relationships by their statements; nodes with what they say, and with detach what is said of them."""
    live = store.live()
    eids = things.where(M.kind(F.col("x")) == "S").select(M.body(F.col("x")).cast("bigint").alias("eid"))
    nodes = things.where(M.kind(F.col("x")) != "S")
    out = live.join(nodes, F.col("s") == F.col("x"), "left_semi")
    into = live.join(nodes, F.col("o") == F.col("x"), "left_semi")
    if not detach:
        edges = out.where(M.kind(F.col("o")).isin("I", "N", "_") & (F.col("p") != M.RDF_TYPE)).select("eid").union(into.select("eid"))
        if edges.join(eids, "eid", "left_anti").take(1):
            raise InvalidQuery("a node with relationships needs DETACH DELETE")
    gone = settled(eids.union(out.select("eid")).union(into.select("eid")).distinct())
    return writes.retract(store, gone) if gone.take(1) else store
