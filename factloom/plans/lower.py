"""From the algebra to DataFrames. Catalyst does what follows: pushdown, pruning, join order."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery, LimitExceeded, Unsupported
from ..functions import cypher as cypher_functions
from ..functions import sparql as sparql_functions
from ..functions.values import V, arithmetic, boolean, constant, equal, integer, number, ordered, strict
from ..operators import grouped, paths
from . import cyclic, ir
from .settle import settled

NESTED = ("list", "map", "path")  #: forms that stay as they are in a column
TESTS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def column(name: str) -> Column:
    """A column whose name may hold dots and other signs."""
    return F.col(f"`{name.replace('`', '``')}`")


@dataclass
class Rel:
    """Rows with a column a variable, and which variables may be null."""

    df: DataFrame
    maybe: frozenset = frozenset()
    forms: dict = field(default_factory=dict)  #: variables that are not terms: number (double), int (bigint), text, bool, list, map
    iso: dict = field(default_factory=dict)  #: MATCH -> [(hidden eid column, constant predicate or None)]

    @property
    def vars(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]


@dataclass
class Lowering:
    """statements: the store; multi: predicates that may hold a triple twice (None: any may).

    groups: relations of which all statements of a predicate are known to consist, so that
    searches may go by their groups. links: such relations from one side of a group to the other.
    """

    statements: DataFrame
    semantics: ir.Semantics = ir.SPARQL
    view: M.View = M.NOW
    tx: DataFrame | None = None
    volatile: DataFrame | None = None  #: (s, p, o) read under Now
    multi: frozenset | None = None
    language: str = "sparql"
    extra: dict = field(default_factory=dict)  #: functions of the caller's: name -> f(list of V) -> V
    groups: tuple = ()
    links: tuple = ()

    def __post_init__(self):
        self.fresh = itertools.count()
        self.order = M.CYPHER_ORDER if self.language == "cypher" else M.VALUE_ORDER

    def run(self, op) -> DataFrame:
        """The rows of op with terms in all columns but those of aggregates and computed numbers."""
        rel = self.lower(op)
        return rel.df.select(*map(column, rel.vars))

    def distinct(self, op, kept: list[str]) -> DataFrame:
        """The distinct values of the variables kept in the rows of op.

        A join of triples gives up one other variable after the other: what holds it is joined
        and only distinct rows without it go on. A relation with links is joined by its groups.
        """
        parts = op.parts if isinstance(op, ir.Join) else (op,)
        plain = self.semantics.triples and all(isinstance(t, ir.Triple) and isinstance(t.p, str) and t.eid is None and t.graph is None and t.iso is None for t in parts)
        if not plain or not set(kept) <= {x.name for t in parts for x in (t.s, t.o) if isinstance(x, ir.Var)}:
            return self.run(op).select(*map(column, kept)).distinct()
        rels = []
        for t in parts:
            link = next((x for x in self.links if x.p == t.p), None) if (t.view or self.view) == M.NOW and self.volatile is None else None
            if link and isinstance(t.s, ir.Var) and isinstance(t.o, ir.Var) and t.s != t.o:
                g = f"__group{len(rels)}"
                rels += [side.select(F.col("node").alias(v.name), F.col("group").alias(g)) for side, v in ((link.left, t.s), (link.right, t.o))]
            else:
                rels.append(self._triple(t).df)
        joined = lambda xs: reduce(lambda a, b: a.join(b, on) if (on := [c for c in a.columns if c in b.columns]) else a.crossJoin(b), xs)
        while out := {c for x in rels for c in x.columns} - {*kept, "__one"}:
            left = lambda v: {c for x in rels if v in x.columns for c in x.columns} - {v}
            v = min(out, key=lambda v: (v.startswith("__group"), len(left(v)), v))  # groups last, as they stand for pairs
            names, mine = sorted(left(v)), [x for x in rels if v in x.columns]
            rels = [x for x in rels if v not in x.columns] + [joined(mine).select(*(map(column, names) if names else [F.lit(1).alias("__one")])).distinct()]
        return joined(rels).select(*map(column, kept)).distinct()

    def lower(self, op) -> Rel:
        return getattr(self, f"_{type(op).__name__.lower()}")(op)

    # --- leaves ----------------------------------------------------------------

    def _seen(self, view) -> DataFrame:
        return M.seen(self.statements, view or self.view, self.tx)

    def _triple(self, t: ir.Triple) -> Rel:
        view = t.view or self.view
        x = self._seen(view)
        for c in ("s", "p", "o"):
            term = getattr(t, c)
            if not isinstance(term, ir.Var):
                x = x.where(F.col(c) == F.lit(term if c == "p" or isinstance(term, str) and term[1:2] == ":" else M.key(term)))
        if self.volatile is not None and view.mode == "now" and view.valid is None and t.graph is None and t.eid is None:
            extra = self.volatile.select(F.lit(None).cast("bigint").alias("eid"), "s", "p", "o", *[F.lit(None).cast(x.schema[c].dataType).alias(c) for c in x.columns[4:]])
            for c in ("s", "p", "o"):
                term = getattr(t, c)
                if not isinstance(term, ir.Var):
                    extra = extra.where(F.col(c) == F.lit(term if c == "p" or isinstance(term, str) and term[1:2] == ":" else M.key(term)))
            x = x.unionByName(extra)
        names = {}
        if t.graph is not None:
            member = self._seen(view).where(F.col("p") == M.IN_GRAPH).select(F.col("s").alias("__m"), F.col("o").alias("__g"))
            ref = M.statement_ref("eid")
            if isinstance(t.graph, ir.Var):
                x = x.join(member, ref == F.col("__m"))
                names[t.graph.name] = F.col("__g")
            else:
                x = x.join(member.where(F.col("__g").isin(*t.graph)), ref == F.col("__m"), "left_semi")
        can_repeat = isinstance(t.p, ir.Var) or self.multi is None or t.p in self.multi
        if self.semantics.triples and t.eid is None and can_repeat and not isinstance(t.graph, ir.Var):
            x = M.canonical(x)
        for c in ("s", "p", "o"):
            term = getattr(t, c)
            if isinstance(term, ir.Var):
                value = F.concat(F.lit("I:"), F.col("p")) if c == "p" else F.col(c)
                if term.name in names:
                    x = x.where(names[term.name] == value)
                else:
                    names[term.name] = value
        if t.eid is not None:
            ref = M.statement_ref("eid")
            if t.eid.name in names:
                x = x.where(names[t.eid.name] == ref)
            names[t.eid.name] = ref
        iso, hidden = {}, []
        if t.iso and self.semantics.isomorphism:
            h = f"__eid{next(self.fresh)}"
            hidden = [F.col("eid").alias(h)]
            iso = {t.iso: [(h, None if isinstance(t.p, ir.Var) else t.p)]}
        if not names and not hidden:
            return Rel(x.select(F.lit(1).alias("__one")), iso=iso)
        return Rel(x.select(*[c.alias(n) for n, c in names.items()], *hidden), iso=iso)

    def _virtual(self, v: ir.Virtual) -> Rel:
        x = self._seen(v.view or self.view)
        null = lambda c: F.when(F.col(c).isNotNull(), M.date_time(c))
        col = {
            "subject": F.col("s"), "predicate": F.concat(F.lit("I:"), F.col("p")), "object": F.col("o"),
            "txAdded": F.concat(F.lit("T:"), F.col("t_add").cast("string")), "txRetracted": F.concat(F.lit("T:"), F.col("t_ret").cast("string")),
            "addedAt": null("t_add"), "retractedAt": null("t_ret"), "validFrom": null("v_from"), "validTo": null("v_to"), "retractKind": M.integer("ret_kind"),
        }.get(v.name)
        if col is None:
            raise InvalidQuery(f"no virtual predicate {v.name}")
        if v.name in ("addedAt", "retractedAt") and self.tx is not None:
            t = "t_add" if v.name == "addedAt" else "t_ret"
            x = x.join(self.tx.select(F.col("t").alias("__t"), "instant"), F.col(t) == F.col("__t"))
            col = M.date_time("instant")
        x = x.select(M.statement_ref("eid").alias(v.eid.name), col.alias("__v")).where("__v is not null")
        if isinstance(v.value, ir.Var):
            return Rel(x.withColumnRenamed("__v", v.value.name))
        return Rel(x.where(F.col("__v") == F.lit(M.key(v.value) if not isinstance(v.value, str) else v.value)).drop("__v"))

    def _pathmatch(self, p: ir.PathMatch, seeds: DataFrame | None = None, at: str = "") -> Rel:
        """seeds (node) are the values that the variable ``at`` may have; without them all nodes are tried."""
        x = self._seen(p.view or self.view)
        path = paths.parse_path(p.path) if isinstance(p.path, str) else p.path
        s, o, back = p.s, p.o, False
        if isinstance(s, ir.Var) and (not isinstance(o, ir.Var) or at == o.name != s.name):  # from the bound end
            s, o, path, back = o, s, paths.inverted(path), True
        if seeds is not None:
            starts = seeds
        elif isinstance(s, ir.Var):
            starts = x.select(F.col("s").alias("node")).union(x.select("o")).distinct()
        else:
            starts = x.sparkSession.createDataFrame([(s,)], "node string")
        if p.mode == "reach":
            g = self._grouped(p, path)
            r = (grouped.reach(g, starts, path) if g else paths.reach(x, starts, path)).rows
            extra, iso = [], {}
        else:
            found = paths.trails(x, starts, path, p.longest) if p.mode == "trail" else paths.shortest(x, starts, path, p.mode, p.longest)
            if p.capped and found.verdict != "exhaustive":
                raise LimitExceeded(f"paths of more than {p.longest} hops")
            eids, nodes = (F.reverse("eids"), F.reverse("nodes")) if back else (F.col("eids"), F.col("nodes"))
            steps = F.flatten(F.zip_with(eids, F.slice(nodes, F.lit(2), F.size(eids)), lambda e, n: F.array(M.statement_ref(e), n)))
            h = f"__pe{next(self.fresh)}"
            r, iso = found.rows, {p.iso: [(h, None)]} if p.iso and self.semantics.isomorphism else {}
            extra = ([F.concat(F.slice(nodes, 1, 1), steps).alias(p.bind)] if p.bind else []) + ([eids.alias(h)] if iso else [])
        forms = {p.bind: "path"} if p.bind and extra else {}
        if isinstance(s, ir.Var) and isinstance(o, ir.Var):
            if s.name == o.name:
                return Rel(r.where("start = node").select(F.col("start").alias(s.name), *extra), forms=forms, iso=iso)
            return Rel(r.select(F.col("start").alias(s.name), F.col("node").alias(o.name), *extra), forms=forms, iso=iso)
        if isinstance(o, ir.Var):
            return Rel(r.select(F.col("node").alias(o.name), *extra), forms=forms, iso=iso)
        return Rel(r.where(F.col("node") == o).select(F.lit(1).alias("__one"), *extra), forms=forms, iso=iso)

    def _grouped(self, p: ir.PathMatch, path) -> grouped.Grouped | None:
        """The relation of groups that a path goes along, if it takes nothing else."""
        auto = paths.compile_path(path)
        return next((g for g in self.groups if g.covers(auto)), None) if (p.view or self.view) == M.NOW else None

    def _by_ends(self, op, kept: tuple):
        """op where only distinct values of ``kept`` count: a way that cannot come to a statement again is as good as its ends."""
        if self.groups and isinstance(op, ir.Extend) and isinstance(op.value, ir.Var):
            return ir.Extend(self._by_ends(op.op, (*kept, op.value.name)), op.var, op.value)
        if not self.groups or not isinstance(op, ir.Join):
            return op
        parts = []
        for p in op.parts:
            if isinstance(p, ir.PathMatch) and p.mode == "trail" and not p.capped and p.bind not in kept and sum(getattr(x, "iso", None) == p.iso for x in op.parts) == 1:
                path = paths.parse_path(p.path) if isinstance(p.path, str) else p.path
                ways = {inverse for _, _, inverse, _ in paths.compile_path(path).moves}
                if len(ways) == 1 and self._grouped(p, path):
                    p = ir.PathMatch(p.s, path, p.o, p.view)
            parts.append(p)
        return ir.Join(tuple(parts), op.null_safe)

    def _nodescan(self, n: ir.NodeScan) -> Rel:
        x = self._seen(n.view or self.view).where(~F.startswith("p", F.lit(M.SYS)))
        ends = x.where((F.col("p") != M.RDF_TYPE) & M.kind(F.col("o")).isin(*M.NODES)).select("o")
        return Rel(x.select(F.col("s").alias(n.node.name)).where(M.kind(F.col(n.node.name)).isin(*M.NODES)).union(ends).distinct())

    def _table(self, t: ir.Table) -> Rel:
        return Rel(t.frame, frozenset(t.maybe))

    def _procedure(self, c: ir.Procedure) -> Rel:
        from .procedures import PROCEDURES

        if c.name not in PROCEDURES:
            raise InvalidQuery(f"unknown procedure {c.name}")
        df = PROCEDURES[c.name](self._seen(None), *c.args)
        yields = c.yields or tuple((x, x) for x in df.columns)
        return Rel(df.select(*[F.col(a).alias(b) for a, b in yields]))

    def _values(self, v: ir.Values) -> Rel:
        df = self.statements.sparkSession.createDataFrame(list(v.rows), ", ".join(f"`{n}` string" for n in v.vars))
        return Rel(df, frozenset(n for i, n in enumerate(v.vars) if any(r[i] is None for r in v.rows)))

    # --- joins -----------------------------------------------------------------

    def _join(self, j: ir.Join) -> Rel:
        if not j.parts:
            return Rel(self.statements.sparkSession.range(1).select(F.lit(1).alias("__one")))
        walks = [p for p in j.parts if isinstance(p, ir.PathMatch)]
        rels = [self.lower(p) for p in cyclic.ordered([p for p in j.parts if not isinstance(p, ir.PathMatch)])]
        out = rels.pop(0) if rels else self.lower(walks.pop(0))
        while rels:  # connected parts first, so that only what shares nothing is crossed
            i = next((i for i, r in enumerate(rels) if set(r.vars) & set(out.vars)), 0)
            out = self._pair(out, rels.pop(i), j.null_safe)
        while walks:  # paths last, from the ends that are known by then
            known = lambda t: isinstance(t, ir.Var) and t.name in out.vars and t.name not in out.maybe
            i = next((i for i, w in enumerate(walks) if known(w.s) or known(w.o)), 0)
            w = walks.pop(i)
            end = w.s if known(w.s) else w.o if known(w.o) else None
            if end is None or not (isinstance(w.s, ir.Var) and isinstance(w.o, ir.Var)):
                out = self._pair(out, self.lower(w))
            else:
                out = Rel(settled(out.df), out.maybe, out.forms, out.iso)
                out = self._pair(out, self._pathmatch(w, out.df.select(F.col(end.name).alias("node")).distinct(), end.name))
        return out

    def _pair(self, a: Rel, b: Rel, null_safe: tuple = ()) -> Rel:
        shared = [v for v in a.vars if v in b.vars]
        maybe = [v for v in shared if v not in null_safe and self.semantics.unbound and (v in a.maybe or v in b.maybe)]
        b, ren = self._apart(b, shared)
        if not maybe:
            on = [F.col(v).eqNullSafe(F.col(ren[v])) if v in null_safe else F.col(v) == F.col(ren[v]) for v in shared]
            df = a.df.join(b.df, on) if on else a.df.crossJoin(b.df)
        else:
            df = self._compatible(a.df, b.df, shared, maybe, ren)
        return self._merged(df, a, b, shared, ren, "inner")

    def _compatible(self, a: DataFrame, b: DataFrame, shared, maybe, ren) -> DataFrame:
        """Missing values match anything: an equi-join for every set of variables missing on a side."""
        parts = []
        for left in itertools.product((True, False), repeat=len(maybe)):
            for right in itertools.product((True, False), repeat=len(maybe)):
                x = a.where(reduce(lambda p, q: p & q, [F.col(v).isNotNull() if has else F.col(v).isNull() for v, has in zip(maybe, left)]))
                y = b.where(reduce(lambda p, q: p & q, [F.col(ren[v]).isNotNull() if has else F.col(ren[v]).isNull() for v, has in zip(maybe, right)]))
                on = [F.col(v) == F.col(ren[v]) for v in shared if v not in maybe] + [F.col(v) == F.col(ren[v]) for v, p, q in zip(maybe, left, right) if p and q]
                parts.append(x.join(y, on) if on else x.crossJoin(y))
        return reduce(lambda p, q: p.unionByName(q), parts)

    def _apart(self, b: Rel, shared) -> tuple[Rel, dict]:
        ren = {v: f"__r{next(self.fresh)}" for v in shared}
        df = b.df.withColumnsRenamed(ren) if ren else b.df
        clash = {c: f"__c{next(self.fresh)}" for c in df.columns if c == "__one"}
        return Rel(df.withColumnsRenamed(clash) if clash else df, b.maybe, b.forms, b.iso), ren

    def _merged(self, df: DataFrame, a: Rel, b: Rel, shared, ren, how: str) -> Rel:
        cols = []
        for c in a.df.columns:
            if c in shared and (c in a.maybe or c in b.maybe):
                cols.append(F.coalesce(F.col(c), F.col(ren[c])).alias(c))
            else:
                cols.append(F.col(c))
        cols += [F.col(c) for c in b.df.columns if c not in ren.values()]
        maybe = (a.maybe - set(shared)) | {v for v in shared if v in a.maybe and (how == "left" or v in b.maybe)} | {v for v in b.maybe if v not in shared}
        if how == "left":
            maybe |= {v for v in b.vars if v not in shared and v not in ren.values()}
        iso = {k: a.iso.get(k, []) + b.iso.get(k, []) for k in {*a.iso, *b.iso}}
        if how == "inner":
            df = self._isomorphic(df, a, b)
        return Rel(df.select(*cols), frozenset(maybe), {**b.forms, **a.forms}, iso)

    def _iso_tests(self, a: Rel, b: Rel) -> list[Column]:
        tests = []
        for name in set(a.iso) & set(b.iso):
            for (x, p), (y, q) in itertools.product(a.iso[name], b.iso[name]):
                walk = [c.startswith("__pe") for c in (x, y)]
                if all(walk):
                    tests.append(~F.arrays_overlap(x, y))
                elif any(walk):
                    a_, b_ = (x, y) if walk[0] else (y, x)
                    tests.append(~F.array_contains(F.col(a_), F.col(b_)))
                elif p is None or q is None or p == q:
                    tests.append(F.col(x) != F.col(y))
        return tests

    def _isomorphic(self, df: DataFrame, a: Rel, b: Rel) -> DataFrame:
        for t in self._iso_tests(a, b):
            df = df.where(t)
        return df

    def _leftjoin(self, j: ir.LeftJoin) -> Rel:
        a, b = self.lower(j.left), self.lower(j.right)
        shared = [v for v in a.vars if v in b.vars]
        b2, ren = self._apart(b, shared)
        loose = [v for v in shared if self.semantics.unbound and (v in a.maybe or v in b.maybe)]
        plain = not any(self._has_exists(t) for t in j.on)
        if not loose and plain:
            both = Rel(None, a.maybe | b.maybe, {**b.forms, **a.forms})
            on = [F.col(v) == F.col(ren[v]) for v in shared] + self._iso_tests(a, b2) + [self.value(t, both).bool for t in j.on]
            df = a.df.join(b2.df, on, "left") if on else a.df.join(b2.df, F.lit(True), "left")
            return self._merged(df, a, b2, shared, ren, "left")
        # with missing values: matches, and the rows that have none
        tag = f"__id{next(self.fresh)}"
        left = Rel(settled(a.df.withColumn(tag, F.monotonically_increasing_id())), a.maybe, a.forms, a.iso)
        hit = self._pair(left, b)
        if j.on:
            hit = self._filtered(hit, j.on)
        rest = left.df.join(hit.df.select(tag).distinct(), tag, "left_anti")
        df = hit.df.unionByName(rest, allowMissingColumns=True).drop(tag)
        return Rel(df, a.maybe | {v for v in hit.vars if v not in a.vars and v != tag}, hit.forms, hit.iso)

    def _minus(self, m: ir.Minus) -> Rel:
        """Without rows of the left that agree with some row of the right in a variable bound on both sides."""
        a, b = self.lower(m.left), self.lower(m.right)
        shared = [v for v in a.vars if v in b.vars]
        if not shared:
            return a
        b2, ren = self._apart(b, shared)
        loose = [v for v in shared if v in a.maybe or v in b.maybe]
        right = b2.df.select(*ren.values()).distinct()
        if not loose:
            df = a.df.join(right, [F.col(v) == F.col(ren[v]) for v in shared], "left_anti")
            return Rel(df, a.maybe, a.forms, a.iso)
        return Rel(self._agreeing(a.df, right, shared, loose, ren, True, True), a.maybe, a.forms, a.iso)

    @staticmethod
    def _agreeing(a: DataFrame, right: DataFrame, shared, loose, ren, common: bool, negated: bool) -> DataFrame:
        """Rows of a that agree (or do not: negated) with some row of right wherever both have a value.

        common: they must share a value. Every set of variables that miss on a side gets an
        equi-join of its own, so that there is no join by a condition with OR.
        """
        flags, out = [], []
        right = right.select(*ren.values()).distinct()
        for left in itertools.product((True, False), repeat=len(loose)):
            x = a.where(reduce(lambda p, q: p & q, [F.col(v).isNotNull() if has else F.col(v).isNull() for v, has in zip(loose, left)]))
            flags = []
            for there in itertools.product((True, False), repeat=len(loose)):
                y = right.where(reduce(lambda p, q: p & q, [F.col(ren[v]).isNotNull() if has else F.col(ren[v]).isNull() for v, has in zip(loose, there)]))
                both = [v for v in shared if v not in loose] + [v for v, p, q in zip(loose, left, there) if p and q]
                flag = f"__f{len(flags)}"
                if both:
                    keys = y.select(*[ren[v] for v in both]).distinct().withColumn(flag, F.lit(True))
                    x = x.join(keys, [F.col(v) == F.col(ren[v]) for v in both], "left").drop(*[ren[v] for v in both])
                elif not common:  # nothing to agree on: any row does
                    x = x.crossJoin(F.broadcast(y.limit(1).agg(F.when(F.count("*") > 0, True).alias(flag))))
                else:
                    continue
                flags.append(flag)
            found = reduce(lambda p, q: p | q, [F.col(f).isNotNull() for f in flags]) if flags else F.lit(False)
            out.append(x.where(~found if negated else found).select(*a.columns))
        return reduce(lambda p, q: p.unionByName(q), out)

    # --- unary -----------------------------------------------------------------

    def _has_exists(self, e) -> bool:
        return isinstance(e, ir.Exists) or isinstance(e, ir.Call) and any(self._has_exists(x) for x in e.args)

    def _filter(self, f: ir.Filter) -> Rel:
        return self._filtered(self.lower(f.op), f.tests)

    def _filtered(self, rel: Rel, tests) -> Rel:
        for t in tests:
            if isinstance(t, ir.Call) and t.name == "&&":
                rel = self._filtered(rel, t.args)
            elif isinstance(t, ir.Call) and t.name == "!" and isinstance(t.args[0], ir.Exists):
                rel = self._existing(rel, ir.Exists(t.args[0].op, not t.args[0].negated))
            elif isinstance(t, ir.Exists):
                rel = self._existing(rel, t)
            else:
                rel, t = self._marked(rel, t)
                rel = Rel(rel.df.where(self.value(t, rel).bool), rel.maybe, rel.forms, rel.iso)
        return rel

    def _existing(self, rel: Rel, e: ir.Exists) -> Rel:
        b = self.lower(e.op)
        shared = [v for v in rel.vars if v in b.vars]
        b2, ren = self._apart(b, shared)
        loose = [v for v in shared if v in rel.maybe or v in b.maybe] if self.semantics.unbound else []
        if loose:
            return Rel(self._agreeing(rel.df, b2.df, shared, loose, ren, False, e.negated), rel.maybe, rel.forms, rel.iso)
        on = [F.col(v) == F.col(ren[v]) for v in shared] + self._iso_tests(rel, b2)
        return Rel(rel.df.join(b2.df, on or F.lit(True), "left_anti" if e.negated else "left_semi"), rel.maybe, rel.forms, rel.iso)

    def _marked(self, rel: Rel, e):
        """EXISTS inside another expression: a joined column that says whether it holds."""
        if not self._has_exists(e):
            return rel, e
        if isinstance(e, ir.Exists):
            name = f"__x{next(self.fresh)}"
            b = self.lower(e.op)
            shared = [v for v in rel.vars if v in b.vars]
            keys = b.df.select(*shared).distinct().withColumn(name, F.lit(True)) if shared else b.df.limit(1).select(F.lit(True).alias(name))
            df = rel.df.join(keys, shared, "left") if shared else rel.df.join(keys, F.lit(True), "left")
            out = Rel(df, rel.maybe, {**rel.forms, name: "bool"}, rel.iso)
            found = ir.Call("coalesce_bool", (ir.Var(name),))
            return out, ir.Call("!", (found,)) if e.negated else found
        args = []
        for x in e.args:
            rel, x = self._marked(rel, x)
            args.append(x)
        return rel, ir.Call(e.name, tuple(args))

    def _union(self, u: ir.Union) -> Rel:
        rels = [self.lower(p) for p in u.parts]
        every = {v for r in rels for v in r.vars}
        maybe = {v for v in every if any(v in r.maybe or v not in r.vars for r in rels)}
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.df.select(*map(column, r.vars)) for r in rels])
        return Rel(df, frozenset(maybe), {k: v for r in rels for k, v in r.forms.items()})

    def _with_lookups(self, rel: Rel, e):
        """Lookups in e as joined columns."""
        if isinstance(e, ir.Lookup):
            name = f"__l{next(self.fresh)}"
            if e.predicate == "@properties":
                x = self._seen(None).where(~F.startswith("p", F.lit(M.SYS)) & (F.col("p") != M.RDF_TYPE) & ~M.kind(F.col("o")).isin(*M.NODES, "S"))
                one = x.groupBy(F.col("s").alias("__s"), "p").agg(F.min_by("o", "eid").alias("o"))
                found = one.groupBy("__s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias(name))
                df = rel.df.join(found, F.col(e.subject.name) == F.col("__s"), "left").drop("__s")
                some = F.when(F.col(e.subject.name).isNotNull(), F.coalesce(name, F.create_map().cast("map<string,string>")))
                return Rel(df.withColumn(name, some), rel.maybe, {**rel.forms, name: "map"}, rel.iso), ir.Var(name)
            x = self._seen(None).where(F.col("p") == e.predicate)
            value = F.min_by("o", "eid") if not e.many else F.transform(F.array_sort(F.collect_list(F.struct("eid", "o"))), lambda r: r["o"])
            found = x.groupBy(F.col("s").alias("__s")).agg(value.alias(name))
            df = rel.df.join(found, F.col(e.subject.name) == F.col("__s"), "left").drop("__s")
            return Rel(df, rel.maybe, {**rel.forms, name: "list"} if e.many else rel.forms, rel.iso), ir.Var(name)
        if isinstance(e, ir.Call):
            args = []
            for x in e.args:
                rel, x = self._with_lookups(rel, x)
                args.append(x)
            return rel, ir.Call(e.name, tuple(args))
        return rel, e

    def _extend(self, x: ir.Extend) -> Rel:
        rel = self.lower(x.op)
        rel, e = self._with_lookups(rel, x.value)
        rel, e = self._marked(rel, e)
        v = self.value(e, rel)
        forms = {k: f for k, f in rel.forms.items() if k != x.var} | ({x.var: v.form} if v.form in NESTED else {})
        return Rel(rel.df.withColumn(x.var, v.term), rel.maybe | {x.var}, forms, rel.iso)

    def _unnest(self, u: ir.Unnest) -> Rel:
        rel = self.lower(u.op)
        v = self.value(u.value, rel)
        return Rel(rel.df.withColumn(u.var, F.explode(v.col)), rel.maybe | {u.var}, rel.forms, rel.iso)

    def _counted(self, a: ir.Aggregate) -> Rel | None:
        """Rows of two parts counted from the rows that each has for a value they share; None where that does not do.

        Rows in which one statement stands for two relationships of a MATCH are taken off.
        """
        if not isinstance(a.op, ir.Join) or len(a.op.parts) != 2 or any(isinstance(p, ir.PathMatch) for p in a.op.parts) or not a.aggs or any(g != ir.Agg("count") for _, g in a.aggs):
            return None
        x, y = (self.lower(p) for p in a.op.parts)
        shared = [v for v in x.vars if v in y.vars]
        loose = [v for v in shared if v not in a.op.null_safe and self.semantics.unbound and (v in x.maybe or v in y.maybe)]
        pairs = [(b, c) for name in set(x.iso) & set(y.iso) for (b, p), (c, q) in itertools.product(x.iso[name], y.iso[name]) if p is None or q is None or p == q]
        if not shared or loose or len(pairs) > 1 or any(c.startswith("__pe") for pair in pairs for c in pair) or not all(k in x.vars or k in y.vars for k in a.keys):
            return None
        y, ren = self._apart(y, shared)
        on = [F.col(v).eqNullSafe(F.col(ren[v])) if v in a.op.null_safe else F.col(v) == F.col(ren[v]) for v in shared]
        n, m, total = (f"__n{next(self.fresh)}" for _ in range(3))
        mine = list(dict.fromkeys([*shared, *[k for k in a.keys if k in x.vars]]))
        theirs = list(dict.fromkeys([*ren.values(), *[k for k in a.keys if k in y.vars]]))
        both = x.df.groupBy(*map(column, mine)).agg(F.count("*").alias(n)).join(y.df.groupBy(*map(column, theirs)).agg(F.count("*").alias(m)), on)
        rows = both.select(*map(column, a.keys), (F.col(n) * F.col(m)).alias(total))
        if pairs:
            same = x.df.join(y.df, [*on, F.col(pairs[0][0]) == F.col(pairs[0][1])])
            rows = rows.unionByName(same.select(*map(column, a.keys), F.lit(-1).cast("bigint").alias(total)))
        rows = rows.groupBy(*map(column, a.keys)).agg(F.coalesce(F.sum(total), F.lit(0)).alias(total))
        rows = rows.where(F.col(total) > 0) if a.keys else rows
        maybe = (x.maybe | y.maybe) & set(a.keys)
        forms = {k: f for k, f in {**y.forms, **x.forms}.items() if k in a.keys}
        return Rel(rows.select(*map(column, a.keys), *[F.col(total).alias(name) for name, _ in a.aggs]), maybe, {**forms, **{name: "int" for name, _ in a.aggs}})

    def _aggregate(self, a: ir.Aggregate) -> Rel:
        counted = self._counted(a)
        if counted is not None:
            return counted
        rel = self.lower(a.op)
        cols, forms, rows = [], {}, rel.df
        for name, agg in a.aggs:
            c, form, added = self._agg(agg, rel)
            rows = rows.withColumns(added) if added else rows
            cols.append(c.alias(name))
            if form != "term":
                forms[name] = form
        df = rows.groupBy(*a.keys).agg(*cols) if cols else rows.select(*a.keys).distinct()
        return Rel(df, (rel.maybe & set(a.keys)) | {n for n, g in a.aggs if g.name != "count"}, {**{k: f for k, f in rel.forms.items() if k in a.keys}, **forms})

    def _sum(self, v: V, distinct: bool) -> Column:
        """The sum as a term: an integer, exactly, if all are; Cypher's must fit 64 bits."""
        n, exact, whole = v.number, v.exact, v.is_whole
        if distinct:  # by value: 1 and 1.0 are one
            exact = F.coalesce(exact, F.when((n == F.floor(n)) & (F.abs(n) < 2.0**53), n.try_cast("bigint")))
        add = F.sum_distinct if distinct else F.sum
        total = add(exact.cast("decimal(20,0)"))
        rest = add(F.when(exact.isNull(), n))
        if self.language == "cypher":
            total = F.when(F.abs(total) > (1 << 63) - 1, F.raise_error(F.lit("integer overflow")).cast("decimal(30,0)")).otherwise(total)
        mixed = F.count(F.when(n.isNotNull() & ~whole, 1)) > 0
        return F.when(mixed, M.double(F.coalesce(total.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0)))).otherwise(M.integer(total))

    def _agg(self, g: ir.Agg, rel: Rel) -> tuple[Column, str, dict]:
        """The aggregate, its form, and columns that have to be added for it."""
        if g.value is None:
            if g.distinct:
                raise InvalidQuery("COUNT(DISTINCT *) is refused")
            return F.count("*"), "int", {}
        v = self.value(g.value, rel)
        name = g.name.lower()
        if name == "count":
            once = M.group_key(v.term) if self.language == "cypher" else v.term
            return (F.count_distinct(once) if g.distinct else F.count(v.term)), "int", {}
        if name == "sum":
            return self._sum(v, g.distinct), "term", {}
        if name in ("min", "max"):
            pick = F.min_by if name == "min" else F.max_by
            return pick(v.term, M.sort_key(v.term, self.order)), "term", {}
        if name == "sample":
            return F.min(v.term), "term", {}
        if name == "group_concat":
            if g.distinct and g.extra is not None:
                raise InvalidQuery("GROUP_CONCAT(DISTINCT with a separator) is refused")
            return F.array_join(F.array_sort(F.collect_set(v.text) if g.distinct else F.collect_list(v.text)), g.extra if g.extra is not None else " "), "text", {}
        if name == "collect":
            if g.distinct:  # one term for each value
                once = F.collect_set(F.struct(M.group_key(v.term).alias("k"), v.term.alias("t")))
                first = F.aggregate(F.array_sort(once), F.array().cast("array<struct<k:string,t:string>>"), lambda acc, x: F.when(F.try_element_at(acc, F.lit(-1))["k"] == x["k"], acc).otherwise(F.concat(acc, F.array(x))))
                return F.array_sort(F.transform(first, lambda x: x["t"])), "list", {}
            return F.array_sort(F.collect_list(v.term)), "list", {}
        # of numbers; DISTINCT is by value
        x = f"__n{next(self.fresh)}"
        once = "DISTINCT " if g.distinct else ""
        share = float(g.extra) if name.startswith("percentile") else 0.0
        text = {
            "avg": f"avg({once}{x})", "stdevp": f"stddev_pop({once}{x})",
            "stdev": f"CASE WHEN count({x}) > 0 THEN coalesce(stddev_samp({once}{x}), 0D) END",
            "percentilecont": f"percentile({once}{x}, {share}D)",
            "percentiledisc": f"percentile_disc({share}D) WITHIN GROUP (ORDER BY {x})",
        }.get(name)
        if text is None:
            raise InvalidQuery(f"unknown aggregate {g.name}")
        if name == "percentiledisc" and g.distinct:
            order = F.array_sort(F.collect_set(x))
            return F.try_element_at(order, F.greatest(F.ceil(F.lit(share) * F.size(order)), F.lit(1)).cast("int")), "number", {x: v.number}
        return F.expr(text), "number", {x: v.number}

    def _project(self, p: ir.Project) -> Rel:
        rel = self.lower(self._by_ends(p.op, p.vars) if p.distinct else p.op)
        cols = [column(v) if v in rel.df.columns else F.lit(None).cast("string").alias(v) for v in p.vars]
        df = rel.df.select(*cols)
        df = df.distinct() if p.distinct else df
        return Rel(df, frozenset(v for v in p.vars if v in rel.maybe or v not in rel.df.columns), {k: f for k, f in rel.forms.items() if k in p.vars})

    def _orders(self, rel: Rel, keys) -> list[Column]:
        out = []
        for e, down in keys:
            k = self.value(e, rel).sort(self.order)
            first = self.semantics.nulls_first != down
            out.append((k.desc_nulls_first() if first else k.desc_nulls_last()) if down else (k.asc_nulls_first() if first else k.asc_nulls_last()))
        return out

    def _orderlimit(self, o: ir.OrderLimit) -> Rel:
        rel = self.lower(o.op)
        df = rel.df.orderBy(*self._orders(rel, o.keys)) if o.keys else rel.df
        df = df.offset(o.offset) if o.offset else df
        df = df.limit(o.limit) if o.limit is not None else df
        return Rel(df, rel.maybe, rel.forms, rel.iso)

    def _rownumber(self, r: ir.RowNumber) -> Rel:
        rel = self.lower(r.op)
        w = Window.partitionBy(*r.partition).orderBy(*self._orders(rel, r.keys))
        return Rel(rel.df.withColumn(r.var, F.row_number().over(w)), rel.maybe, {**rel.forms, r.var: "int"}, rel.iso)

    # --- expressions -------------------------------------------------------------

    def value(self, e, rel: Rel, bound: dict | None = None) -> V:
        bound = bound or {}
        if isinstance(e, ir.Var):
            if e.name in bound:
                return bound[e.name]
            if rel.df is not None and e.name not in rel.df.columns:
                return constant(None)
            form = rel.forms.get(e.name, "term")
            if form == "int":
                return integer(column(e.name))
            return V(column(e.name).cast("double"), "number", F.lit(False)) if form == "number" else V(column(e.name), form)
        if isinstance(e, ir.Const):
            if isinstance(e.value, tuple):
                return V(F.array(*[constant(x).term for x in e.value]) if e.value else F.array().cast("array<string>"), "list")
            return constant(e.value)
        if isinstance(e, ir.Each):
            return self._each(e, rel, bound)
        if not isinstance(e, ir.Call):
            raise InvalidQuery(f"no expression: {e!r}")
        a = [self.value(x, rel, bound) for x in e.args]
        n = e.name
        if n in TESTS:
            return ordered(a[0], a[1], TESTS[n])
        if n in ("=", "!="):
            t = equal(a[0], a[1])
            return t if n == "=" else boolean(~t.col)
        if n in ("+", "-", "*", "/"):
            if len(a) == 1:
                return strict("-", integer(F.lit(0)), a[0]) if self.language == "cypher" else number(-a[0].number, a[0].is_whole, F.try_subtract(F.lit(0).cast("bigint"), a[0].exact))
            if n == "+" and self.language == "cypher":
                if "list" in (a[0].form, a[1].form):
                    as_list = [x.col if x.form == "list" else F.array(x.term) for x in a]
                    return V(F.concat(*as_list), "list")
                if "text" in (a[0].form, a[1].form):
                    return V(F.coalesce(M.string(F.concat(a[0].text, a[1].text))))
                if a[0].form == a[1].form == "number":
                    return strict("+", a[0], a[1])
                both = a[0].number + a[1].number
                return V(F.when(both.isNotNull(), strict("+", a[0], a[1]).term).otherwise(M.string(F.concat(a[0].text, a[1].text))))
            return (strict if self.language == "cypher" else arithmetic)(n, a[0], a[1])
        if n == "%":
            if self.language == "cypher":
                return strict("%", a[0], a[1])
            return number(F.try_mod(a[0].number, a[1].number), a[0].is_whole & a[1].is_whole, F.try_mod(a[0].exact, a[1].exact))
        if n == "^":
            return number(F.pow(a[0].number, a[1].number))
        if n == "&&":
            return boolean(reduce(lambda x, y: x & y, [x.bool for x in a]))
        if n == "||":
            return boolean(reduce(lambda x, y: x | y, [x.bool for x in a]))
        if n == "xor":
            return boolean((a[0].bool & ~a[1].bool) | (~a[0].bool & a[1].bool))
        if n == "!":
            return boolean(~a[0].bool)
        if n == "isnull":
            return boolean(a[0].term.isNull())
        if n == "coalesce_bool":
            return boolean(F.coalesce(a[0].col, F.lit(False)))
        if n == "in":
            if len(a) == 2 and a[1].form == "list":
                return boolean(F.exists(a[1].col, lambda x: equal(V(x), a[0]).col))
            return boolean(reduce(lambda x, y: x | y, [equal(a[0], x).col for x in a[1:]]))
        if n == "list":
            return V(F.array(*[x.term for x in a]) if a else F.array().cast("array<string>"), "list")
        if n == "map":
            if any(x.form in NESTED for x in a[1::2]):
                raise Unsupported("maps of lists or maps")
            pairs = [y for k, x in zip(e.args[::2], a[1::2]) for y in (F.lit(k.value[2:]), x.term)]
            return V(F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"), "map")
        if n == "merged":
            return V(reduce(lambda x, y: F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y), [x.col for x in a]), "map")
        if n == "member":  # m.key of a map, else a component of a date or time
            key = e.args[1].value[2:]
            if a[0].form == "map":
                return V(F.try_element_at(a[0].col, F.lit(key)))
            return cypher_functions.call(key, a[:1])
        if n == "path":  # a node, then either a relationship and a node, or a walk from the last node on
            out = F.array(a[0].term)
            rest = a[1:]
            while rest:
                if rest[0].form == "path":
                    out, rest = F.concat(out, F.slice(rest[0].col, F.lit(2), F.size(rest[0].col))), rest[1:]
                else:
                    out, rest = F.concat(out, F.array(rest[0].term, rest[1].term)), rest[2:]
            return V(F.when(reduce(lambda x, y: x & y, [x.term.isNotNull() for x in a]), out), "path")
        if n == "index" and a[0].form == "map":
            return V(F.try_element_at(a[0].col, a[1].text))
        if n == "index":
            i = a[1].number.cast("int")
            return V(F.try_element_at(a[0].col, F.when(i >= 0, i + 1).otherwise(i)))
        if n == "slice":
            lo, hi = a[1].number.cast("int"), a[2].number.cast("int")
            return V(F.slice(a[0].col, lo + 1, F.greatest(F.least(hi, F.size(a[0].col)) - lo, F.lit(0))), "list")
        if n == "case":
            out = F.when(a[0].bool, a[1].term)
            for t, x in zip(a[2:-1:2], a[3:-1:2]):
                out = out.when(t.bool, x.term)
            return V(out.otherwise(a[-1].term))
        if n in ("starts with", "ends with", "contains") and self.language == "cypher":
            return boolean({"starts with": F.startswith, "ends with": F.endswith, "contains": F.contains}[n](a[0].text, a[1].text))
        if n == "=~":
            return boolean(F.rlike(a[0].text, F.concat(F.lit("^(?:"), a[1].text, F.lit(")$"))))
        if n in self.extra:
            return self.extra[n](a)
        return (cypher_functions if self.language == "cypher" else sparql_functions).call(n, a)

    def _each(self, e: ir.Each, rel: Rel, bound: dict) -> V:
        src = self.value(e.source, rel, bound).col
        inner = lambda x: self.value(e.body, rel, {**bound, e.var: V(x)})
        if e.kind == "map":
            return V(F.transform(src, lambda x: inner(x).term), "list")
        if e.kind == "filter":
            return V(F.filter(src, lambda x: inner(x).bool), "list")
        if e.kind == "all":
            return boolean(F.forall(src, lambda x: inner(x).bool))
        if e.kind == "any":
            return boolean(F.exists(src, lambda x: inner(x).bool))
        if e.kind == "none":
            return boolean(~F.exists(src, lambda x: inner(x).bool))
        if e.kind == "single":
            return boolean(F.size(F.filter(src, lambda x: inner(x).bool)) == 1)
        start = self.value(e.start, rel, bound).term
        return V(F.aggregate(src, start, lambda acc, x: self.value(e.body, rel, {**bound, e.total: V(acc), e.var: V(x)}).term))
