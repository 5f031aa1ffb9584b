"""Datalog with stratified negation, aggregates over valid time, and metric temporal operators.

    reach(X, Y) :- edge(X, Y).
    reach(X, Z) :- reach(X, Y), edge(Y, Z).
    low(X) :- size(X, N), N < 5, not big(X).
    total(X, sum<N>) :- order(X, N).
    recent(X) :- past[0, 10] seen(X).
    until[0, 5](a(X), b(X))  and since[..](..)  as body atoms
    always_future[0, 7] open(X) :- shipped(X).   holds at all instants up to 7 after
    @prefix ex: <http://example.org/>.           before rules

Predicates of one or two terms that no rule defines are read from the store: ``p(S, O)`` are
the statements of p, ``p(S)`` the subjects of that rdf:type; ``p(S, O) @ E`` binds the eid.
Every fact has a valid time; atoms join where their times meet. A stratum is a loop of
DataFrame jobs over the facts that the round before found (semi-naive).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery, LimitExceeded, UnsafeRule, Unstratified
from ..functions.values import V, arithmetic, constant, equal, ordered
from ..operators import intervals, temporal
from .settle import Layers, numbered, parts, settled, spread

TOKEN = re.compile(r"""\s*(?:%[^\n]*\s*)*(?:(?P<string>"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w:]*)|(?P<op>:-|<=|>=|!=|[()\[\],.<>=+\-*/%@!?]))""")
AGGREGATES = ("count", "sum", "min", "max")
METRIC = ("past", "always_past", "future", "always_future")
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
LIMIT = 100_000
#: Tests of two values; the thirteen relations and intersects take intervals as valid(E, I) gives them.
BUILTINS = ("contains", "starts_with", "intersects", *temporal.ALLEN)
FUNCTIONS = ("concat", "lower", "upper", "strlen", "start", "end", "duration", "interval", "tx_instant", "now")
PREFIX = re.compile(r"@prefix\s+(\w*):\s*<([^>]*)>\s*\.")
#: What a head's operator says of its body: where facts have to be for it to hold.
DILATED = {"always_past": "future", "always_future": "past"}


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """A function or arithmetic of terms: + - * / % concat lower upper strlen."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple
    negated: bool = False
    eid: Var | None = None
    wrap: tuple = ()  #: (operator, low, high) from the outside in


@dataclass(frozen=True)
class Both:
    """since or until of two atoms."""

    kind: str
    low: int
    high: int
    left: Atom
    right: Atom


@dataclass(frozen=True)
class Test:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple
    aggs: tuple = ()  #: (place, function) of the head's aggregates
    invented: tuple = ()  #: head variables that the body does not bind, made from the others


class Parser:
    def __init__(self, text: str, prefixes: dict | None = None):
        self.tokens, at = [], 0
        self.prefixes = {**(prefixes or {}), **dict(PREFIX.findall(text))}
        text = PREFIX.sub(" ", text).rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise InvalidQuery(f"cannot read {text[at:at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                t = m[m.lastgroup]
                if m.lastgroup == "name" and ":" in t and t.split(":", 1)[0] in self.prefixes:
                    t = self.prefixes[t.split(":", 1)[0]] + t.split(":", 1)[1]
                self.tokens.append((m.lastgroup, t))
        self.at = 0

    def sees(self, t: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] == t

    def word(self, t: str) -> bool:
        if self.sees(t):
            self.at += 1
            return True
        return False

    def need(self, t: str) -> None:
        if not self.word(t):
            raise InvalidQuery(f"{t} expected at {self.tokens[self.at : self.at + 3]}")

    def program(self) -> list[Rule]:
        out = []
        while self.at < len(self.tokens):
            head, aggs = self.head()
            body = []
            if self.word(":-"):
                while True:
                    body.append(self.literal())
                    if not self.word(","):
                        break
            self.need(".")
            out.append(Rule(head, tuple(body), tuple(aggs)))
        return out

    def head(self):
        wrap = []
        while self.tokens[self.at][1] in DILATED and self.tokens[self.at + 1][1] == "[":
            self.at += 1
            wrap.append((self.tokens[self.at - 1][1], *self.bounds()))
        name = self.tokens[self.at][1]
        self.at += 1
        args, aggs = [], []
        self.need("(")
        while not self.word(")"):
            k, t = self.tokens[self.at]
            if k == "name" and t in AGGREGATES and self.tokens[self.at + 1][1] == "<":
                self.at += 2
                aggs.append((len(args), t))
                args.append(self.term())
                self.need(">")
            else:
                args.append(self.sum())
            self.word(",")
        return Atom(name, tuple(args), wrap=tuple(wrap)), aggs

    def bounds(self) -> tuple[int, int]:
        self.need("[")
        lo = int(self.tokens[self.at][1])
        self.at += 1
        self.need(",")
        hi = int(self.tokens[self.at][1])
        self.at += 1
        self.need("]")
        return lo, hi

    def literal(self):
        k, t = self.tokens[self.at]
        nxt = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else ""
        if t in ("since", "until") and nxt == "[":
            self.at += 1
            lo, hi = self.bounds()
            self.need("(")
            a = self.atom()
            self.need(",")
            b = self.atom()
            self.need(")")
            return Both(t, lo, hi, a, b)
        if t == "not":
            self.at += 1
            a = self.atom()
            return Atom(a.name, a.args, True, a.eid, a.wrap)
        if k == "name" and nxt == "(" and t in BUILTINS:
            self.at += 2
            a = self.sum()
            self.need(",")
            b = self.sum()
            self.need(")")
            return Test(t, a, b)
        if t in METRIC and nxt == "[" or k == "name" and nxt == "(" and not t[0].isupper() and t not in FUNCTIONS:
            return self.atom()
        a = self.sum()
        op = self.tokens[self.at][1]
        self.at += 1
        if op not in COMPARE and op not in ("=", "!="):
            raise InvalidQuery(f"no comparison: {op!r}")
        return Test(op, a, self.sum())

    def atom(self) -> Atom:
        wrap = []
        while self.tokens[self.at][1] in METRIC:
            name = self.tokens[self.at][1]
            self.at += 1
            wrap.append((name, *self.bounds()))
        name = self.tokens[self.at][1]
        self.at += 1
        args = []
        self.need("(")
        while not self.word(")"):
            args.append(self.sum())
            self.word(",")
        eid = self.term() if self.word("@") else None
        return Atom(name, tuple(args), False, eid, tuple(wrap))

    def sum(self):
        a = self.product()
        while self.sees("+") or self.sees("-"):
            op = self.tokens[self.at][1]
            self.at += 1
            a = Term(op, (a, self.product()))
        return a

    def product(self):
        a = self.term()
        while self.sees("*") or self.sees("/") or self.sees("%"):
            op = self.tokens[self.at][1]
            self.at += 1
            a = Term(op, (a, self.term()))
        return a

    def term(self):
        k, t = self.tokens[self.at]
        self.at += 1
        if t == "(":
            x = self.sum()
            self.need(")")
            return x
        if k == "string":
            return f"s:{t[1:-1]}"
        if k == "number":
            return f"i:{t}" if "." not in t else f"d:{float(t)!r}"
        if k == "name" and self.sees("("):
            self.at += 1
            args = []
            while not self.word(")"):
                args.append(self.sum())
                self.word(",")
            return Term(t, tuple(args))
        if k == "name" and (t[0].isupper() or t[0] == "_"):
            return Var(t if t != "_" else f"_{self.at}")
        if k == "name":
            return f"I:{t}"
        raise InvalidQuery(f"no term: {t!r}")


def variables(x) -> set[str]:
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Term):
        return set().union(*[variables(a) for a in x.args])
    if isinstance(x, Atom):
        return set().union(set(), *[variables(a) for a in x.args]) | (variables(x.eid) if x.eid else set())
    if isinstance(x, Test):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Both):
        return variables(x.left) | variables(x.right)
    return set()


def atoms(rule: Rule):
    for b in rule.body:
        if isinstance(b, Atom):
            yield b, b.negated
        elif isinstance(b, Both):
            yield b.left, False
            yield b.right, False


def checked(rules: list[Rule]) -> list[Rule]:
    """Rules in which every variable of a test or negation is bound; heads may invent values."""
    out = []
    for r in rules:
        bound = set().union(set(), *[variables(b) for b in r.body if isinstance(b, Both) or isinstance(b, Atom) and not b.negated])
        for b in r.body:
            if isinstance(b, Test) and b.op == "=" and isinstance(b.left, Var) and variables(b.right) <= bound:
                bound |= variables(b.left)
        for b in r.body:
            if (isinstance(b, Test) or isinstance(b, Atom) and b.negated) and any(not v.startswith("_") for v in variables(b) - bound):
                raise UnsafeRule(f"{r.head.name}: {sorted(variables(b) - bound)} are not bound")
        free = set().union(set(), *[variables(a) for a in r.head.args]) - bound
        if free and any(not isinstance(a, Var) for a in r.head.args if variables(a) & free):
            raise UnsafeRule(f"{r.head.name}: {sorted(free)} are not bound")
        out.append(Rule(r.head, r.body, r.aggs, tuple(sorted(free))))
    return out


def strata(rules: list[Rule]) -> list[set[str]]:
    """Predicates in the order of evaluation."""
    level = {r.head.name: 0 for r in rules}
    for _ in range(len(level) + 1):
        moved = False
        for r in rules:
            for a, negated in atoms(r):
                if a.name in level:
                    need = level[a.name] + (1 if negated or r.aggs else 0)
                    if level[r.head.name] < need:
                        level[r.head.name], moved = need, True
        if not moved:
            return [{p for p, n in level.items() if n == k} for k in range(max(level.values(), default=-1) + 1)]
    raise Unstratified("negation or aggregation through recursion")


@dataclass
class Program:
    """rules over a store; time: whether facts have valid times (else all hold always)."""

    rules: list[Rule]
    statements: DataFrame
    view: M.View = M.NOW
    time: bool = False
    facts: dict = field(default_factory=dict)
    rounds: int = 0
    complete: bool = True  #: whether the rules came to rest within the rounds allowed
    found: list = field(default_factory=list)  #: (predicate, facts) as rounds found them
    bases: dict = field(default_factory=dict)  #: relations of the store that rounds read again and again
    groups: dict = field(default_factory=dict)  #: predicate -> the groups of which all its statements are known to consist
    members: dict = field(default_factory=dict)  #: those groups' members, settled

    @cached_property
    def tasks(self) -> int:
        """The least tasks of a settled frame with time, as many as the store needs: files behind settled frames are no longer seen."""
        return parts(self.statements) if self.time else 0

    # A relation is a frame (a0 .. an, f, t) with term keys and closed-open bounds; without time f and t are absent.

    @staticmethod
    def span() -> Column:
        return F.concat(F.lit("x:interval|"), F.coalesce(F.col("v_from").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("v_to").cast("string"), F.lit("")))

    def spans(self, r: Rule) -> tuple[dict[int, list[str]], set[int]]:
        """The interval variables that atoms of the store give themselves, by their places, and the places of the valid atoms that need no join.

        valid(E, I) of an atom's own statement E is a column of that statement, which its eid identifies.
        """
        given, done = {}, set()
        if self.time:
            return given, done
        heads = {x.head.name for x in self.rules}
        stored = lambda b: isinstance(b, Atom) and not b.negated and not b.wrap and b.name not in heads and b.name not in self.facts
        for i, v in enumerate(r.body):
            if not (stored(v) and v.name == "valid" and len(v.args) == 2 and v.eid is None and all(isinstance(x, Var) for x in v.args)):
                continue
            e, span = (x.name for x in v.args)
            hosts = [k for k, b in enumerate(r.body) if stored(b) and b.name not in ("valid", "added") and b.eid is not None and b.eid.name == e and span not in variables(b) and e not in {x.name for x in b.args if isinstance(x, Var)} and (b.name, len(b.args), False) not in self.bases]
            if hosts:
                given.setdefault(hosts[0], [])
                given[hosts[0]] += [span] if span not in given[hosts[0]] else []
                done.add(i)
        return given, done

    def base(self, a: Atom, spans: bool = False) -> DataFrame:
        x = M.seen(self.statements, self.view)
        if a.name in ("valid", "added") and len(a.args) == 2:
            value = self.span() if a.name == "valid" else F.concat(F.lit("T:"), F.col("t_add").cast("string"))
            x = x.select(M.statement_ref("eid").alias("a0"), value.alias("a1"), *([temporal.begin(F.col("v_from")).alias("f"), temporal.end(F.col("v_to")).alias("t")] if self.time else []))
            return x
        x = x.where(F.col("p") == M.RDF_TYPE).where(F.col("o") == f"I:{a.name}") if len(a.args) == 1 else x.where(F.col("p") == a.name)
        cols = [F.col("s").alias("a0")] + ([F.col("o").alias("a1")] if len(a.args) == 2 else [])
        if a.eid is not None:
            cols.append(M.statement_ref("eid").alias("e"))
        if spans:
            cols += [self.span().alias("span"), F.col("v_from"), F.col("v_to")]
        return x.select(*cols, temporal.begin(F.col("v_from")).alias("f"), temporal.end(F.col("v_to")).alias("t")) if self.time else x.select(*cols)

    def relation(self, a: Atom, delta: dict | None = None, spans: tuple | list = ()) -> DataFrame:
        """The rows of an atom with a column a variable, and f and t. spans: variables of its statement's valid interval, each with its bounds."""
        if delta is not None and a.name in delta:
            rel = delta[a.name]
        elif a.name in self.facts:
            rel = self.facts[a.name]
        elif a.name in {r.head.name for r in self.rules}:
            return None
        else:
            rel = self.bases.get((a.name, len(a.args), a.eid is None))
            rel = self.base(a, bool(spans)) if rel is None or spans else rel
        seen: dict[str, str] = {}
        for i, x in enumerate(a.args):
            c = f"a{i}"
            if isinstance(x, Var):
                if x.name in seen:
                    rel = rel.where(F.col(c) == F.col(seen[x.name]))
                else:
                    seen[x.name] = c
            else:
                rel = rel.where(F.col(c) == self.value(x, None).term)
        cols = [F.col(c).alias(n) for n, c in seen.items()] + ([F.col("e").alias(a.eid.name)] if a.eid else [])
        for v in spans:
            cols += [F.col("span").alias(v), F.col("v_from").alias(f"__from_{v}"), F.col("v_to").alias(f"__to_{v}")]
        keys = list(seen) + ([a.eid.name] if a.eid else [])
        rel = rel.select(*cols, *(["f", "t"] if self.time else []))
        for op, lo, hi in reversed(a.wrap):
            if not self.time:
                raise InvalidQuery("metric operators need valid time")
            rel = self.opened(intervals.metric(rel.withColumnsRenamed({"f": "v_from", "t": "v_to"}), keys, op, lo, hi))
        return rel

    @staticmethod
    def opened(df: DataFrame) -> DataFrame:
        keys = [c for c in df.columns if c not in ("v_from", "v_to")]
        return df.select(*keys, temporal.begin(F.col("v_from")).alias("f"), temporal.end(F.col("v_to")).alias("t"))

    def value(self, x, row) -> V:
        if isinstance(x, Var):
            return V(F.col(x.name))
        if isinstance(x, Term):
            a = [self.value(y, row) for y in x.args]
            if x.name in "+-*/":
                return arithmetic(x.name, a[0], a[1])
            if x.name == "%":
                return V(M.integer(F.try_mod(a[0].number, a[1].number).cast("bigint")))
            if x.name in ("start", "end", "duration"):
                f, t = bounds(a[0].term)
                return V(M.integer({"start": f, "end": t, "duration": t - f}[x.name]))
            if x.name == "interval":
                return V(F.concat(F.lit("x:interval|"), F.coalesce(a[0].exact.cast("string"), F.lit("")), F.lit("/"), F.coalesce(a[1].exact.cast("string"), F.lit(""))))
            if x.name == "tx_instant":
                t = M.body(a[0].term).try_cast("bigint")
                return V(M.integer(t))
            if x.name == "now":
                return V(M.integer(F.unix_millis(F.current_timestamp())))
            if x.name == "strlen":
                return V(M.integer(F.length(a[0].text)))
            text = {"concat": lambda: F.concat(*[y.text for y in a]), "lower": lambda: F.lower(a[0].text), "upper": lambda: F.upper(a[0].text)}
            if x.name not in text:
                raise InvalidQuery(f"unknown function {x.name}")
            return V(M.string(text[x.name]()))
        return constant(x)

    def joined(self, a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns and c not in ("f", "t")]
        if self.time:
            b = b.withColumnsRenamed({"f": "f2", "t": "t2"})
        j = a.join(b, shared) if shared else a.crossJoin(b)
        if self.time:
            keep = [c for c in j.columns if c not in ("f", "t", "f2", "t2")]
            j = j.select(*keep, F.greatest("f", "f2").alias("f"), F.least("t", "t2").alias("t")).where("f < t")
        return j

    def without(self, a: DataFrame, atom: Atom) -> DataFrame:
        """Rows of a where and when an atom does not hold."""
        b = self.relation(Atom(atom.name, atom.args, False, atom.eid, atom.wrap))
        if b is None:
            return a
        shared = [c for c in a.columns if c in b.columns and c not in ("f", "t")]
        if not self.time:
            return a.join(b.select(*shared).distinct(), shared, "left_anti") if shared else a.join(b.select(F.lit(1).alias("__b")).limit(1), F.lit(True), "left_anti")
        gone = b.groupBy(*shared).agg(F.collect_list(F.struct("f", "t")).alias("gone"))
        j = a.join(gone, shared, "left") if shared else a.join(gone, F.lit(True), "left")
        here = F.array(F.struct("f", "t"))
        left = F.when(F.col("gone").isNull(), here).otherwise(intervals.subtract(here, F.col("gone")))
        keep = [c for c in a.columns if c not in ("f", "t")]
        return j.select(*keep, F.explode(left).alias("i")).select(*keep, "i.f", "i.t")

    def body(self, r: Rule, delta: dict | None = None, at: int | None = None) -> DataFrame | None:
        """The rows of a rule's body; the atom at place ``at`` reads the delta."""
        out, tests, nots = None, [], []
        given, done = self.spans(r)
        rest = sorted((i for i in range(len(r.body)) if i not in done), key=lambda i: i != at)
        while rest:  # the delta first, then what shares a variable with the rows so far
            i = next((i for i in rest if out is not None and not isinstance(r.body[i], Test) and variables(r.body[i]) & set(out.columns)), rest[0])
            rest.remove(i)
            b = r.body[i]
            if isinstance(b, Test):
                tests.append(b)
                continue
            if isinstance(b, Atom) and b.negated:
                nots.append(b)
                continue
            if out is not None and i != at and self.hops(b) and variables(b) & set(out.columns):
                used = variables(r.head).union(*[variables(x) for j, x in enumerate(r.body) if j in rest or isinstance(x, Test) or isinstance(x, Atom) and x.negated])
                out = self.hop(out, b, used if not r.aggs else set(out.columns))
                continue
            rel = self.both(b) if isinstance(b, Both) else self.relation(b, delta if i == at else None, given.get(i, ()))
            if rel is None:
                return None
            rel = rel.drop(*[c for c in rel.columns if out is not None and c.startswith(("__from_", "__to_")) and c in out.columns])
            out = rel if out is None else self.joined(out, rel)
        if out is None:
            out = self.statements.sparkSession.range(1).select(*([F.lit(M.EVER_FROM).alias("f"), F.lit(M.EVER_TO).alias("t")] if self.time else [F.lit(1).alias("__one")]))
        todo = list(tests)
        while todo:
            b = next((b for b in todo if variables(b) <= set(out.columns) or b.op == "=" and isinstance(b.left, Var) and variables(b.right) <= set(out.columns)), None)
            if b is None:
                raise UnsafeRule(f"{r.head.name}: unbound test")
            todo.remove(b)
            if b.op == "=" and isinstance(b.left, Var) and b.left.name not in out.columns:
                out = out.withColumn(b.left.name, self.value(b.right, out).term)
            elif b.op in BUILTINS:
                x, y = self.value(b.left, out), self.value(b.right, out)
                if b.op in ("contains", "starts_with"):
                    out = out.where((F.contains if b.op == "contains" else F.startswith)(x.text, y.text))
                else:
                    known = lambda z: isinstance(z, Var) and f"__from_{z.name}" in out.columns
                    ends = [c for z, v in ((b.left, x), (b.right, y)) for c in ((F.col(f"__from_{z.name}"), F.col(f"__to_{z.name}")) if known(z) else bounds(v.term))]
                    out = out.where(temporal.overlaps(*ends) if b.op == "intersects" else temporal.relate(*ends) == b.op)
            elif b.op in ("=", "!="):
                t = equal(self.value(b.left, out), self.value(b.right, out)).col
                out = out.where(t if b.op == "=" else ~t)
            else:
                out = out.where(ordered(self.value(b.left, out), self.value(b.right, out), COMPARE[b.op]).col)
        for b in nots:
            out = self.without(out, b)
        return out

    def hops(self, b) -> bool:
        """Whether an atom over two variables can be joined by its groups."""
        plain = isinstance(b, Atom) and b.name in self.groups and not (self.time or b.negated or b.wrap or b.eid) and b.name not in self.facts
        return plain and self.view == M.NOW and len(b.args) == 2 and all(isinstance(x, Var) for x in b.args) and b.args[0] != b.args[1]

    def hop(self, out: DataFrame, b: Atom, used: set) -> DataFrame:
        """out joined with an atom by its groups: where the bound end is not used again, a group counts once, from its outermost place on."""
        x, y = (v.name for v in b.args)
        back = x not in out.columns
        near, far = (y, x) if back else (x, y)
        if b.name not in self.members:
            self.members[b.name] = settled(self.groups[b.name].members.select("node", "group", "place"))
        m = self.members[b.name]
        keep = [c for c in out.columns if c in used or c == far]
        at = out.join(m.select(F.col("node").alias(near), F.col("group").alias("__g"), F.col("place").alias("__near")), near)
        if near not in keep:
            at = at.groupBy(*keep, "__g").agg((F.max if back else F.min)("__near").alias("__near"))
        on = ["__g", far] if far in out.columns else ["__g"]
        x = at.join(m.select(F.col("node").alias(far), F.col("group").alias("__g"), F.col("place").alias("__far")), on)
        return x.where("__far < __near" if back else "__far > __near").select(*dict.fromkeys([*keep, far])).distinct()

    def both(self, b: Both) -> DataFrame:
        if not self.time:
            raise InvalidQuery("since and until need valid time")
        x, y = self.relation(b.left), self.relation(b.right)
        if x is None or y is None:
            return None
        keys = [c for c in x.columns if c not in ("f", "t")]
        if set(keys) != {c for c in y.columns if c not in ("f", "t")}:
            raise InvalidQuery("since and until join atoms over the same variables")
        old = {"f": "v_from", "t": "v_to"}
        op = intervals.since if b.kind == "since" else intervals.until
        return self.opened(op(x.withColumnsRenamed(old), y.withColumnsRenamed(old), keys, b.low, b.high))

    def heads(self, r: Rule, rows: DataFrame) -> DataFrame:
        cols = []
        for i, x in enumerate(r.head.args):
            if isinstance(x, Var) and x.name in r.invented:
                frontier = sorted(set().union(set(), *[variables(a) for a in r.head.args]) - set(r.invented))
                cols.append(F.concat(F.lit("N:"), F.sha2(F.concat_ws("|", F.lit(f"{self.rules.index(r)}.{i}"), *[F.col(v) for v in frontier]), 256)).alias(f"a{i}"))
            elif any(i == k for k, _ in r.aggs):
                cols.append(self.value(x, rows).term.alias(f"a{i}"))
            else:
                cols.append(self.value(x, rows).term.alias(f"a{i}"))
        x = rows.select(*cols, *(["f", "t"] if self.time else []), *[F.col(c).alias(f"__v{j}") for j, c in enumerate(sorted(c for c in rows.columns if c not in ("f", "t")))] if r.aggs else [])
        if not r.aggs:
            return self.dilated(r, x)
        k, name = r.aggs[0]
        keys = [f"a{i}" for i in range(len(r.head.args)) if i != k]
        x = x.distinct()
        value = F.lit(1.0) if name == "count" else M.num(F.col(f"a{k}"))
        if self.time:
            s = temporal.segments(x.withColumnsRenamed({"f": "v_from", "t": "v_to"}), keys, value, name)
            out = self.opened(s.withColumn(f"a{k}", whole(F.col("value"))).drop("value"))
        else:
            agg = {"count": F.count("*").cast("double"), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[name]
            out = x.groupBy(*keys).agg(whole(agg).alias(f"a{k}")) if keys else x.agg(whole(agg).alias(f"a{k}"))
        return self.dilated(r, out.select(*[f"a{i}" for i in range(len(r.head.args))], *(["f", "t"] if self.time else [])))

    def dilated(self, r: Rule, x: DataFrame) -> DataFrame:
        """A head's always operators: the fact holds at all instants that they reach from the body's."""
        for op, lo, hi in reversed(r.head.wrap):
            if not self.time:
                raise InvalidQuery("metric operators need valid time")
            keys = [c for c in x.columns if c not in ("f", "t")]
            x = self.opened(intervals.metric(x.withColumnsRenamed({"f": "v_from", "t": "v_to"}), keys, DILATED[op], lo, hi))
        return x

    def merged(self, x: DataFrame) -> DataFrame:
        """Facts once each; with time, their maximal intervals."""
        if not self.time:
            return x.distinct()
        keys = [c for c in x.columns if c not in ("f", "t")]
        return temporal.coalesced(x.withColumnsRenamed({"f": "v_from", "t": "v_to"}), keys).select(*keys, temporal.begin(F.col("v_from")).alias("f"), temporal.end(F.col("v_to")).alias("t"))

    def fresh(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is None:
            return self.merged(new)
        new = self.merged(new)
        if not self.time:
            return new.join(old, new.columns, "left_anti")
        keys = [c for c in new.columns if c not in ("f", "t")]
        inside = old.select(*keys, F.col("f").alias("f2"), F.col("t").alias("t2"))
        a, b = new.alias("n"), inside.alias("o")
        covered = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys] + [F.col("n.f") >= F.col("o.f2"), F.col("n.t") <= F.col("o.t2")]
        return a.join(b, covered, "left_anti")

    def run(self, most: int = LIMIT, partial: bool = False) -> dict:
        """All facts of the program. Beyond ``most`` rounds it raises, or with partial stops with ``complete`` unset."""
        for layer in strata(self.rules):
            mine = [r for r in self.rules if r.head.name in layer]
            delta: dict[str, DataFrame] = {}
            for name in layer:
                parts = [self.heads(r, b) for r in mine if r.head.name == name and (b := self.body(r)) is not None]
                if parts:
                    x = parts[0]
                    for y in parts[1:]:
                        x = x.union(y)
                    delta[name] = settled(self.merged(x), self.tasks)
            self.facts.update(delta)
            self.found += delta.items()
            looping = [r for r in mine if any(a.name in layer for a, _ in atoms(r))]
            heads = {r.head.name for r in self.rules}
            for a in {(a.name, len(a.args), a.eid is None): a for r in looping for a, _ in atoms(r) if a.name not in heads and not self.hops(a)}.values():
                x = self.base(a)
                self.bases.setdefault((a.name, len(a.args), a.eid is None), settled(x if self.time or a.eid is not None else x.distinct(), self.tasks))
            layers = {name: Layers(x) for name, x in delta.items()} if not self.time else {}
            while looping and delta:
                self.rounds += 1
                if self.rounds > most and partial:
                    self.complete = False
                    return self.facts
                if self.rounds > most:
                    raise LimitExceeded("too many rounds of rules")
                found: dict[str, DataFrame] = {}
                for r in looping:
                    for i, b in enumerate(r.body):
                        if isinstance(b, Both) and {b.left.name, b.right.name} & set(delta):
                            rows = self.body(r)
                        elif isinstance(b, Atom) and not b.negated and b.name in delta:
                            rows = self.body(r, delta, i)
                        else:
                            continue
                        if rows is not None:
                            x = self.heads(r, rows)
                            found[r.head.name] = found[r.head.name].union(x) if r.head.name in found else x
                delta = {}
                for name, x in found.items():
                    new = settled(self.fresh(x, self.facts.get(name)), self.tasks)
                    if new.take(1):
                        delta[name] = new
                self.found += delta.items()
                for name, new in delta.items():
                    old = self.facts.get(name)
                    self.facts[name] = settled(self.merged(old.union(new)) if old is not None else new, self.tasks)
        return self.facts


def bounds(k):
    """The bounds of an interval term, null where it is open."""
    text = M.lex(k)
    return F.substring_index(text, "/", 1).try_cast("bigint"), F.substring_index(text, "/", -1).try_cast("bigint")


def whole(x):
    return F.when(x == F.floor(x), M.integer(x.cast("bigint"))).otherwise(M.double(x))


def demanded(rules: list[Rule], goal: Atom) -> tuple[list[Rule], Atom]:
    """A program that derives only what a goal with constants asks for (magic sets), and the goal in it.

    A predicate is copied for each set of places that are bound when it is called (name__bf), and
    a predicate of demands (demand__name__bf) holds the values it is called with, found from the
    left to the right of the bodies that call it. Programs whose goal rests on negation,
    aggregates, time or invented values stay as they are.
    """
    heads = {r.head.name for r in rules}
    ground = lambda x, bound: not isinstance(x, (Var, Term)) or variables(x) <= bound
    need, todo = set(), [goal.name]
    while todo:  # what the goal rests on
        name = todo.pop()
        if name in need or name not in heads:
            continue
        need.add(name)
        todo += [a.name for r in rules if r.head.name == name for a, _ in atoms(r)]
    mine = [r for r in rules if r.head.name in need]
    plain = all(not r.aggs and not r.invented and not r.head.wrap and not any(isinstance(b, Both) or isinstance(b, Atom) and (b.negated or b.wrap) for b in r.body) for r in mine)
    marks = lambda a, bound: "".join("b" if ground(x, bound) else "f" for x in a.args)
    first = marks(goal, set())
    if goal.name not in heads or "b" not in first or not plain:
        return rules, goal
    named = lambda name, how: f"{name}__{how}"
    chosen = lambda a, how: tuple(x for x, m in zip(a.args, how) if m == "b")
    out, done, calls, whole = [], set(), [(goal.name, first)], set()
    out.append(Rule(Atom(f"demand__{named(goal.name, first)}", chosen(goal, first)), ()))
    while calls:
        name, how = calls.pop()
        if (name, how) in done:
            continue
        done.add((name, how))
        for r in (r for r in mine if r.head.name == name):
            demand = Atom(f"demand__{named(name, how)}", chosen(r.head, how))
            bound = set().union(set(), *[variables(x) for x in demand.args if isinstance(x, Var)])
            body: list = [demand]
            rest = list(r.body)
            while rest:  # in order, but what is bound in a place comes before what is not
                b = rest.pop(next((i for i, b in enumerate(rest) if (any(variables(x) <= bound for x in (b.left, b.right)) if isinstance(b, Test) else "b" in marks(b, bound))), 0))
                if isinstance(b, Atom) and b.name in heads:
                    asked = marks(b, bound)
                    if "b" in asked:
                        calls.append((b.name, asked))
                        ask = Rule(Atom(f"demand__{named(b.name, asked)}", chosen(b, asked)), tuple(body))
                        if ask.head != demand or len(ask.body) > 1:
                            out.append(ask)
                        b = Atom(named(b.name, asked), b.args, False, b.eid)
                    else:  # called for everything: the predicate as it is
                        whole.add(b.name)
                body.append(b)
                bound |= variables(b) if not isinstance(b, Test) or b.op == "=" else set()
            out.append(Rule(Atom(named(name, how), r.head.args), tuple(body)))
    if any(isinstance(x, Term) for r in out for x in r.head.args if r.head.name.startswith("demand__")):
        return rules, goal  # demands that are computed may never come to rest
    while any(a.name in heads and a.name not in whole for r in mine if r.head.name in whole for a, _ in atoms(r)):
        whole |= {a.name for r in mine if r.head.name in whole for a, _ in atoms(r) if a.name in heads}
    return out + [r for r in mine if r.head.name in whole], Atom(named(goal.name, first), goal.args, False, goal.eid)


@dataclass
class Answer:
    """The rows of a goal, whether the rules came to rest (complete or incomplete), and the program behind them."""

    rows: DataFrame
    verdict: str
    program: Program


def answered(text: str, goal: str, statements: DataFrame, view: M.View = M.NOW, time: bool = False, magic: bool = True, most: int = LIMIT, partial: bool = False, groups: tuple = ()) -> Answer:
    parser = Parser(text)
    rules = checked(parser.program())
    g = Parser(goal, parser.prefixes).atom()
    if magic and not time:
        rules, g = demanded(rules, g)
        rules = checked(rules)
    p = Program(rules, statements, view, time, groups={g.p: g for g in groups})
    p.run(most, partial)
    x = p.relation(g)
    if x is None:
        x = statements.sparkSession.createDataFrame([], ", ".join(f"`{v}` string" for v in sorted(variables(g))) or "__none int")
    if time:
        x = x.select(*[c for c in x.columns if c not in ("f", "t")], F.when(F.col("f") > M.EVER_FROM, F.col("f")).alias("v_from"), F.when(F.col("t") < M.EVER_TO, F.col("t")).alias("v_to"))
    # derived facts are once each, and a goal over all their places tells them apart
    once = g.name in p.facts and not g.wrap and len(p.facts[g.name].columns) == len(g.args) + (2 if time else 0)
    return Answer(x if once else spread(x, *x.columns).distinct(), "complete" if p.complete else "incomplete", p)


def datalog(text: str, goal: str, statements: DataFrame, view: M.View = M.NOW, time: bool = False, magic: bool = True, groups: tuple = ()) -> DataFrame:
    """The rows of a goal atom, such as ``reach(u1, X)``: a column a variable, and v_from and v_to with time.

    groups: relations (grouped.Grouped) of which all statements of a predicate are known to consist.
    """
    return answered(text, goal, statements, view, time, magic, groups=groups).rows


def proof(text: str, fact: str, statements: DataFrame, view: M.View = M.NOW) -> dict | None:
    """One derivation of a fact without variables, or None: {fact, rule, eids, from: [derivations of its premises]}.

    A fact is derived from facts of rounds before its own, so a derivation never goes in circles.
    """
    parser = Parser(text)
    rules = checked(parser.program())
    g = Parser(fact, parser.prefixes).atom()
    if variables(g):
        raise InvalidQuery("a proof is of a fact without variables")
    p = Program(rules, statements, view)
    p.run()
    heads = {r.head.name for r in rules}
    spell = lambda a: f"{a.name}({', '.join(str(x) for x in a.args)})"

    def has(x: DataFrame, args: tuple) -> bool:
        for i, v in enumerate(args):
            x = x.where(F.col(f"a{i}") == v)
        return bool(x.take(1))

    def derive(a: Atom) -> dict | None:
        at = next((k for k, (name, x) in enumerate(p.found) if name == a.name and has(x, a.args)), None)
        if at is None:
            return None
        q = Program(rules, statements, view, bases=p.bases)
        for name, x in p.found[:at]:
            q.facts[name] = q.facts[name].unionByName(x) if name in q.facts else x
        for number, r in enumerate(rules):
            if r.head.name != a.name or r.aggs or r.invented:
                continue
            same = tuple(Test("=", h, v) for h, v in zip(r.head.args, a.args))
            rows = q.body(Rule(r.head, r.body + same))
            row = rows.limit(1).collect() if rows is not None else []
            if row:
                bound = row[0].asDict()
                made = lambda b: Atom(b.name, tuple(bound[x.name] if isinstance(x, Var) else x for x in b.args))
                premises = [made(b) for b in r.body if isinstance(b, Atom) and not b.negated]
                below = [derive(b) for b in premises if b.name in heads]
                base = [b for b in premises if b.name not in heads and b.name not in ("valid", "added")]
                eids = [_eid(statements, view, b) for b in base]
                return {"fact": spell(a), "rule": number, "eids": sorted(e for e in eids if e is not None), "from": below}
        return {"fact": spell(a), "rule": None, "eids": [], "from": []}  # an aggregate or invented value: taken as it is

    return derive(g)


def _eid(statements: DataFrame, view: M.View, a: Atom) -> int | None:
    """The smallest statement that says a fact of the store."""
    x = M.seen(statements, view).where(F.col("s") == a.args[0])
    x = x.where((F.col("p") == M.RDF_TYPE) & (F.col("o") == f"I:{a.name}")) if len(a.args) == 1 else x.where((F.col("p") == a.name) & (F.col("o") == a.args[1]))
    return x.agg(F.min("eid")).first()[0]


def with_rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the dense rank of their values, the order in which goals list results; equal values share one."""
    keys = [M.sort_key(F.col(c)).alias(f"__k{i}") for i, c in enumerate(by)]
    # 1 and 1.0 sort apart only by their text, so a rank is of the values without it
    value = [F.struct(*[F.col(f"__k{i}").getField(f) for f in ("kind", "number", "whole")], F.when(F.col(f"__k{i}").getField("number").isNull(), F.col(f"__k{i}").getField("text"))).alias(f"__v{i}") for i in range(len(by))]
    x = rows.select("*", *keys).select(*rows.columns, *value)
    names = [f"__v{i}" for i in range(len(by))]
    ranks = numbered(x.select(*names).distinct(), names, "rank").withColumnsRenamed({n: f"{n}r" for n in names})
    return x.join(ranks, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names]).select(*rows.columns, "rank")


def check(constraints: str, statements: DataFrame, view: M.View = M.NOW) -> dict[str, DataFrame]:
    """The violations of every predicate that a program of constraints defines."""
    rules = checked(Parser(constraints).program())
    return Program(rules, statements, view).run()


def materialised(text: str, name: str, predicate: str, statements: DataFrame, view: M.View = M.NOW) -> tuple[DataFrame, DataFrame]:
    """(to assert, to retract) that make the store's statements of a predicate equal to a rule's facts."""
    got = datalog(text, f"{name}(S, O)", statements, view, magic=False).select(F.col("S").alias("s"), F.lit(predicate).alias("p"), F.col("O").alias("o"))
    have = M.seen(statements, view).where(F.col("p") == predicate)
    return got.join(have, ["s", "p", "o"], "left_anti"), have.join(got, ["s", "p", "o"], "left_anti").select("eid")


def explain(text: str, goal: str | None = None) -> str:
    """A program's strata and the rules each runs, after the rewrite for a goal."""
    rules = checked(Parser(text).program())
    if goal:
        rules, _ = demanded(rules, Parser(goal).atom())
    lines = []
    for i, layer in enumerate(strata(rules)):
        for r in rules:
            if r.head.name in layer:
                loop = any(a.name in layer for a, _ in atoms(r))
                lines.append(f"stratum {i}: {r.head.name}/{len(r.head.args)} from {', '.join(sorted({a.name for a, _ in atoms(r)})) or 'facts'}{' (recursive)' if loop else ''}{' (invents ' + ', '.join(r.invented) + ')' if r.invented else ''}")
    return "\n".join(lines)
