"""Path search: regular expressions over predicates, run as frontier loops over the edges.

An expression becomes a small automaton on the driver. REACH keeps visited (start, node, state)
and expands only new ones; TRAIL and SHORTEST carry their hops. Guards raise, results are never
cut short.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery, LimitExceeded
from ..plans.settle import Layers, settled

MAX_STATES = 4096


# --- expressions -----------------------------------------------------------


@dataclass(frozen=True)
class Pred:
    name: str  #: "*" stands for any relationship, "!a|b" for any predicate but a and b

    inverse: bool = False


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    part: object
    least: int
    most: int | None


def parse_path(text: str):
    """a/b, a|b, ^a, (a), a*, a+, a?, a{m,n}; names are IRIs without "I:"."""
    tokens = re.findall(r"\{\d+(?:,\d*)?\}|[()|/^*+?]|[\w:.\-]+|\*", text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def alt():
        parts = [seq()]
        while peek() == "|":
            take()
            parts.append(seq())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def seq():
        parts = [post()]
        while peek() == "/":
            take()
            parts.append(post())
        return parts[0] if len(parts) == 1 else Seq(tuple(parts))

    def post():
        x = atom()
        while peek() and (peek() in "*+?" or peek()[0] == "{"):
            m = take()
            if m[0] == "{":
                lo, _, hi = m[1:-1].partition(",")
                x = Repeat(x, int(lo), int(hi) if hi else (int(lo) if "," not in m else None))
            else:
                x = Repeat(x, 1 if m == "+" else 0, 1 if m == "?" else None)
        return x

    def atom():
        t = take() if peek() else None
        if t == "(":
            x = alt()
            if not peek() or take() != ")":
                raise InvalidQuery(f"unclosed group in path {text!r}")
            return x
        if t == "^":
            return inverted(atom())
        if t is None or t in ")|/+?":
            raise InvalidQuery(f"bad path {text!r}")
        return Pred(t)

    out = alt()
    if peek():
        raise InvalidQuery(f"unexpected {peek()!r} in path {text!r}")
    return out


def inverted(x):
    if isinstance(x, Pred):
        return Pred(x.name, not x.inverse)
    if isinstance(x, Seq):
        return Seq(tuple(inverted(p) for p in reversed(x.parts)))
    if isinstance(x, Alt):
        return Alt(tuple(inverted(p) for p in x.parts))
    return Repeat(inverted(x.part), x.least, x.most)


@dataclass(frozen=True)
class Automaton:
    moves: tuple  #: (state, predicate, inverse, next)
    final: frozenset
    start: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, p, i, t, t in self.final) for s, p, i, t in self.moves], "state int, pred string, inverse boolean, next int, done boolean")


def compile_path(x) -> Automaton:
    """Thompson's construction, then subsets."""
    edges: list[tuple] = []  # (from, label or None, to)
    count = 0

    def new():
        nonlocal count
        count += 1
        if count > 50_000:
            raise LimitExceeded("path automaton too large")
        return count - 1

    def build(x, a, b):
        if isinstance(x, Pred):
            edges.append((a, (x.name, x.inverse), b))
        elif isinstance(x, Seq):
            for i, p in enumerate(x.parts):
                c = b if i == len(x.parts) - 1 else new()
                build(p, a, c)
                a = c
        elif isinstance(x, Alt):
            for p in x.parts:
                build(p, a, b)
        else:
            for _ in range(x.least):
                c = new()
                build(x.part, a, c)
                a = c
            if x.most is None:
                c = new()
                edges.append((a, None, c))
                build(x.part, c, c)
                edges.append((c, None, b))
            else:
                for _ in range(x.most - x.least):
                    edges.append((a, None, b))
                    c = new()
                    build(x.part, a, c)
                    a = c
                edges.append((a, None, b))

    first, last = new(), new()
    build(x, first, last)
    quiet: dict = {}
    loud: dict = {}
    for a, label, b in edges:
        (quiet if label is None else loud).setdefault(a, []).append((label, b))

    def closed(states):
        todo, seen = list(states), set(states)
        while todo:
            for _, b in quiet.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    names, moves, todo = {closed({first}): 0}, [], [closed({first})]
    while todo:
        here = todo.pop()
        by: dict = {}
        for a in here:
            for label, b in loud.get(a, []):
                by.setdefault(label, set()).add(b)
        for (p, inverse), to in sorted(by.items()):
            to = closed(to)
            if to not in names:
                if len(names) >= MAX_STATES:
                    raise LimitExceeded(f"more than {MAX_STATES} path states")
                names[to] = len(names)
                todo.append(to)
            moves.append((names[here], p, inverse, names[to]))
    return Automaton(tuple(moves), frozenset(n for s, n in names.items() if last in s))


# --- edges -----------------------------------------------------------------


def path_edges(statements: DataFrame, auto: Automaton) -> DataFrame:
    """(u, v, eid, hop, state, next, done, v_from, v_to): each edge once for every move it allows.

    The automaton is a few rows, so this join is broadcast; a wildcard matches relationships
    alone, not types, literals or the system's statements.
    """
    spark = statements.sparkSession
    named = {p for _, p, _, _ in auto.moves}
    open_ = any(p == "*" or p.startswith("!") for p in named)
    x = statements if open_ else statements.where(F.col("p").isin(*named))
    x = x.select("eid", "s", "p", "o", "v_from", "v_to")
    moves = F.broadcast(auto.frame(spark))
    wild = (F.col("pred") == "*") & (F.col("p") != M.RDF_TYPE) & ~F.col("p").startswith(M.SYS) & M.kind(F.col("o")).isin("I", "N", "_", "S")
    but = F.startswith("pred", F.lit("!")) & ~F.array_contains(F.split(F.substr("pred", F.lit(2)), "[|]"), F.col("p"))
    j = x.join(moves, (F.col("p") == F.col("pred")) | wild | but) if open_ else x.join(moves, F.col("p") == F.col("pred"))
    u, v = F.when(F.col("inverse"), F.col("o")).otherwise(F.col("s")), F.when(F.col("inverse"), F.col("s")).otherwise(F.col("o"))
    return j.select(u.alias("u"), v.alias("v"), "eid", "state", "next", "done", "v_from", "v_to")


def with_virtual(statements: DataFrame) -> DataFrame:
    """Statements, and hops from a statement to its subject, predicate and object."""
    ref = M.statement_ref("eid")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("t_ret", "v_from", "v_to")]

    def hop(p, o):
        return statements.select(F.lit(None).cast("bigint").alias("eid"), ref.alias("s"), F.lit(f"sys:{p}").alias("p"), o.alias("o"), "t_add", *none, F.lit(None).cast("tinyint").alias("ret_kind"))

    return statements.unionByName(hop("subject", F.col("s"))).unionByName(hop("predicate", F.concat(F.lit("I:"), F.col("p")))).unionByName(hop("object", F.col("o")))


def within_graphs(statements: DataFrame, graphs: tuple) -> DataFrame:
    """The statements that are members of one of the graphs."""
    inside = statements.where((F.col("p") == M.IN_GRAPH) & F.col("o").isin(*graphs)).select(M.body(F.col("s")).try_cast("bigint").alias("eid"))
    return statements.join(inside, "eid", "left_semi").select(*statements.columns)


@dataclass
class Found:
    rows: DataFrame
    verdict: str  #: exhaustive, stopped at bound (the caller's), or stopped at cap (the engine's own)


VERDICTS = ("exhaustive", "stopped at bound", "stopped at cap")


def merged_verdict(*verdicts: str) -> str:
    """What several searches amount to: as complete as the least complete of them."""
    return max(verdicts, key=VERDICTS.index, default=VERDICTS[0])


def _starts(starts: DataFrame, auto: Automaton) -> DataFrame:
    return starts.select(F.col("node").alias("start"), F.col("node"), F.lit(auto.start).alias("state"))


def reach(statements: DataFrame, starts: DataFrame, path, max_hops: int | None = None, guard: int = 50_000_000) -> Found:
    """(start, node, hops): every end that the path matches, once, with the fewest hops.

    A path that may be empty reaches its start with no hops.
    """
    auto = compile_path(parse_path(path) if isinstance(path, str) else path)
    # which statements make an edge does not matter here, so parallel ones are one
    edges = settled(path_edges(statements, auto).select("u", "v", "state", "next", "done").distinct())
    frontier = _starts(starts.select("node").distinct(), auto)
    first = settled(frontier.withColumn("hops", F.lit(0)).withColumn("done", F.lit(auto.start in auto.final)))
    seen, hops, verdict = Layers(first), 0, "exhaustive"
    frontier = first.select("start", "node", "state")
    while True:
        step = frontier.join(edges, (F.col("node") == F.col("u")) & (frontier["state"] == edges["state"])).select("start", F.col("v").alias("node"), F.col("next").alias("state"), "done").distinct()
        new = settled(step.join(seen.rows.select("start", "node", "state"), ["start", "node", "state"], "left_anti").withColumn("hops", F.lit(hops + 1)))
        n = new.count()
        if not n:
            break
        if max_hops is not None and hops == max_hops:
            verdict = "stopped at bound"
            break
        hops += 1
        seen.add(new)
        guard -= n
        if guard < 0:
            raise LimitExceeded("path search visits too many states")
        frontier = new.select("start", "node", "state")
    return Found(seen.rows.where("done").groupBy("start", "node").agg(F.min("hops").alias("hops")), verdict)


def reach_in_time(statements: DataFrame, starts: DataFrame, path, since: int = M.EVER_FROM, guard: int = 50_000_000) -> DataFrame:
    """(start, node, arrival): the earliest time at which a time-respecting path can end.

    A hop may be taken while it is valid: it must end after the time so far, and the time
    becomes the later of that and its begin. States are expanded again when reached earlier.
    """
    auto = compile_path(parse_path(path) if isinstance(path, str) else path)
    edges = settled(path_edges(statements, auto).select("u", "v", "state", "next", "done", F.coalesce("v_from", F.lit(M.EVER_FROM)).alias("f"), F.coalesce("v_to", F.lit(M.EVER_TO)).alias("t")))
    best = settled(_starts(starts.select("node").distinct(), auto).select("start", "node", "state", F.lit(since).alias("arrival"), F.lit(auto.start in auto.final).alias("done")))
    frontier = best
    while True:
        step = frontier.drop("done").join(edges, (F.col("node") == F.col("u")) & (frontier["state"] == edges["state"]) & (F.col("t") > F.col("arrival")))
        step = step.select("start", F.col("v").alias("node"), F.col("next").alias("state"), F.greatest("arrival", "f").alias("arrival"), edges["done"].alias("done"))
        step = step.groupBy("start", "node", "state", "done").agg(F.min("arrival").alias("arrival"))
        old = best.select("start", "node", "state", F.col("arrival").alias("old"))
        frontier = settled(step.join(old, ["start", "node", "state"], "left").where("old is null or arrival < old").select("start", "node", "state", "arrival", "done"))
        n = frontier.count()
        if not n:
            break
        guard -= n
        if guard < 0:
            raise LimitExceeded("path search visits too many states")
        best = settled(best.unionByName(frontier).groupBy("start", "node", "state", "done").agg(F.min("arrival").alias("arrival")))
    return best.where("done").groupBy("start", "node").agg(F.min("arrival").alias("arrival"))


def trails(statements: DataFrame, starts: DataFrame, path, max_hops: int, guard: int = 20_000_000) -> Found:
    """(start, node, hops, eids, nodes): every way along the path that uses no statement twice."""
    auto = compile_path(parse_path(path) if isinstance(path, str) else path)
    edges = settled(path_edges(statements, auto))
    front = settled(_starts(starts.select("node").distinct(), auto).withColumns({"done": F.lit(auto.start in auto.final), "eids": F.array().cast("array<bigint>"), "nodes": F.array("node")}))
    found, verdict = front.where("done"), "exhaustive"
    for hop in range(max_hops + 1):
        nxt = front.drop("done").join(edges, (F.col("node") == F.col("u")) & (front["state"] == edges["state"])).where(F.col("eid").isNull() | ~F.array_contains("eids", F.col("eid")))
        nxt = nxt.select("start", F.col("v").alias("node"), F.col("next").alias("state"), edges["done"].alias("done"), F.concat("eids", F.array(F.coalesce("eid", F.lit(-1)))).alias("eids"), F.concat("nodes", F.array("v")).alias("nodes"))
        if hop == max_hops:
            verdict = "stopped at bound" if nxt.take(1) else verdict
            break
        front = settled(nxt)
        n = front.count()
        guard -= n
        if guard < 0:
            raise LimitExceeded("too many trails")
        if not n:
            break
        found = found.unionByName(front.where("done"))
    return Found(found.select("start", "node", F.size("eids").alias("hops"), "eids", "nodes").distinct(), verdict)


def shortest(statements: DataFrame, starts: DataFrame, path, which: str = "any", max_hops: int | None = None, guard: int = 20_000_000) -> Found:
    """Shortest paths to every end: all of them, or the one whose eids come first (any).

    States are settled layer by layer, and a layer keeps all (or the least) ways to a state, so
    that no longer way to a settled state is ever built.
    """
    auto = compile_path(parse_path(path) if isinstance(path, str) else path)
    edges = settled(path_edges(statements, auto))
    front = settled(_starts(starts.select("node").distinct(), auto).withColumns({"done": F.lit(auto.start in auto.final), "eids": F.array().cast("array<bigint>"), "nodes": F.array("node")}))
    visited, hops, verdict = Layers(front), 0, "exhaustive"
    while True:
        nxt = front.drop("done").join(edges, (F.col("node") == F.col("u")) & (front["state"] == edges["state"]))
        nxt = nxt.select("start", F.col("v").alias("node"), F.col("next").alias("state"), edges["done"].alias("done"), F.concat("eids", F.array(F.coalesce("eid", F.lit(-1)))).alias("eids"), F.concat("nodes", F.array("v")).alias("nodes"))
        nxt = nxt.join(visited.rows.select("start", "node", "state"), ["start", "node", "state"], "left_anti")
        if which == "any":
            nxt = nxt.groupBy("start", "node", "state", "done").agg(F.min(F.struct("eids", "nodes")).alias("w")).select("start", "node", "state", "done", "w.eids", "w.nodes")
        front = settled(nxt)
        n = front.count()
        if not n:
            break
        if max_hops is not None and hops == max_hops:
            verdict = "stopped at bound"
            break
        hops += 1
        guard -= n
        if guard < 0:
            raise LimitExceeded("too many shortest paths")
        visited.add(front)
    best = visited.rows.where("done").select("start", "node", F.size("eids").alias("hops"), "eids", "nodes").distinct()
    low = best.groupBy("start", "node").agg(F.min("hops").alias("hops"))
    best = best.join(low, ["start", "node", "hops"])
    if which == "any":
        best = best.groupBy("start", "node", "hops").agg(F.min(F.struct("eids", "nodes")).alias("w")).select("start", "node", "hops", "w.eids", "w.nodes")
    return Found(best, verdict)


FEW = 20_000  #: eids that are sent to all tasks, so that statements are read where they lie


def links(statements: DataFrame, own: bool = False) -> DataFrame:
    """(child, on, derived): statements and what they are about (own: and themselves), and conclusions and what they were derived from."""
    ref = lambda c: F.when(M.kind(F.col(c)) == "S", M.body(F.col(c)).try_cast("bigint"))
    x = statements.select(F.col("eid").alias("child"), F.explode(F.array(ref("s"), ref("o"), *([F.col("eid")] if own else []))).alias("on"), F.lit(False).alias("derived")).where("on is not null")
    derived = statements.where(F.col("p") == M.DERIVED_FROM).select(ref("s").alias("child"), ref("o").alias("on"), F.lit(True).alias("derived"))
    return x.union(derived.where("child is not null and on is not null"))


def dependents(statements: DataFrame, roots: DataFrame, view: M.View = M.NOW) -> DataFrame:
    """(eid): all statements about the roots (column eid), derived from them, or so on.

    While only few are found, the statements are read once a round, and nothing of them is
    written; the links of all are settled when a search goes deep or wide.
    """
    up, every = links(M.seen(statements, view)), None
    base = settled(roots.select("eid").distinct())
    front, seen, depth = base, Layers(base), 0
    while True:
        depth += 1
        if every is None and depth <= 3 and front.count() <= FEW:
            found = up.join(F.broadcast(front.select(F.col("eid").alias("on"))), "on")
        else:
            every = settled(up) if every is None else every
            found = every.join(front.select(F.col("eid").alias("on")), "on")
        front = settled(found.select(F.col("child").alias("eid")).distinct().join(seen.rows, "eid", "left_anti"))
        if not front.take(1):
            return seen.rows.join(base, "eid", "left_anti")
        seen.add(front)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle of an undirected graph (u, v), each once.

    Edges point from the end of smaller degree (ties: smaller name), which bounds every node's
    out-edges by the root of twice the edges, so the wedge join stays near the worst-case optimum.
    """
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    degree = e.select(F.col("u").alias("n")).union(e.select("v")).groupBy("n").agg(F.count("*").alias("d"))
    d = settled(e.join(degree.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v"))
    forward = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = d.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = o.alias("p").join(o.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closing = e.select(F.col("u").alias("y"), F.col("v").alias("z"))
    t = wedge.join(closing, ["y", "z"])
    s = F.array_sort(F.array("x", "y", "z"))
    return t.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))
