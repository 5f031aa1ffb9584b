"""Write verbs as batches: each call makes a new version of the statement frame.

A Store is a frame of statements, the next eid and transaction, and rules about predicates.
Nothing is changed in place: dry runs and speculation are a Store that is not kept.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..errors import ConstraintViolated, InvalidQuery, LimitExceeded
from ..plans.settle import Layers, numbered, settled
from . import paths
from .temporal import overlaps

FACT = "s string, p string, o string, v_from bigint, v_to bigint"
MAX_CASCADE = 10_000
LAZY = 8  #: retractions that are laid over a store before it is written anew


@dataclass(frozen=True)
class Store:
    statements: DataFrame
    t: int = 0
    next_eid: int = 1
    tx: tuple = ()  #: (t, instant) of transactions so far
    lazy: int = 0  #: retractions since statements were written

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(spark.createDataFrame([], M.STATEMENT))

    @staticmethod
    def over(statements: DataFrame) -> Store:
        top = statements.agg(F.max("eid"), F.greatest(F.max("t_add"), F.coalesce(F.max("t_ret"), F.lit(0)))).first()
        return Store(statements, top[1] or 0, (top[0] or 0) + 1)

    def begin(self, instant: int | None = None) -> Store:
        t = self.t + 1
        if self.tx and instant is not None and instant < self.tx[-1][1]:
            raise InvalidQuery("time goes backwards")
        return replace(self, t=t, tx=(*self.tx, (t, instant if instant is not None else t)))

    def live(self) -> DataFrame:
        return M.seen(self.statements)


def batch(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Facts to write, from (s, p, o[, v_from, v_to]) of Python values."""
    k = lambda x: x if isinstance(x, str) and x[1:2] == ":" else M.key(x)
    return spark.createDataFrame([(k(r[0]), r[1], k(r[2]), *(tuple(r[3:]) + (None, None))[:2]) for r in rows], FACT)


def _check(store: Store, facts: DataFrame) -> None:
    bad = facts.where(~M.kind(F.col("s")).isin("I", "N", "_", "S", "T"))
    if bad.take(1):
        raise ConstraintViolated("a subject is an IRI, node, statement or transaction")
    if facts.where(F.col("v_from") >= F.col("v_to")).take(1):
        raise ConstraintViolated("an interval ends after it begins")
    rules = store.live().where(F.col("p") == M.VALUE_TYPE).select(M.body(F.col("s")).alias("rp"), M.body(F.col("o")).alias("kind"))
    wrong = facts.join(F.broadcast(rules), F.col("p") == F.col("rp")).where(M.datatype(F.col("o")).isNull() | (M.datatype(F.col("o")) != F.col("kind")))
    if wrong.take(1):
        raise ConstraintViolated("a value has another type than its predicate asks")


def _append(store: Store, facts: DataFrame) -> tuple[Store, DataFrame]:
    """Facts with fresh eids, in order of (s, p, o, v_from)."""
    order = ["s", "p", "o", F.col("v_from").asc_nulls_first(), "v_to"]
    none = F.lit(None)
    new = settled(numbered(facts, order, "eid", store.next_eid).select("eid", "s", "p", "o", F.lit(store.t).cast("bigint").alias("t_add"), none.cast("bigint").alias("t_ret"), "v_from", "v_to", none.cast("tinyint").alias("ret_kind")))
    return replace(store, statements=store.statements.unionByName(new), next_eid=store.next_eid + new.count()), new


def create(store: Store, facts: DataFrame) -> tuple[Store, DataFrame]:
    """Every fact as a new statement, whatever is there."""
    _check(store, facts)
    return _append(store, facts)


def assert_(store: Store, facts: DataFrame) -> tuple[Store, DataFrame]:
    """Facts as statements; where a live one has the same (s, p, o) and a common time, that one stands.

    Unique predicates refuse a second subject, and predicates of cardinality one retract what
    they held at the time, with all that hangs on it.
    """
    _check(store, facts)
    facts = settled(facts.distinct())
    live = store.live()
    same = live.select(F.col("s").alias("ls"), F.col("p").alias("lp"), F.col("o").alias("lo"), F.col("v_from").alias("lf"), F.col("v_to").alias("lt"), F.col("eid").alias("le"))
    hit = (F.col("s") == F.col("ls")) & (F.col("p") == F.col("lp")) & (F.col("o") == F.col("lo")) & overlaps(F.col("v_from"), F.col("v_to"), F.col("lf"), F.col("lt"))
    new = settled(facts.join(same, hit, "left_anti"))
    flags = live.where(F.col("p").isin(M.UNIQUE, M.CARDINALITY)).select(M.body(F.col("s")).alias("fp"), F.col("p").alias("flag"))
    unique = new.join(F.broadcast(flags.where(F.col("flag") == M.UNIQUE)), F.col("p") == F.col("fp"), "left_semi")
    other = unique.join(same, (F.col("p") == F.col("lp")) & (F.col("o") == F.col("lo")) & (F.col("s") != F.col("ls")), "left_semi")
    if other.take(1):
        raise ConstraintViolated("a unique value has another subject")
    one = new.join(F.broadcast(flags.where(F.col("flag") == M.CARDINALITY)), F.col("p") == F.col("fp"), "left_semi")
    gone = same.join(one, (F.col("s") == F.col("ls")) & (F.col("p") == F.col("lp")) & (F.col("o") != F.col("lo")) & overlaps(F.col("v_from"), F.col("v_to"), F.col("lf"), F.col("lt")), "left_semi").select(F.col("le").alias("eid"))
    gone = settled(gone)
    if gone.take(1):
        store = retract(store, gone, "cardinality")
    return _append(store, new)


def cascade(store: Store, roots: DataFrame, most: int = MAX_CASCADE) -> DataFrame:
    """(eid, depth, parent): the roots and all live statements about them or derived from them.

    While only few are found, the store is read once a round, and nothing of it is written; the
    links of all statements are settled when a cascade goes deep or wide.
    """
    live = store.live()
    up, every, found = paths.links(live), None, None
    roots = settled(roots.select("eid").distinct())
    few = roots.count() <= paths.FEW
    if few:  # one reading finds which roots live, and the first statements about them
        both = settled(paths.links(live, own=True).join(F.broadcast(roots.select(F.col("eid").alias("on"))), "on").distinct())
        front = both.where("child = on and not derived").select(F.col("child").alias("eid")).distinct()
        found = both.where("child <> on or derived")
    else:
        front = roots.join(live.select("eid"), "eid", "left_semi")
    front = settled(front.withColumns({"depth": F.lit(0), "parent": F.col("eid")}))
    seen, depth, count = Layers(front), 0, front.count()
    while True:
        depth += 1
        on = front.select(F.col("eid").alias("on"))
        if found is not None:
            found = found.join(on, "on")
        elif every is None and few and depth <= 3 and front.count() <= paths.FEW:
            found = up.join(F.broadcast(on), "on")
        else:
            every = settled(up) if every is None else every
            found = every.join(on, "on")
        front = settled(found.groupBy(F.col("child").alias("eid")).agg(F.min("on").alias("parent"), F.min("derived").alias("derived")).join(seen.rows.select("eid"), "eid", "left_anti"))
        if front.where("derived").take(1):  # the others are live, as their links are of live statements
            front = settled(front.join(live.select("eid"), "eid", "left_semi"))
        front, found = front.select("eid", F.lit(depth).alias("depth"), "parent"), None
        new = front.count()
        if not new:
            return seen.rows
        seen.add(front)
        count += new
        if count > most:
            raise LimitExceeded(f"a cascade of more than {most} statements")


def retract(store: Store, roots: DataFrame, why: str = "explicit", most: int = MAX_CASCADE) -> Store:
    """Ends the roots (kind ``why``) and what hangs on them (kind cascade) at this transaction."""
    return _ended(store, cascade(store, roots, most), why)


def _ended(store: Store, closure: DataFrame, why: str) -> Store:
    gone = settled(closure.select(F.col("eid").alias("ge"), F.when(F.col("depth") == 0, M.RETRACTED[why]).otherwise(M.RETRACTED["cascade"]).alias("gk")))
    few = gone.count() <= paths.FEW
    x = store.statements.join(F.broadcast(gone) if few else gone, F.col("eid") == F.col("ge"), "left")
    ends = F.col("ge").isNotNull() & F.col("t_ret").isNull()
    x = x.withColumns({"t_ret": F.when(ends, F.lit(store.t)).otherwise(F.col("t_ret")).cast("bigint"), "ret_kind": F.when(ends, F.col("gk")).otherwise(F.col("ret_kind")).cast("tinyint")}).select(*M.COLUMNS)
    lay = few and store.lazy < LAZY
    return replace(store, statements=x if lay else settled(x), lazy=store.lazy + 1 if lay else 0)


def retract_matching(store: Store, test: Column, most: int = MAX_CASCADE) -> Store:
    return retract(store, settled(store.live().where(test).select("eid")), most=most)


def supersede(store: Store, old: int, o, v_from: int | None = None, v_to: int | None = None) -> tuple[Store, DataFrame]:
    """A statement's object replaced: it and its layers end, and the layers stand anew on the new one.

    Returns (old eid, new eid) of all that was replayed, the root first.
    """
    spark = store.statements.sparkSession
    root = spark.createDataFrame([(old,)], "eid bigint")
    closure = cascade(store, root)
    order = Window.orderBy("depth", "parent", "eid")  # at most MAX_CASCADE rows
    ids = settled(closure.select(F.col("eid").alias("old"), "depth", (F.row_number().over(order) + store.next_eid - 1).cast("bigint").alias("new")))
    if not ids.take(1):
        raise InvalidQuery(f"no live statement {old}")
    gone = settled(store.live().join(F.broadcast(ids), F.col("eid") == F.col("old")))
    remap = lambda c, side: F.coalesce(M.statement_ref(F.col(f"{side}.new")), F.col(c))
    x = gone.alias("g")
    for c, side in (("s", "a"), ("o", "b")):
        x = x.join(ids.select(M.statement_ref("old").alias("k"), "new").alias(side), F.col(f"g.{c}") == F.col(f"{side}.k"), "left")
    top = F.col("g.depth") == 0
    key = o if isinstance(o, str) and o[1:2] == ":" else M.key(o)
    new = x.select(
        F.col("g.new").alias("eid"), remap("g.s", "a").alias("s"), F.col("g.p").alias("p"), F.when(top, F.lit(key)).otherwise(remap("g.o", "b")).alias("o"),
        F.lit(store.t).cast("bigint").alias("t_add"), F.lit(None).cast("bigint").alias("t_ret"),
        F.when(top, F.coalesce(F.lit(v_from).cast("bigint"), F.col("g.v_from"))).otherwise(F.col("g.v_from")).alias("v_from"),
        F.when(top, F.coalesce(F.lit(v_to).cast("bigint"), F.col("g.v_to"))).otherwise(F.col("g.v_to")).alias("v_to"), F.lit(None).cast("tinyint").alias("ret_kind"),
    )
    new = settled(new)
    ended = _ended(store, closure, "supersede")
    return replace(ended, statements=ended.statements.unionByName(new), next_eid=store.next_eid + new.count()), ids.select("old", "new")


def confirm(store: Store, eids: DataFrame, author: str) -> tuple[Store, DataFrame]:
    return assert_(store, eids.select(M.statement_ref("eid").alias("s"), F.lit(M.CONFIRMED_BY).alias("p"), F.lit(author).alias("o"), F.lit(None).cast("bigint").alias("v_from"), F.lit(None).cast("bigint").alias("v_to")))


def upsert(store: Store, facts: DataFrame) -> tuple[Store, DataFrame]:
    """Facts in place of whatever their subject and predicate hold now."""
    keys = facts.select("s", "p").distinct()
    keep = facts.select("s", "p", "o")
    old = store.live().join(keys, ["s", "p"], "left_semi").join(keep, ["s", "p", "o"], "left_anti").select("eid")
    old = settled(old)
    return assert_(retract(store, old) if old.take(1) else store, facts)


def derive(store: Store, facts: DataFrame, supports: DataFrame) -> tuple[Store, DataFrame]:
    """A conclusion a fact, each linked to all supports (eid), so that it falls with any of them."""
    store, new = _append(store, facts)
    links = new.select("eid").crossJoin(F.broadcast(supports.select(F.col("eid").alias("on"))))  # a rule's few premises
    store, _ = _append(store, links.select(M.statement_ref("eid").alias("s"), F.lit(M.DERIVED_FROM).alias("p"), M.statement_ref("on").alias("o"), F.lit(None).cast("bigint").alias("v_from"), F.lit(None).cast("bigint").alias("v_to")))
    return store, new


def upsert_derived(store: Store, facts: DataFrame, supports: DataFrame) -> tuple[Store, DataFrame]:
    """Conclusions in place of what their subject and predicate hold now, linked to their supports."""
    keys = facts.select("s", "p").distinct()
    old = settled(store.live().join(keys, ["s", "p"], "left_semi").select("eid"))
    return derive(retract(store, old) if old.take(1) else store, facts, supports)


def meta(store: Store, eids: DataFrame, p: str, o) -> tuple[Store, DataFrame]:
    """A statement (p, o) about each of the statements."""
    key = o if isinstance(o, str) and o[1:2] == ":" else M.key(o)
    none = F.lit(None).cast("bigint")
    return assert_(store, eids.select(M.statement_ref("eid").alias("s"), F.lit(p).alias("p"), F.lit(key).alias("o"), none.alias("v_from"), none.alias("v_to")))


def new_nodes(store: Store, count: int, blank: bool = False) -> tuple[Store, list[str]]:
    """Terms of fresh anonymous (or blank) nodes, numbered like statements so that none comes twice."""
    names = [f"{'_' if blank else 'N'}:{store.next_eid + i}" for i in range(count)]
    return replace(store, next_eid=store.next_eid + count), names


# --- graphs and volatile values -----------------------------------------------


def graphs(statements: DataFrame, view: M.View = M.NOW) -> DataFrame:
    return M.seen(statements, view).where(F.col("p") == M.IN_GRAPH).select(F.col("o").alias("graph")).distinct()


def graph_members(statements: DataFrame, graph: str, view: M.View = M.NOW) -> DataFrame:
    x = M.seen(statements, view)
    inside = x.where((F.col("p") == M.IN_GRAPH) & (F.col("o") == graph)).select(M.body(F.col("s")).try_cast("bigint").alias("eid"))
    return x.join(inside, "eid", "left_semi")


def add_to_graph(store: Store, eids: DataFrame, graph: str) -> tuple[Store, DataFrame]:
    return assert_(store, eids.select(M.statement_ref("eid").alias("s"), F.lit(M.IN_GRAPH).alias("p"), F.lit(graph).alias("o"), F.lit(None).cast("bigint").alias("v_from"), F.lit(None).cast("bigint").alias("v_to")))


def clear_graph(store: Store, graph: str) -> Store:
    return retract(store, settled(graph_members(store.statements, graph).select("eid")))


def drop_graph(store: Store, graph: str) -> Store:
    """The memberships end; the statements stay."""
    return retract_matching(store, (F.col("p") == M.IN_GRAPH) & (F.col("o") == graph))


def remove_from_graph(store: Store, eids: DataFrame, graph: str) -> Store:
    """The memberships of these statements end; the statements stay."""
    refs = eids.select(M.statement_ref("eid").alias("s"))
    return retract(store, settled(store.live().where((F.col("p") == M.IN_GRAPH) & (F.col("o") == graph)).join(refs, "s", "left_semi").select("eid")))


def latest_volatile(log: DataFrame) -> DataFrame:
    """The current values of a log (s, p, o, at) of volatile writes: the last writer wins, null clears."""
    return log.groupBy("s", "p").agg(F.max_by("o", "at").alias("o")).where("o is not null")


# --- updates in SPARQL ----------------------------------------------------------


def update(store: Store, text: str, prefixes: dict | None = None) -> Store:
    """INSERT and DELETE with or without WHERE, and CREATE, CLEAR and DROP GRAPH, as one transaction."""
    from ..plans import sparql
    from ..plans.lower import Lowering

    spark = store.statements.sparkSession
    store = store.begin()
    for u in sparql.parse_update(text, prefixes):
        if u.kind == "create":
            continue
        if u.kind in ("clear", "drop"):
            store = (clear_graph if u.kind == "clear" else drop_graph)(store, u.graph)
            continue
        rows = settled(Lowering(store.statements).run(u.where)) if u.where is not None else spark.range(1).select(F.lit(1).alias("__one"))
        made = [sparql.constructed(rows, t) if t else None for t in (u.delete, u.insert)]
        if made[0] is not None:
            gone = settled(store.live().join(made[0], ["s", "p", "o"], "left_semi").select("eid"))
            store = retract(store, gone) if gone.take(1) else store
        if made[1] is not None:
            none = F.lit(None).cast("bigint")
            store, new = assert_(store, made[1].withColumns({"v_from": none, "v_to": none}))
            if u.graph:
                store, _ = add_to_graph(store, new.select("eid"), u.graph)
    return store
