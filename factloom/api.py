"""One object over a statement frame: reads in every language, writes, rules and recall."""

from __future__ import annotations

import re
import threading
import uuid
import warnings
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from .errors import ConstraintViolated, InvalidQuery, LimitExceeded
from .functions import sql as sql_functions
from .operators import paths, provenance, recall, temporal, writes
from .plans import cypher as cypher_text
from .plans import datalog as rules
from .plans import ir, procedures
from .plans.lower import Lowering
from .plans.settle import settled
from .plans.sparql import sparql
from .sources import rdf
from .sources import store as files


#: A table function after FROM, JOIN or a comma, and its constant arguments.
TABLE_CALL = re.compile(r"(?P<before>\b(?:from|join)\s+|,\s*)(?P<name>path|text_search|goal|conflicts|triangles)\((?P<args>(?:\s*(?:'(?:[^']|'')*'|\d+)\s*,?)*)\)", re.I)
SHOW_INDEXES = re.compile(r"\s*SHOW\s+VECTOR\s+INDEX(ES)?\s*;?\s*", re.I)
CREATE_INDEX = re.compile(r"\s*CREATE\s+VECTOR\s+INDEX\s+(?P<name>\w+)\s+OPTIONS\s*\{\s*dimensions\s*:\s*(?P<dims>\d+)\s*\}\s*;?\s*", re.I)
DROP_INDEX = re.compile(r"\s*DROP\s+VECTOR\s+INDEX\s+(?P<name>\w+)\s*;?\s*", re.I)
ARGUMENT = re.compile(r"'(?:[^']|'')*'|\d+")


@dataclass(frozen=True)
class Options:
    """max_cascade, max_rows, max_bytes and deadline raise when passed; results are never cut short."""

    max_cascade: int = writes.MAX_CASCADE
    max_rows: int | None = None
    max_bytes: int | None = None  #: of the rows of an answer, as text
    deadline: float | None = None  #: seconds that an answer may take; the jobs behind it are cancelled then
    path_guard: int = 50_000_000
    max_hops: int = 64  #: of trails without a bound of their own
    max_rounds: int = rules.LIMIT
    constraints: str | None = None  #: rules whose facts a commit must not have
    warnings: str | None = None  #: rules whose facts a commit warns of


@contextmanager
def within(spark: SparkSession, seconds: float | None):
    """Spark jobs of the block, cancelled (LimitExceeded) once it has taken so long."""
    if seconds is None:
        yield
        return
    tag, late = f"factloom-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag)

    clock = threading.Timer(seconds, stop)
    spark.addTag(tag)
    clock.start()
    try:
        yield
    except Exception as e:
        raise LimitExceeded(f"more than {seconds} seconds") if late.is_set() else e
    finally:
        clock.cancel()
        spark.removeTag(tag)
    if late.is_set():
        raise LimitExceeded(f"more than {seconds} seconds")


@dataclass(frozen=True)
class Graph:
    """A version of a store with a view on it. Writing methods return the next version."""

    store: writes.Store
    view: M.View = M.NOW
    options: Options = field(default_factory=Options)
    volatile: DataFrame | None = None
    prefixes: dict = field(default_factory=dict)  #: names that texts may use without saying so
    answers: dict = field(default_factory=dict)  #: saved answers by name
    embeddings: DataFrame | None = None  #: (model, eid, vec)
    models: dict = field(default_factory=dict)  #: model -> dimensions

    @staticmethod
    def empty(spark: SparkSession, **options) -> Graph:
        return Graph(writes.Store.empty(spark), options=Options(**options))

    @staticmethod
    def over(statements: DataFrame, **options) -> Graph:
        return Graph(writes.Store.over(statements), options=Options(**options))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int, **options) -> Graph:
        return Graph.over(files.load(spark, path, version), **options)

    def save(self, path: str, version: int | None = None) -> int:
        version = self.store.t if version is None else version
        files.save(self.statements, path, version)
        return version

    # --- views ---

    def at(self, view: M.View) -> Graph:
        return replace(self, view=view)

    def as_of(self, t: int) -> Graph:
        return self.at(replace(self.view, mode="tx", at=t))

    def at_instant(self, ms: int) -> Graph:
        return self.at(replace(self.view, mode="instant", at=ms))

    def history(self) -> Graph:
        return self.at(replace(self.view, mode="history"))

    def valid_at(self, ms: int) -> Graph:
        return self.at(self.view.valid_at(ms))

    @property
    def statements(self) -> DataFrame:
        return self.store.statements

    @property
    def tx(self) -> DataFrame | None:
        spark = self.statements.sparkSession
        return spark.createDataFrame(list(self.store.tx), "t bigint, instant bigint") if self.store.tx else None

    # --- reads ---

    def _checked(self, df: DataFrame) -> DataFrame:
        """df, once it is known to keep within the budgets that are set."""
        o = self.options
        if o.max_rows is None and o.max_bytes is None and o.deadline is None:
            return df
        with within(df.sparkSession, o.deadline):
            if o.max_bytes is not None or o.deadline is not None:
                df = settled(df)
            if o.max_bytes is not None:
                size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0
                if size > o.max_bytes:
                    raise LimitExceeded(f"more than {o.max_bytes} bytes")
            return self._counted(df)

    def _counted(self, df: DataFrame) -> DataFrame:
        if self.options.max_rows is not None and df.limit(self.options.max_rows + 1).count() > self.options.max_rows:
            raise LimitExceeded(f"more than {self.options.max_rows} rows")
        return df

    def sparql(self, text: str, prefixes: dict | None = None, **how) -> DataFrame:
        return self._checked(sparql(text, self.statements, self.view, {**self.prefixes, **(prefixes or {})}, tx=self.tx, volatile=self.volatile, **how))

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """A reading query, or SHOW VECTOR INDEXES."""
        if SHOW_INDEXES.fullmatch(text):
            rows = [(M.key(name), M.key(dims)) for name, dims in sorted(self.models.items())]
            return self.statements.sparkSession.createDataFrame(rows, "name string, dimensions string")
        return self._checked(cypher_text.cypher(text, self.statements, self.view, params, tx=self.tx, volatile=self.volatile))

    def run(self, op, semantics: ir.Semantics = ir.SPARQL) -> DataFrame:
        return self._checked(Lowering(self.statements, semantics, self.view, self.tx, self.volatile).run(op))

    def sql(self, text: str, name: str = "statement") -> DataFrame:
        """Plain Spark SQL over the view's statements, with the term helpers.

        Operators stand in FROM as table functions with constant arguments: ``path('a', 'knows+')``,
        ``text_search('words', 'any', 10)``, ``goal('rules', 'goal')``, ``conflicts()`` and
        ``triangles('knows')``.
        """
        spark = self.statements.sparkSession
        sql_functions.register(spark, M.seen(self.statements, self.view, self.tx), name)
        return self._checked(spark.sql(TABLE_CALL.sub(self._table, text)))

    def _table(self, call: re.Match) -> str:
        """A table function's rows as a temporary view."""
        args = [a[1:-1].replace("''", "'") if a.startswith("'") else int(a) for a in ARGUMENT.findall(call["args"])]
        x = self.triples()
        if call["name"] == "path":
            df = procedures.path(x, *args).select("node", M.num(F.col("hops")).cast("bigint").alias("hops"))
        elif call["name"] == "text_search":
            df = self.text_search(*args)
        elif call["name"] == "goal":
            df = rules.datalog(args[0], args[1], self.statements, self.view)
        elif call["name"] == "conflicts":
            df = self.conflicts()
        else:
            df = paths.triangles(x.where(F.col("p") == args[0]).select(F.col("s").alias("u"), F.col("o").alias("v")))
        view = f"factloom_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        return f"{call['before']}{view}"

    def triples(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        x = M.seen(self.statements, self.view, self.tx)
        for c, v in (("s", s), ("p", p), ("o", o)):
            x = x if v is None else x.where(F.col(c) == v)
        return x

    def values(self, s: str, p: str) -> DataFrame:
        """The objects of a subject and predicate, volatile ones too."""
        x = self.triples(s, p).select("o")
        if self.volatile is not None and self.view.mode == "now":
            x = x.union(self.volatile.where((F.col("s") == s) & (F.col("p") == p)).select("o"))
        return x

    def graphs(self) -> DataFrame:
        return writes.graphs(self.statements, self.view)

    def graph_members(self, graph: str) -> DataFrame:
        return writes.graph_members(self.statements, graph, self.view)

    def events(self, since: int | None = None) -> DataFrame:
        return temporal.events(self.statements, since)

    def dependents(self, eids: list[int]) -> DataFrame:
        return paths.dependents(self.statements, self._ids(eids), self.view)

    def conflicts(self) -> DataFrame:
        return temporal.conflicts(self.statements, self.view)

    def path(self, start: list[str], path: str, mode: str = "reach", max_hops: int | None = None, virtual: bool = False, graphs: tuple = ()) -> paths.Found:
        """Rows, by hops, and verdict of reach, trail, any_shortest, all_shortest or (in time) earliest."""
        spark = self.statements.sparkSession
        starts = spark.createDataFrame([(s,) for s in start], "node string")
        x = M.seen(self.statements, self.view, self.tx)
        x = paths.within_graphs(x, graphs) if graphs else x  # every hop a member
        x = paths.with_virtual(x) if virtual else x
        guard, cap = self.options.path_guard, self.options.max_hops
        if mode == "reach":
            found = paths.reach(x, starts, path, max_hops, guard)
        elif mode == "earliest":
            found = paths.Found(paths.reach_in_time(x, starts, path, guard=guard), "exhaustive")
            return paths.Found(found.rows.orderBy("arrival", "start", "node"), found.verdict)
        elif mode == "trail":
            found = paths.trails(x, starts, path, max_hops if max_hops is not None else cap, guard)
        else:
            found = paths.shortest(x, starts, path, mode.split("_")[0], max_hops, guard)
        capped = mode == "trail" and max_hops is None and found.verdict != "exhaustive"
        return paths.Found(found.rows.orderBy("hops", "start", "node", *[c for c in ("eids",) if c in found.rows.columns]), "stopped at cap" if capped else found.verdict)

    def text_search(self, text: str, mode: str = "all", limit: int | None = 10, predicate: str | None = None) -> DataFrame:
        """Statements whose string object matches, ranked by score and evidence. Statistics are of all strings."""
        strings = self.statements.where(M.kind(F.col("o")).isin("s", "l")).select("eid", M.lex(F.col("o")).alias("text"))
        visible = self.triples(p=predicate).select("eid")
        hits = recall.text_search(strings, text, mode, visible)
        return recall.with_evidence(hits, recall.evidence(self.statements, self.view), self.statements, limit)

    def vector_search(self, embeddings: DataFrame, vector: list[float], metric: str = "cosine", limit: int = 10) -> DataFrame:
        """embeddings: (eid, vec)."""
        return recall.vector_search(embeddings, vector, metric, limit, "eid", "vec", self.triples().select("eid"))

    def recall(self, text: str, embeddings: DataFrame, vector: list[float], limit: int = 10, mode: str = "any") -> DataFrame:
        depth = max(4 * limit, 50)
        return recall.fused([self.text_search(text, mode, depth), self.vector_search(embeddings, vector, limit=depth)], limit)

    def register(self, name: str, f, returns: str):
        """A Python function for sql(); Arrow batches carry its arguments where it is a pandas UDF."""
        return self.statements.sparkSession.udf.register(name, f, returns)

    def explain_datalog(self, program: str, goal: str | None = None) -> str:
        return rules.explain(program, goal)

    def datalog(self, program: str, goal: str, time: bool = False) -> DataFrame:
        return self._checked(rules.answered(program, goal, self.statements, self.view, time, most=self.options.max_rounds).rows)

    def datalog_report(self, program: str, goal: str, time: bool = False) -> rules.Answer:
        """Rows, and whether they are complete: rules that do not come to rest in max_rounds give what they found."""
        return rules.answered(program, goal, self.statements, self.view, time, most=self.options.max_rounds, partial=True)

    def proof(self, program: str, fact: str) -> dict | None:
        """One derivation of a fact."""
        return rules.proof(program, fact, self.statements, self.view)

    def check(self, constraints: str) -> dict[str, DataFrame]:
        return rules.check(constraints, self.statements, self.view)

    def provenance(self, op) -> DataFrame:
        return provenance.with_provenance(op, self.statements, self.view)

    def save_answer(self, op, predicates: tuple = ()) -> provenance.Saved:
        return provenance.save(op, self.statements, self.store.t, predicates)

    def answer_status(self, saved: provenance.Saved) -> DataFrame:
        return provenance.status(saved, self.statements, self.store.t)

    def keep_answer(self, name: str, op, predicates: tuple = ()) -> Graph:
        """A graph that knows an answer by name."""
        return replace(self, answers={**self.answers, name: self.save_answer(op, predicates)})

    def refresh_answer(self, name: str) -> tuple[Graph, DataFrame]:
        """The named answer made again, and the rows that came and went."""
        old = self.answers[name]
        new = provenance.refreshed(old, self.statements, self.store.t)
        return replace(self, answers={**self.answers, name: new}), provenance.compared(old, new)

    def delete_answer(self, name: str) -> Graph:
        return replace(self, answers={k: v for k, v in self.answers.items() if k != name})

    def with_prefix(self, name: str, iri: str) -> Graph:
        """A graph whose texts may write name: for an IRI's beginning."""
        return replace(self, prefixes={**self.prefixes, name: iri})

    # --- embeddings and volatile values ---

    def define_embedding(self, model: str, dims: int) -> Graph:
        if self.models.get(model, dims) != dims:
            raise InvalidQuery(f"{model} has {self.models[model]} dimensions")
        return replace(self, models={**self.models, model: dims})

    def drop_embedding(self, model: str) -> Graph:
        left = None if self.embeddings is None else recall.without_model(self.embeddings, model)
        return replace(self, models={k: v for k, v in self.models.items() if k != model}, embeddings=left)

    def set_embeddings(self, model: str, vectors: DataFrame) -> Graph:
        """vectors (eid, vec) of a defined model, in place of those the eids had."""
        if model not in self.models:
            raise InvalidQuery(f"no model {model}")
        return replace(self, embeddings=recall.with_embeddings(self.embeddings, model, vectors, self.models[model]))

    def unembedded(self, model: str) -> DataFrame:
        none = self.statements.sparkSession.createDataFrame([], "model string, eid bigint, vec array<double>")
        return recall.unembedded(self.statements, none if self.embeddings is None else self.embeddings, model, self.view)

    def set_volatile(self, s, p: str, o) -> Graph:
        """A value that is seen under Now only and has no history; None clears it."""
        spark, k = self.statements.sparkSession, lambda x: x if isinstance(x, str) and x[1:2] == ":" else M.key(x)
        old = spark.createDataFrame([], "s string, p string, o string") if self.volatile is None else self.volatile
        left = old.where(~((F.col("s") == k(s)) & (F.col("p") == p)))
        return replace(self, volatile=left if o is None else left.union(spark.createDataFrame([(k(s), p, k(o))], "s string, p string, o string")))

    # --- writes ---

    def _ids(self, eids: list[int]) -> DataFrame:
        return self.statements.sparkSession.createDataFrame([(e,) for e in eids], "eid bigint")

    def _batch(self, rows: list[tuple]) -> DataFrame:
        return writes.batch(self.statements.sparkSession, rows)

    def _next(self, store: writes.Store) -> Graph:
        g = replace(self, store=store)
        if self.options.constraints:
            broken = [name for name, x in g.check(self.options.constraints).items() if x.take(1)]
            if broken:
                raise ConstraintViolated(", ".join(sorted(broken)))
        if self.options.warnings:
            found = [name for name, x in g.check(self.options.warnings).items() if x.take(1)]
            if found:
                warnings.warn(", ".join(sorted(found)), stacklevel=3)
        return g

    def assert_(self, rows: list[tuple], instant: int | None = None) -> Graph:
        return self._next(writes.assert_(self.store.begin(instant), self._batch(rows))[0])

    def create(self, rows: list[tuple], instant: int | None = None) -> Graph:
        return self._next(writes.create(self.store.begin(instant), self._batch(rows))[0])

    def bulk_import(self, facts: DataFrame, instant: int | None = None, chunks: int = 1) -> Graph:
        """Facts (s, p, o, v_from, v_to) of a frame as new statements, in as many transactions as chunks.

        Facts are dealt to chunks by a hash of their subject, so that a subject's come together.
        """
        g = self
        for k in range(chunks):
            part = facts if chunks == 1 else facts.where(F.pmod(F.xxhash64("s"), F.lit(chunks)) == k)
            g = g._next(writes.create(g.store.begin(instant), part)[0])
        return g

    def upsert(self, rows: list[tuple], instant: int | None = None) -> Graph:
        return self._next(writes.upsert(self.store.begin(instant), self._batch(rows))[0])

    def retract(self, eids: list[int], instant: int | None = None) -> Graph:
        return self._next(writes.retract(self.store.begin(instant), self._ids(eids), most=self.options.max_cascade))

    def supersede(self, eid: int, o, instant: int | None = None) -> Graph:
        return self._next(writes.supersede(self.store.begin(instant), eid, o)[0])

    def confirm(self, eids: list[int], author: str, instant: int | None = None) -> Graph:
        return self._next(writes.confirm(self.store.begin(instant), self._ids(eids), author)[0])

    def update(self, text: str, prefixes: dict | None = None) -> Graph:
        return self._next(writes.update(self.store, text, prefixes))

    def cypher_write(self, text: str, params: dict | None = None) -> Graph:
        """A writing query, or CREATE or DROP VECTOR INDEX."""
        made, gone = CREATE_INDEX.fullmatch(text), DROP_INDEX.fullmatch(text)
        if made:
            return self.define_embedding(made["name"], int(made["dims"]))
        if gone:
            return self.drop_embedding(gone["name"])
        from .plans.cypher_write import write

        return self._next(write(self.store, text, params))

    def meta(self, eids: list[int], p: str, o, instant: int | None = None) -> Graph:
        return self._next(writes.meta(self.store.begin(instant), self._ids(eids), p, o)[0])

    def derive(self, rows: list[tuple], supports: list[int], instant: int | None = None) -> Graph:
        return self._next(writes.derive(self.store.begin(instant), self._batch(rows), self._ids(supports))[0])

    def upsert_derived(self, rows: list[tuple], supports: list[int], instant: int | None = None) -> Graph:
        return self._next(writes.upsert_derived(self.store.begin(instant), self._batch(rows), self._ids(supports))[0])

    def new_nodes(self, count: int = 1, blank: bool = False) -> tuple[Graph, list[str]]:
        store, names = writes.new_nodes(self.store, count, blank)
        return replace(self, store=store), names

    def retract_matching(self, s: str | None = None, p: str | None = None, o: str | None = None, instant: int | None = None) -> Graph:
        test = F.lit(True)
        for c, v in (("s", s), ("p", p), ("o", o)):
            test = test if v is None else test & (F.col(c) == v)
        return self._next(writes.retract_matching(self.store.begin(instant), test, self.options.max_cascade))

    def add_to_graph(self, eids: list[int], graph: str, instant: int | None = None) -> Graph:
        return self._next(writes.add_to_graph(self.store.begin(instant), self._ids(eids), graph)[0])

    def remove_from_graph(self, eids: list[int], graph: str, instant: int | None = None) -> Graph:
        return self._next(writes.remove_from_graph(self.store.begin(instant), self._ids(eids), graph))

    def clear_graph(self, graph: str, instant: int | None = None) -> Graph:
        return self._next(writes.clear_graph(self.store.begin(instant), graph))

    def drop_graph(self, graph: str, instant: int | None = None) -> Graph:
        return self._next(writes.drop_graph(self.store.begin(instant), graph))

    def transact(self, write, dry_run: bool = False) -> tuple[Graph, dict]:
        """What a function of this graph makes of it in one step, and a report of it; a dry run keeps nothing."""
        g = write(self)
        log = temporal.events(g.statements, self.store.t).groupBy("op").count().collect()
        report = {"transaction": g.store.t, **{r["op"]: r["count"] for r in log}}
        return (self if dry_run else g), report

    def bundle(self, eids: list[int]) -> DataFrame:
        return rdf.bundle(self.statements, self._ids(eids), self.view)

    def preview_bundle(self, lines: DataFrame) -> DataFrame:
        """(s, p, o, new): the facts of a bundle, and whether the store does not hold them yet."""
        x = rdf.import_bundle(self.statements.sparkSession, lines, self.store.next_eid, self.store.t + 1).select("s", "p", "o")
        have = self.store.live().select("s", "p", "o").distinct().withColumn("have", F.lit(True))
        return x.join(have, ["s", "p", "o"], "left").select("s", "p", "o", F.col("have").isNull().alias("new"))

    def import_bundle(self, lines: DataFrame, instant: int | None = None) -> Graph:
        store = self.store.begin(instant)
        new = settled(rdf.import_bundle(self.statements.sparkSession, lines, store.next_eid, store.t))
        return self._next(replace(store, statements=store.statements.unionByName(new), next_eid=store.next_eid + new.count()))

    def materialise(self, program: str, name: str, predicate: str, instant: int | None = None) -> Graph:
        """The store's statements of a predicate made equal to the facts of a rule."""
        add, gone = rules.materialised(program, name, predicate, self.statements, self.view)
        store = self.store.begin(instant)
        store = writes.retract(store, gone) if gone.take(1) else store
        none = F.lit(None).cast("bigint")
        return self._next(writes.assert_(store, add.withColumns({"v_from": none, "v_to": none}))[0])

    def speculate(self, write) -> Graph:
        """What a function of this graph would make of it; nothing is kept unless the caller keeps it."""
        return write(self)
