"""The graph's reads and writes as JSON: an object with an ``op`` in, an object or a changed graph out.

Terms are written as in the store: ``I:iri``, ``s:text``, ``i:5``; numbers, booleans and other
strings of a fact's object stand for themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType

from .api import Graph
from .errors import InvalidQuery


def cell(v):
    """A value that JSON can hold."""
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    if isinstance(v, dict):
        return {str(k): cell(x) for k, x in v.items()}
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def rows(df: DataFrame) -> dict:
    """Columns and rows; the answer is brought to the caller, who bounds it by the graph's options."""
    return {"columns": df.columns, "rows": [[cell(v) for v in r] for r in df.toLocalIterator()]}


def encoded(df: DataFrame) -> DataFrame:
    """(value): each row as the text of a JSON array, made where the row lies."""

    def text(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            parts = F.concat(F.lit("["), F.concat_ws(",", *[text(c.getField(f.name), f.dataType) for f in kind]), F.lit("]"))
            return F.when(c.isNull(), "null").otherwise(parts)
        as_is = isinstance(kind, (StringType, BooleanType, IntegralType, FloatType, DoubleType, ArrayType, MapType))
        one = F.to_json(F.array(c if as_is else c.cast("string")))
        return F.substring(one, F.lit(2), F.length(one) - 2)

    x = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return x.select(F.concat(F.lit("["), F.concat_ws(",", *[text(F.col(f.name), f.dataType) for f in x.schema]), F.lit("]")).alias("value"))


def seen(g: Graph, q: dict) -> Graph:
    """The graph under the view that a request names: as_of, at_instant, history, valid_at."""
    g = g.as_of(q["as_of"]) if "as_of" in q else g.at_instant(q["at_instant"]) if "at_instant" in q else g.history() if q.get("history") else g
    return g.valid_at(q["valid_at"]) if "valid_at" in q else g


def vectors(g: Graph, model: str) -> DataFrame:
    if g.embeddings is None:
        raise InvalidQuery(f"no model {model}")
    return g.embeddings.where(g.embeddings["model"] == model).select("eid", "vec")


def walk(g: Graph, q: dict):
    return g.path(q["start"], q["path"], q.get("mode", "reach"), q.get("max_hops"), q.get("virtual", False), tuple(q.get("graphs", ())))


def walked(g: Graph, q: dict) -> dict:
    found = walk(g, q)
    return rows(found.rows) | {"verdict": found.verdict}


def reasoned(g: Graph, q: dict) -> dict:
    a = g.datalog_report(q["program"], q["goal"], q.get("time", False))
    return rows(a.rows) | {"verdict": a.verdict}


#: Reads whose answer is a frame.
FRAMES: dict[str, Callable[[Graph, dict], DataFrame]] = {
    "sparql": lambda g, q: g.sparql(q["text"], q.get("prefixes")),
    "cypher": lambda g, q: g.cypher(q["text"], q.get("params")),
    "sql": lambda g, q: g.sql(q["text"]),
    "triples": lambda g, q: g.triples(q.get("s"), q.get("p"), q.get("o")),
    "values": lambda g, q: g.values(q["s"], q["p"]),
    "path": lambda g, q: walk(g, q).rows,
    "events": lambda g, q: g.events(q.get("since")).orderBy("t", "eid"),
    "graphs": lambda g, q: g.graphs(),
    "graphMembers": lambda g, q: g.graph_members(q["graph"]),
    "dependents": lambda g, q: g.dependents(q["eids"]),
    "bundle": lambda g, q: g.bundle(q["eids"]),
    "textSearch": lambda g, q: g.text_search(q["text"], q.get("mode", "all"), q.get("limit", 10), q.get("predicate")),
    "vectorSearch": lambda g, q: g.vector_search(vectors(g, q["model"]), q["vector"], q.get("metric", "cosine"), q.get("limit", 10)),
    "recall": lambda g, q: g.recall(q["text"], vectors(g, q["model"]), q["vector"], q.get("limit", 10), q.get("mode", "any")),
    "unembedded": lambda g, q: g.unembedded(q["model"]).select("eid"),
    "conflicts": lambda g, q: g.conflicts(),
    "datalog": lambda g, q: g.datalog_report(q["program"], q["goal"], q.get("time", False)).rows,
}


READS: dict[str, Callable[[Graph, dict], dict]] = {name: lambda g, q, f=f: rows(f(g, q)) for name, f in FRAMES.items()} | {
    "path": walked,
    "explainSparql": lambda g, q: {"plan": g.sparql(q["text"], q.get("prefixes"))._jdf.queryExecution().explainString(g.statements.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))},
    "datalog": reasoned,
    "explainDatalog": lambda g, q: {"plan": g.explain_datalog(q["program"], q.get("goal"))},
    "proof": lambda g, q: {"proof": g.proof(q["program"], q["fact"])},
    "check": lambda g, q: {"violations": {name: rows(x) for name, x in g.check(q["constraints"]).items()}},
}


def facts(q: dict) -> list[tuple]:
    return [tuple(f) if isinstance(f, list) else (f["s"], f["p"], f["o"], f.get("from"), f.get("to")) for f in q["facts"]]


def embedded(g: Graph, q: dict) -> Graph:
    spark = g.statements.sparkSession
    return g.set_embeddings(q["model"], spark.createDataFrame([(int(e), [float(x) for x in v]) for e, v in q["vectors"]], "eid bigint, vec array<double>"))


WRITES: dict[str, Callable[[Graph, dict], Graph]] = {
    "assert": lambda g, q: g.assert_(facts(q), q.get("instant")),
    "create": lambda g, q: g.create(facts(q), q.get("instant")),
    "upsert": lambda g, q: g.upsert(facts(q), q.get("instant")),
    "derive": lambda g, q: g.derive(facts(q), q["supports"], q.get("instant")),
    "upsertDerived": lambda g, q: g.upsert_derived(facts(q), q["supports"], q.get("instant")),
    "retract": lambda g, q: g.retract(q["eids"], q.get("instant")),
    "retractMatching": lambda g, q: g.retract_matching(q.get("s"), q.get("p"), q.get("o"), q.get("instant")),
    "supersede": lambda g, q: g.supersede(q["eid"], q["o"], q.get("instant")),
    "confirm": lambda g, q: g.confirm(q["eids"], q["author"], q.get("instant")),
    "meta": lambda g, q: g.meta(q["eids"], q["p"], q["o"], q.get("instant")),
    "newNode": lambda g, q: g.new_nodes(q.get("count", 1), q.get("blank", False))[0],
    "defineEmbedding": lambda g, q: g.define_embedding(q["model"], q["dims"]),
    "dropEmbedding": lambda g, q: g.drop_embedding(q["model"]),
    "setEmbedding": embedded,
    "addToGraph": lambda g, q: g.add_to_graph(q["eids"], q["graph"], q.get("instant")),
    "removeFromGraph": lambda g, q: g.remove_from_graph(q["eids"], q["graph"], q.get("instant")),
    "clearGraph": lambda g, q: g.clear_graph(q["graph"], q.get("instant")),
    "dropGraph": lambda g, q: g.drop_graph(q["graph"], q.get("instant")),
    "importBundle": lambda g, q: g.import_bundle(g.statements.sparkSession.createDataFrame([(x,) for x in q["lines"]], "value string"), q.get("instant")),
    "setVolatile": lambda g, q: g.set_volatile(q["s"], q["p"], q.get("o")),
    "sparqlUpdate": lambda g, q: g.update(q["text"], q.get("prefixes")),
    "cypher": lambda g, q: g.cypher_write(q["text"], q.get("params")),
    "materialise": lambda g, q: g.materialise(q["program"], q["name"], q["predicate"], q.get("instant")),
}


def parsed(request: str | dict) -> dict:
    q = json.loads(request) if isinstance(request, str) else request
    if not isinstance(q, dict) or not isinstance(q.get("op"), str):
        raise InvalidQuery("a request is an object with an op")
    return q


def called(table: dict, g: Graph, q: dict):
    if q["op"] not in table:
        raise InvalidQuery(f"no operation {q['op']}")
    try:
        return table[q["op"]](g, q)
    except KeyError as e:
        raise InvalidQuery(f"{q['op']} needs {e.args[0]}") from None


def read(g: Graph, request: str | dict) -> dict:
    """The answer to a reading request."""
    q = parsed(request)
    return called(READS, seen(g, q), q)


def lines(g: Graph, request: str | dict) -> DataFrame:
    """(value): the rows of the answer to a reading request, each as JSON. None of them is brought to the caller."""
    q = parsed(request)
    return encoded(called(FRAMES, seen(g, q), q))


def write(g: Graph, request: str | dict) -> tuple[Graph, dict]:
    """The graph that a writing request makes (the one given, with dryRun), and a report of what it did."""
    q = parsed(request)
    return g.transact(lambda x: called(WRITES, x, q), q.get("dryRun", False))
