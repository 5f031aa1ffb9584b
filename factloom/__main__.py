"""python -m factloom: make, import, export, convert, query, check and change stored versions, or serve one as tools."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import jsonops, mcp
from . import model as M
from .api import Graph
from .operators import writes
from .plans.cypher import cypher
from .plans.datalog import datalog
from .plans.sparql import sparql
from .sources import rdf, store


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    said = {
        "create": (), "info": (), "import": ("text",), "export": ("text",), "sparql": ("text",), "cypher": ("text",), "datalog": ("text", "goal"), "check": ("text",), "path": ("start", "text"), "search": ("text",),
        "convert": ("target", "target_format"), "materialise": ("text", "goal", "predicate", "target_version"), "read": ("text",), "write": ("text", "target_version"), "mcp": (),
    }
    for name, more in said.items():
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("version", type=int)
        for m in more:
            c.add_argument(m, type=int if m == "target_version" else str)
        if name in ("sparql", "cypher", "datalog"):
            c.add_argument("--as-of", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "import":
        facts = rdf.read_ntriples(spark, a.text).selectExpr("s", "p", "o", "cast(null as bigint) v_from", "cast(null as bigint) v_to").distinct()
        s, _ = writes.create(writes.Store.empty(spark).begin(), facts)
        store.save(s.statements, a.store, a.version)
        return
    if a.command == "create":
        store.save(writes.Store.empty(spark).statements, a.store, a.version)
        return
    if a.command == "convert":
        store.convert(spark, a.store, a.version, a.target, "parquet", a.target_format)
        return
    x = store.load(spark, a.store, a.version)
    g = Graph.over(x)
    if a.command == "mcp":
        mcp.serve(g)
        return
    if a.command in ("read", "write"):
        if a.command == "read":
            print(json.dumps(jsonops.read(g, a.text)))
            return
        g, report = jsonops.write(g, a.text)
        g.save(a.store, a.target_version)
        print(json.dumps(report))
        return
    if a.command == "materialise":
        g.materialise(a.text, a.goal, a.predicate).save(a.store, a.target_version)
        return
    if a.command == "check":
        for name, found in g.check(a.text).items():
            for row in found.toLocalIterator():
                print("\t".join([name, *map(str, row)]))
        return
    if a.command == "export":
        rdf.ntriples(M.seen(x)).write.text(a.text)
        return
    if a.command == "path":
        out = g.path([a.start], a.text).rows
    elif a.command == "search":
        out = g.text_search(a.text)
    elif a.command == "info":
        out = x.groupBy("p").count().orderBy("p")
    else:
        view = M.NOW if a.as_of is None else M.as_of(a.as_of)
        out = datalog(a.text, a.goal, x, view) if a.command == "datalog" else (sparql if a.command == "sparql" else cypher)(a.text, x, view)
    for row in out.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
