"""The JSON operations as tools of the Model Context Protocol: JSON-RPC, a message a line, on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from . import jsonops
from .api import Graph
from .errors import FactloomError

PROTOCOL = "2024-11-05"
#: What the parameters of operations are, by name.
KINDS = {
    "text": "string", "program": "string", "goal": "string", "fact": "string", "constraints": "string", "graph": "string", "model": "string", "s": "string", "p": "string", "path": "string", "author": "string", "name": "string", "predicate": "string",
    "eids": "array", "start": "array", "facts": "array", "supports": "array", "vector": "array", "vectors": "array", "lines": "array",
    "eid": "integer", "limit": "integer", "dims": "integer", "since": "integer", "max_hops": "integer", "as_of": "integer", "mode": "string",
}
READ_VIEW = ("as_of",)
NEEDS = {
    "sparql": ("text",), "cypher": ("text",), "sql": ("text",), "triples": (), "values": ("s", "p"), "path": ("start", "path"), "events": (), "graphs": (), "graphMembers": ("graph",), "dependents": ("eids",), "bundle": ("eids",),
    "textSearch": ("text",), "vectorSearch": ("model", "vector"), "recall": ("text", "model", "vector"), "unembedded": ("model",), "conflicts": (), "explainSparql": ("text",), "datalog": ("program", "goal"), "explainDatalog": ("program",),
    "proof": ("program", "fact"), "check": ("constraints",),
    "assert": ("facts",), "create": ("facts",), "upsert": ("facts",), "derive": ("facts", "supports"), "upsertDerived": ("facts", "supports"), "retract": ("eids",), "retractMatching": (), "supersede": ("eid", "o"), "confirm": ("eids", "author"),
    "meta": ("eids", "p", "o"), "newNode": (), "defineEmbedding": ("model", "dims"), "dropEmbedding": ("model",), "setEmbedding": ("model", "vectors"), "addToGraph": ("eids", "graph"), "removeFromGraph": ("eids", "graph"), "clearGraph": ("graph",),
    "dropGraph": ("graph",), "importBundle": ("lines",), "setVolatile": ("s", "p"), "sparqlUpdate": ("text",), "cypherWrite": ("text",), "materialise": ("program", "name", "predicate"),
}


def tools() -> list[dict]:
    """Every operation as a tool: reads by their name, the writing ``cypher`` as cypherWrite."""
    out = []
    for name, needed in NEEDS.items():
        reads = name in jsonops.READS
        fields = {k: {"type": KINDS[k]} if k in KINDS else {} for k in (*needed, *(READ_VIEW if reads else ("dryRun",)))}
        out.append({"name": name, "description": f"{'Reads' if reads else 'Writes'}: {name}", "inputSchema": {"type": "object", "properties": fields, "required": list(needed)}})
    return out


class Server:
    """Answers messages over a graph that writes replace."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def call(self, name: str, arguments: dict) -> dict:
        if name in jsonops.READS:
            return jsonops.read(self.graph, {**arguments, "op": name})
        op = "cypher" if name == "cypherWrite" else name
        self.graph, report = jsonops.write(self.graph, {**arguments, "op": op})
        return report

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; notifications have none."""
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "factloom", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": tools()}}
        if method == "tools/call":
            try:
                text, failed = json.dumps(self.call(params.get("name", ""), params.get("arguments") or {})), False
            except FactloomError as e:  # what the caller asked for cannot be done; the server goes on
                text, failed = f"{type(e).__name__}: {e}", True
            return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(graph: Graph, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    server = Server(graph)
    for line in lines:
        if line.strip():
            reply = server.answer(json.loads(line))
            if reply is not None:
                print(json.dumps(reply), file=out, flush=True)
