"""Procedures that Cypher can CALL. Each takes the view's statements and constants, and gives rows of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..operators import recall


def labels(statements: DataFrame) -> DataFrame:
    return statements.where(F.col("p") == M.RDF_TYPE).select(M.string(M.lex(F.col("o"))).alias("label")).distinct()


def is_edge():
    return M.kind(F.col("o")).isin("I", "N", "_", "S") & (F.col("p") != M.RDF_TYPE) & ~F.startswith("p", F.lit(M.SYS))


def relationship_types(statements: DataFrame) -> DataFrame:
    return statements.where(is_edge()).select(M.string("p").alias("relationshipType")).distinct()


def property_keys(statements: DataFrame) -> DataFrame:
    return statements.where(~M.kind(F.col("o")).isin("I", "N", "_", "S") & ~F.startswith("p", F.lit(M.SYS))).select(M.string("p").alias("propertyKey")).distinct()


def text_search(statements: DataFrame, query: str, mode: str = "all", limit: int = 10) -> DataFrame:
    strings = statements.where(M.kind(F.col("o")).isin("s", "l")).select("eid", M.lex(F.col("o")).alias("text"))
    hits = recall.text_search(strings, query, mode, limit=int(limit)).join(statements.select("eid", "s"), "eid")
    return hits.select(M.statement_ref("eid").alias("statement"), F.col("s").alias("node"), M.double("score").alias("score"), M.integer("rank").alias("rank"))


def ask_goal(statements: DataFrame, program: str, goal: str) -> DataFrame:
    from .datalog import datalog

    return datalog(program, goal, statements, M.HISTORY)


def conflicts(statements: DataFrame) -> DataFrame:
    from ..operators.temporal import conflicts as found

    x = found(statements)
    return x.select("s", M.string("p").alias("predicate"), M.statement_ref("eid_a").alias("a"), M.statement_ref("eid_b").alias("b"))


def vector_search(statements: DataFrame, vector: list, metric: str = "cosine", limit: int = 10) -> DataFrame:
    """Statements whose object is a vector literal (datatype sys:vector, numbers between commas) nearest to a vector."""
    x = statements.where(F.startswith("o", F.lit("x:sys:vector|"))).select("eid", F.split(M.lex(F.col("o")), ",").cast("array<double>").alias("vec"))
    hits = recall.vector_search(x, [float(v) for v in vector], metric, int(limit), "eid", "vec").join(statements.select("eid", "s"), "eid")
    return hits.select(M.statement_ref("eid").alias("statement"), F.col("s").alias("node"), M.double("score").alias("score"), M.integer("rank").alias("rank"))


def path(statements: DataFrame, start: str, path: str, mode: str = "reach", most: int | None = None) -> DataFrame:
    """The nodes that a path reaches from a node, and in how many hops."""
    from ..operators import paths

    starts = statements.sparkSession.createDataFrame([(f"I:{start}",)], "node string")
    kind = mode.split("_")[0]
    if kind == "reach":
        x = paths.reach(statements, starts, path, None if most is None else int(most)).rows
    elif kind == "trail":
        x = paths.trails(statements, starts, path, 64 if most is None else int(most)).rows
    else:
        x = paths.shortest(statements, starts, path, kind, None if most is None else int(most)).rows
    return x.select("node", M.integer("hops").alias("hops"))


PROCEDURES = {"db.labels": labels, "db.relationshipTypes": relationship_types, "db.propertyKeys": property_keys, "text.search": text_search, "datalog.goal": ask_goal, "time.conflicts": conflicts, "vector.search": vector_search, "path.find": path}
