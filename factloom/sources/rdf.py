"""RDF text in and out: N-Triples, statements with both clocks, result JSON, and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..plans.settle import numbered, reachable, settled

#: One line of N-Triples: subject, predicate, object, and a literal's parts.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'
XSD = "http://www.w3.org/2001/XMLSchema#"


def unescaped(c: Column) -> Column:
    for plain, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"'), ("\\", "\\\\")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def escaped(c: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def parsed(lines: DataFrame, *keep: str) -> DataFrame:
    """(s, p, o) and the columns named of lines (column value); comments and blank lines have none."""
    g = lambda i: F.regexp_extract("value", LINE, i)
    x = lines.where(F.col("value").rlike(LINE))
    text, dt = unescaped(g(6)), g(7)
    literal = (
        F.when(g(8) != "", F.concat(F.lit("l:"), F.lower(g(8)), F.lit("|"), text)).when((dt == "") | (dt == XSD + "string"), M.string(text))
        .when(dt == XSD + "integer", M.integer(text.try_cast("decimal(38,0)"))).when(dt == XSD + "double", M.double(text.try_cast("double"))).when(dt == XSD + "decimal", F.concat(F.lit("m:"), text))
        .when(dt == XSD + "boolean", F.concat(F.lit("b:"), F.when(text.isin("1", "true"), "true").otherwise("false"))).when(dt == XSD + "date", M.date(F.unix_date(text.try_cast("date"))))
        .when(dt == XSD + "dateTime", M.date_time(F.unix_millis(F.try_to_timestamp(text)))).otherwise(F.concat(F.lit("x:"), dt, F.lit("|"), text))
    )
    o = F.when(g(3).startswith("<"), M.iri(g(4))).when(g(3).startswith("_:"), F.concat(F.lit("_:"), g(5))).otherwise(literal)
    s = F.when(g(1).startswith("<"), M.iri(F.regexp_extract(g(1), "^<(.*)>$", 1))).otherwise(g(1))
    return x.select(s.alias("s"), g(2).alias("p"), o.alias("o"), *keep)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def term_text(k: Column) -> Column:
    """A term in N-Triples."""
    dt = M.datatype(k)
    full = F.when(dt.startswith("xsd:"), F.concat(F.lit(XSD), F.substr(dt, F.lit(5)))).otherwise(dt)
    quoted = F.concat(F.lit('"'), escaped(M.lex(k)), F.lit('"'))
    kind = M.kind(k)
    return (
        F.when(kind == "I", F.concat(F.lit("<"), M.body(k), F.lit(">"))).when(kind.isin("_", "N"), F.concat(F.lit("_:"), M.body(k)))
        .when(kind == "S", F.concat(F.lit("<urn:statement:"), M.body(k), F.lit(">"))).when(kind == "T", F.concat(F.lit("<urn:tx:"), M.body(k), F.lit(">")))
        .when(kind == "s", quoted).when(kind == "l", F.concat(quoted, F.lit("@"), M.lang(k))).otherwise(F.concat(quoted, F.lit("^^<"), full, F.lit(">")))
    )


def ntriples(facts: DataFrame) -> DataFrame:
    """(value): a line a fact."""
    return facts.select(F.concat(term_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), term_text(F.col("o")), F.lit(" .")).alias("value"))


def statement_graph(statements: DataFrame) -> DataFrame:
    """(value): every statement reified, with both clocks, in N-Triples with triple terms."""
    ref = F.concat(F.lit("<urn:statement:"), F.col("eid").cast("string"), F.lit(">"))
    triple = F.concat(F.lit("<<( "), term_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), term_text(F.col("o")), F.lit(" )>>"))
    fact = lambda p, o: F.when(o.isNotNull(), F.concat(ref, F.lit(f" <{p}> "), o, F.lit(" .")))
    number = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit(f'"^^<{XSD}integer>'))
    lines = F.array(fact("rdf:reifies", triple), *[fact(f"sys:{p}", number(c)) for p, c in (("txAdded", "t_add"), ("txRetracted", "t_ret"), ("validFrom", "v_from"), ("validTo", "v_to"), ("retractKind", "ret_kind"))])
    return statements.select(F.explode(F.array_compact(lines)).alias("value"))


def result_json(rows: DataFrame) -> DataFrame:
    """(value): a row's bindings as SPARQL JSON; unbound variables are left out."""

    def cell(c: str) -> Column:
        k = F.col(c)
        kind = F.when(M.kind(k) == "I", "uri").when(M.kind(k).isin("N", "_"), "bnode").otherwise("literal")
        plain = M.kind(k).isin("s", "l", "I", "N", "_")
        return F.when(k.isNotNull(), F.struct(kind.alias("type"), M.lex(k).alias("value"), F.when(~plain, M.datatype(k)).alias("datatype"), F.when(M.kind(k) == "l", M.lang(k)).alias("xml:lang"))).alias(c)

    return rows.select(F.to_json(F.struct(*[cell(c) for c in rows.columns])).alias("value"))


def bundle(statements: DataFrame, roots: DataFrame, view: M.View = M.NOW) -> DataFrame:
    """(value): the roots and all statements about them as JSON lines, to carry elsewhere."""
    from ..operators.paths import FEW, dependents

    roots = settled(roots.select("eid").distinct())
    ids = settled(dependents(statements, roots, view).unionByName(roots))
    return M.seen(statements, view).join(F.broadcast(ids) if ids.count() <= FEW else ids, "eid", "left_semi").select(F.to_json(F.struct("eid", "s", "p", "o", "v_from", "v_to")).alias("value"))


def import_bundle(spark: SparkSession, lines: DataFrame, next_eid: int, t: int) -> DataFrame:
    """Statements of a bundle under fresh eids; references inside the bundle follow."""
    x = lines.select(F.from_json("value", "eid bigint, s string, p string, o string, v_from bigint, v_to bigint").alias("r")).select("r.*")
    ids = settled(numbered(x.select(F.col("eid").alias("old")), ["old"], "new", next_eid))
    x = x.join(ids, F.col("eid") == F.col("old"))
    for c in ("s", "o"):
        side = ids.select(M.statement_ref("old").alias("k"), M.statement_ref("new").alias("moved"))
        x = x.join(side, F.col(c) == F.col("k"), "left").withColumn(c, F.coalesce("moved", c)).drop("k", "moved")
    return x.select(F.col("new").alias("eid"), "s", "p", "o", F.lit(t).cast("bigint").alias("t_add"), F.lit(None).cast("bigint").alias("t_ret"), "v_from", "v_to", F.lit(None).cast("tinyint").alias("ret_kind"))


def turtle_rows(text: str, prefixes: dict | None = None) -> list[tuple]:
    """The facts of a Turtle text: prefixes, ; and , lists, literals."""
    import re

    from ..plans import ir
    from ..plans.sparql import Parser

    head = "".join(f"PREFIX {k}: <{v}>\n" for k, v in (prefixes or {}).items())
    p = Parser(head + re.sub(r"@prefix\s+(\S*)\s*(<[^>]*>)\s*\.", r"PREFIX \1 \2", text))
    rows = []
    while p.peek()[0]:
        p.prologue()
        if p.peek()[0] and not p.word("."):
            for t in p.triples():
                name = lambda x: f"_:{x.name.lstrip('_')}" if isinstance(x, ir.Var) else x if isinstance(x, str) and x[1:2] == ":" else M.key(x)
                rows.append((name(t.s), t.p, name(t.o)))
    return rows


def turtle(spark: SparkSession, text: str) -> DataFrame:
    """(s, p, o) of a small Turtle text, read on the driver."""
    return spark.createDataFrame(turtle_rows(text), "s string, p string, o string")


def read_turtle(blocks: DataFrame, prefixes: dict | None = None) -> DataFrame:
    """(s, p, o) of Turtle blocks (column value), each of whole statements, read where they lie.

    Lines of prefixes must be given apart, as a name and an IRI each. A file of statements that
    end their lines gives such blocks by ``spark.read.option("lineSep", " .\\n").text(path)``.
    """
    import pyarrow as pa

    reachable(blocks.sparkSession)

    def run(batches):
        for b in batches:
            rows = [r for v in b.column("value").to_pylist() if v and v.strip() for r in turtle_rows(v, prefixes)]
            s, p, o = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(s, pa.string()), pa.array(p, pa.string()), pa.array(o, pa.string())], ["s", "p", "o"])

    return blocks.select("value").mapInArrow(run, "s string, p string, o string")


def turtle_text(facts: DataFrame) -> DataFrame:
    """(value): a block for each subject and sixteenth of its facts, with ; between predicates and , between objects."""
    x = facts.select(term_text(F.col("s")).alias("s"), "p", term_text(F.col("o")).alias("o")).withColumn("part", F.pmod(F.xxhash64("p", "o"), F.lit(16)))
    objects = x.groupBy("s", "part", "p").agg(F.concat(F.lit("<"), F.col("p"), F.lit("> "), F.array_join(F.array_sort(F.collect_set("o")), " , ")).alias("line"))
    return objects.groupBy("s", "part").agg(F.concat(F.col("s"), F.lit(" "), F.array_join(F.array_sort(F.collect_list("line")), " ;\n  "), F.lit(" .")).alias("value")).select("value")


def nquads(lines: DataFrame) -> DataFrame:
    """(s, p, o, graph) of N-Quads lines; graph is null in the default graph."""
    graph = F.regexp_extract("value", r"\s<([^>]*)>\s*\.\s*$", 1)
    four = F.regexp_replace("value", r"\s<[^>]*>\s*\.\s*$", " .")
    is_quad = four.rlike(LINE) & (graph != "")
    x = lines.select(F.when(is_quad, four).otherwise(F.col("value")).alias("value"), F.when(is_quad, F.concat(F.lit("I:"), graph)).alias("graph")).where(F.col("value").rlike(LINE))
    return parsed(x, "graph")
