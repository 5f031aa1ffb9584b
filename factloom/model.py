"""The statement relation, canonical term keys, and views in time.

A fact is one row (eid, s, p, o, t_add, t_ret, v_from, v_to, ret_kind). Terms are canonical
strings, so that equal terms are equal strings and joins need no dictionary:

    I:iri   N:anonymous   _:blank   S:eid   T:transaction   i:integer   d:double   m:decimal
    b:boolean   t:ms|offset   D:days   s:string   l:lang|text   x:datatype|text

Everything here is a column expression over those strings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATEMENT = "eid bigint, s string, p string, o string, t_add bigint, t_ret bigint, v_from bigint, v_to bigint, ret_kind tinyint"
COLUMNS = ("eid", "s", "p", "o", "t_add", "t_ret", "v_from", "v_to", "ret_kind")
EVER_FROM, EVER_TO = -(1 << 62), 1 << 62  #: stand for open ends where numbers are needed

RETRACTED = {"explicit": 0, "cascade": 1, "supersede": 2, "cardinality": 3}

#: Predicates of the system's own statements.
SYS = "sys:"
IN_GRAPH, DERIVED_FROM = "sys:inGraph", "sys:derivedFrom"
CARDINALITY, UNIQUE, VALUE_TYPE, SUBJECT_TYPE = "sys:cardinality", "sys:unique", "sys:valueType", "sys:subjectType"
CONFIDENCE, CONFIRMED_BY, AUTHOR = "sys:confidence", "sys:confirmedBy", "sys:author"
RDF_TYPE = "rdf:type"
VIRTUAL = ("subject", "predicate", "object", "txAdded", "txRetracted", "addedAt", "retractedAt", "validFrom", "validTo", "retractKind")


# --- keys ----------------------------------------------------------------


def iri(x) -> Column:
    return F.concat(F.lit("I:"), _text(x))


def integer(x) -> Column:
    return F.concat(F.lit("i:"), _text(x))


def double(x) -> Column:
    return F.concat(F.lit("d:"), _col(x).cast("double").cast("string"))


def string(x) -> Column:
    return F.concat(F.lit("s:"), _text(x))


def boolean(x) -> Column:
    return F.concat(F.lit("b:"), _text(x))


def statement_ref(x) -> Column:
    return F.concat(F.lit("S:"), _text(x))


def date_time(ms, offset_minutes=0) -> Column:
    return F.concat(F.lit("t:"), _text(ms), F.lit("|"), _text(F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes))


def date(days) -> Column:
    return F.concat(F.lit("D:"), _text(days))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(x) -> Column:
    return _col(x).cast("string")


def key(value) -> str:
    """The canonical key of a Python value; strings that are keys already are IRIs by Iri."""
    if isinstance(value, Iri):
        return f"I:{value.name}"
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"d:{value!r}" if value not in (float("inf"), float("-inf")) else f"d:{'' if value > 0 else '-'}Infinity"
    if isinstance(value, Ref):
        return f"S:{value.eid}"
    return f"s:{value}"


@dataclass(frozen=True)
class Iri:
    name: str


@dataclass(frozen=True)
class Ref:
    """A statement as a term."""

    eid: int


# --- what a key holds ------------------------------------------------------


def kind(k: Column) -> Column:
    return F.substring(k, 1, 1)


def body(k: Column) -> Column:
    return F.substr(k, F.lit(3))


def num(k: Column) -> Column:
    """The number of an integer, decimal or double key, else null."""
    return F.when(kind(k).isin("i", "d", "m"), body(k).try_cast("double"))


def whole(k: Column) -> Column:
    """The whole number of an integer key, exactly, else null (as for integers beyond 64 bits)."""
    return F.when(kind(k) == "i", body(k).try_cast("bigint"))


def exact(n: Column, w: Column) -> Column:
    """The whole number where doubles no longer tell whole numbers apart: w, or the double n itself; else null."""
    return F.when(F.abs(n) >= 2.0**53, F.coalesce(w, n.try_cast("bigint")))


def millis(k: Column) -> Column:
    """The instant of a date-time in ms, else null."""
    return F.when(kind(k) == "t", F.substring_index(body(k), "|", 1).try_cast("bigint"))


def offset(k: Column) -> Column:
    return F.when(kind(k) == "t", F.substring_index(body(k), "|", -1).try_cast("int"))


def days(k: Column) -> Column:
    return F.when(kind(k) == "D", body(k).try_cast("int"))


def lex(k: Column) -> Column:
    """STR(): the plain text of a term."""
    after = F.substr(body(k), F.instr(body(k), "|") + 1)
    return F.when(kind(k).isin("l", "x"), after).when(kind(k) == "t", F.date_format(F.timestamp_millis(millis(k) + offset(k) * 60000), "yyyy-MM-dd'T'HH:mm:ss")).when(kind(k) == "D", F.date_from_unix_date(days(k)).cast("string")).otherwise(body(k))


def lang(k: Column) -> Column:
    return F.when(kind(k) == "l", F.substring_index(body(k), "|", 1)).when(kind(k).isin("I", "N", "_", "S", "T"), F.lit(None)).otherwise(F.lit(""))


def datatype(k: Column) -> Column:
    names = {"i": "xsd:integer", "d": "xsd:double", "m": "xsd:decimal", "b": "xsd:boolean", "t": "xsd:dateTime", "D": "xsd:date", "s": "xsd:string", "l": "rdf:langString"}
    out = F.when(kind(k) == "x", F.substring_index(body(k), "|", 1))
    for c, name in names.items():
        out = out.when(kind(k) == c, F.lit(name))
    return out


#: Kinds of nodes: named, anonymous and blank ones.
NODES = ("I", "N", "_")

#: Letters of kinds in ascending order of values: SPARQL's, and Cypher's.
VALUE_ORDER = ("N_", "I", "S", "T", "idm", "b", "t", "D", "s", "l", "x")
CYPHER_ORDER = ("IN_", "S", "T", "t", "D", "slx", "b", "idm")


def kind_rank(k: Column, order: tuple = VALUE_ORDER) -> Column:
    """Place of a term's kind in an order of values (ORDER BY, min and max)."""
    out = None
    for rank, letters in enumerate(order, 1):
        test = kind(k).isin(*letters)
        out = F.when(test, F.lit(rank)) if out is None else out.when(test, F.lit(rank))
    return out


def sort_key(k: Column, order: tuple = VALUE_ORDER) -> Column:
    """A struct that sorts as the value order does; null for no term."""
    number = F.coalesce(num(k), millis(k).cast("double"), days(k).cast("double"), F.when(kind(k).isin("S", "T", "N"), body(k).try_cast("double")))
    return F.when(k.isNotNull(), F.struct(kind_rank(k, order).alias("kind"), number.alias("number"), exact(num(k), whole(k)).alias("whole"), lex(k).alias("text"), k.alias("term")))


def group_key(k: Column) -> Column:
    """Equal for terms of equal value: 1 and 1.0 are one, as are date-times of one instant."""
    n = num(k)
    return F.coalesce(F.concat(F.lit("#"), F.coalesce(exact(n, whole(k)).cast("string"), n.cast("string"))), F.concat(F.lit("@"), millis(k).cast("string")), k)


# --- views -----------------------------------------------------------------


@dataclass(frozen=True)
class View:
    """Which statements are seen: now, as of a transaction or instant, or all history; and when valid."""

    mode: str = "now"
    at: int | None = None
    valid: int | None = None

    def valid_at(self, ms: int) -> View:
        return replace(self, valid=ms)

    def condition(self, tx: int | None = None) -> Column:
        """The only place where time decides visibility. tx: what the instant resolves to."""
        c = F.lit(True)
        if self.mode == "now":
            c = F.col("t_ret").isNull()
        elif self.mode in ("tx", "instant"):
            t = F.lit(self.at if self.mode == "tx" else tx)
            c = (F.col("t_add") <= t) & (F.col("t_ret").isNull() | (F.col("t_ret") > t))
        if self.valid is not None:
            v = F.lit(self.valid)
            c = c & (F.col("v_from").isNull() | (F.col("v_from") <= v)) & (F.col("v_to").isNull() | (F.col("v_to") > v))
        return c


NOW, HISTORY = View(), View("history")


def as_of(t: int) -> View:
    return View("tx", t)


def at_instant(ms: int) -> View:
    return View("instant", ms)


def tx_of(tx: DataFrame, ms: int) -> int:
    """The last transaction whose instant is not after ms, 0 if none."""
    return tx.where(F.col("instant") <= ms).agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]


def seen(statements: DataFrame, view: View = NOW, tx: DataFrame | None = None) -> DataFrame:
    """The statements a view shows. An instant needs the tx table, or t_add in ms itself."""
    t = None
    if view.mode == "instant":
        t = tx_of(tx, view.at) if tx is not None else view.at
    return statements.where(view.condition(t))


def canonical(statements: DataFrame) -> DataFrame:
    """One statement for each (s, p, o): the smallest eid in the view."""
    keep = F.min_by(F.struct(*[c for c in statements.columns if c not in ("s", "p", "o")]), "eid").alias("r")
    return statements.groupBy("s", "p", "o").agg(keep).select("s", "p", "o", "r.*").select(*statements.columns)


def literal(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Statements from (eid, s, p, o, t_add, t_ret, v_from, v_to, ret_kind) tuples; s, p and o are Python values."""
    done = [(r[0], *[x if isinstance(x, str) and x[1:2] == ":" and len(x) > 1 else key(x) for x in (r[1],)], r[2], r[3] if isinstance(r[3], str) and r[3][1:2] == ":" else key(r[3]), *r[4:], *([None] * (9 - len(r)))) for r in rows]
    return spark.createDataFrame([tuple(x) for x in done], STATEMENT)
