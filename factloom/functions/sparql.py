"""SPARQL functions by name. Arguments and results are V; errors are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery, Unsupported
from .values import V, boolean, number, text

REFUSED = "BNODE RAND UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 TRIPLE SUBJECT PREDICATE OBJECT ISTRIPLE LANGDIR HASLANG HASLANGDIR STRLANGDIR ADJUST".split()


def like(v: V, c: Column) -> V:
    """c with the language of v, if it has one."""
    if v.form != "term":
        return text(c)
    return V(F.when(M.kind(v.col) == "l", F.concat(F.lit("l:"), M.lang(v.col), F.lit("|"), c)).otherwise(M.string(c)))


def pattern(p: V, flags: V | None) -> Column:
    """A Java pattern with SPARQL's flags as an inline group."""
    if flags is None:
        return p.text
    return F.concat(F.when(F.length(flags.text) > 0, F.concat(F.lit("(?"), F.regexp_replace(flags.text, "[^imsx]", ""), F.lit(")"))).otherwise(F.lit("")), p.text)


def local(v: V) -> Column:
    """The timestamp of a date-time or date in its own offset."""
    return F.coalesce(F.timestamp_millis(M.millis(v.term) + M.offset(v.term) * 60000), F.date_from_unix_date(M.days(v.term)).cast("timestamp"))


def zone(v: V) -> Column:
    o = M.offset(v.term)
    sign = F.when(o < 0, "-").otherwise("+")
    return F.when(o == 0, F.lit("Z")).otherwise(F.concat(sign, F.lpad(F.floor(F.abs(o) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(o) % 60).cast("string"), 2, "0")))


def duration(minutes: Column) -> Column:
    """Minutes as hours and minutes of a day-time duration; none are PT0S."""
    h, m = F.floor(F.abs(minutes) / 60).cast("string"), (F.abs(minutes) % 60).cast("string")
    text = F.concat(F.when(minutes < 0, "-PT").otherwise("PT"), F.when(F.abs(minutes) >= 60, F.concat(h, F.lit("H"))).otherwise(""), F.when(minutes % 60 != 0, F.concat(m, F.lit("M"))).otherwise(""))
    return F.when(minutes == 0, F.lit("PT0S")).otherwise(text)


def encode_uri(c: Column) -> Column:
    """Keeps A-Z a-z 0-9 - _ . ~ and codes all other bytes."""
    out = F.url_encode(c)
    for plain, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def lang_matches(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return F.when(b == "*", F.length(a) > 0).otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-"))))


def cast_boolean(v: V) -> V:
    t = F.lower(v.text)
    return boolean(F.coalesce(v.number != 0, F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)))


def cast_integer(v: V) -> V:
    n = F.coalesce(v.number, F.trim(v.text).try_cast("double"))
    long = F.coalesce(v.exact, F.trim(v.text).try_cast("bigint"))
    if v.form == "term":
        n = F.coalesce(n, F.when(M.kind(v.term) == "b", (M.body(v.term) == "true").cast("double")))
    cut = F.signum(n) * F.floor(F.abs(n))
    long = F.when(M.exact(n, long).isNotNull(), long).otherwise(cut.try_cast("bigint"))
    return number(F.when(F.isnan(n) | long.isNull(), None).otherwise(cut), True, long)


def cast_date_time(v: V) -> V:
    t = v.text
    instant = F.unix_millis(F.try_to_timestamp(t))
    o = F.regexp_extract(t, r"([+-])(\d\d):(\d\d)$", 0)
    minutes = F.when(o != "", (F.substring(o, 2, 2).cast("int") * 60 + F.substring(o, 5, 2).cast("int")) * F.when(F.substring(o, 1, 1) == "-", -1).otherwise(1)).otherwise(0)
    return V(F.when(M.kind(v.term) == "t", v.term).otherwise(M.date_time(instant, minutes)))


def substr(a: list[V]) -> V:
    """1-based; begins and lengths may be real and out of range, as in XPath."""
    begin = F.floor(a[1].number + 0.5).cast("int")
    if len(a) == 2:
        return like(a[0], F.substr(a[0].text, F.greatest(begin, F.lit(1))))
    end = begin + F.floor(a[2].number + 0.5).cast("int")
    return like(a[0], F.substr(a[0].text, F.greatest(begin, F.lit(1)), F.greatest(end - F.greatest(begin, F.lit(1)), F.lit(0))))


def before(a: list[V]) -> V:
    at = F.instr(a[0].text, a[1].text)
    return like(a[0], F.when(at > 0, F.substr(a[0].text, F.lit(1), at - 1)).otherwise(F.lit("")))


def after(a: list[V]) -> V:
    at = F.instr(a[0].text, a[1].text)
    return like(a[0], F.when(at > 0, F.substr(a[0].text, at + F.length(a[1].text))).otherwise(F.lit("")))


def real(f):
    return lambda a: number(f(a[0].number), a[0].is_whole)


def part(f):
    return lambda a: number(f(local(a[0])), True)


def tested(f):
    return lambda a: boolean(f(a[0].term))


FUNCTIONS = {
    "STR": lambda a: text(a[0].text),
    "LANG": lambda a: text(M.lang(a[0].term)),
    "DATATYPE": lambda a: V(F.concat(F.lit("I:"), M.datatype(a[0].term))),
    "ISIRI": tested(lambda k: M.kind(k) == "I"), "ISURI": tested(lambda k: M.kind(k) == "I"),
    "ISBLANK": tested(lambda k: M.kind(k).isin("N", "_")), "ISNUMERIC": tested(lambda k: M.kind(k).isin("i", "d", "m")),
    "ISLITERAL": tested(lambda k: ~M.kind(k).isin("I", "N", "_", "S", "T")),
    "STRLEN": lambda a: number(F.length(a[0].text), True),
    "UCASE": lambda a: like(a[0], F.upper(a[0].text)), "LCASE": lambda a: like(a[0], F.lower(a[0].text)),
    "CONTAINS": lambda a: boolean(F.contains(a[0].text, a[1].text)),
    "STRSTARTS": lambda a: boolean(F.startswith(a[0].text, a[1].text)), "STRENDS": lambda a: boolean(F.endswith(a[0].text, a[1].text)),
    "REGEX": lambda a: boolean(F.rlike(a[0].text, pattern(a[1], a[2] if len(a) > 2 else None))),
    "REPLACE": lambda a: like(a[0], F.regexp_replace(a[0].text, pattern(a[1], a[3] if len(a) > 3 else None), a[2].text)),
    "LANGMATCHES": lambda a: boolean(lang_matches(a[0].text, a[1].text)),
    "IRI": lambda a: V(M.iri(a[0].text)), "URI": lambda a: V(M.iri(a[0].text)),
    "STRDT": lambda a: V(F.concat(F.lit("x:"), M.body(a[1].term), F.lit("|"), a[0].text)),
    "STRLANG": lambda a: V(F.concat(F.lit("l:"), F.lower(a[1].text), F.lit("|"), a[0].text)),
    "SUBSTR": substr, "STRBEFORE": before, "STRAFTER": after,
    "CONCAT": lambda a: text(F.concat(*[x.text for x in a])),
    "ENCODE_FOR_URI": lambda a: text(encode_uri(a[0].text)),
    "ABS": real(F.abs), "CEIL": real(F.ceil), "FLOOR": real(F.floor), "ROUND": real(lambda x: F.floor(x + 0.5)),
    "YEAR": part(F.year), "MONTH": part(F.month), "DAY": part(F.dayofmonth), "HOURS": part(F.hour), "MINUTES": part(F.minute),
    "SECONDS": lambda a: number(F.second(local(a[0])) + (F.pmod(M.millis(a[0].term), F.lit(1000)) / 1000), False),
    "TZ": lambda a: text(zone(a[0])),
    "TIMEZONE": lambda a: V(F.concat(F.lit("x:xsd:dayTimeDuration|"), duration(M.offset(a[0].term)))),
    "COALESCE": lambda a: V(F.coalesce(*[x.term for x in a])),
    "IF": lambda a: V(F.when(a[0].bool, a[1].term).when(~a[0].bool, a[2].term)),
    "SAMETERM": lambda a: boolean(a[0].term == a[1].term),
    "BOUND": lambda a: boolean(a[0].term.isNotNull()),
    "XSD:STRING": lambda a: text(a[0].text), "XSD:INTEGER": lambda a: cast_integer(a[0]), "XSD:BOOLEAN": lambda a: cast_boolean(a[0]),
    "XSD:DOUBLE": lambda a: number(F.coalesce(a[0].number, F.trim(a[0].text).try_cast("double"))),
    "XSD:DECIMAL": lambda a: V(F.concat(F.lit("m:"), F.coalesce(a[0].number, F.trim(a[0].text).try_cast("double")).cast("string"))),
    "XSD:DATE": lambda a: V(M.date(F.unix_date(F.coalesce(local(a[0]).cast("date"), F.trim(a[0].text).try_cast("date"))))),
    "XSD:DATETIME": lambda a: cast_date_time(a[0]),
}


def call(name: str, args: list[V]) -> V:
    upper = name.upper()
    if upper in REFUSED:
        raise Unsupported(f"{name}() is not offered")
    if upper not in FUNCTIONS:
        raise InvalidQuery(f"unknown function {name}")
    try:
        return FUNCTIONS[upper](args)
    except IndexError:
        raise InvalidQuery(f"{name}() takes more arguments than {len(args)}") from None
