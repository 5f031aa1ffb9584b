"""Cypher functions by name. Lists are arrays of term keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..errors import InvalidQuery
from .sparql import cast_boolean, cast_integer, local, zone
from .values import V, boolean, equal, number, text


def math(f):
    return lambda a: number(f(a[0].number))


def magnitude(a: list[V]) -> V:
    return number(F.abs(a[0].number), a[0].is_whole, F.when(a[0].exact >= 0, a[0].exact).otherwise(F.try_subtract(F.lit(0).cast("bigint"), a[0].exact)))


def component(f):
    return lambda a: number(f(local(a[0])), True)


def length(a: list[V]) -> V:
    if a[0].form == "path":
        return number(F.floor(F.size(a[0].col) / 2), True)
    return number(F.size(a[0].col) if a[0].form == "list" else F.length(a[0].text), True)


def along(odd: int):
    """The nodes (0) or relationships (1) of a path."""
    def call(a: list[V]) -> V:
        if a[0].form != "path":
            raise InvalidQuery("nodes() and relationships() are of paths")
        return V(F.filter(a[0].col, lambda x, i: i % 2 == odd), "list")

    return call


def keys(a: list[V]) -> V:
    if a[0].form != "map":
        raise InvalidQuery("keys() is of nodes, relationships and maps")
    return V(F.transform(F.array_sort(F.map_keys(a[0].col)), M.string), "list")


def properties(a: list[V]) -> V:
    if a[0].form != "map":
        raise InvalidQuery("properties() is of nodes, relationships and maps")
    return a[0]


def now(a: list[V]) -> V:
    return V(M.date_time(F.unix_millis(F.current_timestamp())))


def pick(at):
    return lambda a: V(F.try_element_at(a[0].col, F.lit(at)))


def substring(a: list[V]) -> V:
    """0-based, unlike SPARQL's."""
    begin = a[1].number.cast("int") + 1
    return text(F.substr(a[0].text, begin, a[2].number.cast("int")) if len(a) > 2 else F.substr(a[0].text, begin))


def range_list(a: list[V]) -> V:
    lo, hi = a[0].number.cast("bigint"), a[1].number.cast("bigint")
    step = a[2].number.cast("bigint") if len(a) > 2 else F.lit(1).cast("bigint")
    fits = ((hi >= lo) & (step > 0)) | ((hi <= lo) & (step < 0))
    return V(F.transform(F.when(fits, F.sequence(lo, hi, step)).otherwise(F.array().cast("array<bigint>")), M.integer), "list")


def truncated(kind):
    """truncate('unit', x); the unit is a constant of the query."""

    def call(a: list[V]) -> V:
        at = _trunc(a[0].text, local(a[1]))
        return V(M.date(F.unix_date(at.cast("date"))) if kind == "date" else M.date_time(F.unix_millis(at)))

    return call


def _trunc(unit, at):
    out = None
    for name in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        test = F.lower(unit) == name
        out = F.when(test, F.date_trunc(name, at)) if out is None else out.when(test, F.date_trunc(name, at))
    return out


FUNCTIONS = {
    "isnode": lambda a: boolean(M.kind(a[0].term).isin("I", "N", "_", "S")),
    "id": lambda a: V(a[0].term), "elementid": lambda a: text(a[0].term), "statementid": lambda a: number(M.body(a[0].term).try_cast("bigint"), True),
    "size": length, "length": length, "char_length": length, "isempty": lambda a: boolean(length(a).col == 0),
    "nodes": along(0), "relationships": along(1), "keys": keys, "properties": properties,
    "datetime.statement": now, "datetime.transaction": now, "datetime.realtime": now, "localdatetime.statement": now, "localdatetime.transaction": now, "localdatetime.realtime": now,
    "date.statement": lambda a: V(M.date(F.unix_date(F.current_date()))), "date.transaction": lambda a: V(M.date(F.unix_date(F.current_date()))), "date.realtime": lambda a: V(M.date(F.unix_date(F.current_date()))),
    "timezone": lambda a: text(zone(a[0])), "offset": lambda a: text(zone(a[0])),
    "head": pick(1), "last": pick(-1), "tail": lambda a: V(F.slice(a[0].col, F.lit(2), F.greatest(F.size(a[0].col) - 1, F.lit(0))), "list"),
    "reverse": lambda a: V(F.reverse(a[0].col), "list") if a[0].form == "list" else text(F.reverse(a[0].text)),
    "range": range_list,
    "tostring": lambda a: text(a[0].text), "tointeger": lambda a: cast_integer(a[0]), "toboolean": lambda a: cast_boolean(a[0]),
    "tofloat": lambda a: number(F.coalesce(a[0].number, F.trim(a[0].text).try_cast("double"))),
    "tolower": lambda a: text(F.lower(a[0].text)), "toupper": lambda a: text(F.upper(a[0].text)),
    "tostringornull": lambda a: text(a[0].text), "tointegerornull": lambda a: cast_integer(a[0]), "tobooleanornull": lambda a: cast_boolean(a[0]),
    "tofloatornull": lambda a: number(F.coalesce(a[0].number, F.trim(a[0].text).try_cast("double"))),
    "character_length": length,
    "trim": lambda a: text(F.trim(a[0].text)), "ltrim": lambda a: text(F.ltrim(a[0].text)), "rtrim": lambda a: text(F.rtrim(a[0].text)),
    "substring": substring, "left": lambda a: text(F.left(a[0].text, a[1].number.cast("int"))), "right": lambda a: text(F.right(a[0].text, a[1].number.cast("int"))),
    "replace": lambda a: text(F.replace(a[0].text, a[1].text, a[2].text)),
    "split": lambda a: V(F.transform(F.split(a[0].text, F.concat(F.lit("\\Q"), a[1].text, F.lit("\\E")), -1), M.string), "list"),
    "abs": magnitude, "sign": lambda a: number(F.signum(a[0].number), True), "ceil": math(F.ceil), "floor": math(F.floor), "round": math(lambda x: F.floor(x + 0.5)),
    "sqrt": math(F.sqrt), "exp": math(F.exp), "log": math(F.ln), "log10": math(F.log10), "sin": math(F.sin), "cos": math(F.cos), "tan": math(F.tan), "cot": math(F.cot),
    "asin": math(F.asin), "acos": math(F.acos), "atan": math(F.atan), "degrees": math(F.degrees), "radians": math(F.radians),
    "atan2": lambda a: number(F.atan2(a[0].number, a[1].number)), "haversin": math(lambda x: (1 - F.cos(x)) / 2),
    "isnan": lambda a: boolean(F.isnan(a[0].number)), "e": lambda a: number(F.lit(2.718281828459045)), "pi": lambda a: number(F.lit(3.141592653589793)), "rand": lambda a: number(F.rand()),
    "coalesce": lambda a: V(F.coalesce(*[x.term for x in a])), "exists": lambda a: boolean(a[0].term.isNotNull()),
    "nullif": lambda a: V(F.when(~F.coalesce(equal(a[0], a[1]).col, F.lit(False)), a[0].term)),
    "timestamp": lambda a: number(F.unix_millis(F.current_timestamp()), True), "randomuuid": lambda a: text(F.uuid()),
    "date": lambda a: V(M.date(F.unix_date(F.coalesce(local(a[0]).cast("date"), a[0].text.try_cast("date"))))),
    "datetime": lambda a: V(F.coalesce(F.when(M.kind(a[0].term) == "t", a[0].term), M.date_time(F.unix_millis(F.try_to_timestamp(a[0].text))))),
    "localdatetime": lambda a: V(M.date_time(F.unix_millis(F.coalesce(local(a[0]), F.try_to_timestamp(a[0].text))))),
    "date.truncate": truncated("date"), "datetime.truncate": truncated("datetime"), "localdatetime.truncate": truncated("datetime"),
    "datetime.fromepoch": lambda a: V(M.date_time((a[0].number * 1000).cast("bigint"))), "datetime.fromepochmillis": lambda a: V(M.date_time(a[0].number.cast("bigint"))),
    "year": component(F.year), "month": component(F.month), "day": component(F.dayofmonth), "hour": component(F.hour), "minute": component(F.minute), "second": component(F.second),
    "millisecond": lambda a: number(F.pmod(M.millis(a[0].term), F.lit(1000)), True),
}


def call(name: str, args: list[V]) -> V:
    f = FUNCTIONS.get(name.lower())
    if f is None:
        raise InvalidQuery(f"unknown function {name}")
    return f(args)
