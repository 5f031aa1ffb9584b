"""Values of expressions: a column together with what its strings or numbers stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M


@dataclass(frozen=True)
class V:
    """form: term (canonical key), number, text, bool, list (of keys), or map (of names to keys).

    A number is a double. whole tells whether it is an integer, and exact, a bigint, is that
    integer (null for other numbers); without exact the double itself is taken to be it.
    """

    col: Column
    form: str = "term"
    whole: Column | None = None
    long: Column | None = None

    @property
    def term(self) -> Column:
        if self.form == "term":
            return self.col
        if self.form == "number":
            return F.when(self.is_whole, M.integer(self.exact)).otherwise(M.double(self.col))
        return M.string(self.col) if self.form == "text" else M.boolean(self.col) if self.form == "bool" else self.col

    @property
    def number(self) -> Column:
        if self.form == "number":
            return self.col
        return M.num(self.col) if self.form == "term" else self.col.try_cast("double")

    @property
    def exact(self) -> Column:
        """The integer as a bigint; null for what is none."""
        if self.form == "number":
            return self.long if self.long is not None else F.when(self.is_whole, self.col.try_cast("bigint"))
        return M.whole(self.col) if self.form == "term" else F.lit(None).cast("bigint")

    @property
    def is_whole(self) -> Column:
        if self.form == "number":
            return self.whole if self.whole is not None else F.lit(False)
        return M.kind(self.col) == "i" if self.form == "term" else F.lit(False)

    @property
    def text(self) -> Column:
        return self.col if self.form == "text" else M.lex(self.term)

    @property
    def bool(self) -> Column:
        """The effective boolean value; null for terms that have none."""
        if self.form == "bool":
            return self.col
        if self.form == "number":
            return (self.col != 0) & ~F.isnan(self.col)
        if self.form == "text":
            return F.length(self.col) > 0
        k = M.kind(self.col)
        n = M.num(self.col)
        return F.when(k == "b", M.body(self.col) == "true").when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(k.isin("s", "l"), F.length(M.lex(self.col)) > 0)

    def sort(self, order: tuple = M.VALUE_ORDER) -> Column:
        if self.form == "number":
            return F.struct(self.col.alias("number"), M.exact(self.col, self.exact).alias("whole"))
        return self.col if self.form in ("number", "text", "bool") else M.sort_key(self.col, order)


def number(c: Column, whole: Column | bool = False, long: Column | None = None) -> V:
    return V(c.cast("double"), "number", F.lit(whole) if isinstance(whole, bool) else whole, long)


def integer(c: Column) -> V:
    """An integer from a bigint, exactly."""
    c = c.cast("bigint")
    return V(c.cast("double"), "number", F.lit(True), c)


def text(c: Column) -> V:
    return V(c, "text")


def boolean(c: Column) -> V:
    return V(c, "bool")


def constant(value) -> V:
    if isinstance(value, bool):
        return boolean(F.lit(value))
    if isinstance(value, int):
        return integer(F.lit(value)) if -(1 << 63) <= value < 1 << 63 else V(F.lit(M.key(value)))
    if isinstance(value, float):
        return number(F.lit(value))
    if value is None:
        return V(F.lit(None).cast("string"))
    return V(F.lit(value if isinstance(value, str) and value[1:2] == ":" else M.key(value)))


# --- comparison and arithmetic ----------------------------------------------


def compared(a: V, b: V, test) -> Column:
    """test on two numbers; where they are one as doubles, whole numbers decide."""
    x, y = a.number, b.number
    fine = test(M.exact(x, a.exact), M.exact(y, b.exact))
    return F.when(x == y, F.coalesce(fine, test(x, y))).otherwise(test(x, y))


def equal(a: V, b: V) -> V:
    """Value equality: numbers across types, date-times by instant, else the same term."""
    same = lambda x, y: x == y
    if a.form == b.form == "number":
        return boolean(compared(a, b, same))
    if a.form == b.form and a.form in ("text", "bool"):
        return boolean(a.col == b.col)
    if "number" in (a.form, b.form):
        return boolean(F.coalesce(compared(a, b, same), F.when(a.term.isNotNull() & b.term.isNotNull(), F.lit(False))))
    x, y = a.term, b.term
    return boolean(F.coalesce(compared(V(x), V(y), same), M.millis(x) == M.millis(y), x == y))


def ordered(a: V, b: V, test) -> V:
    """a < b and the like; null where the two cannot be compared."""
    if a.form == b.form and a.form in ("text", "bool"):
        return boolean(test(a.col, b.col))
    if "number" in (a.form, b.form):
        return boolean(compared(a, b, test))
    x, y = a.term, b.term
    same = (M.kind(x) == M.kind(y)) & M.kind(x).isin("s", "l", "b", "D")
    plain = F.when(M.kind(x) == "D", test(M.days(x).cast("double"), M.days(y).cast("double"))).otherwise(test(M.lex(x), M.lex(y)))
    return boolean(F.coalesce(compared(V(x), V(y), test), test(M.millis(x), M.millis(y)), F.when(same, plain)))


WIDE = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def arithmetic(op: str, a: V, b: V) -> V:
    """+ - * keep integers, exactly; / is always real; errors, division by zero and overflow are null."""
    x, y = a.number, b.number
    if op == "/":
        return number(F.try_divide(x, y))
    out = {"+": x + y, "-": x - y, "*": x * y}[op]
    if a.whole is not None and b.whole is not None and a.long is None and b.long is None:
        return number(out, a.is_whole & b.is_whole)
    both = a.is_whole & b.is_whole
    long = WIDE[op](a.exact, b.exact)
    return number(F.when(both, long.cast("double")).otherwise(out), both, long)


def strict(op: str, a: V, b: V) -> V:
    """Cypher's arithmetic: integers stay so and / cuts; overflow, and integers divided by zero, raise."""
    x, y = a.number, b.number
    both = a.is_whole & b.is_whole
    i, j = a.exact, b.exact
    if op in ("/", "%"):
        real = F.when(y != 0, F.try_divide(x, y) if op == "/" else F.try_mod(x, y))
        if op == "/":  # as floats do: signed infinity, or no number for 0 / 0
            real = F.when(y != 0, real).when(x != 0, F.signum(x) * F.lit(float("inf"))).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(float("nan"))))
        else:
            real = F.when(y != 0, real).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(float("nan"))))
        zero = F.raise_error(F.lit("division by zero" if op == "/" else "modulo by zero")).cast("bigint")
        cut = F.try_mod(i, j) if op == "%" else F.when((i == -(1 << 63)) & (j == -1), F.raise_error(F.lit("integer overflow")).cast("bigint")).otherwise(F.call_function("div", i, j))
        long = F.when(both & (j == 0), zero).when(both, cut)
    else:
        real = {"+": x + y, "-": x - y, "*": x * y}[op]
        long = WIDE[op](i, j)
        long = F.when(both & i.isNotNull() & j.isNotNull() & long.isNull(), F.raise_error(F.lit("integer overflow")).cast("bigint")).when(both, long)
    return number(F.when(both, long.cast("double")).otherwise(real), both, long)
