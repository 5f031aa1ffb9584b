"""The algebra that every query language here lowers to."""

from __future__ import annotations

from dataclasses import dataclass, field

from .. import model as M

# --- expressions -------------------------------------------------------------


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A term key, or a number, string or boolean."""

    value: object


@dataclass(frozen=True)
class Call:
    """A function or operator: = != < <= > >= + - * / && || ! in and the functions of both languages."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    op: object
    negated: bool = False


@dataclass(frozen=True)
class Lookup:
    """The value of a predicate of a bound subject: of the smallest eid, or a list if many. Never multiplies rows.

    The predicate @properties stands for a map of all properties: literals, by predicate.
    """

    subject: Var
    predicate: str
    many: bool = False


@dataclass(frozen=True)
class Each:
    """A comprehension over a list: map, filter, all, any, none, single or reduce."""

    kind: str
    var: str
    source: object
    body: object
    start: object = None
    total: str = ""


# --- operators -----------------------------------------------------------------


@dataclass(frozen=True)
class Triple:
    """s, p, o and eid: Var or term key. iso names the MATCH whose relationships must differ."""

    s: object
    p: object
    o: object
    eid: Var | None = None
    view: M.View | None = None
    graph: object = None  #: None, a tuple of graph keys (a statement in any of them, one time), or a Var (bound to each graph that holds it)
    iso: str | None = None


@dataclass(frozen=True)
class Virtual:
    """One of the computed predicates of a bound statement."""

    eid: Var
    name: str
    value: object
    view: M.View | None = None


@dataclass(frozen=True)
class PathMatch:
    """s path o, from where s or o is bound or from all subjects.

    mode: reach (each end once), trail (each way without a statement twice), any or all (shortest
    ways). bind names the way, a list of nodes and the statements between them; longest is a
    bound on hops, beyond which a search raises if it is the engine's own (capped).
    """

    s: object
    path: object
    o: object
    view: M.View | None = None
    mode: str = "reach"
    bind: str = ""
    longest: int | None = None
    capped: bool = False
    iso: str = ""


@dataclass(frozen=True)
class NodeScan:
    """Every node: subjects of statements but the system's, and nodes that relationships point to."""

    node: Var
    view: M.View | None = None


@dataclass(frozen=True)
class Table:
    """Rows that are there already: hits, goals, VALUES. Columns are the variables."""

    frame: object
    maybe: frozenset = frozenset()


@dataclass(frozen=True)
class Procedure:
    """The rows of a named procedure; yields are (its column, our variable)."""

    name: str
    args: tuple
    yields: tuple


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple  #: of tuples of term keys; None is unbound


@dataclass(frozen=True)
class Join:
    """Parts joined by their common variables; those in null_safe agree where both are missing, too."""

    parts: tuple
    null_safe: tuple = ()


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    on: tuple = ()


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    op: object
    tests: tuple


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Extend:
    op: object
    var: str
    value: object


@dataclass(frozen=True)
class Unnest:
    op: object
    var: str
    value: object


@dataclass(frozen=True)
class Agg:
    name: str
    value: object = None  #: None: rows
    distinct: bool = False
    extra: object = None


@dataclass(frozen=True)
class Aggregate:
    op: object
    keys: tuple
    aggs: tuple  #: of (var, Agg)


@dataclass(frozen=True)
class Project:
    op: object
    vars: tuple
    distinct: bool = False


@dataclass(frozen=True)
class OrderLimit:
    op: object
    keys: tuple = ()  #: of (expression, descending)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class RowNumber:
    op: object
    var: str
    partition: tuple
    keys: tuple


@dataclass(frozen=True)
class Semantics:
    """The four switches in which the languages differ."""

    isomorphism: bool = False
    unbound: bool = True  #: a missing value is compatible with any; else SQL null
    triples: bool = True  #: one match a distinct (s, p, o); else one a statement
    nulls_first: bool = True  #: in ascending order

    options: dict = field(default_factory=dict, hash=False, compare=False)


SPARQL = Semantics()
CYPHER = Semantics(True, False, False, False)
