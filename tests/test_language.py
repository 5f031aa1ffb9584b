"""Exact numbers, paths and maps of Cypher, loose joins, rules by demand, budgets, and the JSON operations."""

import itertools
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom import jsonops, mcp
from factloom import model as M
from factloom.__main__ import main
from factloom.api import Graph
from factloom.errors import InvalidQuery, LimitExceeded, Unsupported
from factloom.operators import paths, recall, temporal, writes
from factloom.plans import cyclic, ir
from factloom.plans import datalog as D
from factloom.plans.cypher import cypher
from factloom.plans.lower import Lowering
from factloom.plans.settle import Layers, numbered
from factloom.plans.sparql import sparql
from factloom.sources import rdf

I = M.Iri  # noqa: E741
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
KNOWS = [("alice", "bob"), ("bob", "carol"), ("bob", "carol"), ("carol", "alice"), ("carol", "dave")]


@pytest.fixture(scope="module")
def people(spark):
    rows = []
    for name, age in (("alice", 41), ("bob", 30), ("carol", 25), ("dave", None)):
        rows += [(I(name), M.RDF_TYPE, I("Person")), (I(name), "name", name)] + ([(I(name), "age", age)] if age else [])
    rows += [(I(a), "knows", I(b)) for a, b in KNOWS]
    rows.append((M.Ref(12), "since", 1999))
    return M.literal(spark, [(i, *r, 1) for i, r in enumerate(rows, 1)]).cache()


def one(people, text, **params):
    return [tuple(r) for r in cypher(text, people, params=params).collect()]


# --- numbers ---------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["1 / 0", "1 % 0", "9223372036854775807 + 1", "-9223372036854775807 - 2", "9223372036854775807 * 2"])
def test_integer_errors_raise(people, text):
    with pytest.raises(Exception, match="by zero|overflow"):
        one(people, f"RETURN {text} AS x")


def test_sum_beyond_64_bits_raises(people):
    with pytest.raises(Exception, match="overflow"):
        one(people, "UNWIND [9223372036854775807, 1] AS x RETURN sum(x) AS s")


def test_floats_divide_by_zero(people):
    assert one(people, "RETURN 1.0 / 0 AS a, -1.0 / 0 AS b, 0.0 / 0 AS c") == [("d:Infinity", "d:-Infinity", "d:NaN")]


@FEW
@given(a=st.integers(-(1 << 62), 1 << 62), b=st.integers(-(1 << 62), 1 << 62))
def test_integers_are_exact(people, a, b):
    cut = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if b else 0
    got = one(people, "RETURN $a + $b AS s, $a - $b AS d, $a < $b AS l, $a = $b AS e, CASE WHEN $b <> 0 THEN $a / CASE WHEN $b = 0 THEN 1 ELSE $b END ELSE 0 END AS q", a=a, b=b)
    assert got == [(f"i:{a + b}", f"i:{a - b}", f"b:{str(a < b).lower()}", f"b:{str(a == b).lower()}", f"i:{cut}")]


def test_sparql_overflow_is_unbound(spark, people):
    x = sparql("SELECT ?y { <alice> <age> ?a BIND(?a * 9223372036854775807 AS ?y) }", people)
    assert [r.y for r in x.collect()] == [None]


def test_distinct_is_by_value(people):
    got = one(people, "UNWIND [1, 1.0, 1, 5, 'a', 'a'] AS x RETURN count(DISTINCT x) AS n, size(collect(DISTINCT x)) AS k")
    assert got == [("i:3", "i:3")]
    assert one(people, "UNWIND [1, 1.0, 5] AS x RETURN sum(DISTINCT x) AS s, avg(DISTINCT x) AS a") == [("d:6.0", "d:3.0")]


# --- paths and maps ----------------------------------------------------------------------


def brute_trails(most):
    """(start, end, edges) of every walk of 1 to ``most`` edges that uses none twice."""
    out, front = [], [(a, b, (i,)) for i, (a, b) in enumerate(KNOWS)]
    for _ in range(most):
        out += front
        front = [(a, KNOWS[j][1], w + (j,)) for a, b, w in front for j in range(len(KNOWS)) if KNOWS[j][0] == b and j not in w]
    return out


def test_variable_length_is_trails(people):
    got = one(people, "MATCH p = (a)-[r:knows*1..3]->(b) RETURN a, b, length(p) AS n, size(r) AS k")
    assert sorted(got) == sorted((f"I:{a}", f"I:{b}", f"i:{len(w)}", f"i:{len(w)}") for a, b, w in brute_trails(3))
    unbound = one(people, "MATCH (a {name: 'alice'})-[:knows*]->(b) RETURN b")
    assert sorted(unbound) == sorted((f"I:{b}",) for a, b, _ in brute_trails(9) if a == "alice")


def test_relationships_of_a_match_differ(people):
    got = one(people, "MATCH (a)-[e:knows]->(b)-[:knows*1..2]->(c) RETURN count(*) AS n")
    assert got == [(f"i:{sum(2 <= len(w) <= 3 for *_, w in brute_trails(3))}",)]


def test_both_directions_meet_a_loop_once(spark):
    loop = M.literal(spark, [(1, I("a"), "p", I("a"), 1), (2, I("a"), "p", I("b"), 1)])
    assert one(loop, "MATCH (x)-[:p]-(y) RETURN count(*) AS n") == [("i:3",)]


def test_shortest_paths(people):
    assert one(people, "MATCH (a {name: 'alice'}), (b {name: 'dave'}), p = shortestPath((a)-[:knows*]->(b)) RETURN nodes(p) AS n, length(p) AS l") == [(["I:alice", "I:bob", "I:carol", "I:dave"], "i:3")]
    assert len(one(people, "MATCH p = allShortestPaths((a {name: 'alice'})-[:knows*]->(b {name: 'dave'})) RETURN relationships(p) AS r")) == 2
    with pytest.raises(Unsupported):
        one(people, "MATCH p = shortestPath((a)-[:knows*]->(b)-[:knows]->(c)) RETURN p")


def test_paths_of_optional_matches_may_be_missing(people):
    got = one(people, "MATCH (n:Person) OPTIONAL MATCH p = (n)-[:knows]->({name: 'dave'}) RETURN n, length(p) AS l")
    assert sorted(got, key=str) == [("I:alice", None), ("I:bob", None), ("I:carol", "i:1"), ("I:dave", None)]


def test_entities_and_maps(people):
    assert one(people, "MATCH (n {name: 'bob'}) RETURN keys(n) AS k, properties(n) AS p, n {.*, z: 1} AS m") == [(["s:age", "s:name"], {"age": "i:30", "name": "s:bob"}, {"age": "i:30", "name": "s:bob", "z": "i:1"})]
    assert one(people, "MATCH ()-[r:knows]->() WHERE r.since = 1999 RETURN keys(r) AS k, properties(r) AS p") == [(["s:since"], {"since": "i:1999"})]
    assert one(people, "RETURN {a: 1, b: 'x'}['b'] AS v, {a: 1}.nope AS w, keys({}) AS k") == [("s:x", None, [])]
    assert sorted(one(people, "MATCH (n) RETURN n")) == [(f"I:{n}",) for n in ("alice", "bob", "carol", "dave")]
    assert one(people, "MATCH (n) WHERE NOT (n)-[:knows]->() AND n:Person RETURN n.name") == [("s:dave",)]


def test_create_makes_a_relationship_a_row(people):
    g = Graph.over(people).cypher_write("MATCH (a)-[:knows]->(b) CREATE (a)-[:met]->(b)")
    assert g.triples(p="met").count() == len(KNOWS)


# --- joins ------------------------------------------------------------------------------------

CELLS = st.sampled_from([None, "s:1", "s:2"])
ROWS = st.lists(st.tuples(CELLS, CELLS), min_size=0, max_size=6)


@FEW
@given(left=ROWS, right=ROWS)
def test_minus_and_exists_with_missing_values(spark, people, left, right):
    frame = lambda rows: ir.Table(spark.createDataFrame(rows, "x string, y string"), frozenset("xy"))
    low = Lowering(people)
    agree = lambda a, b: all(p is None or q is None or p == q for p, q in zip(a, b))
    share = lambda a, b: any(p is not None and q is not None for p, q in zip(a, b))
    run = lambda op: sorted((tuple(r) for r in low.run(op).select("x", "y").collect()), key=str)
    order = lambda rows: sorted(rows, key=str)
    assert run(ir.Minus(frame(left), frame(right))) == order(a for a in left if not any(agree(a, b) and share(a, b) for b in right))
    assert run(ir.Filter(frame(left), (ir.Exists(frame(right)),))) == order(a for a in left if any(agree(a, b) for b in right))
    assert run(ir.Filter(frame(left), (ir.Exists(frame(right), True),))) == order(a for a in left if not any(agree(a, b) for b in right))


def test_cyclic_patterns_close_early():
    t = lambda a, b: ir.Triple(ir.Var(a), "p", ir.Var(b))
    four = [t("a", "b"), t("c", "d"), t("b", "c"), t("d", "a")]
    assert cyclic.is_cyclic(four)
    bound = set()
    for i, p in enumerate(cyclic.ordered(four)):
        assert not i or {p.s.name, p.o.name} & bound
        bound |= {p.s.name, p.o.name}
    path = [t("a", "b"), t("c", "d"), t("b", "c")]
    assert cyclic.ordered(path) == path


@FEW
@given(edges=st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=16))
def test_cycles_against_loops(spark, edges):
    store = M.literal(spark, [(i, I(f"n{a}"), "p", I(f"n{b}"), 1) for i, (a, b) in enumerate(sorted(edges), 1)])
    count = lambda text: sparql(text, store).collect()[0][0]
    e = set(edges)
    assert count("SELECT (COUNT(*) AS ?n) { ?a <p> ?b . ?c <p> ?a . ?b <p> ?c }") == sum((a, b) in e and (b, c) in e and (c, a) in e for a, b, c in itertools.product(range(6), repeat=3))
    assert count("SELECT (COUNT(*) AS ?n) { ?a <p> ?b . ?c <p> ?d . ?b <p> ?c . ?d <p> ?a }") == sum((a, b) in e and (b, c) in e and (c, d) in e and (d, a) in e for a, b, c, d in itertools.product(range(6), repeat=4))


# --- loops and numbering ----------------------------------------------------------------------


def test_numbers_of_a_whole_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert {r.v: r.n for r in numbered(df, ["v"], "n", 5).collect()} == {v: v + 5 for v in range(1000)}
    assert numbered(df.limit(0), ["v"], "n").count() == 0


def test_layers_keep_all_rows(spark):
    x = Layers(spark.range(1))
    for i in range(1, 40):
        x.add(spark.range(i, i + 1))
        assert len(x.parts) <= Layers.MOST
    assert sorted(r.id for r in x.rows.collect()) == list(range(40))


def test_long_chains(spark):
    chain = M.literal(spark, [(i, I(f"n{i}"), "p", I(f"n{i + 1}"), 1) for i in range(1, 31)])
    got = paths.reach(chain, spark.createDataFrame([("I:n1",)], "node string"), "p+").rows
    assert {r.node: r.hops for r in got.collect()} == {f"I:n{i + 1}": i for i in range(1, 31)}


# --- rules ---------------------------------------------------------------------------------------

PROGRAMS = [
    "reach(X, Y) :- knows(X, Y). reach(X, Z) :- reach(X, Y), knows(Y, Z).",
    "reach(X, Y) :- knows(X, Y). reach(X, Z) :- knows(X, Y), reach(Y, Z).",
    "reach(X, Y) :- knows(X, Y). reach(X, Z) :- reach(X, Y), reach(Y, Z).",
    "reach(X, Y) :- link(Y, X). link(X, Y) :- knows(Y, X). link(X, Y) :- link(X, Z), knows(Y, Z), Z != X.",
]


@pytest.mark.parametrize("text", PROGRAMS)
def test_demand_changes_no_answer(people, text):
    for goal in ("reach(alice, Y)", "reach(X, dave)", "reach(bob, alice)", "reach(dave, X)"):
        rows = [sorted(map(tuple, D.datalog(text, goal, people, magic=magic).collect())) for magic in (True, False)]
        assert rows[0] == rows[1]


def test_demand_derives_less(people):
    a = D.answered(PROGRAMS[0], "reach(dave, Y)", people)
    assert sum(x.count() for name, x in a.program.facts.items() if name.startswith("reach")) == 0
    rules, goal = D.demanded(D.checked(D.Parser("odd(X) :- age(X, N), not old(X). old(X) :- age(X, N), N > 40.").program()), D.Parser("odd(bob)").atom())
    assert goal.name == "odd" and len(rules) == 2  # negation: as it was


def test_proofs_rest_on_statements(people):
    p = D.proof(PROGRAMS[0], "reach(alice, dave)", people)
    eids = []

    def walk(q):
        eids.extend(q["eids"])
        for below in q["from"]:
            walk(below)

    walk(p)
    edges = {r.eid: (r.s, r.o) for r in people.where("p = 'knows'").collect()}
    way = [edges[e] for e in sorted(eids)]
    assert way[0][0] == "I:alice" and way[-1][1] == "I:dave" and all(a[1] == b[0] for a, b in zip(way, way[1:]))
    assert D.proof(PROGRAMS[0], "reach(dave, alice)", people) is None


def test_rules_that_never_rest(people):
    text = "n(0) :- knows(X, Y). n(M) :- n(N), M = N + 1."
    a = D.answered(text, "n(N)", people, magic=False, most=4, partial=True)
    assert a.verdict == "incomplete" and a.rows.count() == 5
    with pytest.raises(LimitExceeded):
        D.answered(text, "n(N)", people, magic=False, most=4)


def test_equal_values_share_a_rank(spark):
    df = spark.createDataFrame([("i:1",), ("d:1.0",), ("i:3",), ("s:a",)], "v string")
    assert {r.v: r["rank"] for r in D.with_rank(df, ["v"]).collect()} == {"i:1": 1, "d:1.0": 1, "i:3": 2, "s:a": 3}


# --- the graph object ------------------------------------------------------------------------------


def test_budgets(people):
    ask = "SELECT ?s { ?s <name> ?n }"
    assert Graph.over(people, max_rows=4, max_bytes=1000, deadline=60).sparql(ask).count() == 4
    for budget in ({"max_rows": 3}, {"max_bytes": 20}):
        with pytest.raises(LimitExceeded):
            Graph.over(people, **budget).sparql(ask)


def test_a_late_answer_is_cancelled(spark, people):
    slow = spark.range(0, 60, 1, 60).selectExpr("reflect('java.lang.Thread', 'sleep', 500L) AS x")
    with pytest.raises(LimitExceeded):
        Graph.over(people, deadline=1.0).run(ir.Table(slow))


def test_dry_runs_keep_nothing(people):
    g = Graph.over(people)
    same, report = g.transact(lambda x: x.retract_matching(p="knows"), dry_run=True)
    assert same is g and report["retract"] == len(KNOWS) + 1
    kept, report = g.transact(lambda x: x.assert_([(I("eve"), "knows", I("bob"))]))
    assert report["assert"] == 1 and kept.triples(p="knows").count() == len(KNOWS) + 1


def test_derived_values_replace_each_other(people):
    g = Graph.over(people).derive([(I("bob"), "risk", "low")], [2]).upsert_derived([(I("bob"), "risk", "high")], [5])
    assert [r.o for r in g.values("I:bob", "risk").collect()] == ["s:high"]
    g, names = g.new_nodes(2)
    assert len(set(names)) == 2 and all(n.startswith("N:") for n in names)


def test_requests_in_json(people):
    g = Graph.over(people)
    assert jsonops.read(g, json.dumps({"op": "cypher", "text": "MATCH (n:Person) RETURN count(*) AS n"})) == {"columns": ["n"], "rows": [["i:4"]]}
    assert jsonops.read(g, {"op": "path", "start": ["I:alice"], "path": "knows{1}"})["verdict"] == "exhaustive"
    assert jsonops.read(g, {"op": "proof", "program": PROGRAMS[0], "fact": "reach(alice, bob)"})["proof"]["eids"] == [12]
    made, report = jsonops.write(g, {"op": "assert", "facts": [["I:eve", "age", 7]]})
    assert report["assert"] == 1 and jsonops.read(made, {"op": "values", "s": "I:eve", "p": "age"})["rows"] == [["i:7"]]
    assert jsonops.read(made, {"op": "values", "s": "I:eve", "p": "age", "as_of": 1})["rows"] == []
    for bad in ("[]", '{"op": "nope"}', '{"op": "sparql"}'):
        with pytest.raises(InvalidQuery):
            jsonops.read(g, bad)


def test_tools(people):
    s = mcp.Server(Graph.over(people))
    names = {t["name"] for t in s.answer({"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert names == set(mcp.NEEDS) and {n if n != "cypherWrite" else "cypher" for n in names} == set(jsonops.READS) | set(jsonops.WRITES)
    call = lambda name, **a: s.answer({"id": 2, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert not call("assert", facts=[["I:eve", "name", "eve"]])["isError"]
    assert json.loads(call("values", s="I:eve", p="name")["content"][0]["text"])["rows"] == [["s:eve"]]
    assert call("cypher", text="NONSENSE")["isError"] and s.answer({"method": "notifications/initialized"}) is None


def test_table_functions_in_sql(people):
    g = Graph.over(people)
    assert sorted(r.o for r in g.sql("SELECT s.o FROM path('alice', 'knows+') p JOIN statement s ON s.s = p.node WHERE s.p = 'name'").collect()) == ["s:alice", "s:bob", "s:carol", "s:dave"]
    assert [r.n for r in g.sql("SELECT count(*) AS n FROM goal('old(X) :- age(X, N), N > 40.', 'old(X)')").collect()] == [1]


@pytest.mark.parametrize("mode,query", [("all", "a b"), ("any", "a c*"), ("phrase", "a b"), ("phrase", "a a"), ("any", "zz")])
def test_an_index_gives_the_same_hits(spark, tmp_path, mode, query):
    texts = ["a b a b c", "b a", "a a a a", "cat a, B!", "", None, "d"]
    df = spark.createDataFrame(list(enumerate(texts)), "eid int, text string")
    recall.TextIndex.over(df).save(str(tmp_path / "index"))
    index = recall.TextIndex.load(spark, str(tmp_path / "index"))
    show = lambda x: [(r.eid, round(r.score, 9), r["rank"]) for r in x.orderBy("rank").collect()]
    assert show(index.search(query, mode)) == show(recall.text_search(df, query, mode))


def test_command_line(tmp_path, capsys):
    d = str(tmp_path / "store")
    main(["create", d, "0"])
    main(["write", d, "0", '{"op": "assert", "facts": [["I:a", "knows", "I:b"], ["I:b", "knows", "I:c"]]}', "1"])
    main(["materialise", d, "1", "r(X, Y) :- knows(X, Y). r(X, Z) :- r(X, Y), knows(Y, Z).", "r", "reaches", "2"])
    main(["convert", d, "2", f"{d}-orc", "orc"])
    capsys.readouterr()
    main(["path", d, "2", "I:a", "knows+"])
    assert [line.split("\t")[1:] for line in capsys.readouterr().out.splitlines()] == [["I:b", "1"], ["I:c", "2"]]
    main(["sparql", d, "2", "SELECT ?y { <a> <reaches> ?y }"])
    assert sorted(capsys.readouterr().out.split()) == ["I:b", "I:c"]
    main(["check", d, "2", "bad(X) :- reaches(X, c)."])
    assert sorted(capsys.readouterr().out.split()) == ["I:a", "I:b", "bad", "bad"]
    main(["read", d, "2", '{"op": "values", "s": "I:b", "p": "knows"}'])
    assert json.loads(capsys.readouterr().out)["rows"] == [["I:c"]]


def test_turtle_text(spark, people):
    x = people.where("p in ('name', 'knows')")
    back = rdf.read_turtle(rdf.turtle_text(x))
    assert {tuple(r) for r in back.collect()} == {(r.s, r.p, r.o) for r in x.collect()}


def test_memberships_end(people):
    s = writes.Store.over(people).begin()
    ids = people.where("p = 'name'").select("eid")
    s, _ = writes.add_to_graph(s, ids, "I:g")
    assert writes.graph_members(s.statements, "I:g").count() == 4
    s = writes.remove_from_graph(s.begin(), ids.limit(1), "I:g")
    assert writes.graph_members(s.statements, "I:g").count() == 3 and s.live().where("p = 'name'").count() == 4


@FEW
@given(rows=st.lists(st.tuples(st.integers(0, 12), st.integers(1, 9), st.integers(-5, 5), st.sampled_from(["a", "b"])), min_size=1, max_size=12))
def test_least_and_greatest_at_every_instant(spark, rows):
    df = spark.createDataFrame([(k, f, f + n, x) for f, n, x, k in rows], "k string, v_from bigint, v_to bigint, x int")
    for kind, pick in (("min", min), ("max", max)):
        got = {}
        for r in temporal.segments(df, ["k"], F.col("x"), kind).collect():
            for i in range(r.v_from, r.v_to):
                assert (r.k, i) not in got
                got[r.k, i] = r.value
        want = {(k, i): pick(x for f, n, x, k2 in rows if k2 == k and f <= i < f + n) for k in "ab" for i in range(25) if any(k2 == k and f <= i < f + n for f, n, _, k2 in rows)}
        assert got == want


def test_open_ends_of_extremes(spark):
    df = spark.createDataFrame([("a", None, 5, 1), ("a", 3, None, 7)], "k string, v_from bigint, v_to bigint, x int")
    assert {tuple(r) for r in temporal.segments(df, ["k"], F.col("x"), "max").select("v_from", "v_to", "value").collect()} == {(None, 3, 1), (3, None, 7)}
