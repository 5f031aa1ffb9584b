"""Writes and searches that touch few statements read the store where it lies, and write none of it."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import jsonops
from factloom import model as M
from factloom.api import Graph
from factloom.catalog import QUERIES
from factloom.operators import paths, temporal, writes
from factloom.plans import settle
from factloom.plans.datalog import Parser, Program, checked, datalog
from factloom.sources import ingest

from .conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layers_rank_lines_once(spark):
    assert plan(ingest.layers(spark, f"{DATA}/sf0.001")).count("Window [") == 1


def test_ranked_layers_are_layers_read_without_ranking(spark):
    a, b = ingest.layers(spark, f"{DATA}/sf0.001"), ingest.ranked_layers(spark, f"{DATA}/sf0.001")
    assert a.dtypes == b.dtypes and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert "Window [" not in plan(b)
    assert "parquet" not in plan(b.where("p = 'other'"))


def test_large_inputs_make_more_tasks(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/sf0.01/lineitem.parquet")
    assert settle.parts(df) == 0
    monkeypatch.setattr(settle, "PART_BYTES", 100_000)
    n = settle.parts(df)
    assert n > 4
    out = settle.settled(df.groupBy("l_orderkey").count())
    assert out.rdd.getNumPartitions() == n
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


@pytest.fixture()
def chain(spark):
    """6 hangs on 5, that on 1 and so on; 20 was derived from 1, but ended before; 30 was derived from 5."""
    rows = [(1, M.Iri("a"), "p", M.Iri("b"), 1), (2, M.Iri("a"), "p", M.Iri("c"), 1), (20, M.Iri("d"), "p", M.Iri("x"), 1, 1), (30, M.Iri("e"), "p", M.Iri("x"), 1)]
    rows += [(eid, M.Ref(on), "about", M.Iri("y"), 1) for eid, on in ((5, 1), (6, 5), (7, 6), (8, 7), (9, 8), (10, 9))]
    rows += [(eid, M.Ref(new), M.DERIVED_FROM, M.key(M.Ref(on)), 1) for eid, new, on in ((21, 20, 1), (31, 30, 5))]
    return writes.Store.over(M.literal(spark, rows)).begin()


def test_cascade_of_few(spark, chain, monkeypatch):
    roots = spark.createDataFrame([(1,), (20,), (99,)], "eid bigint")
    few = {r.eid: (r.depth, r.parent) for r in writes.cascade(chain, roots).collect()}
    assert few == {1: (0, 1), 5: (1, 1), 21: (1, 1), 6: (2, 5), 30: (2, 5), 31: (2, 5), 7: (3, 6), 8: (4, 7), 9: (5, 8), 10: (6, 9)}
    below = {r.eid for r in paths.dependents(chain.statements, roots).collect()}
    assert below == {5, 6, 7, 8, 9, 10, 21, 30, 31}
    monkeypatch.setattr(paths, "FEW", 0)
    assert {r.eid: (r.depth, r.parent) for r in writes.cascade(chain, roots).collect()} == few
    assert {r.eid for r in paths.dependents(chain.statements, roots).collect()} == below


def test_retracting_few_lays_over_the_store(spark, chain):
    s = chain
    for i in range(writes.LAZY + 1):
        s = writes.retract(s, spark.createDataFrame([(10 - i if i < 6 else 2,)], "eid bigint"))
        assert s.lazy == (i + 1 if i < writes.LAZY else 0)
    assert {r.eid for r in s.live().collect()} == {1, 21}


def test_json_lines_are_the_rows_of_the_answer(spark):
    rows = [(1, M.Iri("a"), "p", 'say "x"\n\\', 1), (2, M.Iri("a"), "q", 1.5, 1), (3, M.Iri("b"), "p", M.Iri("é"), 1, 2)]
    g = Graph.over(M.literal(spark, rows))
    sql = "SELECT eid, eid / 4 AS d, eid > 1 AS b, o, t_ret, date '2020-01-02' AS day, 1.50BD AS m, array(p, NULL) AS l, struct(eid, p) AS st FROM statement"
    for q in ({"op": "sql", "text": sql}, {"op": "triples", "p": "p"}, {"op": "events", "since": 0}, {"op": "datalog", "program": "x(O) :- p(S, O).", "goal": "x(O)"}):
        want = jsonops.read(g, q)["rows"]
        assert want and sorted([json.loads(r.value) for r in jsonops.lines(g, q).collect()], key=repr) == sorted(want, key=repr)


def test_json_reads_brings_no_rows_to_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows are brought to the driver")

    monkeypatch.setattr(jsonops, "rows", refuse)
    assert {r["op"]: r["count"] for r in QUERIES["json_reads"](spark, f"{DATA}/sf0.001").collect()}["events"] == 450


def test_pointwise_steps_deal_large_inputs_to_more_tasks(spark, monkeypatch):
    def rows():
        x = temporal.segments(ingest.shipping.__wrapped__(spark, f"{DATA}/sf0.001"), ["s"], F.lit(1))
        return plan(x).count("RepartitionByExpression"), sorted(x.collect())

    deals, want = rows()
    assert deals == 0
    monkeypatch.setattr(settle, "PART_BYTES", 4_000)
    deals, got = rows()
    assert deals >= 2 and got == want  # lines by their order, ends by their key


def test_valid_of_a_statement_is_read_with_it(spark):
    rows = [(1, M.Iri("a"), "p", M.Iri("x"), 1, None, 0, 5), (2, M.Iri("a"), "p", M.Iri("y"), 1, None, 0, 9), (3, M.Iri("a"), "p", M.Iri("z"), 1, None, 0, None), (4, M.Iri("b"), "p", M.Iri("x"), 1, None, None, 4), (5, M.Iri("b"), "q", M.Iri("x"), 1, None, 2, 4)]
    st = M.literal(spark, rows)
    text = "short(X, Y) :- p(O, X) @ E, p(O, Y) @ G, valid(E, I), valid(G, J), starts(I, J)."
    x = datalog(text, "short(X, Y)", st)
    assert plan(x).count("Join ") == 0  # settled; the rule's own plan is below
    assert {(r.X, r.Y) for r in x.collect()} == {("I:x", "I:y"), ("I:x", "I:z"), ("I:y", "I:z")}
    p = Program(checked(Parser(text).program()), st)
    assert plan(p.body(p.rules[0])).count("Join ") == 1
    same = "both(O) :- p(O, X) @ E, q(O, Y) @ G, valid(E, I), valid(G, J), finishes(J, I). none(O) :- p(O, X) @ E, q(O, X) @ G, valid(E, I), valid(G, I)."
    assert [r.O for r in datalog(same, "both(O)", st).collect()] == ["I:b"]
    assert datalog(same, "none(O)", st).count() == 0
    long = datalog("d(E, D) :- p(O, X) @ E, valid(E, I), D = duration(I).", "d(E, D)", st)
    assert {(r.E, r.D) for r in long.collect()} == {("S:1", "i:5"), ("S:2", "i:9"), ("S:3", None), ("S:4", None)}


def test_goals_over_derived_facts_are_answered_without_a_shuffle(spark):
    rows = [(1, M.Iri("a"), "p", M.Iri("x"), 1, None, 0, 5), (2, M.Iri("a"), "p", M.Iri("x"), 1, None, 5, 9), (3, M.Iri("b"), "p", M.Iri("y"), 1, None, None, 4), (4, M.Iri("b"), "p", M.Iri("b"), 1, None, 7, None)]
    st = M.literal(spark, rows)
    text = "k(O, count<L>) :- p(O, L). r(X, Y) :- p(X, Y). r(X, Y) :- p(Y, X). three(X, Y, O) :- r(X, Y), r(X, O)."
    n = datalog(text, "k(O, N)", st, time=True)
    assert "Aggregate" not in plan(n) and "Exchange" not in n._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, n.collect()), key=repr) == [("I:a", "i:1", 0, 9), ("I:b", "i:1", 7, None), ("I:b", "i:1", None, 4)]
    for goal, want in {"r(X, Y)": 5, "r(b, Y)": 2, "r(X, X)": 1, "r(b, y)": 1, "r(b, x)": 0, "p(X, Y)": 3, "three(X, Y)": 5}.items():
        for time in (False, True):
            x = datalog(text, goal, st, time=time)
            got = x.collect()
            assert not got or ("Aggregate" in plan(x)) == (goal in ("p(X, Y)", "three(X, Y)"))
            assert len(got) == len(set(got)) == want + (time and goal == "p(X, Y)"), goal


def test_goals_over_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    def rows():
        x = datalog("none(X) :- never(X, Y).", "shipping(O, P)", ingest.shipping.__wrapped__(spark, f"{DATA}/sf0.001"))
        return x.rdd.getNumPartitions(), plan(x).count("RepartitionByExpression [O"), sorted(x.collect())

    _, deals, want = rows()
    assert deals == 0
    monkeypatch.setattr(settle, "PART_BYTES", 4_000)
    parts, deals, got = rows()
    assert deals == 1 and parts > 4 and got == want


def test_rounds_with_time_settle_large_inputs_in_more_tasks(spark, monkeypatch):
    def facts():
        p = Program(checked(Parser("open(O) :- shipping(O, P). lately(O) :- past[86400000, 172800000] open(O).").program()), ingest.shipping.__wrapped__(spark, f"{DATA}/sf0.001"), time=True)
        x = p.run()["lately"]
        return x.rdd.getNumPartitions(), sorted(x.collect())

    n, want = facts()
    assert n <= 4 and want
    monkeypatch.setattr(settle, "PART_BYTES", 4_000)
    n, got = facts()
    assert n > 4 and got == want
