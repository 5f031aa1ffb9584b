"""Counts of joins are made from counts of their parts, so that no row of the join is built."""

import pytest
from pyspark.sql import functions as F

from factloom import model as M
from factloom.plans import ir
from factloom.plans.cypher import cypher
from factloom.plans.lower import Lowering


@pytest.fixture(scope="module")
def loops(spark):
    return M.literal(spark, [(1, M.Iri("a"), "then", M.Iri("b"), 1), (2, M.Iri("a"), "then", M.Iri("b"), 1), (3, M.Iri("b"), "then", M.Iri("b"), 1), (4, M.Iri("b"), "then", M.Iri("c"), 1), (5, M.Iri("d"), "then", M.Iri("d"), 1)])


@pytest.mark.parametrize("keys", ["", "a, ", "b, ", "c, ", "a, c, "])
def test_two_relationships(spark, loops, keys):
    names = [k for k in keys.split(", ") if k]
    got = cypher(f"MATCH (a)-[:then]->(b)-[:then]->(c) RETURN {keys}count(*) AS n", loops)
    e = [(r.eid, r.s, r.o) for r in loops.collect()]
    want = {}
    for i, s, o in e:
        for j, s2, o2 in e:
            if o == s2 and i != j:
                k = tuple({"a": s, "b": o, "c": o2}[n] for n in names)
                want[k] = want.get(k, 0) + 1
    assert {tuple(r[n] for n in names): int(r.n[2:]) if isinstance(r.n, str) else r.n for r in got.collect()} == want


def test_nothing_to_count(spark, loops):
    assert cypher("MATCH (a)-[:then]->(b)-[:never]->(c) RETURN count(*) AS n", loops).select(M.num(F.col("n"))).first()[0] == 0


def test_large_groups_are_not_joined(spark, loops):
    """Two parts of 200,000 rows that all agree: 40 billion rows, which no test could wait for."""
    part = lambda c: ir.Table(spark.range(200_000).select(F.lit("i:1").alias("k"), F.col("id").cast("string").alias(c)), frozenset(["k"]))
    op = ir.Aggregate(ir.Join((part("x"), part("y")), ("k",)), ("k",), (("n", ir.Agg("count")),))
    assert Lowering(loops).run(op).collect() == [("i:1", 200_000**2)]


def test_no_task_holds_all_prices(spark):
    """Exact percentiles hold every value in one task; the ranks of one value are counts."""
    from factloom import catalog

    x = catalog.approximate_aggregates(spark, "/root/testdata/sf0.01")
    assert " percentile(" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert x.collect() == [(True, True)]
