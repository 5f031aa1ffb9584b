"""More queries over the driver's tables: terms, functions and patterns of SPARQL and Cypher."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import model as M
from .catalog import ask, graph_store, match, num, q
from .functions.sparql import call
from .functions.values import V
from .operators import paths
from .plans import ir
from .plans.cypher import cypher
from .plans.lower import Lowering
from .plans.settle import numbered
from .plans.sparql import sparql
from .sources import ingest
from .sources.ingest import table

text = lambda c: M.lex(F.col(c)).alias(c)
truth = lambda c: (M.body(F.col(c)) == "true").alias(c)
whole = lambda c: M.whole(F.col(c)).alias(c)

# --- terms and tests -----------------------------------------------------------------------


VIRTUAL = "subject predicate object txAdded txRetracted addedAt retractedAt validFrom validTo retractKind".split()


@q("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS a, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
v AS (SELECT event_id, unnest([{'k': 'subject', 'v': 'I:u:' || user_id}, {'k': 'predicate', 'v': 'I:lastEvent'}, {'k': 'object', 'v': 's:' || event_type}, {'k': 'txAdded', 'v': 'T:' || a}, {'k': 'addedAt', 'v': 't:' || a || '|0'},
  {'k': 'txRetracted', 'v': 'T:' || r}, {'k': 'retractedAt', 'v': 't:' || r || '|0'}, {'k': 'retractKind', 'v': CASE WHEN r IS NOT NULL THEN 'i:0' END}]) AS x FROM e)
SELECT 'S:' || event_id AS e, x.k AS name, x.v AS value FROM v WHERE x.v IS NOT NULL""")
def virtual_predicates_all(spark, sf_dir):
    """All ten over all history; last events have no valid times, so two of them are empty."""
    low = Lowering(ingest.last_events(spark, sf_dir), view=M.HISTORY)
    parts = [low.run(ir.Virtual(ir.Var("e"), n, ir.Var("value"))).select("e", F.lit(n).alias("name"), "value") for n in VIRTUAL]
    return ingest.union(parts)


@q("SELECT 'I:p:' || p_partkey AS p, p_size = 7 AS same, p_size IN (7, 8) AS near FROM part")
def same_term(spark, sf_dir):
    x = ask(spark, sf_dir, "PREFIX : <> SELECT ?p ?same ?near { ?p :size ?z BIND(sameTerm(?z, 7) AS ?same) BIND(?z IN (7.0, 8.0) AS ?near) }")
    return x.select("p", truth("same"), truth("near"))


@q("SELECT 'I:c:' || c_custkey AS c, count(o_orderkey) > 0 AS has FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def bound_test(spark, sf_dir):
    x = ask(spark, sf_dir, "PREFIX : <> SELECT DISTINCT ?c ?has { ?c :inNation ?n OPTIONAL { ?o :placedBy ?c ; :total ?t FILTER(?t > 300000) } BIND(BOUND(?o) AS ?has) }")
    return x.select("c", truth("has"))


@q("SELECT 'I:p:' || p_partkey AS p, p_size <> 1 AS yes, CASE WHEN p_size > 40 THEN 'big' ELSE p_brand END AS k FROM part")
def effective_boolean(spark, sf_dir):
    x = ask(spark, sf_dir, 'PREFIX : <> SELECT ?p ?yes ?k { ?p :size ?z ; :brand ?b BIND(IF(?z - 1, true, false) AS ?yes) BIND(IF(?z > 40, "big", 1/0) AS ?w) BIND(COALESCE(?w, ?b) AS ?v) BIND(IF(?z > 40, "big", ?b) AS ?k) }')
    return x.select("p", truth("yes"), text("k"))


@q("SELECT 'I:r:' || n_regionkey AS r, string_agg('s:' || n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def collect_values(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (n)-[:inRegion]->(r) RETURN r, collect(n.nationName) AS names")
    return x.select("r", F.array_join("names", "|").alias("names"))


@q("SELECT 'I:n:' || n_nationkey AS n FROM nation, range(2)")
def reduced_keeps_duplicates(spark, sf_dir):
    return ask(spark, sf_dir, "PREFIX : <> SELECT REDUCED ?n { { ?n :inRegion ?r } UNION { ?n :inRegion ?q } }")


@q("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'iri' WHEN c_custkey % 4 = 1 THEN 'blank' WHEN c_custkey % 4 = 2 THEN 'number' ELSE 'other' END AS kind FROM customer) GROUP BY kind")
def term_kinds(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = F.when(F.expr("c_custkey % 4 = 0"), ingest.node("n", "c_nationkey")).when(F.expr("c_custkey % 4 = 1"), F.concat(F.lit("_:b"), F.col("c_custkey").cast("string"))).when(F.expr("c_custkey % 4 = 2"), M.double("c_acctbal")).otherwise(M.string("c_name"))
    st = ingest.facts(c, F.col("c_custkey"), ingest.node("c", "c_custkey"), "any", o)
    x = sparql('SELECT ?kind (COUNT(*) AS ?n) { ?c <any> ?o BIND(IF(isIRI(?o), "iri", IF(isBlank(?o), "blank", IF(isNumeric(?o), "number", IF(isLiteral(?o), "other", "none")))) AS ?kind) } GROUP BY ?kind', st, multi=frozenset())
    return x.select(text("kind"), "n")


@q("""SELECT doc_id, lang AS lang, lang = 'en' AS en, 'I:' || source AS i, 'x:' || source || '|' || lang AS typed, 'l:' || lang || '-x|' || source AS tagged, lang IN ('en', 'de') AS one_of FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def language_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    v = V(F.concat(F.lit("l:"), F.col("lang"), F.lit("|"), F.col("source")))
    lit = lambda s: V(F.lit(f"s:{s}"))
    tag = call("LANG", [v])
    wide = V(F.concat(F.lit("s:"), F.col("lang"), F.lit("-x")))
    return d.select(
        "doc_id", tag.text.alias("lang"), call("LANGMATCHES", [wide, lit("EN")]).col.alias("en"), call("IRI", [call("STR", [v])]).term.alias("i"), call("STRDT", [V(M.string("lang")), call("IRI", [V(M.string("source"))])]).term.alias("typed"),
        call("STRLANG", [call("STR", [v]), wide]).term.alias("tagged"), (call("LANGMATCHES", [tag, lit("en")]).col | call("LANGMATCHES", [tag, lit("de")]).col).alias("one_of"),
    )


@q("""SELECT event_id, CASE WHEN o = 0 THEN 'Z' ELSE (CASE WHEN o < 0 THEN '-' ELSE '+' END) || lpad((abs(o) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(o) % 60)::VARCHAR, 2, '0') END AS tz,
((epoch_ms(ts) // 60000 + o) // 60 % 24)::BIGINT AS h, ((epoch_ms(ts) // 60000 + o) % 60)::BIGINT AS m FROM (SELECT event_id, ts, (event_id % 5 - 2) * 90 AS o FROM events)""")
def time_zones(spark, sf_dir):
    """Parts of a date-time are read in the offset that it was written with."""
    e = table(spark, sf_dir, "events").withColumn("o", F.expr("cast((event_id % 5 - 2) * 90 as int)"))
    v = V(M.date_time(ingest.ms("ts"), F.col("o")))
    return e.select("event_id", call("TZ", [v]).text.alias("tz"), call("HOURS", [v]).col.cast("bigint").alias("h"), call("MINUTES", [v]).col.cast("bigint").alias("m"))


@q("""SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, o_totalprice AS d, o_totalprice > 0 AS b, strftime(o_orderdate, '%Y-%m-%d') AS day, TRY_CAST(o_orderstatus AS BIGINT) AS none FROM orders""")
def casts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price, day, st = V(M.double("o_totalprice")), V(M.string(F.date_format("o_orderdate", "yyyy-MM-dd"))), V(M.string("o_orderstatus"))
    back = call("XSD:DOUBLE", [call("XSD:STRING", [price])])
    return o.select("o_orderkey", M.whole(call("XSD:INTEGER", [price]).term).alias("i"), back.col.alias("d"), call("XSD:BOOLEAN", [price]).col.alias("b"), call("XSD:STRING", [call("XSD:DATE", [day])]).text.alias("day"), M.whole(call("XSD:INTEGER", [st]).term).alias("none"))


@q("SELECT 9007199254740993 AS x, 18014398509481986 AS twice, false AS same, true AS more, 4611686018427387904 AS half, 3 AS cut, -3 AS neg, -1 AS rest")
def cypher_big_integers(spark, sf_dir):
    x = match(spark, sf_dir, "UNWIND [9007199254740993] AS x RETURN x, x * 2 AS twice, x = 9007199254740992 AS same, x > 9007199254740992 AS more, 9223372036854775807 / 2 + 1 AS half, 7 / 2 AS cut, -7 / 2 AS neg, -7 % 3 AS rest")
    return x.select(whole("x"), whole("twice"), truth("same"), truth("more"), whole("half"), whole("cut"), whole("neg"), whole("rest"))


@q("SELECT 'I:r:' || n_regionkey AS r, sum(n_nationkey + 9007199254740993)::BIGINT AS total, count(*) AS n, 'i' AS kind FROM nation GROUP BY n_regionkey")
def sum_of_integers(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    st = ingest.facts(n, F.col("n_nationkey"), ingest.node("r", "n_regionkey"), "code", M.integer(F.col("n_nationkey").cast("bigint") + 9007199254740993))
    x = sparql("SELECT ?r (SUM(?k) AS ?total) (COUNT(*) AS ?n) { ?r <code> ?k } GROUP BY ?r", st, multi=frozenset())
    return x.select("r", M.whole(F.col("total")).alias("total"), "n", M.kind(F.col("total")).alias("kind"))


@q("SELECT avg(DISTINCT p_size) AS a, sum(DISTINCT p_size)::BIGINT AS s, round(stddev_pop(DISTINCT p_size), 6) AS sp, round(stddev_samp(DISTINCT p_size), 6) AS sd, quantile_cont(DISTINCT p_size, 0.5) AS m, count(DISTINCT p_size) AS n FROM part")
def distinct_aggregates(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (p:Part) RETURN avg(DISTINCT p.size) AS a, sum(DISTINCT p.size) AS s, stdevp(DISTINCT p.size) AS sp, stdev(DISTINCT p.size) AS sd, percentileCont(DISTINCT p.size, 0.5) AS m, count(DISTINCT p.size) AS n")
    return x.select(num("a"), whole("s"), num("sp", 6), num("sd", 6), num("m"), whole("n"))


# --- patterns of Cypher ----------------------------------------------------------------------


@q("SELECT 'I:c:' || c_custkey AS c, 'balance|custName|segment' AS names, c_name AS name, c_acctbal AS balance, 3 AS n FROM customer")
def cypher_properties(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (c:Customer) RETURN c, keys(c) AS names, properties(c) AS p, size(keys(c)) AS n")
    return x.select("c", F.array_join(F.transform("names", M.lex), "|").alias("names"), M.lex(F.col("p")["custName"]).alias("name"), M.num(F.col("p")["balance"]).alias("balance"), whole("n"))


@q("""SELECT x FROM (SELECT 'I:c:' || c_custkey AS x FROM customer UNION SELECT 'I:s:' || s_suppkey FROM supplier UNION SELECT 'I:n:' || n_nationkey FROM nation UNION SELECT 'I:r:' || r_regionkey FROM region UNION SELECT 'I:p:' || p_partkey FROM part
UNION SELECT 'I:o:' || o_orderkey FROM orders)""")
def cypher_all_nodes(spark, sf_dir):
    return match(spark, sf_dir, "MATCH (x) RETURN x")


@q("SELECT 'I:c:' || c_custkey || ' I:n:' || n_nationkey || ' I:r:' || n_regionkey AS way, 2 AS hops, 'inNation inRegion' AS types FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cypher_path_variable(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH p = (c:Customer)-[a:inNation]->(n)-[b:inRegion]->(r) RETURN nodes(p) AS way, length(p) AS hops, type(a) AS t, type(b) AS u, size(relationships(p)) AS k")
    return x.select(F.array_join("way", " ").alias("way"), whole("hops"), F.concat_ws(" ", M.lex(F.col("t")), M.lex(F.col("u"))).alias("types"))


TRADE = "e AS (SELECT DISTINCT c_nationkey AS u, s_nationkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R')"


@q(f"WITH {TRADE} SELECT 'I:n:' || c AS x, count(*) AS n FROM (SELECT b.v AS c FROM e a JOIN e b ON a.v = b.u WHERE a.u = 3 AND (a.u, a.v) <> (b.u, b.v) UNION ALL SELECT v FROM e WHERE u = 3) GROUP BY c")
def cypher_trails(spark, sf_dir):
    """Every way of one or two hops that uses no relationship twice is a row."""
    x = cypher("MATCH (a)-[:buysFrom*1..2]->(x) WHERE id(a) = $start RETURN x, count(*) AS n", ingest.trade(spark, sf_dir), params={"start": "I:n:3"}, multi=frozenset())
    return x.select("x", whole("n"))


@q(f"WITH RECURSIVE {TRADE}, r(n, d) AS (SELECT 3, 0 UNION SELECT v, d + 1 FROM r JOIN e ON u = n WHERE d < 25), m AS (SELECT n, min(d) AS d FROM r WHERE d > 0 GROUP BY n) SELECT 'I:n:' || n AS x, d AS hops FROM m")
def cypher_shortest_path(spark, sf_dir):
    x = cypher("MATCH (a), (x), p = shortestPath((a)-[:buysFrom*]->(x)) WHERE id(a) = $start RETURN x, length(p) AS hops", ingest.trade(spark, sf_dir), params={"start": "I:n:3"}, multi=frozenset())
    return x.select("x", whole("hops"))


@q("SELECT n_name AS name, n_nationkey + 1 AS next, upper(n_name) AS up FROM nation")
def cypher_maps(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (n:Nation) WITH n {.nationName, code: toInteger(substring(id(n), 2))} AS m RETURN m.nationName AS name, m['code'] + 1 AS next, {a: toUpper(m.nationName)}.a AS up")
    return x.select(text("name"), whole("next"), text("up"))


@q("SELECT 'I:c:' || c_custkey AS c FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def cypher_pattern_tests(spark, sf_dir):
    return match(spark, sf_dir, "MATCH (c)-[:inNation]->(n) WHERE c:Customer AND c.balance > 0 AND NOT (c)<-[:placedBy]-() RETURN c")


@q("SELECT 'I:n:' || n_nationkey AS n, 'I:r:' || r_regionkey AS r FROM nation, region WHERE n_nationkey <= r_regionkey")
def cross_components(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (n:Nation), (r:Region) WHERE toInteger(substring(id(n), 2)) <= toInteger(substring(id(r), 2)) RETURN n, r")
    return x


@q("SELECT * FROM (VALUES (1::BIGINT, 's:a'), (2, 's:b'), (3, 'b:false'), (4, 'b:true'), (5, 'i:-5'), (6, 'd:2.5'), (7, 'i:10')) v(place, x)")
def cypher_order_across_types(spark, sf_dir):
    x = match(spark, sf_dir, "UNWIND [10, 'b', true, 2.5, 'a', false, -5] AS x RETURN x")
    return numbered(x, [M.sort_key(F.col("x"), M.CYPHER_ORDER)], "place")


@q("""SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS l, round(log10(o_totalprice), 6) AS l10, round(sin(o_totalprice), 6) AS s, round(atan2(o_totalprice, 2), 6) AS at, sign(o_totalprice)::BIGINT AS sg, ceil(o_totalprice) AS up, floor(o_totalprice) AS down,
round(degrees(1.0), 6) AS dg, round((1 - cos(o_totalprice)) / 2, 6) AS hs, o_totalprice * o_totalprice AS sq FROM orders""")
def cypher_math(spark, sf_dir):
    x = match(spark, sf_dir, """MATCH (o:Order) WITH o, o.total AS t RETURN toInteger(substring(id(o), 2)) AS o_orderkey, sqrt(t) AS root, log(t) AS l, log10(t) AS l10, sin(t) AS s, atan2(t, 2) AS at, sign(t) AS sg, ceil(t) AS up, floor(t) AS down,
      degrees(1.0) AS dg, haversin(t) AS hs, t ^ 2 AS sq""")
    return x.select(whole("o_orderkey"), *[num(c, 6) for c in ("root", "l", "l10", "s", "at")], whole("sg"), num("up"), num("down"), num("dg", 6), num("hs", 6), num("sq"))


@q("""SELECT 'I:p:' || p_partkey AS p, p_size::VARCHAR AS s, p_size AS i, (p_size || '.5')::DOUBLE AS f, NULL::BIGINT AS bad, p_brand AS c, CASE WHEN p_size <> 7 THEN p_size END AS nif, p_size % 2 = 0 AS even FROM part""")
def cypher_conversions(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (p:Part) RETURN p, toString(p.size) AS s, toInteger(toString(p.size)) AS i, toFloat(toString(p.size) + '.5') AS f, toIntegerOrNull(p.brand) AS bad, coalesce(p.noSuch, p.brand) AS c, nullIf(p.size, 7) AS nif, toBoolean(toString(p.size % 2 = 0)) AS even")
    return x.select("p", text("s"), whole("i"), num("f"), whole("bad"), text("c"), whole("nif"), truth("even"))


@q("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, epoch_ms(o_orderdate) AS ms FROM orders""")
def cypher_temporal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st = ingest.facts(o, F.col("o_orderkey"), ingest.node("o", "o_orderkey"), "day", M.string(F.date_format("o_orderdate", "yyyy-MM-dd")))
    x = cypher("MATCH (o) WITH o, date(o.day) AS d RETURN toInteger(substring(id(o), 2)) AS o_orderkey, toString(d) AS d, d.year AS y, d.month AS m, toString(date.truncate('month', d)) AS first, toString(date.truncate('quarter', d)) AS q, datetime.fromEpochMillis(86400000) AS e", st, multi=frozenset())
    day = F.unix_millis(F.to_timestamp(M.lex(F.col("d"))))
    return x.select(whole("o_orderkey"), text("d"), whole("y"), whole("m"), text("first"), text("q"), day.alias("ms"))


@q("SELECT 'S:' || event_id AS e, 'lastEvent' AS t, event_id AS id, 'T:' || epoch_us(ts) AS came, 'I:u:' || user_id AS s FROM events")
def cypher_statement_functions(spark, sf_dir):
    e = ingest.last_events(spark, sf_dir)
    edges = e.withColumn("o", F.concat(F.lit("I:"), M.body(F.col("o"))))
    x = cypher("USE HISTORY MATCH (s)-[e:lastEvent]->(o) RETURN e, type(e) AS t, statementId(e) AS id, transaction(e) AS came, startNode(e) AS s", edges, multi=frozenset())
    return x.select("e", text("t"), whole("id"), "came", "s")


@q("SELECT 'I:r:' || n_regionkey AS r, n AS n, first, last, rest, rev FROM (SELECT n_regionkey, count(*) AS n, min(n_name) AS first, max(n_name) AS last, count(*) - 1 AS rest, max(n_name) AS rev FROM nation GROUP BY n_regionkey)")
def cypher_lists(spark, sf_dir):
    x = match(spark, sf_dir, "MATCH (n)-[:inRegion]->(r) WITH r, collect(n.nationName) AS names RETURN r, size(names) AS n, head(names) AS first, last(names) AS last, size(tail(names)) AS rest, head(reverse(names)) AS rev, isEmpty(names) AS none, range(1, 3) AS k")
    return x.select("r", whole("n"), text("first"), text("last"), whole("rest"), text("rev"))


# --- cyclic patterns -----------------------------------------------------------------------------


@q(f"WITH {TRADE} SELECT count(*) AS n FROM e x JOIN e y ON x.v = y.u JOIN e z ON y.v = z.u AND z.v = x.u")
def cyclic_directed_triangle(spark, sf_dir):
    return sparql("PREFIX : <> SELECT (COUNT(*) AS ?n) { ?a :buysFrom ?b . ?c :buysFrom ?a . ?b :buysFrom ?c }", ingest.trade(spark, sf_dir), multi=frozenset())


@q(f"WITH {TRADE} SELECT count(*) AS n FROM e w JOIN e x ON w.v = x.u JOIN e y ON x.v = y.u JOIN e z ON y.v = z.u AND z.v = w.u")
def cyclic_four(spark, sf_dir):
    return sparql("PREFIX : <> SELECT (COUNT(*) AS ?n) { ?a :buysFrom ?b . ?c :buysFrom ?d . ?b :buysFrom ?c . ?d :buysFrom ?a }", ingest.trade(spark, sf_dir), multi=frozenset())


@q(f"WITH {TRADE} SELECT count(*) AS n FROM e w JOIN e x ON w.u = x.u JOIN e y ON y.u = w.v JOIN e z ON z.u = x.v AND z.v = y.v JOIN e k ON k.u = w.v AND k.v = x.v")
def cyclic_diamond(spark, sf_dir):
    return sparql("PREFIX : <> SELECT (COUNT(*) AS ?n) { ?a :buysFrom ?b . ?a :buysFrom ?c . ?b :buysFrom ?d . ?c :buysFrom ?d . ?b :buysFrom ?c }", ingest.trade(spark, sf_dir), multi=frozenset())


@q(f"WITH {TRADE} SELECT 'I:n:' || x.u AS a, count(*) AS n FROM e x JOIN e y ON x.v = y.u JOIN e z ON y.v = z.u AND z.v = x.u JOIN e t ON t.u = x.u GROUP BY x.u")
def cyclic_tailed_triangle(spark, sf_dir):
    return sparql("PREFIX : <> SELECT ?a (COUNT(*) AS ?n) { ?a :buysFrom ?t . ?a :buysFrom ?b . ?c :buysFrom ?a . ?b :buysFrom ?c } GROUP BY ?a", ingest.trade(spark, sf_dir), multi=frozenset())


# --- paths -----------------------------------------------------------------------------------------


@q("SELECT 'I:n:' || n_nationkey AS n, 'I:r:' || n_regionkey AS x FROM nation")
def path_wildcard(spark, sf_dir):
    """Any relationship: no types, literals or statements of the system."""
    starts = table(spark, sf_dir, "nation").select(ingest.node("n", "n_nationkey").alias("node"))
    return paths.reach(ingest.entities(spark, sf_dir), starts, "*").rows.select(F.col("start").alias("n"), F.col("node").alias("x"))


@q("SELECT 'I:n:' || n_nationkey AS n, 'I:r:' || n_regionkey AS x FROM nation")
def cypher_untyped_relationship(spark, sf_dir):
    return match(spark, sf_dir, "MATCH (n:Nation)-[]->(x) RETURN n, x")


@q(f"WITH {TRADE}, r AS (SELECT 0 AS hops, 3 AS n UNION SELECT 1, v FROM e WHERE u = 3 UNION SELECT 2, b.v FROM e a JOIN e b ON a.v = b.u WHERE a.u = 3), m AS (SELECT n, min(hops) AS hops FROM r GROUP BY n) SELECT CASE WHEN EXISTS (SELECT 1 FROM e JOIN m ON u = n WHERE m.hops = 1 AND v NOT IN (SELECT n FROM m WHERE hops <= 1)) THEN 'stopped at bound' ELSE 'exhaustive' END AS verdict, count(*) FILTER (hops <= 1) AS n FROM m")
def path_verdict(spark, sf_dir):
    """Whether a search stopped at its bound though there was more to find."""
    starts = spark.createDataFrame([("I:n:3",)], "node string")
    found = paths.reach(ingest.trade(spark, sf_dir), starts, "buysFrom*", 1)
    return found.rows.agg(F.lit(found.verdict).alias("verdict"), F.count("*").alias("n"))


@q("SELECT 'I:c:' || c_custkey AS c, 'I:n:' || c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def path_in_graphs(spark, sf_dir):
    """Every hop is a member of one of the graphs."""
    st = graph_store(spark, sf_dir)
    starts = table(spark, sf_dir, "customer").select(ingest.node("c", "c_custkey").alias("node"))
    return paths.reach(paths.within_graphs(st, ("I:BUILDING",)), starts, "inNation").rows.select(F.col("start").alias("c"), F.col("node").alias("n"))


@q("SELECT 'I:c:' || c_custkey AS c, 'I:r:' || n_regionkey AS \"R\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def goal_in_sparql(spark, sf_dir):
    """A goal's rows join the patterns around it."""
    return ask(spark, sf_dir, 'PREFIX : <> SELECT ?c ?R { ?c :balance ?b FILTER(?b < 0) ?c :inNation ?N SERVICE <call:datalog.goal> { [] <program> "lies(N, R) :- inRegion(N, R)." ; <goal> "lies(N, R)" } }')


@q("SELECT 'I:n:' || n_nationkey AS n, 'I:r:' || n_regionkey AS r FROM nation WHERE len(list_filter(regexp_extract_all(lower(n_name), '[\\p{L}\\p{N}]+'), lambda t: t = 'united')) > 0")
def text_in_sparql(spark, sf_dir):
    """Hits of a text search join the patterns around them."""
    return ask(spark, sf_dir, 'PREFIX : <> SELECT ?n ?r { ?n :inRegion ?r SERVICE <call:text.search> { [] <query> "united" ; <limit> 1000 ; <node> ?n } }')


@q("SELECT 'I:r:' || n_regionkey AS r, 1::BIGINT AS hops FROM nation WHERE n_nationkey = 7")
def path_call_in_sparql(spark, sf_dir):
    x = ask(spark, sf_dir, 'SELECT ?r ?h { SERVICE <call:path.find> { [] <start> "n:7" ; <path> "inRegion+" ; <node> ?r ; <hops> ?h } }')
    return x.select("r", M.whole(F.col("h")).alias("hops"))


@q("""SELECT event_id, CASE WHEN o = 0 THEN 'PT0S' ELSE (CASE WHEN o < 0 THEN '-PT' ELSE 'PT' END) || (CASE WHEN abs(o) >= 60 THEN (abs(o) // 60) || 'H' ELSE '' END) || (CASE WHEN o % 60 <> 0 THEN (abs(o) % 60) || 'M' ELSE '' END) END AS zone
FROM (SELECT event_id, (event_id % 5 - 2) * 90 AS o FROM events)""")
def time_zone_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.expr("cast((event_id % 5 - 2) * 90 as int)"))
    return e.select("event_id", M.lex(call("TIMEZONE", [V(M.date_time(ingest.ms("ts"), F.col("o")))]).term).alias("zone"))


@q("SELECT 'I:c:' || c_custkey AS c, 'I:r:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def path_from_known_ends(spark, sf_dir):
    """A path pattern starts from the nodes that the other patterns leave."""
    return ask(spark, sf_dir, "PREFIX : <> SELECT ?c ?r { ?c (:inNation/:inRegion) ?r . ?c :balance ?b FILTER(?b < 0) }")
