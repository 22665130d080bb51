"""Further queries: operators that need a source, a limit or a host of their own, walks and fixpoints over relations that
grow beyond what runs in memory, and parts of the API whose results are told as rows."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow import plain
from strataflow.cypher import Edge, Graph, Refused, compile_query, explained, grammar, kinds_of, store
from strataflow.engine import Engine
from strataflow.errors import BudgetExceeded, CheckError, SyntaxRefused, located
from strataflow.functions import host
from strataflow.limits import Limits
from strataflow.naive import Naive
from strataflow.operators import versions
from strataflow.plans import rewrite
from strataflow.plans.text import parse, show
from strataflow.queries import GRAPH, NEXT, ORACLES, QUERIES, TURN, asked, engine, entry_query, history, made
from strataflow.server import Server, serve
from strataflow.sources import facts, lookup
from strataflow.sources.catalog import federated
from strataflow.sources.storage import fresh_path
from strataflow.tools import Tools

__all__ = ["ORACLES", "QUERIES", "entry_query"]


def told(spark: SparkSession, rows: list[tuple], schema: str = "name string, value string") -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str = "name, value") -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


# Filters, joins, rules

asked("fact_join", "picked(?f) :- nation(?k, _, 1) as ?f; nation(?k, ?n, _) as ?f, picked(?f) => ?n", "n", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")


@made("key_semi_join", "SELECT l_orderkey AS o, l_linenumber AS l FROM lineitem WHERE l_quantity > 49 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')")
def key_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem has no key and an answer is a set, so lines with equal columns are counted and told as often as there are."""
    lines = engine(spark, sf_dir).query('lineitem(?o, ?p, _, ?l, ?q, _, _, _, _, _, _), ?q > 49, part(?p, _, "Brand#11", _, _, _) => ?o, ?l, count(?p)', names=["o", "l", "n"])
    return lines.select("o", "l", F.explode(F.sequence(F.lit(1), "n")).alias("n")).drop("n")


asked("theta_join_keys", "customer(?c, _, ?k, ?b, _), supplier(?s, _, ?k, ?a), ?a > ?b, ?b > 9000 => ?c, ?s", "c s",
      "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal WHERE c_acctbal > 9000")
asked("recursion_generator", 'bit(?s) :- region(_, ?s); bit(?t) :- bit(?s), str.split(?s, "E", ?i, ?t); bit(?s)', "s", "WITH RECURSIVE b AS (SELECT r_name AS s FROM region UNION SELECT unnest(string_split(s, 'E')) AS s FROM b) SELECT s FROM b")
asked("recursion_filter", NEXT + "reach(?a, ?b) :- next(?a, ?b), ?b != 13; reach(?a, ?c) :- reach(?a, ?b), next(?b, ?c), ?c != 13; reach(?a, ?b)", "a b",
      "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (b.n_nationkey < 13 OR a.n_nationkey >= 13)")


@made("module_facts", "SELECT r_regionkey AS k, r_name AS r FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def module_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.module("far", 'land("ASIA"); land("EUROPE");')
    return e.query("far.land(?r), region(?k, ?r) => ?k, ?r", names=["k", "r"])


@made("plain_evaluator", "SELECT CAST(a.n_nationkey AS DOUBLE) AS a, CAST(b.n_nationkey AS DOUBLE) AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def plain_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator that the engine is tested against, on its own."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    q = parse(NEXT + "reach(?a, ?b) :- next(?a, ?b); reach(?a, ?c) :- reach(?a, ?b), next(?b, ?c); reach(?a, ?b)")
    return told(spark, Naive({"nation": rows}, q.rules).answer(q), "a double, b double")


REFUSED = {
    "unknown": "nations(?k)", "arity": "nation(?k)", "redefined": "nation(?a, ?b, ?c) :- nation(?a, ?b, ?c); region(?a, ?b)", "unbound": "nation(?k, _, _), ?z < 3", "projection": "region(?k, _) => ?n",
    "recursion": "n(?m) :- region(?m, _); n(?k) :- n(?m), ?k = ?m + 1; n(?m)", "aggregate": "c(count(?k)) :- region(?k, _); c(?k) :- region(?k, _); c(?x)", "order": "region(?k, _) => ?k limit 1 offset 2",
    "type": 'region(_, ?n), str.match(?n, "(?=x)")', "walk": 'graph.paths("nation", ?a, ?b, "odd", 1, 2, ?p)', "fact": "p(?k) :- region(?k, _); p(?k) as ?r",
}


@made("refusals", values([(k, k) for k in REFUSED] + [("syntax", "syntax"), ("domain", "type"), ("across", "version"), ("limit", "syntax"), ("meant", "nation")]))
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused before any job runs, by the kind of reason."""
    e = engine(spark, sf_dir)
    e.catalog.add("coast", spark.createDataFrame([("N",)], "side string"), domains={"side": ("N", "S")})
    e.catalog.add("old", spark.createDataFrame([(1, 2, [(0, 1)])], "a int, b int, __versions array<struct<from:bigint,to:bigint>>"))

    def kind(program: str, **more) -> str:
        try:
            e.query(program, **more)
        except CheckError as x:
            return x.kind
        except SyntaxRefused:
            return "syntax"
        return "none"

    rows = [(k, kind(p)) for k, p in REFUSED.items()]
    rows += [("syntax", kind("nation(?k")), ("domain", kind('coast("E")')), ("across", kind('graph.closure("old", ?a, ?b, 1, 0, ?h)', across=[0])), ("limit", kind("region(?k, _) => ?k limit 0"))]
    try:
        e.query("natoin(?k, _, _)")
    except CheckError as x:
        rows.append(("meant", x.fix or ""))
    return told(spark, rows)


# Aggregates

asked("sum_distinct", "lineitem(_, _, _, _, ?q, _, _, _, ?f, _, _) => ?f, sum(distinct ?q), avg(distinct ?q)", "f total mean", "SELECT l_returnflag AS f, sum(DISTINCT l_quantity) AS total, avg(DISTINCT l_quantity) AS mean FROM lineitem GROUP BY 1", rounded="mean")
asked("list_distinct", "nation(_, _, ?r) => list(distinct ?r)", "rs", "SELECT '[' || string_agg(x, ',' ORDER BY x) || ']' AS rs FROM (SELECT DISTINCT n_regionkey AS x FROM nation)")


@made("exact_sum", "SELECT 'asked' AS name, CAST(sum(n_nationkey) FILTER (n_nationkey > 1) AS DOUBLE) AS total FROM nation")
def exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum is the true one rounded once: what cancels doesn't take the small numbers with it."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    x = F.when(F.col("n_nationkey") == 0, 1e16).when(F.col("n_nationkey") == 1, -1e16).otherwise(F.col("n_nationkey").cast("double"))
    e = Engine(spark)
    e.catalog.add("v", n.withColumn("x", x))
    return e.query('?a = "asked", v(?k, ?x) => ?a, sum(?x)', names=["name", "total"])


@made("mixed_units", "SELECT k, count(*) AS n, CASE WHEN count(DISTINCT u) > 1 THEN 'mixed units: A, V' END AS why FROM (SELECT DISTINCT s_nationkey AS k, 'V' AS u, s_acctbal AS x FROM supplier WHERE s_nationkey < 13 UNION ALL SELECT DISTINCT s_nationkey, 'A', s_acctbal + 1000000 FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1")
def mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extreme of numbers in several units is absent, and the answer says why."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    e = Engine(spark)
    e.catalog.add("v", s.where("s_nationkey < 13").select("s_nationkey", "s_acctbal"), units={"s_acctbal": "V"})
    e.catalog.add("i", s.where("s_suppkey % 2 = 0").select("s_nationkey", (F.col("s_acctbal") + 1000000).alias("x")), units={"x": "A"})
    out = e.query("m(?k, ?x) :- v(?k, ?x); m(?k, ?x) :- i(?k, ?x); m(?k, ?x) => ?k, count(?x), max(?x)", names=["k", "n", "top"], reasons=True)
    return out.select("k", "n", F.col("why")["top"].alias("why"))


# Order


def placed(df: DataFrame) -> DataFrame:
    """Rows with their places in the order that they come in."""
    return df.withColumn("at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long")).drop("at")


@made("default_order", "SELECT n_regionkey AS r, n_name AS n, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation")
def default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(engine(spark, sf_dir).query("nation(_, ?n, ?r) => ?r, ?n", names=["r", "n"], ordered=True))


@made("order_places", "SELECT c_nationkey AS k, c_custkey AS c, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS place FROM customer WHERE c_mktsegment = 'BUILDING'")
def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(engine(spark, sf_dir).query('customer(?c, _, ?k, _, "BUILDING") => ?k, ?c order by ?k desc', names=["k", "c"]))


@made("limit_without_order", "SELECT 7 AS n, true AS known")
def limit_without_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows come isn't said; how many is, and that they are the answer's."""
    some = engine(spark, sf_dir).query("orders(?o, _, _, _, _, _) => ?o limit 7", names=["o"])
    all_of = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.lit(True).alias("there"))
    return some.join(all_of, "o", "left").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("there", F.lit(False))).alias("known"))


@made("total", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, [("orders", engine(spark, sf_dir).total('orders(?o, _, "F", ?t, _, _) => ?o, ?t order by ?t limit 3 offset 5'))], "name string, n long")


# Walks

RING = NEXT + "ring(?a, ?b) :- next(?a, ?b); ring(24, 0) :- region(0, _); "
STEP = NEXT + "step(?a, ?e, ?b) :- next(?a, ?b), ?e = ?a * 100; "
asked("paths_simple", RING + 'graph.paths("ring", 3, 3, "simple", 1, 0, ?p), path.length(?p, ?n) => ?n', "n", "SELECT count(*) AS n FROM nation")
asked("paths_walk", RING + 'graph.paths("ring", 23, ?b, "walk", 2, 3, ?p) => ?b, ?p', "b p", values([(0, "[23,24,0]"), (1, "[23,24,0,1]")], "b, p"))
asked("paths_named", STEP + 'graph.paths("step", 0, ?b, "trail", 1, 3, ?p), path.edge(?p, ?i, ?e) => ?b, ?p, ?i, ?e', "b p i e",
      values([(b, json.dumps({"nodes": list(range(b + 1)), "edges": [100 * i for i in range(b)]}, separators=(",", ":")), i, str(100 * i)) for b in (1, 2, 3) for i in range(b)], "b, p, i, e"))
asked("path_parts", STEP + 'graph.paths("step", 4, 6, "acyclic", 1, 0, ?p), path.nodes(?p, ?n), path.edges(?p, ?e), path.length(?p, ?l) => ?n, ?e, ?l', "n e l", values([("[4,5,6]", "[400,500]", 2)], "n, e, l"))

JOINED = Limits(edges=0, tuples=0)
for name in ("closure_hops", "closure_back", "closure_zero", "paths_acyclic", "paths_shortest", "paths_steps", "recursion_nonlinear", "same_generation"):
    # The same questions by joins and jobs, as large relations are walked.
    def by_joins(spark: SparkSession, sf_dir: str, name: str = name) -> DataFrame:
        return QUERIES[name](spark, sf_dir, limits=JOINED)

    QUERIES[f"{name}_by_joins"], ORACLES[f"{name}_by_joins"] = by_joins, ORACLES[name]
asked("paths_named_by_joins", STEP + 'graph.paths("step", 0, ?b, "trail", 1, 3, ?p), path.edge(?p, ?i, ?e) => ?b, ?p, ?i, ?e', "b p i e", ORACLES["paths_named"], limits=JOINED)

TREE = 300_000


def tree(spark: SparkSession, sf_dir: str, size: int = TREE) -> Engine:
    """Beside the tables, a tree of eight children a node: up(child, parent), kid(parent, child)."""
    e = engine(spark, sf_dir)
    up = spark.range(1, size).select(F.col("id").alias("a"), F.expr("(id - 1) div 8").alias("b"))
    e.catalog.add("up", up, required=["a", "b"], key=("a",)).add("kid", up.select("b", "a").toDF("a", "b"), required=["a", "b"], key=("b",))
    return e


UP = f"(SELECT i AS a, (i - 1) // 8 AS b FROM range(1, {TREE}) t(i))"


@made("closure_large", f"WITH RECURSIVE e AS {UP}, r AS (SELECT a, b, 1 AS h FROM e UNION ALL SELECT r.a, e.b, h + 1 FROM r JOIN e ON e.a = r.b WHERE h < 3) SELECT h, count(*) AS n FROM r GROUP BY 1")
def closure_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unbound closure over more edges than any task is given."""
    return tree(spark, sf_dir).query('graph.closure("up", ?a, ?b, 1, 3, ?h) => ?h, count(?a)', names=["h", "n"])


@made("closure_large_end", f"WITH RECURSIVE e AS {UP}, r AS (SELECT a, 1 AS h FROM e WHERE b = 7 UNION ALL SELECT e.a, h + 1 FROM r JOIN e ON e.b = r.a) SELECT h, count(*) AS n FROM r GROUP BY 1")
def closure_large_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that reaches one node, walked from that end to the last."""
    return tree(spark, sf_dir).query('graph.closure("up", ?a, 7, 1, 0, ?h) => ?h, count(?a)', names=["h", "n"])


@made("paths_large", f"WITH RECURSIVE e AS {UP}, r AS (SELECT a AS s, b, '[' || a || ',' || b AS p FROM e WHERE a >= {TREE} - 5 UNION ALL SELECT s, e.b, p || ',' || e.b FROM r JOIN e ON e.a = r.b) SELECT s AS a, b, p || ']' AS p FROM r")
def paths_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths over the same edges, from the last five nodes."""
    e = tree(spark, sf_dir)
    e.catalog.rows("from", [(TREE - 1 - i,) for i in range(5)], "a long", required=["a"])
    return e.query('from(?a), graph.paths("up", ?a, ?b, "shortest", 1, 0, ?p) => ?a, ?b, ?p', names=["a", "b", "p"])


@made("recursion_large", f"WITH RECURSIVE e AS {UP}, r AS (SELECT a, 1 AS h FROM e WHERE b = 0 UNION ALL SELECT e.a, h + 1 FROM r JOIN e ON e.b = r.a) SELECT 'odd' AS w, count(*) AS n FROM r WHERE h % 2 = 1")
def recursion_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutual recursion over more tuples than rounds in memory may read."""
    program = 'odd(?c) :- kid(0, ?c); even(?c) :- odd(?p), kid(?p, ?c); odd(?c) :- even(?p), kid(?p, ?c); ?w = "odd", odd(?c) => ?w, count(?c)'
    return tree(spark, sf_dir).query(program, names=["w", "n"])


asked("closure_lineitem", 'sold(?s, ?p) :- lineitem(_, ?p, ?s, _, _, _, _, _, _, _, _); near(?a, ?b) :- sold(?a, ?p), sold(?b, ?p), ?a != ?b; graph.closure("near", 1, ?b, 1, 2, ?h) => ?h, count(?b)', "h n",
      "WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT x.s AS a, y.s AS b FROM s x JOIN s y ON x.p = y.p AND x.s <> y.s), "
      "one AS (SELECT b, 1 AS h FROM e WHERE a = 1), two AS (SELECT DISTINCT e.b, 2 AS h FROM one JOIN e ON e.a = one.b WHERE e.b NOT IN (SELECT b FROM one)) "
      "SELECT h, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1", limits=JOINED)  # fmt: skip
asked("conversation_paths", TURN + 'conversations(?c, 0, _, _), ?s = ?c * 1000, graph.paths("follows", ?s, ?e, "acyclic", 2, 2, ?p) => ?c, ?p', "c p",
      "SELECT DISTINCT a.conv_id AS c, '[' || (a.conv_id * 1000) || ',' || (a.conv_id * 1000 + 1) || ',' || (a.conv_id * 1000 + 2) || ']' AS p FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = 2 WHERE a.turn = 0", limits=JOINED)

CHAIN = 150


@made("chain_rows", f"SELECT {CHAIN * (CHAIN - 1) // 2} AS n, {399} AS bound")
def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a chain of 150, and what the start of a chain of 400 reaches."""
    e = Engine(spark)
    chain = lambda n: spark.range(n - 1).select(F.concat(F.lit("v"), "id").alias("a"), F.concat(F.lit("v"), F.col("id") + 1).alias("b"))
    e.catalog.add("short", chain(CHAIN), required=["a", "b"]).add("long", chain(400), required=["a", "b"])
    rules = lambda r: f"r(?a, ?b) :- {r}(?a, ?b); r(?a, ?c) :- r(?a, ?b), {r}(?b, ?c); "
    every, bound = e.query(rules("short") + "r(?a, ?b)").count(), e.query(rules("long") + 'r("v0", ?b)').count()
    return told(spark, [(every, bound)], "n long, bound long")


@made("walk_citations", "SELECT n_nationkey AS b, n_nationkey AS h, (SELECT string_agg('e' || lpad(x.n_nationkey::VARCHAR, 2, '0'), ';' ORDER BY x.n_nationkey) FROM nation x WHERE x.n_nationkey < nation.n_nationkey) AS cites FROM nation WHERE n_nationkey BETWEEN 1 AND 4")
def walk_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk cites the facts of its steps."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    e = Engine(spark)
    e.catalog.add("road", n.select(k.alias("a"), (k + 1).alias("b"), F.array(F.concat(F.lit("e"), F.lpad(k.cast("string"), 2, F.lit("0")))).alias("__cites")))
    return e.query('graph.closure("road", 0, ?b, 1, 4, ?h) => ?b, ?h', names=["b", "h"], cites=True).withColumn("cites", F.array_join("cites", ";"))


def hosted(spark: SparkSession, sf_dir: str) -> Engine:
    """Predicates that Python functions of a host generate; its steps lead from a nation to the next."""
    step = lambda n: [n + 1] if n < 24 else []
    named = lambda n: [(f"e{n}", n + 1)] if n < 24 else []
    e = engine(spark, sf_dir)
    for p in (
        host.reach("go.reach", step, "int"), host.hops("go.hops", step, "int"), host.paths("go.paths", step, 3, "int"), host.edge_paths("go.edges", named, 2, "int"),
        host.generator(lambda n: [(i, int(c)) for i, c in enumerate(str(n))], "digits", (0,), (1, 2), ("int", "int"), doc="a number's digits"),
        host.generator(lambda n, by: [n // by, n % by], "parted", (0,), (2,), ("int",), constants=(1,)),
        host.generator(lambda n: [(n * n, n**3)], "powers", (0,), (1, 2), ("bigint", "bigint"), least=2),
        host.generator(lambda n: [f"{n}-{uuid.uuid4().hex}"], "fresh", (0,), (1,), ("string",), volatile=True),
    ):
        e.catalog.predicate(p)
    return e


def hosted_query(name: str, program: str, columns: str, sql: str) -> None:
    @made(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hosted(spark, sf_dir).query(program, names=columns.split())


hosted_query("host_reach", "nation(?k, _, 1), go.reach(?k, ?b) => ?k, count(?b)", "k n", "SELECT n_nationkey AS k, 24 - n_nationkey AS n FROM nation WHERE n_regionkey = 1 AND n_nationkey < 24")
hosted_query("host_hops", "nation(?k, _, 1), go.hops(?k, ?b, ?h), nation(?b, _, 2) => ?k, ?b, ?h", "k b h", "SELECT a.n_nationkey AS k, b.n_nationkey AS b, b.n_nationkey - a.n_nationkey AS h FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE a.n_regionkey = 1 AND b.n_regionkey = 2")
hosted_query("host_paths", "go.paths(5, ?b, ?p), path.length(?p, ?l) => ?b, ?p, ?l", "b p l", values([(6, "[5,6]", 1), (7, "[5,6,7]", 2), (8, "[5,6,7,8]", 3)], "b, p, l"))
hosted_query("host_edge_paths", "go.edges(5, ?b, ?p) => ?b, ?p", "b p", values([(6, '{"nodes":[5,6],"edges":["e5"]}'), (7, '{"nodes":[5,6,7],"edges":["e5","e6"]}')], "b, p"))
hosted_query("host_generator", "nation(?k, _, _), digits(?k, ?i, ?d) => ?k, ?i, ?d", "k i d", "SELECT n_nationkey AS k, i, CAST(substr(n_nationkey::VARCHAR, CAST(i + 1 AS BIGINT), 1) AS INTEGER) AS d FROM nation, (SELECT unnest([0, 1]) AS i) WHERE i < length(n_nationkey::VARCHAR)")
hosted_query("host_constants", "nation(?k, _, _), parted(?k, 7, ?p) => ?k, ?p", "k p", "SELECT n_nationkey AS k, n_nationkey // 7 AS p FROM nation UNION SELECT n_nationkey, n_nationkey % 7 FROM nation")
hosted_query("host_optional_arguments", "nation(?k, _, _), powers(?k, ?s), ?s < 30, powers(?k, ?t, ?c) => ?k, ?s, ?c", "k s c", "SELECT n_nationkey AS k, n_nationkey * n_nationkey AS s, n_nationkey * n_nationkey * n_nationkey AS c FROM nation WHERE n_nationkey < 6")
hosted_query("host_volatile", "nation(?k, _, _), fresh(?k, ?a), fresh(?k, ?b), ?a != ?b => count(?k)", "n", "SELECT count(*) AS n FROM nation")
hosted_query("host_negated", "nation(?k, ?n, _), not go.reach(?k, 20) => ?n", "n", "SELECT n_name AS n FROM nation WHERE n_nationkey >= 20")

# Functions

asked("str_case", 'nation(?k, ?n, _), str.concat(?n, "straße", ?x), str.upper(?x, ?u), str.concat(?n, "ΟΔΟΣ", ?y), str.lower(?y, ?l) => ?k, ?u, ?l', "k u l", "SELECT n_nationkey AS k, n_name || 'STRAßE' AS u, lower(n_name) || 'οδοσ' AS l FROM nation")
asked("num_neg", "supplier(?s, _, _, ?b), num.neg(?b, ?m), num.neg(?n, ?b) => ?s, ?m, ?n", "s m n", "SELECT s_suppkey AS s, -s_acctbal AS m, -s_acctbal AS n FROM supplier")
asked("absent_test", "nation(?k, ?n, _), optional { supplier(?s, _, ?k, ?b), ?b > 9000 }, absent(?s) => ?n", "n", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
asked("not_a_number", "part(?p, ?n, _, _, _, _), ?x = ?n + 1 => count(?x)", "n", "SELECT 0 AS n")
asked("not_a_list", "nation(_, ?n, _), list.length(?n, ?l) => count(?l)", "n", "SELECT 0 AS n")
asked("not_a_path", 'nation(_, ?n, _), path.step(?n, ?i, ?f, ?t) => count(?i)', "n", "SELECT 0 AS n")


@made("num_value", "SELECT s_suppkey AS s, s_acctbal * 0.001 AS n FROM supplier WHERE s_acctbal * 0.001 > 5")
def num_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number without its unit compares with plain ones."""
    e = engine(spark, sf_dir)
    e.catalog.add("current", spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_acctbal"), required=["s_suppkey"], units={"s_acctbal": "mA"})
    return e.query("current(?s, ?i), num.value(?i, ?n), ?n > 5 => ?s, ?n", names=["s", "n"])


# Sources


def remote(spark: SparkSession, sf_dir: str, **offers) -> Engine:
    """nation in a store of the host's, which finds rows by key and by region."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    names = ["n_nationkey", "n_name", "n_regionkey"]
    tests = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__}

    def find(bound: lookup.Asked, _part: object) -> list[tuple]:
        fits = lambda r: all(r[names.index(c)] in vs for c, vs in bound.items()) and all(tests[op](r[names.index(c)], v) for op, c, v in bound.tests)
        return [r for r in rows if fits(r)]

    e = engine(spark, sf_dir)
    lookup.register(e.catalog, "far_nation", "n_nationkey int, n_name string, n_regionkey int", find, required=names, offers=offers)
    return e


def remote_query(name: str, program: str, columns: str, sql: str, **offers) -> None:
    @made(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return remote(spark, sf_dir, **offers).query(program, names=columns.split())


def grouped(bound: dict, columns: list[str], made_: list[tuple[str, str]]) -> list[tuple]:
    """What the store says of its groups: here five regions of five nations each."""
    return [tuple([r] * len(columns) + [5 if f == "count" else r for f, _ in made_]) for r in range(5)]


remote_query("lookup_constant", "far_nation(7, ?n, ?r) => ?n, ?r", "n r", "SELECT n_name AS n, n_regionkey AS r FROM nation WHERE n_nationkey = 7")
remote_query("lookup_tests", 'far_nation(?k, ?n, _), ?k > 3, str.suffix(?n, "1") => ?k, ?n', "k n", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey > 3 AND ends_with(n_name, '1')")
remote_query("lookup_batches", 'customer(?c, _, ?k, ?b, "BUILDING"), ?b > 9000, far_nation(?k, ?n, ?r) => ?n, ?r, count(?c)', "n r c", "SELECT n_name AS n, n_regionkey AS r, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 GROUP BY 1, 2", keys=("n_nationkey",), batch=4, cache=100)
remote_query("lookup_groups", "far_nation(?k, _, ?r) => ?r, count(?k)", "r n", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1", summarize=grouped)
remote_query("lookup_page", "far_nation(?k, ?n, ?r) => ?k, ?n, ?r order by ?k desc limit 3 offset 1", "k n r", "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation ORDER BY k DESC LIMIT 3 OFFSET 1",
             page=lambda bound, order, n: [(24 - i, f"NATION_{24 - i}", (24 - i) % 5) for i in range(n)])


@made("lookup_walk", "SELECT n_nationkey AS b, n_nationkey - 3 AS h FROM nation WHERE n_nationkey BETWEEN 4 AND 8")
def lookup_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk that the store of its edges makes itself: the edges are never read."""
    e = Engine(spark)

    def refuse(_bound: object, _part: object) -> list[tuple]:
        raise RuntimeError("read")

    walk = lambda starts, low, high: [(s, s + h, h) for s in starts for h in range(low, high + 1) if s + h < 25]
    lookup.register(e.catalog, "far_road", "a int, b int", refuse, offers={"walk": walk})
    return e.query('graph.closure("far_road", 3, ?b, 1, 5, ?h) => ?b, ?h', names=["b", "h"])


@made("lookup_join", "SELECT a.n_nationkey AS k, b.n_name AS n FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey < 4 AND b.n_regionkey <> 2")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relations of one store, which it joins itself: neither is read."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]

    def refuse(_bound: object, _part: object) -> list[tuple]:
        raise RuntimeError("read")

    def join(atoms: list, names: list[str]) -> list[tuple]:
        held = {"far_step": [(r[0], r[0] + 1) for r in rows], "far_land": rows}
        found: list[dict] = [{}]
        for rel, args in atoms:
            more = []
            for env in found:
                for row in held[rel]:
                    new = {**env}
                    if all(a is None or (a[1] == v if a[0] == "const" else new.setdefault(a[1], v) == v) for a, v in zip(args, row, strict=True)):
                        more.append(new)
            found = more
        return [tuple(env[n] for n in names) for env in found]

    e = Engine(spark)
    offers = {"push": join, "home": "far"}
    lookup.register(e.catalog, "far_step", "a int, b int", refuse, required=["a", "b"], offers=offers)
    lookup.register(e.catalog, "far_land", "k int, n string, r int", refuse, required=["k", "n", "r"], offers=offers)
    return e.query("far_step(?k, ?b), far_land(?b, ?n, ?r), ?k < 4, ?r != 2 => ?k, ?n", names=["k", "n"])


@made("memory_rows", "SELECT 'a' AS k, 1.5 AS v UNION ALL SELECT 'b', NULL")
def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.catalog.rows("r", [("a", 1.5), ("b", None)], "k string, v double")
    return e.query("r(?k, ?v)", names=["k", "v"])


@made("fact_text", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
def fact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read from text."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    e = engine(spark, sf_dir)
    facts.load(e.catalog, "#: lies(nation, region)\n" + "\n".join(f'lies("{r.n_name}", {r.n_regionkey})' for r in rows))
    return e.query("lies(?n, ?k), region(?k, ?r) => ?n, ?r", names=["n", "r"])


@made("store_versions", "SELECT n_nationkey AS k, n_name AS n, 1 AS v FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 99, 'NEW', 1 UNION ALL SELECT n_nationkey, n_name, 0 FROM nation")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's relation before and after a session's changes, which travel as text."""
    kept = facts.Store(spark, fresh_path(spark, "store"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    old = nation.where("n_nationkey = 3").first()
    kept.create(nation)
    session = facts.Session(kept, "nation")
    session.changes = facts.decode_changes(facts.encode_changes([("removed", "nation", tuple(old)), ("added", "nation", (99, "NEW", 0))]))
    session.commit()
    both = [kept.read(v).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"), F.lit(v).alias("v")) for v in (0, 1)]
    return both[0].union(both[1])


@made("materialized", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.materialize("pending", 'pending(?c) :- orders(_, ?c, "P", _, _, _);')
    return e.query("pending(?c), customer(?c, _, _, _, ?s) => ?s, count(?c)", names=["s", "n"])


@made("timed_federation", "SELECT n_name AS n, v FROM nation, (SELECT unnest([0, 3]) AS v) WHERE n_regionkey > 1 OR (n_regionkey = 0 AND v < 2)")
def timed_federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member with versions and one without: the latter's facts hold at every version."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    span = F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.lit(2).cast("bigint").alias("to")))
    e = Engine(spark)
    e.catalog.add("nation", federated({"old": n.where("n_regionkey = 0").withColumn("__versions", span), "always": n.where("n_regionkey > 1")}), required=n.columns)
    return e.query("nation(_, ?n, _) => ?n", names=["n"], across=[0, 3]).select("n", F.explode("versions").alias("v"))


@made("federation_walk", "SELECT n_nationkey AS b FROM nation WHERE n_nationkey > 3")
def federation_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk that crosses from one member to another at every step."""
    road = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b")).where("b < 25")
    e = Engine(spark)
    e.catalog.add("road", federated({"even": road.where("a % 2 = 0"), "odd": road.where("a % 2 = 1")}), required=["a", "b"])
    return e.query('graph.closure("road", 3, ?b, 1, 0, ?h) => ?b', names=["b"])


# Versions


@made("version_sets", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN '[]' ELSE '[{\"from\":0,\"to\":' || least(20, n_nationkey) || '}]' END AS before, CASE WHEN n_nationkey >= 15 THEN '[]' ELSE '[{\"from\":' || (n_nationkey + 5) || ',\"to\":20}]' END AS after, CASE WHEN n_nationkey >= 20 THEN '[]' ELSE '[{\"from\":' || n_nationkey || ',\"to\":' || least(20, n_nationkey + 5) || '}]' END AS shared FROM nation")
def version_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the versions 0 to 19 those before, after and inside a range that slides over them."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    span = lambda a, b: F.array(F.struct(a.cast("bigint").alias("from"), b.cast("bigint").alias("to")))
    every, own, low = span(F.lit(0), F.lit(20)), span(F.col("k"), F.col("k") + 5), span(F.lit(0), F.col("k"))
    rest = versions.minus(every, own)
    return n.select("k", F.to_json(versions.both(versions.minus(every, versions.either(own, span(F.col("k") + 5, F.lit(40)))), low)).alias("before"), F.to_json(versions.minus(rest, low)).alias("after"), F.to_json(versions.both(every, own)).alias("shared"))


@made("version_pages", "SELECT c, s, v FROM (SELECT c_custkey AS c, c_mktsegment AS s, v, row_number() OVER (PARTITION BY v ORDER BY c_custkey DESC) AS p FROM customer, (SELECT unnest([1, 4]) AS v) WHERE c_custkey % 5 <= v AND v < CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 5 END) WHERE p BETWEEN 2 AND 4")
def version_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).query("customer(?c, _, ?s) => ?c, ?s order by ?c desc limit 3 offset 1", names=["c", "s"], across=[1, 4])
    return rows.select("c", "s", F.explode("versions").alias("v"))


GONE = "(a * 7 + v) % 25 = 0"


@made("version_recursion", f"WITH RECURSIVE e AS (SELECT v, a, a + 1 AS b FROM range(50) x(v), range(8) y(a) WHERE NOT {GONE}), r AS (SELECT v, a, b FROM e UNION SELECT r.v, r.a, e.b FROM r JOIN e ON e.v = r.v AND e.a = r.b) SELECT v, count(*) AS n FROM r GROUP BY 1")
def version_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure at fifty versions at once, of edges of which a twenty-fifth is gone in each."""
    held = lambda a: [(v, v + 1) for v in range(50) if (a * 7 + v) % 25]
    e = Engine(spark)
    e.catalog.rows("step", [(a, a + 1, held(a)) for a in range(8)], "a int, b int, __versions array<struct<from:bigint,to:bigint>>", required=["a", "b"])
    out = e.query("r(?a, ?b) :- step(?a, ?b); r(?a, ?c) :- r(?a, ?b), step(?b, ?c); r(?a, ?b) => count(?b)", names=["n"], across=range(50))
    return out.select(F.explode("versions").alias("v"), "n")


def cited_roads(spark: SparkSession) -> Engine:
    e = Engine(spark)
    rows = [("a", "b", ["old"], "r1", [(0, 2)]), ("a", "b", ["new"], "r2", [(2, 9)]), ("b", "c", ["far"], None, [(0, 9)])]
    e.catalog.rows("road", rows, "f string, t string, __cites array<string>, __id string, __versions array<struct<from:bigint,to:bigint>>")
    return e


REACH = "r(?a, ?b) :- road(?a, ?b); r(?a, ?c) :- r(?a, ?b), road(?b, ?c); r(?a, ?b)"


@made("cites_at", values([("0", "far;old"), ("5", "far;new"), ("9", "")]))
def cites_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cited_roads(spark)
    return told(spark, [(str(v), ";".join(e.cites_at(REACH, ("a", "c"), v))) for v in (0, 5, 9)])


@made("witnesses", values([("0", 'r1;road("b", "c")'), ("5", 'r2;road("b", "c")')]))
def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of a derivation at a version; facts with an id are told by it."""
    e = cited_roads(spark)
    return told(spark, [(str(v), ";".join(sorted(set().union(*[d.leaves() for d in e.why(REACH, ("a", "c"), at=v)])))) for v in (0, 5)])


@made("canonical_cites", values([("a", "b", "1"), ("a", "c", "3"), ("b", "c", "2")], "a, b, cites"))
def canonical_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several derivations the shortest is cited, then that of the first rule by its text, then the least."""
    e = Engine(spark)
    e.catalog.rows("edge", [("a", "b", ["1"]), ("a", "b", ["9"]), ("b", "c", ["2"]), ("a", "c", ["3"])], "f string, t string, __cites array<string>").rows("long", [("a", "c", ["0"])], "f string, t string, __cites array<string>")
    program = "m(?a, ?b) :- long(?a, ?b); r(?a, ?b) :- m(?a, ?b); r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); r(?a, ?b)"
    return e.query(program, names=["a", "b"], cites=True).withColumn("cites", F.array_join("cites", ";"))


@made("column_kinds", values([("c", "bigint"), ("n", "string"), ("t", "double")]))
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).kinds("customer(?c, ?n, _, ?t, _) => ?c, ?n, ?t")
    return told(spark, [(n, "bigint" if t == "int" else t) for n, t in found])


# Cypher

ROADS = Graph((*GRAPH.nodes,), (*GRAPH.edges, Edge("NEXT", "road", 2)), ("fact", 0, 1, 2), {"home": "home"})


def roads(spark: SparkSession, sf_dir: str) -> Engine:
    """The tables' graph with a road from each nation to the next, key-value properties of some, and a property by rule."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    e = engine(spark, sf_dir)
    e.catalog.add("road", n.select(k.alias("a"), (k + 1).alias("b")).where("b < 25"), required=["a", "b"])
    e.catalog.add("fact", n.where("n_regionkey = 2").select(k.alias("n"), F.lit("climate").alias("k"), F.concat(F.lit("dry"), k).alias("v")))
    e.catalog.add("home", n.select(k.alias("n"), F.concat(F.lit("home of "), "n_name").alias("v")))
    return e


def road_query(name: str, text: str, sql: str, **more) -> None:
    QUERIES[name], ORACLES[name] = (lambda spark, sf_dir: roads(spark, sf_dir).cypher(ROADS, text, **more)), sql


road_query("cypher_lengths", "MATCH (a:Nation {key: 3})-[:NEXT*2..4]->(b:Nation) RETURN b.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey BETWEEN 5 AND 7")
road_query("cypher_undirected", "MATCH (a:Nation {key: 3})-[:NEXT]-(b:Nation) RETURN b.key AS k", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (2, 4)")
road_query("cypher_types", "MATCH (a:Nation {key: 3})-[:NEXT|IN]->(b) RETURN b AS k", "SELECT 4 AS k UNION SELECT n_regionkey FROM nation WHERE n_nationkey = 3")
road_query("cypher_relationship", "MATCH (a:Nation)-[r:NEXT]->(b:Nation) WHERE a.key < 2 RETURN type(r) AS t, startNode(r) AS s, endNode(r) AS e", "SELECT 'NEXT' AS t, n_nationkey AS s, n_nationkey + 1 AS e FROM nation WHERE n_nationkey < 2")
road_query("cypher_edge_property", "MATCH (o:Order)-[s:SUPPLIED_BY]->(p:Supplier) WHERE s.quantity > 49 RETURN p.key AS k, count(s) AS n", "SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1")
road_query("cypher_path", "MATCH p = (a:Nation {key: 3})-[:NEXT*1..2]->(b:Nation) RETURN p, length(p) AS l, nodes(p) AS n", values([("[3,4]", 1, "[3,4]"), ("[3,4,5]", 2, "[3,4,5]")], "p, l, n"))
road_query("cypher_shortest_path", "MATCH p = shortestPath((a:Nation {key: 3})-[:NEXT*]->(b:Nation {key: 6})) RETURN length(p) AS l, nodes(p) AS n", values([(3, "[3,4,5,6]")], "l, n"))
road_query("cypher_call", "MATCH (r:Region) CALL str.split(r.name, 'E') YIELD index AS i, part RETURN r.key AS k, i, part", "SELECT r_regionkey AS k, generate_subscripts(string_split(r_name, 'E'), 1) - 1 AS i, unnest(string_split(r_name, 'E')) AS part FROM region")
road_query("cypher_params", "MATCH (c:Customer) WHERE c.segment = $segment AND c.balance > $least RETURN c.key AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000", params={"segment": "MACHINERY", "least": 9000})
road_query("cypher_page", "MATCH (c:Customer) RETURN c.balance AS b, c.key AS k ORDER BY b DESC, k SKIP 4 LIMIT 6", "SELECT c_acctbal AS b, c_custkey AS k FROM customer ORDER BY b DESC, k LIMIT 6 OFFSET 4")
road_query("cypher_union_all", "MATCH (n:Nation) WHERE n.key < 8 RETURN n.region AS r UNION ALL MATCH (n:Nation) WHERE n.key > 20 RETURN n.region AS r", "SELECT n_regionkey AS r FROM nation WHERE n_nationkey < 8 UNION SELECT n_regionkey FROM nation WHERE n_nationkey > 20")
road_query("cypher_key_value", "MATCH (n:Nation) WHERE n.climate STARTS WITH 'dry1' RETURN n.name AS name, n.climate AS c", "SELECT n_name AS name, 'dry' || n_nationkey AS c FROM nation WHERE n_regionkey = 2 AND starts_with(n_nationkey::VARCHAR, '1')")
road_query("cypher_derived", "MATCH (n:Nation {key: 5}) RETURN n.home AS h", "SELECT 'home of ' || n_name AS h FROM nation WHERE n_nationkey = 5")


@made("cypher_store", "SELECT 'N' || n_nationkey AS n, 'R' || n_regionkey AS r, n_name AS name FROM nation WHERE n_regionkey = 1")
def cypher_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of nodes, edges and attributes, whose labels and types are read from its data."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key, home = F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey")
    e = Engine(spark)
    e.catalog.add("node", n.select(key.alias("id"), F.lit("nation").alias("kind")).union(n.select(home, F.lit("world_region"))).distinct())
    e.catalog.add("edge", n.select(key.alias("f"), F.lit("lies_in").alias("kind"), home.alias("t"))).add("attr", n.select(key.alias("id"), F.lit("name").alias("k"), F.col("n_name").alias("v")))
    return e.cypher(store(*kinds_of(e.catalog)), "MATCH (a:Nation)-[:LIES_IN]->(r:WorldRegion) WHERE r = 'R1' RETURN a AS n, r, a.name AS name")


CYPHER_REFUSED = {"CREATE (a)": "gap", "MATCH (a:Nope) RETURN a": "mistake", "MATCH (a:Nation) RETURN b": "mistake", "MATCH (a:Nation)-[:NO]->(b) RETURN b": "mistake", "MATCH (a:Nation) WITH a ORDER BY a.name RETURN a": "gap", "RETURN 1": "gap", "MATCH (a:Nation": "mistake"}


@made("cypher_refusals", values([*CYPHER_REFUSED.items(), ("place", "2:17"), ("program", "yes"), ("grammar", "yes")]))
def cypher_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text in CYPHER_REFUSED:
        try:
            compile_query(GRAPH, text)
            rows.append((text, "none"))
        except Refused as x:
            rows.append((text, "gap" if x.gap else "mistake"))
    text = "MATCH (a:Nation)\nRETURN a.name + ]"
    try:
        compile_query(GRAPH, text)
    except Refused as x:
        rows.append(("place", ":".join(map(str, located(text, x)[:2]))))
    program = explained(GRAPH, "MATCH (n:Nation) WHERE n.key < 3 RETURN n.name AS name")
    rows.append(("program", "yes" if parse(program.split("\ncolumns")[0]) and program.endswith("columns: name") else "no"))
    text = grammar(GRAPH)
    rows.append(("grammar", "yes" if '"LIVES_IN"' in text and '"Nation"' in text and "root ::=" in text else "no"))
    return told(spark, rows)


# The API


@made("printer", "SELECT 'printed' AS name, 8 AS n")
def printer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that read back as they were printed."""
    texts = [*REFUSED.values()][4:6], [RING + 'ring(?a, ?b) => ?a, count(?b) having count(?b) > 1 order by ?a desc limit 3 offset 1', STEP + "step(?a, ?e, ?b)", NEXT + "next(?a, ?b), not nation(?b, _, 2), optional { region(?a, ?n) } => ?a, ?n",
             "region(?k, ?n), ?c = count(?m) : { nation(?m, _, ?k) } => ?n, (?c * 2)", "p(?x) :- region(?x, _).\n?- p(?x).", "region(?k, _) as ?f => ?f"]
    same = [show(parse(show(parse(t)))) == show(parse(t)) for t in [*texts[0], *texts[1]]]
    return told(spark, [("printed", sum(same))], "name string, n int")


@made("analyses", values([("component", "p,q"), ("empty", "nation(?k, \"NOWHERE\", ?r)"), ("lint", "1"), ("reads", "nation,region"), ("valid", "yes"), ("explained", "yes"), ("described", "nation(n_nationkey: num, n_name: text, n_regionkey: num)"), ("members", "far.land"), ("place", "1:11")]))
def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "far.dl").write_text("land(?n) :- nation(_, ?n, _); _own(?k) :- nation(?k, _, _);")
        e.catalog.modules_in(folder)
    rules = parse("p(?a) :- region(?a, _); p(?a) :- q(?a); q(?a) :- p(?a), nation(?a, _, _); p(?a)").rules
    by: dict = {}
    for r in rules:
        by.setdefault(r.rel, []).append(r)
    e.validate("nation(?k, _, _) => ?k")
    rows = [
        ("component", ",".join(sorted(rewrite.components(by)[0]))),
        ("empty", e.why_empty('region(?r, _), nation(?k, "NOWHERE", ?r)')),
        ("lint", str(len(e.lint("nation(?a, _, ?r), nation(?b, _, ?r) => ?r")))),
        ("reads", ",".join(sorted({n for r in rules for n, _ in rewrite.reads(r.body)} - set(by)))),
        ("valid", "yes"),
        ("explained", "yes" if "nation(?k, _, _)" in e.explain("nation(?k, _, _) => ?k") else "no"),
        ("described", e.catalog.describe("nation")),
        ("members", ",".join(e.catalog.members("far"))),
    ]
    try:
        parse("nation(?k ?n)")
    except SyntaxRefused as x:
        rows.append(("place", ":".join(map(str, located("nation(?k ?n)", x)[:2]))))
    return told(spark, rows)


@made("budgets", values([("rounds in memory", "over"), ("rounds by joins", "over"), ("rows in memory", "over"), ("rows by joins", "over"), ("fixpoint rows in memory", "over"), ("fixpoint rows as jobs", "over"), ("seconds", "over"), ("enough", "276")]))
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits hold in whatever way rounds are run."""
    e = engine(spark, sf_dir)
    walk = NEXT + 'graph.closure("next", ?a, ?b, 1, 0, ?h)'
    loop = NEXT + "hop(?a, ?b) :- next(?a, ?b); hop(?a, ?c) :- hop(?a, ?b), hop(?b, ?c), ?a != ?c; hop(?a, ?b)"

    def tried(program: str, **limits) -> str:
        try:
            return str(e.query(program, limits=Limits(**limits)).count() - 24)
        except BudgetExceeded:
            return "over"

    return told(spark, [
        ("rounds in memory", tried(walk, rounds=5)), ("rounds by joins", tried(walk, rounds=5, edges=0)), ("rows in memory", tried(walk, rows=30)), ("rows by joins", tried(walk, rows=30, edges=0)),
        ("fixpoint rows in memory", tried(loop, rows=30)), ("fixpoint rows as jobs", tried(loop, rows=30, tuples=0)), ("seconds", tried(walk, seconds=0, edges=0)), ("enough", tried(walk, rounds=30, rows=400)),
    ])


@made("agent_server", values([("initialize", "2025-06-18"), ("tools", "8"), ("query", '[["ASIA"]]'), ("refused", "unknown"), ("ask", "5"), ("missing", "-32601"), ("broken", "-32700")]))
def agent_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation with the server of an agent's tools, over text streams."""
    e = engine(spark, sf_dir)
    session = plain.Session(e, lambda _prompt: "```\nregion(?k, ?n) => count(?k)\n```", votes=2)
    server = Server(Tools(e, GRAPH), lambda question: {"rows": session.ask(question).rows})
    call = lambda i, name, **arguments: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    said = [
        json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/list"}),
        call(3, "query", program="region(2, ?n) => ?n"), call(4, "query", program="regions(?n)"), call(5, "ask", question="how many regions?"), json.dumps({"jsonrpc": "2.0", "id": 6, "method": "nothing"}), "{",
    ]
    out = io.StringIO()
    serve(server, said, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    text = lambda r: json.loads(r["result"]["content"][0]["text"])
    return told(spark, [
        ("initialize", got[0]["result"]["protocolVersion"]), ("tools", str(len(got[1]["result"]["tools"]))), ("query", json.dumps(text(got[2])["rows"])), ("refused", text(got[3])["kind"]),
        ("ask", str(text(got[4])["rows"][0][0])), ("missing", str(got[5]["error"]["code"])), ("broken", str(got[6]["error"]["code"])),
    ])


@made("plain_language", values([("answered", "5"), ("tries", "2"), ("agreed", "2"), ("facts", "1"), ("refused lines", "2"), ("card", "yes"), ("chain", "customer(?x0, _, ?x1, _, _), nation(?x1, _, ?x2) => ?x0, ?x2")]))
def plain_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that a model gets wrong at first, votes of several, facts found in a text, and a chain of relations."""
    e = engine(spark, sf_dir)
    said = iter(["regions(?k, ?n) => count(?k)", "region(?k, ?n) => count(?k)"])
    reply = plain.Session(e, lambda _prompt: next(said)).ask("how many regions are there?")
    told_ = iter(["region(?k, _) => count(?k)", "nation(?k, _, _) => count(?k)", "region(?k, ?n) => count(distinct ?n)"])
    voted = plain.Session(e, lambda _prompt: next(told_), votes=3).ask("and once more?")
    found, refused = plain.extracted(e.catalog, lambda _prompt: 'region(7, "ATLANTIS")\nregion("x", "y")\nnothing', "Atlantis is region 7.", ["region"])
    for name, kinds in (("customer", {"c_custkey": "Customer", "c_nationkey": "Nation"}), ("nation", {"n_nationkey": "Nation", "n_regionkey": "Region"})):
        e.catalog.relations[name].entities.update(kinds)
    (chain,) = plain.chains(e.catalog, "Customer", "Region")
    card = plain.card(e)
    return told(spark, [
        ("answered", str(reply.rows[0][0])), ("tries", str(reply.tries)), ("agreed", str(voted.agreed)), ("facts", str(len(found["region"]))), ("refused lines", str(len(refused))),
        ("card", "yes" if "nation(n_nationkey: num" in card and "str.split" in card else "no"), ("chain", plain.chain_program(chain, e.catalog)),
    ])


