"""Queries over the test tables, one or more for each operator, with the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.cypher import Edge, Graph, Node
from strataflow.engine import Engine
from strataflow.operators import versions
from strataflow.sources.catalog import Catalog, federated, overlaid

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents", "pages")
KEYS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type"], "conversations": ["conv_id", "turn"], "documents": ["doc_id"], "pages": ["page_id"],
}


#: Columns that tell a table's rows apart.
IDENTITY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"],
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Catalog(spark).parquet(sf_dir, TABLES, KEYS, IDENTITY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def asked(name: str, program: str, columns: str, sql: str | None, rounded: str = "", **more) -> None:
    """A query that asks a program of the test tables. Columns in `rounded` are means or sums of fractions, which depend
    on the order of addition in their last digits; both sides round them."""

    def run(spark: SparkSession, sf_dir: str, **other) -> DataFrame:
        df = engine(spark, sf_dir).query(program, names=columns.split(), **more | other)
        return df.withColumns({c: F.round(c, 4) for c in rounded.split()}) if rounded else df

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in rounded.split())}) FROM ({sql})" if rounded else sql


def made(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Scans, filters, projections

asked("flagship", 'orders(?o, ?c, "F", ?t, _, _), customer(?c, _, ?k, _, "BUILDING"), nation(?k, ?n, _) => ?n, count(?o), avg(?t) order by ?n', "nation orders mean_price",
      "SELECT n_name AS nation, count(*) AS orders, avg(o_totalprice) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' GROUP BY 1", rounded="mean_price")
asked("scan_constants", 'part(?p, ?n, "Brand#11", _, ?s, _) => ?p, ?n, ?s', "p n s", "SELECT DISTINCT p_partkey AS p, p_name AS n, p_size AS s FROM part WHERE p_brand = 'Brand#11'")
asked("filter_compare", "lineitem(?o, _, _, ?l, ?q, ?e, ?d, _, _, _, _), ?q >= 45, ?d < 0.03, ?e != 0 => ?o, ?l, ?q", "o l q", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS l, l_quantity AS q FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_extendedprice <> 0")
asked("repeated_variable", "nation(?k, ?n, ?k) => ?k, ?n", "k n", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey = n_regionkey")
asked("equality_binds", '?f = "R", lineitem(_, _, _, _, ?q, _, _, _, ?f, ?s, _) => ?f, ?s, count(?q)', "f s n", "SELECT 'R' AS f, l_linestatus AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2")
asked("expression_column", 'lineitem(?o, _, _, ?l, _, ?e, ?d, ?t, "A", _, _) => ?o, ?l, ?e * (1 - ?d) * (1 + ?t)', "o l charge", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS l, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_returnflag = 'A'")
asked("constant_column", 'region(?k, ?n) => ?n, "x", 7', "n tag num", "SELECT r_name AS n, 'x' AS tag, 7 AS num FROM region")
asked("param_one", "customer(?c, ?n, _, ?b, ?s) => ?c, ?s", "c s", "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment = 'MACHINERY'", params={"s": "MACHINERY"})
asked("param_many", "nation(?k, ?n, ?r) => ?k, ?n", "k n", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey IN (1, 3)", params={"r": [1, 3]})
asked("rule_inputs", "dear(?p, ?least) :- part(?p, _, _, _, _, ?v), ?v >= ?least; dear(?p, 950), part(?p, ?n, _, _, _, _) => ?p, ?n", "p n", "SELECT p_partkey AS p, p_name AS n FROM part WHERE p_retailprice >= 950")
asked("native_timestamp", 'orders(?o, _, _, _, ?d, _), ?d < "1996-01-01" => ?o, ?d', "o d", "SELECT o_orderkey AS o, o_orderdate AS d FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")

# Joins

asked("join_six", 'region(?r, "ASIA"), nation(?k, ?n, ?r), supplier(?s, _, ?k, _), lineitem(?o, _, ?s, _, _, ?e, ?d, _, _, _, _), orders(?o, ?c, _, _, _, _), customer(?c, _, ?k, _, _) => ?n, count(?e), avg(?d)', "nation lines discount",
      "SELECT n_name AS nation, count(*) AS lines, avg(l_discount) AS discount FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = n_nationkey WHERE r_name = 'ASIA' GROUP BY 1", rounded="discount")
asked("self_join", "supplier(?a, _, ?k, ?x), supplier(?b, _, ?k, ?y), ?a < ?b => ?a, ?b", "a b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey WHERE x.s_suppkey < y.s_suppkey")
asked("theta_join", "region(?r, ?n), region(?s, ?m), ?r < ?s => ?n, ?m", "n m", "SELECT a.r_name AS n, b.r_name AS m FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
asked("optional", "nation(?k, ?n, _), optional { supplier(?s, _, ?k, ?b), ?b > 5000 } => ?n, ?s", "n s", "SELECT DISTINCT n_name AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
asked("optional_count", "nation(?k, ?n, _), optional { customer(?c, _, ?k, ?b, _), ?b < 0 } => ?n, count(distinct ?c)", "n debtors", "SELECT n_name AS n, count(DISTINCT c_custkey) AS debtors FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY 1")
asked("anti_join", "customer(?c, ?n, _, _, _), not orders(_, ?c, 'P', _, _, _) => ?c, ?n".replace("'", '"'), "c n", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
asked("anti_join_rule", 'open(?c) :- orders(_, ?c, "O", _, _, _); customer(?c, _, ?k, _, _), not open(?c) => ?k, count(?c)', "k n", "SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
asked("ground_negation", 'region(?r, ?n), not nation(99, _, _) => ?n', "n", "SELECT r_name AS n FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)")
asked("semi_join", "big(?o) :- lineitem(?o, _, _, _, ?q, _, _, _, _, _, _), ?q > 49; orders(?o, ?c, _, ?t, _, _), big(?o) => count(?o), max(?t)", "n most", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
asked("fact_names", 'region(?k, ?n) as ?f => ?f', "f", "SELECT 'region(' || r_regionkey || ', \"' || r_name || '\")' AS f FROM region")

# Rules

asked("rule_union", 'place(?n, "region") :- region(_, ?n); place(?n, "nation") :- nation(_, ?n, _); place(?n, ?w) => ?w, count(?n)', "w n", "SELECT 'region' AS w, count(DISTINCT r_name) AS n FROM region UNION ALL SELECT 'nation', count(DISTINCT n_name) FROM nation")
asked("rule_intersect", "a(?k) :- customer(_, _, ?k, _, _); b(?k) :- supplier(_, _, ?k, _); a(?k), b(?k) => ?k", "k", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
asked("rule_except", "a(?k) :- nation(?k, _, _); b(?k) :- supplier(_, _, ?k, ?v), ?v > 8000; a(?k), not b(?k) => ?k", "k", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
asked("head_constants", 'size(?p, "large") :- part(?p, _, _, _, ?s, _), ?s > 40; size(?p, "small") :- part(?p, _, _, _, ?s, _), ?s <= 40; size(?p, ?w) => ?w, count(?p)', "w n", "SELECT CASE WHEN p_size > 40 THEN 'large' ELSE 'small' END AS w, count(*) AS n FROM part GROUP BY 1")
asked("head_expression", "net(?o, ?e * (1 - ?d)) :- lineitem(?o, _, _, _, ?q, ?e, ?d, _, _, _, _), ?q > 48; net(?o, ?v) => ?o, max(?v)", "o v", "SELECT l_orderkey AS o, max(l_extendedprice * (1 - l_discount)) AS v FROM lineitem WHERE l_quantity > 48 GROUP BY 1")
asked("strata", 'buys(?c, ?p) :- orders(?o, ?c, _, _, _, _), lineitem(?o, ?p, _, _, ?q, _, _, _, _, _, _), ?q > 45; n(?c, count(?p)) :- buys(?c, ?p); few(?c) :- n(?c, ?k), ?k < 3; customer(?c, _, _, _, ?s), few(?c) => ?s, count(?c)', "s n",
      "SELECT c_mktsegment AS s, count(*) AS n FROM customer JOIN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45) GROUP BY 1 HAVING count(*) < 3) ON o_custkey = c_custkey GROUP BY 1")

# Recursion and walks: conversations' turns, and a road of nations

NEXT = "next(?a, ?b) :- nation(?a, _, ?r), nation(?b, _, ?s), ?b = ?a + 1; "
asked("recursion_closure", NEXT + "reach(?a, ?b) :- next(?a, ?b); reach(?a, ?c) :- reach(?a, ?b), next(?b, ?c); reach(?a, ?b)", "a b",
      "WITH RECURSIVE e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, b FROM r")
asked("recursion_bound", NEXT + "reach(?a, ?b) :- next(?a, ?b); reach(?a, ?c) :- reach(?a, ?b), next(?b, ?c); reach(10, ?b)", "b", "SELECT n_nationkey AS b FROM nation WHERE n_nationkey > 10")
SUPPLY = "near(?a, ?b) :- supplier(?a, _, ?k, _), supplier(?b, _, ?k, _), ?a != ?b; "
asked("recursion_cyclic", SUPPLY + "linked(?a, ?b) :- near(?a, ?b); linked(?a, ?c) :- near(?a, ?b), linked(?b, ?c); linked(?a, ?b) => ?a, count(?b)", "a n",
      "SELECT a.s_suppkey AS a, count(DISTINCT b.s_suppkey) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE (SELECT count(*) FROM supplier c WHERE c.s_nationkey = a.s_nationkey) > 1 GROUP BY 1")
asked("recursion_mutual", NEXT + "odd(?a, ?b) :- next(?a, ?b); even(?a, ?c) :- odd(?a, ?b), next(?b, ?c); odd(?a, ?c) :- even(?a, ?b), next(?b, ?c); even(0, ?b)", "b", "SELECT n_nationkey AS b FROM nation WHERE n_nationkey > 0 AND n_nationkey % 2 = 0")
asked("recursion_nonlinear", NEXT + "hop(?a, ?b) :- next(?a, ?b); hop(?a, ?c) :- hop(?a, ?b), hop(?b, ?c), ?a != ?c; hop(?a, ?b) => count(?a), max(?b)", "n most", "SELECT count(*) AS n, max(b.n_nationkey) AS most FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
asked("same_generation", "up(?a, ?b) :- nation(?a, _, ?b); same(?x, ?y) :- up(?x, ?p), up(?y, ?p); same(?x, ?y) :- up(?x, ?a), same(?a, ?b), up(?y, ?b); same(7, ?y)", "y",
      "WITH RECURSIVE u AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation), s AS (SELECT x.a AS x, y.a AS y FROM u x JOIN u y ON x.b = y.b UNION SELECT p.a, q.a FROM u p JOIN s ON s.x = p.b JOIN u q ON q.b = s.y) SELECT y FROM s WHERE x = 7")
asked("closure_hops", NEXT + 'graph.closure("next", 3, ?b, 1, 5, ?h)', "b h", "SELECT n_nationkey AS b, n_nationkey - 3 AS h FROM nation WHERE n_nationkey BETWEEN 4 AND 8")
asked("closure_back", NEXT + 'graph.closure("next", ?a, 9, 2, 4, ?h)', "a h", "SELECT n_nationkey AS a, 9 - n_nationkey AS h FROM nation WHERE n_nationkey BETWEEN 5 AND 7")
asked("closure_zero", NEXT + 'graph.closure("next", ?a, ?b, 0, 2, ?h)', "a b h", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, b.n_nationkey - a.n_nationkey AS h FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey BETWEEN 0 AND 2")
asked("paths_acyclic", NEXT + 'graph.paths("next", 0, ?b, "acyclic", 1, 3, ?p), path.length(?p, ?n) => ?b, ?p, ?n', "b p n",
      "WITH RECURSIVE w AS (SELECT 0 AS b, '[0' AS p, 0 AS n UNION ALL SELECT b + 1, p || ',' || (b + 1), n + 1 FROM w WHERE n < 3) SELECT b, p || ']' AS p, n FROM w WHERE n > 0")
asked("paths_shortest", NEXT + 'graph.paths("next", ?a, ?b, "shortest", 4, 4, ?p) => ?a, ?b, ?p', "a b p", "SELECT n_nationkey AS a, n_nationkey + 4 AS b, '[' || n_nationkey || ',' || (n_nationkey + 1) || ',' || (n_nationkey + 2) || ',' || (n_nationkey + 3) || ',' || (n_nationkey + 4) || ']' AS p FROM nation WHERE n_nationkey + 4 IN (SELECT n_nationkey FROM nation)")
asked("paths_steps", NEXT + 'graph.paths("next", 2, 5, "trail", 1, 0, ?p), path.step(?p, ?i, ?f, ?t), path.node(?p, 0, ?s) => ?i, ?f, ?t, ?s', "i f t s", "SELECT CAST(n_nationkey - 2 AS BIGINT) AS i, CAST(n_nationkey AS VARCHAR) AS f, CAST(n_nationkey + 1 AS VARCHAR) AS t, '2' AS s FROM nation WHERE n_nationkey BETWEEN 2 AND 4")
TURN = "follows(?a, ?b) :- conversations(?c, ?t, _, _), conversations(?c, ?u, _, _), ?u = ?t + 1, ?a = ?c * 1000 + ?t, ?b = ?c * 1000 + ?u; "
asked("conversation_depth", TURN + 'conversations(?c, 0, _, _), ?s = ?c * 1000, graph.closure("follows", ?s, ?e, 1, 0, ?h) => ?c, max(?h)', "c depth",
      "SELECT conv_id AS c, max(turn) AS depth FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE g = -1 AND turn > 0 GROUP BY 1")

# Aggregates

asked("aggregates", "lineitem(_, _, _, _, ?q, _, ?d, _, ?f, ?s, _) => ?f, ?s, count(?q), sum(?q), avg(?d), min(?q), max(?d), count(distinct ?q)", "f s n total mean least most kinds",
      "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS total, avg(l_discount) AS mean, min(l_quantity) AS least, max(l_discount) AS most, count(DISTINCT l_quantity) AS kinds FROM lineitem GROUP BY 1, 2", rounded="mean")
asked("aggregate_global", 'part(?p, _, _, _, ?s, _), ?s > 1000 => count(?p), sum(?s), max(?s)', "n total most", "SELECT count(*) AS n, coalesce(sum(p_size), 0) AS total, max(p_size) AS most FROM part WHERE p_size > 1000")
asked("having", "orders(?o, ?c, _, ?t, _, _) => ?c, count(?o) having count(?o) > 15, max(?t) >= 100", "c n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15 AND max(o_totalprice) >= 100")
asked("head_aggregate", "load(?s, count(?o)) :- lineitem(?o, _, ?s, _, _, _, _, _, _, _, _); load(?s, ?n), supplier(?s, ?name, _, _) => ?name, ?n order by ?n desc, ?name limit 5", "name n", "SELECT s_name AS name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
asked("body_aggregate", "nation(?k, ?n, _), ?c = count(?s) : { supplier(?s, _, ?k, _) }, ?m = max(?b) : { customer(_, _, ?k, ?b, _) } => ?n, ?c, ?m", "n suppliers richest",
      "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS richest FROM nation")
asked("body_aggregate_inputs", "region(?r, ?n), ?c = count(?k) : { nation(?k, _, ?r), ?k > ?r } => ?n, ?c", "n c", "SELECT r_name AS n, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > r_regionkey) AS c FROM region")
asked("list_aggregate", "nation(?k, ?n, ?r) => ?r, list(?n), list(?k)", "r names ks", "SELECT n_regionkey AS r, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS ks FROM nation GROUP BY 1")
asked("wildcard_multiplicity", "orders(_, ?c, _, _, _, _), customer(?c, _, ?k, _, _) => ?k, count(?c)", "k n", "SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")

# Order and pages

asked("top_k", "orders(?o, _, _, ?t, _, _) => ?o, ?t order by ?t desc, ?o limit 10 offset 5", "o t", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 10 OFFSET 5")
asked("after_page", "customer(?c, ?n, _, ?b, _) => ?c, ?b order by ?b, ?c after 1000, 5 limit 10", "c b", "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 1000 OR (c_acctbal = 1000 AND c_custkey > 5) ORDER BY b, c LIMIT 10")

# Functions

asked("str_tests", 'part(?p, ?n, _, ?t, _, _), str.contains(?n, "r"), str.prefix(?t, "E"), not str.suffix(?n, "g"), str.glob(?n, "*[a-d]*"), str.match(?t, "[A-Z]+") => ?p', "p",
      "SELECT p_partkey AS p FROM part WHERE contains(p_name, 'r') AND starts_with(p_type, 'E') AND NOT ends_with(p_name, 'g') AND regexp_matches(p_name, '[a-d]') AND regexp_matches(p_type, '[A-Z]+')")
asked("str_functions", 'nation(?k, ?n, _), str.lower(?n, ?l), str.concat(?l, "!", ?x), str.replace(?x, "a", "__", ?y), str.capitalize(?l, ?c), str.distance(?n, "NATION_7", ?d) => ?k, ?y, ?c, ?d', "k y c d",
      "SELECT n_nationkey AS k, replace(lower(n_name) || '!', 'a', '__') AS y, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) AS c, levenshtein(n_name, 'NATION_7') AS d FROM nation")
asked("str_split", 'part(?p, ?t, _, _, _, _), str.split(?t, " ", ?i, ?w) => ?i, ?w, count(distinct ?p)', "i w n", "SELECT i, w, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part) WHERE w <> '' OR true GROUP BY 1, 2")
asked("str_cut", 'supplier(?s, ?n, _, _), str.concat("Supplier", ?rest, ?n) => ?s, ?rest', "s rest", "SELECT s_suppkey AS s, substr(s_name, 9) AS rest FROM supplier WHERE starts_with(s_name, 'Supplier')")
asked("str_find", 'documents(?d, ?t, _, _, _), str.find(?t, "[0-9]+", 0, ?m) => ?d, ?m', "d m", "SELECT doc_id AS d, regexp_extract_all(text, '[0-9]+')[1] AS m FROM documents WHERE regexp_matches(text, '[0-9]')")
asked("arithmetic", "part(?p, _, _, _, ?s, ?v), ?x = ?v / ?s, 100 = ?s + ?y, num.mul(?y, ?z, ?v) => ?p, ?x, ?y, ?z", "p x y z", "SELECT p_partkey AS p, p_retailprice / p_size AS x, 100 - p_size AS y, p_retailprice / (100 - p_size) AS z FROM part WHERE p_size <> 0 AND p_size <> 100")
asked("absent_values", "nation(?k, ?n, _), optional { supplier(?s, _, ?k, ?b), ?b > 9000 }, coalesce(?b, 0, ?v) => ?n, ?v", "n v", "SELECT DISTINCT n_name AS n, coalesce(s_acctbal, 0) AS v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000")
asked("lists", 'nation(_, ?n, ?r), ?l = list(?k) : { nation(?k, _, ?r) }, list.length(?l, ?c), list.at(?l, 0, ?f), list.member(?l, ?i, ?m), ?i = 1 => ?r, ?c, ?f, ?m', "r c f m",
      "SELECT r, c, CAST(l[1] AS VARCHAR) AS f, CAST(l[2] AS VARCHAR) AS m FROM (SELECT n_regionkey AS r, count(*) AS c, list(n_nationkey ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)")
asked("events_json", 'events(?e, _, ?u, ?t, ?v, ?p), str.contains(?p, "1"), ?v > 50 => ?t, count(?e), max(?v)', "t n most", "SELECT event_type AS t, count(*) AS n, max(value) AS most FROM events WHERE contains(props, '1') AND value > 50 GROUP BY 1")


@made("units", "SELECT s_suppkey AS s, s_acctbal * 0.001 * 2.0 AS w FROM supplier WHERE s_acctbal * 0.001 > 1.0")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliampere as a column's unit, folded to ampere; times volt is watt."""
    e = engine(spark, sf_dir)
    e.catalog.add("current", spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_acctbal"), required=["s_suppkey"], units={"s_acctbal": "mA"})
    return e.query("current(?s, ?i), ?i > 1A, ?w = ?i * 2V, num.unit(?w, \"W\") => ?s, ?w", names=["s", "w"])


@made("mixed_kinds", "SELECT CAST(r_regionkey AS VARCHAR) AS v FROM region UNION SELECT r_name FROM region")
def mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and text in one column; they never join."""
    return engine(spark, sf_dir).query("v(?x) :- region(?x, _); v(?x) :- region(_, ?x); v(?x)", names=["v"])


@made("modules", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.catalog.module("geo", 'in(?n, ?r) :- _pair(?n, ?r), ?r != "ASIA"; _pair(?n, ?r) :- nation(_, ?n, ?k), region(?k, ?r);')
    return e.query("geo.in(?n, ?r)", names=["n", "r"])


@made("host_function", "SELECT p_partkey AS p, sqrt(p_retailprice) AS root FROM part WHERE p_size % 7 = 0")
def host_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's own predicates from Spark functions."""
    from strataflow.functions.registry import filter_of, function_of

    e = engine(spark, sf_dir)
    e.catalog.predicate(function_of(F.sqrt, "math.sqrt", 2)).predicate(filter_of(lambda x: x % 7 == 0, "seventh", 1))
    return e.query("part(?p, _, _, _, ?s, ?v), seventh(?s), math.sqrt(?v, ?r) => ?p, ?r", names=["p", "root"])


# Sources, versions, citations


@made("federation", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'O' GROUP BY 1")
def federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = Engine(spark)
    e.catalog.add("orders", federated({"even": o.where("o_orderkey % 2 = 0"), "odd": o.where("o_orderkey % 2 = 1")}, {"odd": lambda df: df["o_orderstatus"] == "O"}))
    return e.query("orders(?o, _, ?s, _, _, _) => ?s, count(?o)", names=["s", "n"])


@made("overlay", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'ATLANTIS'")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    added = spark.createDataFrame([(100, "ATLANTIS", 1)], n.schema)
    e = Engine(spark)
    e.catalog.add("nation", overlaid(n, removed=n.where("n_regionkey = 2"), added=added))
    return e.query("nation(?k, ?n, _) => ?k, ?n", names=["k", "n"])


def history(spark: SparkSession, sf_dir: str) -> Engine:
    """Customers with versions: from the one that their key names, those of a segment until version 3."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    until = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(3)).otherwise(F.lit(5))
    c = c.withColumn("__versions", F.array(F.struct((F.col("c_custkey") % 5).cast("bigint").alias("from"), until.cast("bigint").alias("to"))))
    e = Engine(spark)
    e.catalog.add("customer", c, required=["c_custkey", "c_nationkey", "c_mktsegment"]).parquet(sf_dir, ["nation"], KEYS)
    return e


@made("version_at", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <= 3 AND c_mktsegment <> 'BUILDING' GROUP BY 1")
def version_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).query("customer(?c, ?k, _), nation(?k, ?n, _) => ?n, count(?c)", names=["n", "c"], at=3)


@made("version_across", "SELECT s, v, c FROM (SELECT c_mktsegment AS s, v, count(*) AS c FROM customer, (SELECT unnest([1, 2, 4]) AS v) WHERE c_custkey % 5 <= v AND v < CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 5 END GROUP BY 1, 2)")
def version_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions at once: each row tells the versions that it holds in, here one row a version."""
    rows = history(spark, sf_dir).query("customer(?c, _, ?s) => ?s, count(?c)", names=["s", "c"], across=[1, 2, 4])
    return rows.select("s", F.explode("versions").alias("v"), "c")


@made("version_across_negation", "SELECT n_name AS n, v FROM nation, (SELECT unnest([0, 4]) AS v) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 5 <= v AND c_mktsegment = 'BUILDING' AND v < 3)")
def version_across_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).query('in(?k) :- customer(_, ?k, "BUILDING"); nation(?k, ?n, _), not in(?k) => ?n', names=["n"], across=[0, 4])
    return rows.select("n", F.explode("versions").alias("v"))


@made("version_diff", "SELECT c_custkey AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'removed' ELSE 'added' END AS change FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_custkey % 5 <= 2) OR (c_mktsegment <> 'BUILDING' AND c_custkey % 5 IN (3, 4))")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).diff("customer", 2, 4).select(F.col("c_custkey").alias("c"), "change")


@made("version_commit", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 77, 'NEW'")
def version_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    base = n.withColumn("__versions", F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.lit(1).cast("bigint").alias("to"))))
    row = n.where("n_nationkey = 3").withColumns({"seq": F.lit(1), "change": F.lit("removed")})
    new = spark.createDataFrame([(77, "NEW", 1)], n.schema).withColumns({"seq": F.lit(2), "change": F.lit("added")})
    both = versions.committed(base, row.unionByName(new), 0, 1)
    return versions.at(both, 1).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))


@made("citations", "SELECT r_name AS r, string_agg('nation/' || n_nationkey, ';' ORDER BY 'nation/' || n_nationkey) || ';region/' || r_regionkey AS cites FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with the citations of the facts that it came from."""
    e = Engine(spark)
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        e.catalog.add(name, df.withColumn("__cites", F.array(F.concat(F.lit(f"{name}/"), F.col(key)))))
    return e.query("region(?k, ?r), nation(_, _, ?k) => ?r", names=["r"], cites=True).withColumn("cites", F.array_join("cites", ";"))


# Cypher

GRAPH = Graph(
    (
        Node("Nation", "nation", 3, 0, {"key": 0, "name": 1, "region": 2}), Node("Region", "region", 2, 0, {"key": 0, "name": 1}),
        Node("Customer", "customer", 5, 0, {"key": 0, "name": 1, "balance": 3, "segment": 4}), Node("Order", "orders", 6, 0, {"key": 0, "status": 2, "price": 3}),
        Node("Supplier", "supplier", 4, 0, {"key": 0, "name": 1, "balance": 3}),
    ),
    (
        Edge("IN", "nation", 3, 0, 2), Edge("LIVES_IN", "customer", 5, 0, 2), Edge("PLACED", "orders", 6, 1, 0), Edge("BASED_IN", "supplier", 4, 0, 2),
        Edge("SUPPLIED_BY", "lineitem", 11, 0, 2, {"quantity": 4}),
    ),
)


def cypher(name: str, text: str, sql: str | None, **more) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).cypher(GRAPH, text, **more)
    if sql:
        ORACLES[name] = sql


cypher("cypher_match", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN]->(r:Region {name: 'EUROPE'}) WHERE c.balance > 9000 RETURN c.name AS customer, n.name AS nation ORDER BY customer",
       "SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' AND c_acctbal > 9000")
cypher("cypher_aggregate", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status IN ['F', 'P'] RETURN c.segment AS segment, count(o) AS n, max(o.price) AS most",
       "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
cypher("cypher_with", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 14 MATCH (c)-[:LIVES_IN]->(a:Nation) RETURN a.name AS nation, sum(n) AS orders",
       "SELECT n_name AS nation, sum(n) AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
cypher("cypher_optional", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:BASED_IN]->(n) WHERE s.balance < 0 RETURN n.name AS nation, count(s) AS debtors",
       "SELECT n_name AS nation, count(s_suppkey) AS debtors FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY 1")
cypher("cypher_boolean", "MATCH (n:Nation) WHERE (n.name ENDS WITH '1' OR n.name ENDS WITH '2') AND NOT n.key = 12 OR EXISTS { (:Supplier {key: 1})-[:BASED_IN]->(n) } RETURN n.key AS k",
       "SELECT n_nationkey AS k FROM nation WHERE ((ends_with(n_name, '1') OR ends_with(n_name, '2')) AND n_nationkey <> 12) OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1 AND s_nationkey = n_nationkey)")
cypher("cypher_count_braces", "MATCH (n:Nation) WITH n, COUNT { (:Supplier)-[:BASED_IN]->(n) } AS suppliers WHERE suppliers < 4 RETURN n.name AS nation, suppliers AS n", "SELECT n_name AS nation, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation WHERE n < 4")
cypher("cypher_union", "MATCH (n:Nation) WHERE n.key < 3 RETURN n.name AS x UNION MATCH (r:Region) RETURN toLower(r.name) + '!' AS x", "SELECT n_name AS x FROM nation WHERE n_nationkey < 3 UNION SELECT lower(r_name) || '!' FROM region")
cypher("cypher_unwind", "UNWIND [1, 3, 5] AS k MATCH (n:Nation) WHERE n.key = k RETURN k * 10 AS ten, n.name AS name", "SELECT n_nationkey * 10 AS ten, n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 5)")
cypher("cypher_negated_pattern", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {status: 'P'}) RETURN c.key AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
