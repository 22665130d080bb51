import pytest

from conftest import Ordered as Engine

from strataflow.cypher import Edge, Graph, Node, Refused, compile_query, kinds_of, store

GRAPH = Graph((Node("Package", "pkg", 3, 0, {"name": 0, "license": 1, "loc": 2}),), (Edge("IMPORTS", "imports", 2), Edge("USES", "uses", 3, 0, 1, {"weight": 2})))


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.catalog.rows("imports", [("app", "api"), ("app", "auth"), ("api", "db"), ("auth", "db"), ("db", "util"), ("cache", "config"), ("config", "cache"), ("cache", "log")], "f string, t string")
    e.catalog.rows("uses", [("app", "db", 3), ("api", "log", 5)], "f string, t string, w int")
    e.catalog.rows("pkg", [("app", "MIT", 100), ("api", None, 200), ("auth", "", 300), ("db", "Apache-2.0", 400), ("util", "MIT", 50), ("cache", "MIT", 60), ("config", None, 70), ("log", "BSD", 10)], "name string, license string, loc int")
    return e


CASES = [
    ("MATCH (a:Package)-[:IMPORTS]->(b:Package) WHERE a.name = 'app' RETURN b.name", [("api",), ("auth",)]),
    ("MATCH (a:Package {name: 'db'})<-[:IMPORTS]-(b) RETURN DISTINCT b AS importer ORDER BY importer DESC SKIP 1 LIMIT 2", [("api",)]),
    ("MATCH (a:Package {name: 'app'})-[:IMPORTS*1..3]->(b) RETURN b", [("api",), ("auth",), ("db",), ("util",)]),
    ("MATCH (a:Package {name: 'app'})-[:IMPORTS]->{2,2}(b) RETURN b", [("db",)]),
    ("MATCH (a:Package {name: 'cache'})-[:IMPORTS|USES]-(b) RETURN b", [("config",), ("log",)]),
    ("MATCH (a:Package) WITH a, count { (a)-[:IMPORTS]->() } AS out WHERE out > 1 RETURN a.name AS n, out", [("app", 2), ("cache", 2)]),
    ("MATCH (a:Package) WHERE EXISTS { (a)-[:IMPORTS]->(:Package {license: 'MIT'}) } RETURN a", [("config",), ("db",)]),
    ("MATCH (a:Package) WHERE NOT (a)-[:IMPORTS]->() AND a.loc < 40 RETURN a", [("log",)]),
    ("MATCH (a:Package) WHERE a.license = 'MIT' RETURN a UNION MATCH (a:Package) WHERE a.loc > 300 RETURN a", [("app",), ("cache",), ("db",), ("util",)]),
    ("MATCH (a:Package) WHERE a.name STARTS WITH 'a' AND NOT a.name ENDS WITH 'p' OR a.name CONTAINS 'fi' RETURN a", [("api",), ("auth",), ("config",)]),
    ("MATCH (a:Package) WHERE a.license <> 'MIT' RETURN a", [("auth",), ("db",), ("log",)]),
    ("MATCH (a:Package) WHERE NOT a.license = 'MIT' RETURN a", [("auth",), ("db",), ("log",)]),
    ("MATCH (a:Package) WHERE a.license IS NULL RETURN a", [("api",), ("config",)]),
    ("MATCH (a:Package) WHERE a.name =~ 'a.*' XOR a.license = 'MIT' RETURN a", [("auth",), ("cache",), ("util",)]),
    ("MATCH (a:Package) WHERE a.name IN ['app', 'log', 'no'] RETURN toUpper(a.name) + '!' AS x", [("APP!",), ("LOG!",)]),
    ("MATCH (a:Package) RETURN a.license AS l, sum(a.loc) AS s, collect(a.name) AS names ORDER BY s DESC LIMIT 2", [("Apache-2.0", 400, '["db"]'), ("", 300, '["auth"]')]),
    ("MATCH (a:Package) OPTIONAL MATCH (a)-[:USES]->(b:Package) RETURN a.name AS n, count(b) AS k, b.license AS l ORDER BY k DESC, n LIMIT 3", [("api", 1, "BSD"), ("app", 1, "Apache-2.0"), ("auth", 0, None)]),
    ("MATCH p = (a:Package {name: 'cache'})-[:IMPORTS*]->(b:Package {name: 'log'}) RETURN p, length(p) AS l", [('["cache","config","cache","log"]', 3), ('["cache","log"]', 1)]),
    ("MATCH p = shortestPath((a:Package {name: 'app'})-[:IMPORTS*]->(b:Package {name: 'util'})) RETURN nodes(p) AS n", [('["app","api","db","util"]',)]),
    ("MATCH (a)-[r:USES]->(b) WHERE r.weight > 3 RETURN type(r) AS t, startNode(r) AS a, b, r.weight AS w", [("USES", "api", "log", 5)]),
    ("UNWIND [1, 2, 3] AS x RETURN x * 2 AS y", [(2,), (4,), (6,)]),
    ("MATCH (a:Package) WITH collect(a.name) AS l UNWIND l AS x WITH x WHERE x STARTS WITH 'c' RETURN x", [("cache",), ("config",)]),
    ("CALL str.split('a-b', '-') YIELD index, part RETURN part, index", [("a", 0), ("b", 1)]),
    ("MATCH (a:Package) WHERE a.name = $n RETURN a.loc AS loc", [(400,)]),
    ("MATCH (a:Package)-[:USES]->(b:Package) RETURN a.loc + b.loc AS s, a.loc / 10 AS d", [(210, 20.0), (500, 10.0)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_compiles_and_answers(engine, text, want):
    assert [tuple(r) for r in engine.cypher(GRAPH, text, params={"n": "db"}).collect()] == want


@pytest.mark.parametrize(
    "text,gap",
    [
        ("CREATE (a)", True), ("MATCH (a:Nope) RETURN a", False), ("MATCH (a:Package) RETURN CASE WHEN a.loc > 1 THEN 1 END", True),
        ("MATCH (a:Package)-[:NOPE]->(b) RETURN b", False), ("MATCH (a:Package) WITH a ORDER BY a.name RETURN a", True), ("RETURN 1", True),
        ("MATCH (a:Package) RETURN b", False), ("MATCH (a:Package)-[r:IMPORTS*]->(b) RETURN r", True), ("MATCH (a:Package) WHERE a.loc % 2 = 0 RETURN a", True),
        ("MATCH (a:Package", False), ("OPTIONAL MATCH (a:Package) RETURN a", True), ("MATCH (a:Package) RETURN stdev(a.loc)", True), ("MATCH (a:Package) RETURN {x: 1}", True),
    ],
)
def test_refusals(text, gap):
    with pytest.raises(Refused) as e:
        compile_query(GRAPH, text)
    assert e.value.gap == gap


def test_node_edge_attr_store(spark):
    e = Engine(spark)
    e.catalog.rows("node", [("f1", "func"), ("f2", "func"), ("d1", "doc")], "id string, kind string")
    e.catalog.rows("edge", [("f1", "calls", "f2"), ("d1", "names", "f1")], "f string, kind string, t string").rows("attr", [("f2", "lines", "7")], "id string, k string, v string")
    assert kinds_of(e.catalog) == (["doc", "func"], ["calls", "names"])
    g = store(*kinds_of(e.catalog))
    assert "-[:CALLS]->" in g.describe()
    assert [tuple(r) for r in e.cypher(g, "MATCH (a:Func)-[:CALLS]->(b:Func) RETURN a, b.lines AS n").collect()] == [("f1", "7")]
