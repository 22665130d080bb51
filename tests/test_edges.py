"""Fact files, changes on the wire, stores with lookups, tools, derivations."""

import json

import pytest

from conftest import Ordered as Engine

from strataflow.errors import BudgetExceeded, SyntaxRefused
from strataflow.operators import versions
from strataflow.sources import facts, lookup
from strataflow.sources.catalog import Catalog
from strataflow.tools import Tools

TEXT = """
#: imports(from, to)
imports("app", "api")
imports("api", "db")   # a comment
volts("r1", 3.3V)
volts("r2", _)
loc("app", 100); 
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, facts.load(Catalog(spark), TEXT))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fact_files(engine):
    assert engine.catalog.relations["imports"].labels == ["from", "to"]
    assert rows(engine.query("imports(?a, ?b)")) == [("api", "db"), ("app", "api")]
    assert rows(engine.query("volts(?r, ?v), ?v > 3000mV, num.unit(?v, ?u) => ?r, ?u")) == [("r1", "V")]
    for bad in ("r(?x)", "r(", 'r("a")\nr("a", "b")'):
        with pytest.raises(SyntaxRefused):
            facts.read_facts(bad)


def test_changes_travel_and_apply(spark, engine, tmp_path):
    ops = [("removed", "imports", ("app", "api")), ("added", "imports", ("é", "x")), ("added", "loc", ("q", 1))]
    assert facts.decode_changes(facts.encode_changes(ops)) == ops
    df = engine.catalog.relations["imports"].df
    changed = versions.applied(df, facts.changes_of(spark, df, "imports", ops))
    where = facts.save(changed, str(tmp_path / "out"))
    assert sorted(rows(spark.read.parquet(where))) == [("api", "db"), ("é", "x")]
    with pytest.raises(SyntaxRefused):
        facts.decode_changes('{"op": "moved", "rel": "r", "values": []}')


def test_lookups_are_pushed(spark, tmp_path):
    log = str(tmp_path / "log")

    def store(bound, part):
        with open(log, "a") as f:
            f.write(json.dumps(bound) + "\n")
        data = [("a", 1), ("b", 2), ("c", 3)]
        return [r for r in data if (r[0] < "c") == (part == 0) and r[0] in bound.get("k", [r[0]])]

    e = Engine(spark)
    lookup.register(e.catalog, "kv", "k string, v int", store, (0, 1), required=["k", "v"])
    assert rows(e.query('kv("b", ?v)')) == [(2,)]
    assert json.loads(open(log).read().splitlines()[-1]) == {"k": ["b"]}
    assert rows(e.query("kv(?k, ?v) => sum(?v)")) == [(6,)]
    assert rows(e.query('kv("a", ?x), kv("c", ?y)')) == [(1, 3)]


def stored(spark, log, **offers):
    """A store of twenty rows (k, v, g) that writes down what it is asked."""

    def find(asked, part):
        with open(log, "a") as f:
            f.write(json.dumps([dict(asked), asked.tests]) + "\n")
        tests = {">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "prefix": str.startswith}
        rows = [(f"k{i}", i, i % 3) for i in range(20)]
        names = ["k", "v", "g"]
        return [r for r in rows if all(r[names.index(c)] in vs for c, vs in asked.items()) and all(tests[op](r[names.index(c)], v) for op, c, v in asked.tests if op in tests)]

    e = Engine(spark)
    lookup.register(e.catalog, f"far{len(log)}", "k string, v int, g int", find, required=["k", "v", "g"], offers=offers)
    return e, f"far{len(log)}"


def told(log):
    return [json.loads(x) for x in open(log).read().splitlines()]


def test_ranges_and_text_tests_reach_a_store(spark, tmp_path):
    log = str(tmp_path / "ranges")
    e, name = stored(spark, log)
    assert rows(e.query(f'{name}(?k, ?v, _), ?v > 12, str.prefix(?k, "k1") => ?k')) == [(f"k{i}",) for i in range(13, 20)]
    (asked, tests) = told(log)[-1]
    assert asked == {} and sorted(map(tuple, tests)) == [(">", "v", 12), ("prefix", "k", "k1")]


def test_a_join_sends_its_keys_in_batches(spark, tmp_path):
    log = str(tmp_path / "batch")
    e, name = stored(spark, log, keys=("k",), batch=3, cache=50)
    e.catalog.rows("few", [(f"k{i % 5}", i) for i in range(40)] + [("none", 99)], "k string, n int")
    want = [(f"k{i}", i, 8) for i in range(5)]
    assert rows(e.query(f"few(?k, ?n), {name}(?k, ?v, _) => ?k, ?v, count(?n)")) == want
    calls = [a["k"] for a, _ in told(log)]
    assert all(len(c) <= 3 for c in calls) and sorted(k for c in calls for k in c) == sorted({*(f"k{i}" for i in range(5)), "none"})
    assert rows(e.query(f"{name}(?k, ?v, _), few(?k, ?n) => ?k, ?v, count(?n)")) == want, "whichever is written first, keys come from the table"


def test_a_store_groups_pages_and_walks(spark, tmp_path):
    log = str(tmp_path / "more")
    e, name = stored(spark, log, summarize=lambda bound, by, made: [(g, 100 + g) for g in range(3)], page=lambda bound, order, n: [(f"k{19 - i}", 19 - i, (19 - i) % 3) for i in range(n)], walk=lambda starts, low, high: [(s, "z", low) for s in starts])
    assert rows(e.query(f"{name}(_, ?v, ?g) => ?g, max(?v)")) == [(0, 100), (1, 101), (2, 102)]
    assert rows(e.query(f"{name}(?k, ?v, ?g) => ?k, ?v, ?g order by ?v desc limit 2 offset 1")) == [("k18", 18, 0), ("k17", 17, 2)]
    assert not (tmp_path / "more").exists(), "no row was read one by one"
    assert rows(e.query(f"{name}(_, ?v, ?g) => ?g, avg(?v)"))[0] == (0, 9.0) and len(told(log)) == 1, "means aren't offered: the rows are read"


def test_materialized_relations_are_used_again(spark):
    e = Engine(spark)
    token = [1]
    e.catalog.rows("r", [(1,), (2,)], "x int", version=lambda: token[0])
    e.materialize("twice", "twice(?y) :- r(?x), ?y = ?x * 2;")
    first = e.catalog.relations["twice"].df
    e.forget("twice").materialize("twice", "twice(?y) :- r(?x), ?y = ?x * 2;")
    assert e.catalog.relations["twice"].df is first
    token[0] = 2
    e.forget("twice").materialize("twice", "twice(?y) :- r(?x), ?y = ?x * 2;")
    assert e.catalog.relations["twice"].df is not first and len(e.derived) == 2


def test_a_store_of_versions(spark, tmp_path):
    s = facts.Store(spark, str(tmp_path / "store"))
    assert s.create(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")) == 0
    mine, other = facts.Session(s, "r"), facts.Session(s, "r")
    mine.add("c", 3).remove("a", 1)
    other.add("d", 4)
    assert sorted(rows(mine.view())) == [("b", 2), ("c", 3)]
    assert mine.commit() == 1 and s.versions() == [0, 1] and sorted(rows(s.read())) == [("b", 2), ("c", 3)] and len(rows(s.read(0))) == 2
    with pytest.raises(facts.Conflict):
        other.commit()


def test_tools(engine):
    t = Tools(engine, rows=1)
    assert json.loads(t.call("query", {"program": "imports(?a, ?b)"})) == {"columns": ["a", "b"], "rows": [["api", "db"]], "more": True}
    assert json.loads(t.call("query", {"program": "import(?a, ?b)"}))["kind"] == "unknown"
    assert "imports" in t.call("schema", {}) and "from" in t.call("look", {"name": "imports"})
    assert json.loads(t.call("values", {"relation": "loc", "column": "c0"}))["rows"] == [["app", 1]]
    assert json.loads(t.call("find", {"text": "DB"}))["found"] == [{"relation": "imports", "column": "to", "value": "db"}]
    assert json.loads(t.call("explain", {"program": 'imports("zz", ?x)'}))["empty"] == 'imports("zz", ?x)'
    assert "error" in json.loads(t.call("nothing", {})) and "error" in json.loads(t.call("query", {"text": 1}))


def test_derivation_trees(engine):
    text = "r(?a, ?b) :- imports(?a, ?b); r(?a, ?c) :- r(?a, ?b), imports(?b, ?c); r(?a, ?b)"
    (d,) = engine.why(text, ("app", "db"))
    assert d.leaves() == {'imports("app", "api")', 'imports("api", "db")'}
    assert engine.kinds(text) == [("a", "string"), ("b", "string")]
    with pytest.raises(BudgetExceeded):
        engine.why(text, ("app", "db"), most=1)
