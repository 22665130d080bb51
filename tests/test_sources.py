"""Versions, changes, overlays, federation, modules, citations, units, mixed kinds, streams."""

import pytest
from pyspark.sql import functions as F

from conftest import Ordered as Engine

from strataflow.errors import CheckError
from strataflow.functions import units
from strataflow.operators import versions
from strataflow.sources.catalog import federated, overlaid
from strataflow.streaming import Maintained

SPAN = "f string, t string, __versions array<struct<from:bigint,to:bigint>>"


@pytest.fixture()
def history(spark):
    e = Engine(spark)
    e.catalog.rows("imports", [("app", "api", [(0, 2)]), ("app", "log", [(2, 3)]), ("api", "util", [(0, 3)])], SPAN)
    e.catalog.rows("pkg", [("app",), ("api",), ("util",), ("log",)], "n string")
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_one_version(history):
    reach = 'r(?a, ?b) :- imports(?a, ?b); r(?a, ?c) :- r(?a, ?b), imports(?b, ?c); r("app", ?x)'
    assert rows(history.query(reach, at=0)) == [("api",), ("util",)]
    assert rows(history.query(reach, at=2)) == [("log",)]


def test_across_versions(history):
    got = rows(history.query("imports(?a, ?b)", across=[0, 1, 2]))
    assert got == [("api", "util", [0, 1, 2]), ("app", "api", [0, 1]), ("app", "log", [2])]
    got = rows(history.query("pkg(?p), not imports(?p, _)", across=[0, 2]))
    assert got == [("log", [0, 2]), ("util", [0, 2])]
    got = rows(history.query("r(?a, ?b) :- imports(?a, ?b); r(?a, ?c) :- r(?a, ?b), imports(?b, ?c), ?a != ?c; r(?a, ?b) => ?a, count(?b)", across=[0, 2]))
    assert got == [("api", 1, [0, 2]), ("app", 1, [2]), ("app", 2, [0])]
    with pytest.raises(CheckError):
        history.query('graph.closure("imports", ?a, ?b, 1, 0, ?h)', across=[0])


def test_across_equals_each_version(history):
    text = "pkg(?p), ?k = count(?q) : { imports(?p, ?q) }, optional { imports(?r, ?p) } => ?p, ?k, ?r"
    want = {v: set(rows(history.query(text, at=v))) for v in (0, 1, 2)}
    got: dict = {v: set() for v in want}
    for *row, vs in rows(history.query(text, across=[0, 1, 2])):
        for v in vs:
            got[v].add(tuple(row))
    assert got == want


def test_pages_are_each_version_s_own(history):
    got = rows(history.query("imports(?a, ?b) => ?b, ?a order by ?b limit 1", across=[0, 1, 2]))
    assert got == [("api", "app", [0, 1]), ("log", "app", [2])]


def test_reasons(spark):
    e = Engine(spark)
    e.catalog.rows("v", [("a", 1.0)], "k string, x double", units={"x": "V"}).rows("i", [("a", 2.0), ("b", 5.0)], "k string, x double", units={"x": "A"})
    got = rows(e.query("m(?k, ?x) :- v(?k, ?x); m(?k, ?x) :- i(?k, ?x); m(?k, ?x) => ?k, max(?x), min(?k), count(?x)", names=["k", "top", "low", "n"], reasons=True))
    assert got == [("a", None, None, 2, {"top": "mixed units: A, V", "low": "no numbers"}), ("b", "5A", None, 1, {"low": "no numbers"})]
    assert rows(e.query('v("z", ?x) => avg(?x), sum(?x)', names=["a", "s"], reasons=True)) == [(None, 0.0, {"a": "no rows"})]


def test_materialized_members_are_forgotten(spark):
    e = Engine(spark)
    e.catalog.rows("r", [(1,)], "x int").module("m", "twice(?y) :- r(?x), ?y = ?x * 2;")
    e.materialize("m.twice")
    e.catalog.rows("r", [(5,)], "x int")
    assert rows(e.query("m.twice(?x)")) == [(2,)]
    assert rows(e.forget("m.twice").query("m.twice(?x)")) == [(10,)]


def test_difference(history):
    assert sorted(rows(history.diff("imports", 0, 2))) == [("app", "api", "removed"), ("app", "log", "added")]


def test_version_sets(spark):
    df = spark.createDataFrame([([(0, 3), (5, 9)], [(2, 6), (6, 7)])], "a array<struct<from:bigint,to:bigint>>, b array<struct<from:bigint,to:bigint>>")
    a, b = F.col("a"), F.col("b")
    got = df.select(versions.both(a, b), versions.either(a, b), versions.minus(a, b), versions.normal(F.concat(a, a))).first()
    assert [[tuple(r) for r in x] for x in got] == [[(2, 3), (5, 7)], [(0, 9)], [(0, 2), (7, 9)], [(0, 3), (5, 9)]]


def test_changes_and_commit(spark, history):
    df = history.catalog.relations["imports"].df
    changes = spark.createDataFrame([(1, "removed", "api", "util"), (2, "added", "log", "util"), (3, "added", "x", "y"), (4, "removed", "x", "y")], "seq int, change string, f string, t string")
    assert sorted(rows(versions.applied(versions.at(df, 2).drop("__versions"), changes))) == [("app", "log"), ("log", "util")]
    committed = versions.committed(df, changes, 2, 3)
    assert sorted(rows(versions.at(committed, 3).drop("__versions"))) == [("app", "log"), ("log", "util")]
    assert sorted(rows(versions.at(committed, 1).drop("__versions"))) == [("api", "util"), ("app", "api")]


def test_federation_and_overlay(spark):
    a = spark.createDataFrame([("a", 1, ["x"])], "n string, k int, __cites array<string>")
    b = spark.createDataFrame([("b", 2, ["y"]), ("a", 3, ["z"])], a.schema)
    e = Engine(spark)
    e.catalog.add("r", federated({"one": a, "two": b}, {"two": lambda df: df["n"] == "b"}))
    assert rows(e.query("r(?n, ?k)", cites=True)) == [("a", 1, ["one/x"]), ("b", 2, ["two/y"])]
    gone, new = spark.createDataFrame([(None, 1)], "n string, k int"), spark.createDataFrame([("c", 9)], "n string, k int")
    base = spark.createDataFrame([(None, 1), ("b", 2)], "n string, k int")
    assert sorted(rows(overlaid(base, gone, new))) == [("b", 2), ("c", 9)]


def test_citations_through_recursion(spark):
    e = Engine(spark)
    e.catalog.rows("edge", [("a", "b", ["1"]), ("b", "c", ["2"]), ("a", "c", ["3"])], "f string, t string, __cites array<string>")
    got = rows(e.query("r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); r(?a, ?b)", cites=True))
    assert got == [("a", "b", ["1"]), ("a", "c", ["3"]), ("b", "c", ["2"])]
    # The shortest derivation is cited whatever its citations, and of equally short ones that of the first rule by its text.
    e.catalog.rows("long", [("a", "c", ["0"])], "f string, t string, __cites array<string>")
    deep = "m(?a, ?b) :- long(?a, ?b); r(?a, ?b) :- m(?a, ?b); r(?a, ?b) :- edge(?a, ?b); r(?a, ?b)"
    assert ("a", "c", ["3"]) in rows(e.query(deep, cites=True))
    assert ("a", "c", ["3"]) in rows(e.query("r(?a, ?b) :- long(?a, ?b); r(?a, ?b) :- edge(?a, ?b); r(?a, ?b)", cites=True))
    assert rows(e.query("p(?a, count(?b)) :- edge(?a, ?b); p(?a, ?n)", cites=True)) == [("a", 2, ["1", "3"]), ("b", 1, ["2"])]
    assert rows(e.query("edge(?a, ?b) => ?a, count(?b)", cites=True)) == [("a", 2, ["1", "3"]), ("b", 1, ["2"])]


def test_modules_are_linked_and_private(spark, tmp_path):
    e = Engine(spark)
    e.catalog.rows("imports", [("a", "b"), ("b", "c")], "f string, t string")
    (tmp_path / "deps.dl").write_text('on(?a, ?b) :- _step(?a, ?b); on(?a, ?c) :- on(?a, ?b), _step(?b, ?c); _step(?a, ?b) :- imports(?a, ?b); odd("x");')
    e.catalog.modules_in(str(tmp_path))
    assert rows(e.query('deps.on("a", ?x)')) == [("b",), ("c",)]
    assert rows(e.query('graph.closure("deps.on", "a", ?x, 1, 0, ?h)')) == [("b", 1), ("c", 1)]
    assert rows(e.query("deps.odd(?x)")) == [("x",)]
    assert "deps.on" in e.catalog.members("deps") and "deps._step" not in e.catalog.members("deps")
    with pytest.raises(CheckError):
        e.query("p(?x) :- deps._step(?x, _); p(?x)")
    with pytest.raises(CheckError):
        e.query('deps.on("a") :- imports("a", _); imports(?x, ?y)')


def test_facts_have_names(spark):
    e = Engine(spark)
    e.catalog.rows("edge", [("a", "b", "e1"), ("b", "a", None)], "f string, t string, __id string").rows("cost", [("e1", 5)], "e string, c int")
    assert rows(e.query("edge(?a, ?b) as ?r => ?r")) == [("e1",), ('edge("b", "a")',)]
    assert rows(e.query("edge(?a, ?b) as ?r, cost(?r, ?c) => ?a, ?c")) == [("a", 5)]
    assert rows(e.query("edge(?a, ?b) as ?r, edge(?b, ?c) as ?s, ?r != ?s => ?a, ?c")) == [("a", "a"), ("b", "b")]
    steps = "step(?a, ?r, ?b) :- edge(?a, ?b) as ?r; "
    assert rows(e.query(steps + 'graph.paths("step", "a", ?x, "trail", 2, 2, ?p), path.edge(?p, 0, ?e) => ?p, ?e')) == [('{"nodes":["a","b","a"],"edges":["e1","edge(\\"b\\", \\"a\\")"]}', "e1")]


def test_units(spark):
    assert units.base("mA") == (1e-3, "A") and units.base("kg") == (1.0, "kg") and units.base("Ω") == (1.0, "ohm")
    assert units.product("V", "A") == "W" and units.product("V", "A", -1) == "ohm" and units.product("V", "V", -1) == ""
    e = Engine(spark)
    e.catalog.rows("res", [("r1", 1.0)], "p string, r double", units={"r": "kohm"}).rows("cur", [("r1", 5.0)], "p string, i double", units={"i": "mA"})
    assert rows(e.query("res(?p, ?r), cur(?p, ?i), ?v = ?r * ?i, num.unit(?v, ?u), ?v > 4V => ?p, ?v, ?u")) == [("r1", 5.0, "V")]
    assert rows(e.query("res(?p, ?r), cur(?p, ?i), ?v = ?r + ?i => ?v")) == []
    with pytest.raises(CheckError):
        e.query("res(?p, ?r), cur(?p, ?i), ?r > ?i")


def test_mixed_kinds_and_units(spark):
    e = Engine(spark)
    e.catalog.rows("n", [(10,), (9,), (None,)], "v int").rows("t", [("10",), ("a",)], "v string").rows("m", [(10.0,)], "v double", units={"v": "V"})
    mixed = "x(?v) :- n(?v); x(?v) :- t(?v); "
    assert rows(e.query(mixed + "x(?v)")) == [(None,), ("9",), ("10",), ("10",), ("a",)]
    assert rows(e.query(mixed + "x(?v), t(?v)")) == [("10",), ("a",)]
    assert rows(e.query(mixed + "x(?v), ?v > 9 => count(?v)")) == [(1,)]
    assert rows(e.query(mixed + "x(?v) => count(?v), count(distinct ?v), sum(?v), list(?v)")) == [(5, 4, "19", '[9,10,"10","a"]')]
    assert rows(e.query("y(?v) :- m(?v); y(?v) :- n(?v); y(?v) => max(?v), list(?v)")) == [("10V", "[9,10]")]


def test_domains_and_coercion(spark):
    e = Engine(spark)
    e.catalog.rows("part", [("7", 1), ("x", 2)], "id string, n int", domains={"id": ("7", "x")})
    assert rows(e.query("part(7, ?n)")) == [(1,)]
    assert rows(e.query('part(?i, "2") => ?i')) == [("x",)]
    with pytest.raises(CheckError):
        e.query('part("y", ?n)')


def test_maintained_over_a_stream(spark, tmp_path):
    e = Engine(spark)
    e.catalog.rows("edge", [("a", "b")], "f string, t string").rows("good", [("d",), ("c",)], "n string")
    rules = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); end(?a, ?b) :- r(?a, ?b), good(?b);"
    m = Maintained(e, rules, "end", "edge")
    assert m.answer().count() == 0
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("f string, t string").option("maxFilesPerTrigger", 1).parquet(folder)
    for i, batch in enumerate([[("b", "c")], [("c", "d"), ("d", "a")]]):
        spark.createDataFrame(batch, "f string, t string").coalesce(1).write.mode("append").parquet(folder)
        q = m.start(stream, str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
        want = {0: {("a", "c"), ("b", "c")}, 1: {(a, b) for a in "abcd" for b in "cd"}}[i]
        assert set(rows(m.answer())) == want
    assert m.advance(spark.createDataFrame([("q", "c")], "f string, t string"), 1) == 0, "a batch delivered again"
    with pytest.raises(CheckError):
        Maintained(e, "p(?a) :- edge(?a, _), not good(?a);", "p", "edge")


def test_maintained_state_outlives_its_maker(spark, tmp_path, monkeypatch):
    """Another engine goes on from the folder: with the facts of all batches, without those delivered again."""
    from strataflow.streaming import incremental

    monkeypatch.setattr(incremental, "SETS", 2)
    rules = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c);"

    def begun():
        e = Engine(spark)
        e.catalog.rows("edge", [("a", "b")], "f string, t string")
        return Maintained(e, rules, "r", "edge", str(tmp_path / "state"))

    step = lambda f, t: spark.createDataFrame([(f, t)], "f string, t string")
    m = begun()
    for i, (f, t) in enumerate([("b", "c"), ("c", "d"), ("d", "e")]):
        m.advance(step(f, t), i)
    again = begun()
    assert again.last == 2 and set(rows(again.answer())) == {(a, b) for a in "abcd" for b in "bcde" if a < b}
    assert again.advance(step("x", "y"), 2) == 0 and again.advance(step("e", "f"), 3) == 5
    assert len(rows(again.answer())) == 15
