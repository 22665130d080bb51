"""The engine against the plain evaluator, and against answers worked out by hand."""

import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import Ordered as Engine

from strataflow.errors import BudgetExceeded, CheckError
from strataflow.naive import Naive, num, rank
from strataflow.operators import kernel, walks
from strataflow.limits import Limits
from strataflow.plans import rewrite
from strataflow.plans.text import parse
from strataflow.sources.catalog import Catalog

FACTS = {
    "edge": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "c"), ("e", "e")],
    "node": [("a",), ("b",), ("x",), (None,), ("e",)],
    "w": [("a", 1.0), ("b", 2.0), ("c", None), ("x", 5.0), ("b", 2.0), ("e", -3.0)],
    "tag": [("a", "red"), ("b", ""), ("x", None), ("e", "red")],
}
SCHEMAS = {"edge": "f string, t string", "node": "n string", "w": "n string, w double", "tag": "n string, t string"}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    for name, rows in FACTS.items():
        e.catalog.rows(name, rows, SCHEMAS[name])
    return e


def answers(engine, text, **more):
    return [tuple(num(v) for v in r) for r in engine.query(text, **more).collect()]


PROGRAMS = [
    "edge(?a, ?b), edge(?b, ?c) => ?a, ?c",
    "edge(?a, ?a)",
    "edge(?a, ?b), w(?a, ?v), ?v < 2 => ?a, ?v * 2",
    "w(?n, ?v), w(?m, ?v) => ?n, ?m",
    "node(?n), tag(?n, ?t) => ?n, ?t",
    "node(?n), not edge(?n, _) => ?n",
    "node(?n), not edge(_, ?n), not w(?n, _)",
    'node(?n), not edge("z", "z") => ?n',
    "node(?n), ?k = count(?m) : { edge(?n, ?m) } => ?n, ?k",
    "node(?n), ?k = sum(?v) : { edge(?n, ?m), w(?m, ?v) }, ?k > 1 => ?n, ?k",
    "node(?n), ?l = list(?m) : { edge(?n, ?m) } => ?n, ?l",
    "?k = max(?v) : { w(_, ?v) } => ?k",
    "node(?n), optional { w(?n, ?v), ?v > 1 } => ?n, ?v",
    "node(?n), optional { edge(?n, ?m), w(?m, ?v) } => ?n, count(?m), count(distinct ?m), sum(?v)",
    "edge(?a, _) => count(?a)",
    "edge(?a, _) => ?a, count(?a)",
    "w(_, ?v) => sum(?v), avg(?v), min(?v), max(?v), count(?v), list(?v), sum(distinct ?v), count(distinct ?v)",
    "w(_, ?v), ?v > 100 => sum(?v), avg(?v), count(?v), list(?v)",
    'w(_, ?v), ?v > 100, ?k = "c" => ?k, count(?v)',
    "tag(_, ?t) => count(?t), count(distinct ?t), list(?t), list(distinct ?t), min(?t)",
    "edge(?a, ?b) => ?a, count(?b) having count(?b) > 1",
    "edge(?a, ?b) => ?b, ?a order by ?b desc limit 3 offset 1",
    "w(?n, ?v) => ?v, ?n order by ?v",
    'r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); r(?a, ?b)',
    'r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- edge(?a, ?b), r(?b, ?c); r("b", ?x)',
    'r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), r(?b, ?c); r(?x, "d")',
    'r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- edge(?a, ?b), r(?b, ?c), ?a != ?c; r("a", ?x)',
    'odd(?a, ?b) :- edge(?a, ?b); odd(?a, ?c) :- even(?a, ?b), edge(?b, ?c); even(?a, ?c) :- odd(?a, ?b), edge(?b, ?c); even("a", ?x)',
    's(?x, ?y) :- edge(?p, ?x), edge(?p, ?y); s(?x, ?y) :- edge(?a, ?x), s(?a, ?b), edge(?b, ?y); s("c", ?y)',
    's(?x, ?y) :- edge(?p, ?x), edge(?p, ?y); s(?x, ?y) :- edge(?a, ?x), s(?a, ?b), edge(?b, ?y); s(?x, ?y)',
    'big(?n, ?v) :- w(?n, ?v); big(?n, "none") :- node(?n), not w(?n, _); big(?n, ?v), ?v != 2 => ?n',
    "deg(?n, count(?m)) :- edge(?n, ?m); deg(?n, ?k), ?k >= 1 => max(?k), count(?n)",
    "a(?n) :- node(?n); a(?n) :- edge(?n, _); b(?n) :- w(?n, ?v), ?v > 0; a(?n), not b(?n)",
    "w(?n, ?v), ?d = ?v + 1, ?d * 2 > 5 => ?n, ?d / 2",
    "w(?n, ?v), ?v / 0 = ?x => ?x",
    'tag(?n, ?t), str.contains(?t, "e"), not str.prefix(?t, "b") => ?n',
    'tag(?n, ?t), not absent(?t), ?t != "" => ?n',
    'w(?n, ?v), ?v < "z" => ?n',
    'node(?n), ?x = 5, ?y = "q" => ?n, ?x, ?y',
]


@pytest.mark.parametrize("text", PROGRAMS)
def test_agrees_with_the_plain_evaluator(engine, text):
    q = parse(text)
    got, want = answers(engine, text), Naive(FACTS, q.rules).answer(q)
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(rank, r)))
    assert order(got) == order(want)
    assert got == want, "the order differs"


NAMES = st.sampled_from("abcd")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(NAMES, NAMES), min_size=1, max_size=8), st.lists(st.tuples(NAMES, st.sampled_from([None, 0.0, 1.0, 2.0, 7.0])), min_size=1, max_size=5))
def test_random_graphs(spark, edges, weights):
    e = Engine(spark)
    e.catalog.rows("edge", edges, SCHEMAS["edge"]).rows("w", weights, SCHEMAS["w"])
    facts = {"edge": edges, "w": weights}
    for text in (
        "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); w(?n, ?v), not r(?n, ?n) => ?n, ?v",
        "p(?a, ?v) :- edge(?a, ?b), w(?b, ?v), ?v > 0; edge(?a, _), optional { p(?a, ?v) }, ?k = count(?x) : { edge(?x, ?a) } => ?a, ?v, ?k",
        'r(?a, ?b) :- edge(?b, ?a); r(?a, ?c) :- edge(?b, ?a), r(?b, ?c), ?a != ?c; r("a", ?x)',
    ):
        q = parse(text)
        assert answers(e, text) == Naive(facts, q.rules).answer(q), text


def test_closure_and_paths_by_hand(engine):
    assert answers(engine, 'graph.closure("edge", "a", ?x, 1, 0, ?h)') == [("b", 1.0), ("c", 1.0), ("d", 2.0)]
    assert answers(engine, 'graph.closure("edge", "b", ?x, 3, 4, ?h)') == [("b", 3.0), ("c", 4.0)]
    assert answers(engine, 'graph.closure("edge", "b", "b", 1, 0, ?h)') == [(3.0,)]
    assert answers(engine, 'node(?n), graph.closure("edge", ?n, ?n, 0, 0, ?h) => ?n, ?h') == [("a", 0.0), ("b", 0.0), ("e", 0.0)]
    assert answers(engine, 'graph.paths("edge", "a", "d", "acyclic", 1, 0, ?p) => ?p') == [('["a","b","c","d"]',), ('["a","c","d"]',)]
    assert answers(engine, 'graph.paths("edge", "b", "b", "simple", 1, 0, ?p) => ?p') == [('["b","c","d","b"]',)]
    assert answers(engine, 'graph.paths("edge", "a", ?x, "shortest", 1, 0, ?p), path.length(?p, ?n) => ?x, ?n') == [("b", 1.0), ("c", 1.0), ("d", 2.0)]
    assert answers(engine, 'graph.paths("edge", "e", ?x, "walk", 0, 2, ?p) => ?p') == [('["e","e","e"]',), ('["e","e"]',), ('["e"]',)]


MET = "met(?a, ?b) :- {}; linked(?a, ?b) :- met(?a, ?b); linked(?a, ?c) :- {}; "
APART, ALL = "member(?a, ?g, _), member(?b, ?g, _), ?b != ?a", "member(?b, ?g, 1), member(?a, ?g, 1)"


@pytest.mark.parametrize("kind,memory", [("int", None), ("string", None), ("long", 0)])
def test_members_of_groups_are_linked_as_the_plain_evaluator_has_it(spark, memory, kind):
    """Groups that share members in a row, one with one member, one that names its only member twice, and one without a name."""
    made = (lambda x: x) if kind != "string" else (lambda x: f"n{x}")
    rows = [(made(m), g, w) for m, g, w in [(9, 1, 1), (2, 1, 1), (2, 2, 1), (7, 2, 1), (7, 3, 0), (4, 3, 1), (5, 4, 1), (6, 5, 1), (6, 5, 0), (8, None, 1), (3, None, 1), (2, 1, 1)]]
    e = Engine(spark)
    e.catalog.rows("member", rows, f"m {kind}, g long, w long", required=("m", "w"))
    e.catalog.rows("nobody", [], f"m {kind}, g long, w long", required=("m", "w"))
    two = f'"{made(2)}"' if kind == "string" else "2"
    ends = "linked(?a, ?b)", f"linked({two}, ?b)", f"linked(?a, {two})", f"linked({two}, {two}), member(?a, 3, _) => ?a"
    loops = "met(?a, ?b), linked(?b, ?c)", "linked(?a, ?b), linked(?b, ?c)"
    for pairs, loop, goals in ((APART, loops[0], ends if memory is None else ends[1:2]), (ALL, loops[1], ends[:1]), ("member(?a, _, 1), member(?b, _, 1), ?a != ?b", loops[0], ("linked(?a, ?b) => ?a, count(?b)",))):
        for goal in goals:
            q = parse(MET.format(pairs, loop) + goal)
            rules = {n: [r for r in q.rules if r.rel == n] for n in ("met", "linked")}
            assert rewrite.paired_step(rewrite.closure_step("linked", rules), rules)
            assert answers(e, MET.format(pairs, loop) + goal, limits=Limits(edges=memory)) == Naive({"member": rows}, q.rules).answer(q), (pairs, loop, goal)
    assert answers(e, MET.format(APART, "met(?a, ?b), linked(?b, ?c)").replace("member", "nobody") + "linked(?a, ?b)") == []


def test_many_rounds_put_a_long_row_of_groups_together(spark):
    links = spark.createDataFrame([((i * 7919) % 10_007, ((i + 1) * 7919) % 10_007) for i in range(600)] + [(20_000, 20_001)], "f long, t long")
    found = walks.components_by_joins(links, Limits()).collect()
    least = min((i * 7919) % 10_007 for i in range(601))
    assert len(found) == 603 and {r.node: r.root for r in found} == {r.node: 20_000 if r.node >= 20_000 else least for r in found}
    with pytest.raises(BudgetExceeded):
        walks.components_by_joins(links, Limits(rounds=1))


def test_limits_of_rows_count_linked_pairs(spark):
    e = Engine(spark)
    e.catalog.add("member", spark.sql("select id m, id % 2 g, 1 w from range(20)"), required=("m", "g"))
    text = MET.format(APART, "met(?a, ?b), linked(?b, ?c)")
    assert e.query(text + "linked(?a, ?b)", limits=Limits(rows=200)).count() == 200 and e.query(text + "linked(1, ?b)", limits=Limits(rows=10)).count() == 10
    for goal, rows in (("linked(?a, ?b)", 199), ("linked(1, ?b)", 9)):
        with pytest.raises(BudgetExceeded):
            e.query(text + goal, limits=Limits(rows=rows))


def test_large_groups_are_linked_in_time(spark):
    """Two groups of 3,000: 18 million pairs, which a walk over pairs would meet 3,000 times each."""
    e = Engine(spark)
    e.catalog.add("member", spark.sql("select id m, id % 2 g, 1 w from range(6000)"), required=("m", "g"))
    late = threading.Timer(60, lambda: e.cancel("linked"))
    late.start()
    try:
        with e.cancellable("linked"):
            counts = e.query(MET.format(APART, "met(?a, ?b), linked(?b, ?c)") + "linked(?a, ?b) => ?a, count(?b)", names=["a", "n"]).collect()
    finally:
        late.cancel()
    assert len(counts) == 6000 and {r.n for r in counts} == {3000}


LOOP = "p(?a, ?b) :- line(?a, ?b); p(?a, ?c) :- p(?a, ?b), p(?b, ?c), ?a != ?c; p(?a, ?b)"


@pytest.mark.parametrize("memory", [None, 0])
def test_limits_hold_either_way(spark, memory):
    """A line of 6 nodes: 15 pairs are reached in 5 rounds, and a sixth finds nothing."""
    e = Engine(spark)
    e.catalog.rows("line", [(i, i + 1) for i in range(5)], "f long, t long")
    walk, paths = 'graph.closure("line", ?a, ?b, 1, 0, ?h)', 'graph.paths("line", ?a, ?b, "{}", 1, 0, ?p)'
    tried = lambda text, **limits: e.query(text, limits=Limits(edges=memory, tuples=memory, **limits), ordered=False).count()
    assert tried(walk, rounds=6, rows=15) == 15 and tried(LOOP, rows=15) == 15
    for text in (walk, paths.format("acyclic"), paths.format("shortest")):
        assert tried(text, rounds=6) == 15
        for limits in ({"rounds": 5}, {"rows": 14}):
            with pytest.raises(BudgetExceeded):
                tried(text, **limits)
    for limits in ({"rounds": 1}, {"rows": 9}):
        with pytest.raises(BudgetExceeded):
            tried(LOOP, **limits)
    with pytest.raises(BudgetExceeded):
        e.query(walk, limits=Limits(edges=0, seconds=0))


@pytest.mark.parametrize("low,high", [(0, 0), (1, 0), (1, 2), (2, 3), (3, 4)])
def test_both_ways_of_walking_agree(engine, monkeypatch, low, high):
    texts = [f'graph.closure("edge", ?a, ?b, {low}, {high}, ?h)', f'graph.closure("edge", ?a, "d", {low}, {high}, ?h)']
    texts += [f'graph.paths("edge", ?a, ?b, "{m}", {low}, {high or 4}, ?p)' for m in walks.MODES]
    small = [answers(engine, t) for t in texts]
    monkeypatch.setattr(walks, "SMALL", 0)
    assert [answers(engine, t) for t in texts] == small


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_both_ways_agree_on_every_kind(spark, kind):
    """Nodes and edge names of each kind, in all modes and for closures: one rendering and one choice."""
    cast = {"long": int, "double": float, "string": str}[kind]
    pairs = [(1, 9), (1, 10), (9, 2), (10, 2), (2, 1), (1, 100000), (100000, 3), (1, 20), (20, 3), (1, 9)]
    edges = spark.createDataFrame([(cast(f), cast(t), cast(12 - i)) for i, (f, t) in enumerate(pairs)], f"f {kind}, t {kind}, e {kind}")
    for memory in (Limits(), Limits(edges=0)):
        found = [sorted(map(tuple, walks.paths(edges, mode, 1, 3, named, limits=memory).collect())) for mode in walks.MODES for named in (False, True)]
        found.append(sorted(map(tuple, walks.closure(edges, 1, 3, limits=memory).collect())))
        if memory.edges is None:
            first = found
    assert found == first


@pytest.mark.parametrize("mode", walks.MODES)
def test_both_ways_agree_on_numbers(spark, monkeypatch, mode):
    pairs = [(1.0, 9.0), (1.0, 10.0), (9.0, 2.5), (10.0, 2.5), (1.0, 1e7), (1e7, 3.0), (1.0, 20.0), (20.0, 3.0), (2.5, 1.0), (1.0, 9.0)]
    edges = spark.createDataFrame([(f, t, 12 - i) for i, (f, t) in enumerate(pairs)], "f double, t double, e long")
    found = lambda named: sorted(map(tuple, walks.paths(edges, mode, 1, 3, named).collect()))
    small = [found(named) for named in (False, True)]
    monkeypatch.setattr(walks, "SMALL", 0)
    assert [found(named) for named in (False, True)] == small
    assert (1.0, 2.5, '{"nodes":[1,10,2.5],"edges":[11,9]}') in small[1]


@pytest.mark.parametrize("limit", [0, 5, 10**6])
def test_rounds_in_memory_and_as_jobs_agree(engine, monkeypatch, limit):
    monkeypatch.setattr(kernel, "READ", limit)
    for text in PROGRAMS:
        if text.startswith(("r(", "odd(", "s(")):
            assert answers(engine, text) == Naive(FACTS, parse(text).rules).answer(parse(text)), text


def test_a_component_that_outgrows_memory(spark, monkeypatch):
    rules, start = parse("p(?a, ?b) :- e(?a, ?b); p(?a, ?c) :- p(?a, ?b), p(?b, ?c); p(?a, ?b)").rules, {"p": [(i, i + 1) for i in range(30)]}
    assert kernel.fixpoint(["p"], {"p": [rules[1]]}, start, {}, 100, derived=100) is None
    assert len(kernel.fixpoint(["p"], {"p": [rules[1]]}, start, {}, 100)["p"]) == 465


def test_exact_counts(spark):
    e = Engine(spark)
    e.catalog.rows("edge", [(f"v{i}", f"v{i + 1}") for i in range(149)], SCHEMAS["edge"])
    reach = "r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); "
    assert e.query(reach + "r(?a, ?b)").count() == 11_175
    tree = [(f"t{i}", f"t{c}") for i in range(63) for c in (2 * i + 1, 2 * i + 2)]
    e.catalog.rows("up", tree, SCHEMAS["edge"])
    same = "s(?x, ?y) :- up(?p, ?x), up(?p, ?y); s(?x, ?y) :- up(?a, ?x), s(?a, ?b), up(?b, ?y); "
    assert e.query(same + "s(?x, ?y)").count() == sum(4**d for d in range(1, 7))
    assert e.query(same + 's("t70", ?y)').count() == 64


def test_params_pages_and_totals(engine):
    assert answers(engine, "edge(?a, ?b)", params={"a": "a"}) == [("a", "b"), ("a", "c")]
    assert answers(engine, "edge(?a, ?b) => ?b", params={"a": ["a", "d"]}) == [("b",), ("c",)]
    assert answers(engine, "edge(?a, ?b) => ?b", params={"a": []}) == []
    assert answers(engine, "edge(?a, ?b) => ?a, ?b order by ?a, ?b limit 2", after=("b", "c")) == [("c", "d"), ("d", "b")]
    assert engine.total("edge(?a, ?b) => ?a, ?b order by ?a limit 2") == 6


def test_functions(engine):
    assert answers(engine, 'str.split("a,b,,c", ",", ?i, ?p)') == [(0.0, "a"), (1.0, "b"), (2.0, ""), (3.0, "c")]
    assert answers(engine, 'str.split("a-b", "-", -1, ?p)') == [("b",)]
    assert answers(engine, 'str.split("ab", "", ?i, ?p)') == [(0.0, "a"), (1.0, "b")]
    assert answers(engine, 'str.concat("ab", ?t, "abc"), str.concat(?h, "c", "abc")') == [("c", "ab")]
    assert answers(engine, 'str.replace("aba", "a", "x", ?o), str.capitalize("wORD", ?c), str.distance("Ω", "O", ?d)') == [("xbx", "WORD", 1.0)]
    assert answers(engine, 'str.find("a1b22", "[0-9]+", ?i, ?m)') == [(0.0, "1"), (1.0, "22")]
    assert answers(engine, "num.add(?a, 2, 5), num.mul(3, ?b, 12), num.neg(?c, 4), 10 = ?d - 1") == [(3.0, 4.0, -4.0, 11.0)]
    engine.catalog.rows("lists", [('[1,"x",null]',), ("no",), (None,)], "l string")
    assert answers(engine, "lists(?l), list.member(?l, ?i, ?x) => ?i, ?x") == [(0.0, "1"), (1.0, "x"), (2.0, None)]
    assert answers(engine, 'list.length("[1,2]", ?n), list.at("[1,2]", -1, ?x)') == [(2.0, 2.0)]
    assert answers(engine, 'path.step("[1]", ?i, ?f, ?t)') == []
    assert answers(engine, 'num.unit(?x, ?u), ?x = 3V') == [(3.0, "V")]
    assert answers(engine, "w(?n, ?v), ?p = ?v * 2A, num.unit(?p, ?u) => ?u") == [("A",)]


@pytest.mark.parametrize(
    "text,kind",
    [
        ("edg(?a, ?b)", "unknown"), ("edge(?a)", "arity"), ("p(?x) :- node(?x); p(?x, ?y) :- edge(?x, ?y); p(?x)", "arity"),
        ("edge(?a, ?b) :- node(?a), node(?b); edge(?a, ?b)", "redefined"), ("p(?x, ?z) :- node(?x); p(?a, ?b)", "unbound"),
        ("node(?n), ?z < 3", "unbound"), ("node(?n), not edge(?x, ?y)", "unbound"), ("edge(?a, ?b) => ?c", "projection"),
        ("p(?x) :- node(?x), not p(?x); p(?x)", "recursion"), ("n(?m) :- w(_, ?m); n(?k) :- n(?m), ?k = ?m + 1; n(?m)", "recursion"),
        ("c(count(?x)) :- node(?x); c(?x) :- w(_, ?x); c(?x)", "aggregate"), ("edge(?a, ?b) => ?a order by ?b", "order"),
        ("edge(?a, ?b) => ?a limit 1 offset 2", "order"), ('graph.closure("edge", ?a, ?b, 3, 2, ?h)', "walk"),
        ('graph.paths("edge", ?a, ?b, "walk", 1, 0, ?p)', "walk"), ('graph.paths("edge", ?a, ?b, "odd", 1, 2, ?p)', "walk"),
        ('tag(_, ?t), str.match(?t, "(?=x)")', "type"), ('tag(_, ?t), str.glob(?t, "[a")', "type"), ("node(?n), ?x = 1V, ?y = 2A, ?x < ?y", "type"),
        ("p(?x) :- node(?x); p(?x) as ?r", "fact"),
    ],
)
def test_refusals(engine, text, kind):
    with pytest.raises(CheckError) as e:
        engine.query(text)
    assert e.value.kind == kind


def test_refused_options(engine):
    with pytest.raises(CheckError):
        engine.query("node(?n)", params={"m": 1})
    with pytest.raises(CheckError):
        engine.query("node(?n)", at=1, across=[1])
    with pytest.raises(BudgetExceeded):
        engine.query('s(?x, ?y) :- edge(?p, ?x), edge(?p, ?y); s(?x, ?y) :- edge(?a, ?x), s(?a, ?b), edge(?b, ?y); s(?x, ?y)', limits=Limits(rounds=0))


def test_around_asking(engine):
    engine.validate("edge(?a, ?b)")
    assert "edge(?a, ?b)" in engine.explain("edge(?a, ?b) => ?a")
    assert engine.why_empty('edge(?a, ?b), w(?a, ?v), ?v > 50') == "?v > 50"
    assert engine.lint('edge(?a, ?b), edge(?a, ?c) => ?b') and not engine.lint("edge(?a, ?b), edge(?a, ?c), ?b != ?c => ?b")
    engine.materialize("kept", 'kept(?a) :- edge(?a, "c");')
    assert answers(engine, "kept(?a)") == [("a",), ("b",)]
    assert "edge" in engine.catalog.members() and engine.catalog.describe("edge").startswith("edge(f: text")


def test_derivations():
    q = parse("r(?a, ?b) :- edge(?a, ?b); r(?a, ?c) :- r(?a, ?b), edge(?b, ?c); r(?a, ?b)")
    n = Naive(FACTS, q.rules)
    (d,) = n.why(q, ("a", "d"))
    assert d.height == 2 and d.leaves() == {'edge("a", "c")', 'edge("c", "d")'}


def test_simplified_arithmetic(spark):
    e = Engine(spark, Catalog(spark, simplify=True))
    pairs = [(i / 10, j / 100) for i in range(1, 12) for j in (7, 20, 33, 110, 215)]
    e.catalog.rows("n", pairs, "a double, b double")
    back = {
        "+": (lambda a, b: a + b, lambda c, a: c - a, lambda c, b: c - b), "-": (lambda a, b: a - b, lambda c, a: a - c, lambda c, b: c + b),
        "*": (lambda a, b: a * b, lambda c, a: c / a, lambda c, b: c / b), "/": (lambda a, b: a / b, lambda c, a: a / c if c else None, lambda c, b: c * b),
    }
    changed = 0
    for op, (forward, to_b, to_a) in back.items():
        got = {(a, b): c for a, b, c in answers(e, f"n(?a, ?b) => ?a, ?b, ?a {op} ?b")}
        for (a, b), c in got.items():
            short = float(f"{forward(a, b):.14e}")
            want = short if to_b(short, a) == b and to_a(short, b) == a else forward(a, b)
            assert c == want
            changed += want != forward(a, b)
    assert changed


def test_absent_equals_absent_but_not_in_order(spark):
    e = Engine(spark)
    e.catalog.rows("l", [(1, None), (2, float("nan")), (3, 4.0)], "k int, v double").rows("r", [(None,), (float("nan"),), (4.0,)], "v double")
    assert [r[0] for r in e.query("l(?k, ?v), r(?v) => ?k").collect()] == [1, 2, 3]
    assert [r[0] for r in e.query("l(?k, ?v), ?v >= 0 => ?k").collect()] == [3]
    assert [r[0] for r in e.query("l(?k, ?v) => ?v, ?k").select("k").collect()] == [1, 2, 3]


def test_cited_walks(spark):
    e = Engine(spark)
    rows = [("a", "b", ["2"]), ("b", "d", ["9"]), ("a", "c", ["5"]), ("c", "d", ["1"]), ("a", "b", ["3"]), ("d", "a", ["7"])]
    e.catalog.rows("road", rows, "f string, t string, __cites array<string>")
    got = [tuple(r) for r in e.query('graph.closure("road", "a", ?x, 1, 0, ?h)', cites=True).collect()]
    assert got == [("a", 3, ["1", "5", "7"]), ("b", 1, ["2"]), ("c", 1, ["5"]), ("d", 2, ["1", "5"])]
    got = [tuple(r) for r in e.query('graph.closure("road", ?x, "d", 1, 2, ?h)', cites=True).collect()]
    assert got == [("a", 2, ["1", "5"]), ("b", 1, ["9"]), ("c", 1, ["1"])]
    got = [tuple(r) for r in e.query('graph.paths("road", "a", "d", "acyclic", 1, 0, ?p) => ?p', cites=True).collect()]
    assert got == [('["a","b","d"]', ["2", "9"]), ('["a","c","d"]', ["1", "5"])]


def test_plans_without_needless_work(spark):
    """Answers that show a key need no distinct, tests by key are semi joins, and only asked orders sort."""
    e = Engine(spark)
    e.catalog.add("item", spark.range(100).selectExpr("id AS k", "id % 7 AS g", "id % 3 AS h"), required=["k", "g", "h"], key=("k",))
    plan = lambda text, **more: e.query(text, ordered=False, **more)._jdf.queryExecution().optimizedPlan().toString()
    shown = plan("item(?k, ?g, _), ?g > 2 => ?k, ?g")
    assert "Aggregate" not in shown and "Sort" not in shown
    assert "Aggregate" in plan("item(?k, ?g, _) => ?g") and "Aggregate" in plan("item(?k, ?g, _), item(?j, ?g, _) => ?k, ?g")
    assert "LeftSemi" in plan("big(?g) :- item(_, ?g, ?h), ?h > 1; item(?k, ?g, _), big(?g) => ?k, ?g")
    assert "LeftSemi" in plan("item(?k, ?g, ?h), item(?g, _, _) => ?k, ?h") and "LeftSemi" not in plan("item(?k, ?g, _), item(_, ?g, _) => ?k, count(?g)")
    assert e.query("item(?k, ?g, _), item(?g, _, _) => count(?k)").first()[0] == 100
    assert e.query("item(?k, ?g, _), item(_, ?g, _) => count(?k)").first()[0] == sum(sum(j % 7 == i % 7 for j in range(100)) for i in range(100))


def test_sums_are_exact(spark):
    import math
    import random

    rng = random.Random(1)
    groups = {0: [1e16, 1.0, -1e16], 1: [0.1] * 10, 2: [-0.1] * 7, 3: [float("inf"), 2.0], 4: [1e300, 1e300], 5: [1e18, -1e18 + 128, -0.25], 6: [None], 7: [-1e-9, 2.0]}
    groups |= {i: [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-9, 17) for _ in range(rng.randint(1, 30))] for i in range(8, 40)}
    e = Engine(spark)
    e.catalog.rows("v", [(k, x) for k, xs in groups.items() for x in xs], "k int, x double")
    for k, total, mean in answers(e, "v(?k, ?x) => ?k, sum(?x), avg(?x)"):
        xs = [x for x in groups[k] if x is not None]
        assert total == math.fsum(xs) and mean == (math.fsum(xs) / len(xs) if xs else None)
    e.catalog.rows("nan", [(float("nan"),), (1.0,)], "x double")
    assert math.isnan(e.query("nan(?x) => sum(?x)").first()[0])


def test_work_can_be_cancelled(spark):
    import threading
    import time

    e = Engine(spark)
    e.catalog.add("slow", spark.range(4).selectExpr("id AS k"), required=["k"])
    from strataflow.functions import host

    e.catalog.predicate(host.generator(lambda k: [time.sleep(30) or k], "wait", (0,), (1,), ("long",)))
    began = time.time()
    done = threading.Event()

    def stop():
        while not done.wait(3):
            e.cancel("asked")

    threading.Thread(target=stop, daemon=True).start()
    with pytest.raises(Exception, match="(?i)cancel"), e.cancellable("asked"):
        e.query("slow(?k), wait(?k, ?x) => count(?x)").collect()
    done.set()
    assert time.time() - began < 25
