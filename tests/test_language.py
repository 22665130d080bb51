import pytest

from strataflow.errors import SyntaxRefused
from strataflow.plans.text import parse, parse_rules, show
from strataflow.plans.tree import Agg, Atom, Compare, Const, Maybe, Not, Reduce, Rule, Var, Wild

PROGRAMS = [
    'edge(?a, ?b), not edge(?b, ?a) => ?a',
    'r(?a, ?b) :- edge(?a, ?b);\nr("a", ?x) => ?x',
    'edge(?a, _), ?a != "x" => ?a, count(?a) having count(?a) > 1 order by ?a desc after "b" limit 3 offset 1',
    "node(?n), ?k = count(distinct ?m) : { edge(?n, ?m) } => ?n, ?k",
    'node(?n), optional { w(?n, ?v), ?v >= 1.5 } => ?n, (?v * 2)',
    "edge(?a, ?b) as ?r => ?r",
]


@pytest.mark.parametrize("text", PROGRAMS)
def test_printed_programs_read_back(text):
    q = parse(text)
    again = parse(show(q))
    assert (again.rules, again.goal, again.order, again.limit, again.offset, again.after) == (q.rules, q.goal, q.order, q.limit, q.offset, q.after)
    assert [c.item for c in again.select or ()] == [c.item for c in q.select or ()]


def test_terms_and_literals():
    q = parse('r(?a, "x\\"y", -1.5, _), ?a < 3, ?n = sum(?b) : { s(?b) }, optional { t(?a) }, !u(?a) # a comment')
    assert q.goal[0] == Atom("r", (Var("a"), Const('x\\"y'), Const(-1.5), Wild()))
    assert q.goal[1] == Compare("<", Var("a"), Const(3))
    assert q.goal[2] == Reduce("n", Agg("sum", "b"), (Atom("s", (Var("b"),)),))
    assert q.goal[3] == Maybe((Atom("t", (Var("a"),)),))
    assert q.goal[4] == Not(Atom("u", (Var("a"),)))


def test_other_endings():
    q = parse("p(?x) :- q(?x).\n?- p(?x).")
    assert q.rules[0].rel == "p" and q.goal == (Atom("p", (Var("x"),)),)


def test_module_facts_and_types():
    assert parse_rules('rail("VCC"); size(?p, ?n: number) :- part(?p, ?n);') == (
        Rule("rail", (Const("VCC"),), ()),
        Rule("size", (Var("p"), Var("n")), (Atom("part", (Var("p"), Var("n"))),), (None, "number")),
    )


def test_units_are_folded():
    assert parse("r(?v), ?v > 5mV").goal[1].right == Const(0.005, "V")


@pytest.mark.parametrize("text", ["", "r(?a", 'r("a)', "r(?a) => ?a limit 0", "r(?a) => ?a limit x", "r(a)", "r(?a), s(?b) extra", "?x = count(?y)", "r(?a); s(?b)"])
def test_refused(text):
    with pytest.raises(SyntaxRefused):
        parse(text)
