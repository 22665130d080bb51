from conftest import Ordered as Engine

from strataflow import plain
from strataflow.plans.text import parse


def test_card_grammar_and_chains(spark):
    e = Engine(spark)
    e.catalog.rows("made", [("p1", "s1")], "part string, maker string", entities={"part": "Part", "maker": "Maker"}, doc="who makes what")
    e.catalog.rows("seat", [("s1", "FR")], "maker string, land string", entities={"maker": "Maker", "land": "Country"}, domains={"land": ("FR", "DE")})
    e.catalog.module("geo", 'near(?a, ?b) :- seat(?a, ?c), seat(?b, ?c); _own(?a) :- seat(?a, _);')
    card = plain.card(e)
    assert "made(part: text, maker: text)  who makes what" in card and "land is one of FR, DE" in card and "geo.near/2" in card and "_own" not in card and "str.split" in card
    text = plain.grammar(e)
    assert '"made(" term ", " term ")"' in text and '"geo.near(" term ", " term ")"' in text and "geo._own" not in text
    names = {line.split(" ::= ")[0] for line in text.splitlines()}
    assert {"root", "rule", "goal", "literal", "known", "term"} <= names
    (chain,) = plain.chains(e.catalog, "Part", "Country")
    program = plain.chain_program(chain, e.catalog)
    assert parse(program) and [tuple(r) for r in e.query(program).collect()] == [("p1", "FR")]
    assert plain.chains(e.catalog, "Part", "Nowhere") == []
