"""For plain-language front ends: a card of the vocabulary, a grammar that holds a model's output to it, chains of
relations that lead from one kind of thing to another, and sessions over a model that the host brings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from strataflow.engine import Engine
from strataflow.errors import BudgetExceeded, CheckError, SyntaxRefused
from strataflow.plans.text import AGGREGATES
from strataflow.sources.catalog import Catalog
from strataflow.sources.facts import read_facts


def card(engine: Engine) -> str:
    """What a model has to know to write programs: relations with their columns, predicates with their modes, and the forms."""
    c = engine.catalog
    lines = ["Relations:"]
    for name in c.members():
        if name in c.relations:
            r = c.relations[name]
            lines.append("  " + c.describe(name) + "".join(f"; {k} is one of {', '.join(map(str, v))}" for k, v in r.domains.items()))
    exported = c.exported()
    if exported:
        lines.append("Rules of modules:")
        lines += [f"  {n}/{len(rs[0].args)}" for n, rs in sorted(exported.items()) if not n.split(".")[-1].startswith("_")]
    lines.append("Tests and functions:")
    lines += [f"  {c.describe(n)}" for n in sorted(c.predicates)]
    lines += [
        "Forms:",
        '  r(?a, "text", 3, _)   not r(?a)   ?a < 3   ?n = count(?x) : { r(?a, ?x) }   optional { r(?a, ?x) }',
        "  head(?a, ?b) :- body;   body => ?a, count(?b) having count(?b) > 1 order by ?a desc limit 10",
        '  graph.closure("r", ?from, ?to, 1, 0, ?hops)   graph.paths("r", ?from, ?to, "acyclic", 1, 3, ?path)',
    ]
    return "\n".join(lines)


def grammar(engine: Engine) -> str:
    """Programs over this vocabulary as GBNF: relation names and numbers of arguments are the catalog's own."""
    c = engine.catalog
    arity = {n: len(r.labels) for n, r in c.relations.items()} | {n: len(rs[0].args) for n, rs in c.exported().items()} | {n: p.arity for n, p in c.predicates.items()}
    known = [f'"{n}(" ' + ' ", " '.join(["term"] * k) + ' ")"' for n, k in sorted(arity.items()) if k and not n.split(".")[-1].startswith(("_", "~"))]
    rules = {
        "root": "rule* goal",
        "rule": 'own " :- " body ";\\n"',
        "goal": 'body (" => " column (", " column)* having? order? limit?)?',
        "having": '" having " aggregate op term',
        "order": '" order by " column (" desc")?',
        "limit": '" limit " [1-9] [0-9]*',
        "column": "variable | aggregate",
        "aggregate": "(" + " | ".join(f'"{a}("' for a in AGGREGATES) + ') "distinct "? variable ")"',
        "body": 'literal (", " literal)*',
        "literal": '"not " atom | atom | comparison | variable " = " aggregate " : { " body " }" | "optional { " body " }"',
        "comparison": "term op term",
        "op": '" = " | " != " | " < " | " <= " | " > " | " >= "',
        "atom": "known | own",
        "known": " | ".join(known) or '"nothing()"',
        "own": '"my_" [a-z]+ "(" term (", " term)* ")"',
        "term": 'variable | "_" | string | number',
        "variable": '"?" [a-z] [a-z0-9_]*',
        "string": '"\\"" [^"]* "\\""',
        "number": '"-"? [0-9]+ ("." [0-9]+)?',
    }
    return "\n".join(f"{k} ::= {v}" for k, v in rules.items()) + "\n"


def chains(catalog: Catalog, start: str, goal: str, most: int = 4) -> list[list[tuple[str, str, str]]]:
    """The shortest chains of relations from one entity to another: (relation, column in, column out) a step.

    Columns say what they name by the relation's `entities`. Chains longer than `most` aren't looked for.
    """
    steps: dict[str, list[tuple[str, str, str, str]]] = {}
    for name, r in catalog.relations.items():
        for a, kind in r.entities.items():
            for b, other in r.entities.items():
                if a != b:
                    steps.setdefault(kind, []).append((name, a, b, other))
    level: list[tuple[str, list[tuple[str, str, str]]]] = [(start, [])]
    for _ in range(most):
        level = [(other, [*done, (name, a, b)]) for at, done in level for name, a, b, other in sorted(steps.get(at, [])) if (name, b, a) not in done and (name, a, b) not in done]
        found = [done for at, done in level if at == goal]
        if found:
            return found
    return []


def chain_program(chain: list[tuple[str, str, str]], catalog: Catalog) -> str:
    """A chain as a goal with a variable for each place it passes."""
    atoms = []
    for i, (name, a, b) in enumerate(chain):
        atoms.append(f"{name}(" + ", ".join(f"?x{i}" if c == a else f"?x{i + 1}" if c == b else "_" for c in catalog.relations[name].labels) + ")")
    return ", ".join(atoms) + f" => ?x0, ?x{len(chain)}"


@dataclass(frozen=True)
class Reply:
    """The program that was run and its rows; `tries` counts what the model was asked, `agreed` how many of its programs
    answered alike. Without a program `error` tells what was wrong with the last one."""

    program: str = ""
    columns: tuple = ()
    rows: tuple = ()
    tries: int = 0
    agreed: int = 0
    error: str = ""


def program_in(text: str) -> str:
    """The program in a model's output: what a fence holds, if there is one, else all of it."""
    parts = text.split("```")
    inside = parts[1] if len(parts) > 2 else text
    first, _, rest = inside.partition("\n")
    return (rest if len(parts) > 2 and first.strip().isalpha() else inside).strip()


class Session:
    """Questions one after another, translated by a host's model, a function from a prompt to text.

    A program that is refused goes back to the model with the reason, `tries` times at most. With several votes the model
    is asked as often, and the answer that most of its programs give is taken, of equally many the first. Earlier
    questions and their programs are part of the prompt, so that later ones may refer to them.
    """

    def __init__(self, engine: Engine, model: Callable[[str], str], tries: int = 3, votes: int = 1, rows: int = 200) -> None:
        self.engine, self.model, self.tries, self.votes, self.rows = engine, model, tries, votes, rows
        self.said: list[tuple[str, str]] = []

    def prompt(self, question: str, wrong: list[tuple[str, str]]) -> str:
        parts = [card(self.engine), *[f"Question: {q}\nProgram:\n{p}" for q, p in self.said], f"Question: {question}"]
        parts += [f"This program was refused:\n{p}\nReason: {why}" for p, why in wrong]
        return "\n\n".join([*parts, "Program:"])

    def translated(self, question: str) -> Reply:
        wrong: list[tuple[str, str]] = []
        for n in range(1, self.tries + 1):
            program = program_in(self.model(self.prompt(question, wrong)))
            try:
                df = self.engine.query(program, ordered=True).limit(self.rows)
                return Reply(program, tuple(df.columns), tuple(map(tuple, df.collect())), n, 1)
            except (CheckError, SyntaxRefused, BudgetExceeded) as e:
                wrong.append((program, str(e)))
        return Reply(tries=self.tries, error=wrong[-1][1])

    def ask(self, question: str) -> Reply:
        found = [self.translated(question) for _ in range(self.votes)]
        tries, good = sum(r.tries for r in found), [r for r in found if r.program]
        if not good:
            return Reply(tries=tries, error=found[-1].error)
        alike = {r.rows: sum(o.rows == r.rows for o in good) for r in good}
        best = max(good, key=lambda r: alike[r.rows])
        self.said.append((question, best.program))
        return Reply(best.program, best.columns, best.rows, tries, alike[best.rows])


def extracted(catalog: Catalog, model: Callable[[str], str], text: str, relations: list[str]) -> tuple[dict[str, list[tuple]], list[str]]:
    """Facts of these relations that a model finds in a text, and the lines of its output that aren't such facts.

    A line is kept if it reads as a fact, of a relation that was asked for, with its number of arguments, inside its columns'
    domains and with numbers where the column holds numbers.
    """
    shape = "\n".join(catalog.describe(n) for n in relations)
    out: dict[str, list[tuple]] = {n: [] for n in relations}
    refused = []
    for line in program_in(model(f"Relations:\n{shape}\n\nText:\n{text}\n\nFacts, a line each:")).splitlines():
        try:
            rows, _, _ = read_facts(line)
        except SyntaxRefused:
            refused.append(line)
            continue
        for name, found in rows.items():
            r = catalog.relations.get(name) if name in relations else None
            fits = r is not None and all(
                len(t) == len(r.labels)
                and all(v is None or ((k.name == "num") == isinstance(v, (int, float)) and (c not in r.domains or v in r.domains[c])) for c, k, v in zip(r.labels, r.kinds, t, strict=True))
                for t in found
            )
            if fits:
                out[name] += [t for t in found if t not in out[name]]
            else:
                refused.append(line)
    return out, refused
