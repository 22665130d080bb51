"""The syntax tree of programs, which is also what the rewrites work on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Const:
    value: object  # None, a number or text
    unit: str = ""


@dataclass(frozen=True)
class Op:
    """Arithmetic: + - * /, or `neg` of one operand."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    """A function in an expression; its result is the relation's last argument."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    func: str
    var: str
    distinct: bool = False


@dataclass(frozen=True)
class Atom:
    rel: str
    args: tuple
    fact: str | None = None  # the variable of `as ?r`


@dataclass(frozen=True)
class Not:
    atom: Atom


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    """A disjunction of conjunctions over what the rest of the body binds; front ends make these."""

    branches: tuple  # of bodies


@dataclass(frozen=True)
class Reduce:
    """?var = agg : { body }, once for each value of what the braces share with the outside."""

    var: str
    agg: Agg
    body: tuple


@dataclass(frozen=True)
class Maybe:
    """optional { body }."""

    body: tuple


@dataclass(frozen=True)
class Rule:
    rel: str
    args: tuple
    body: tuple
    types: tuple = ()


@dataclass(frozen=True)
class Column:
    item: object  # Var, Const, Agg or an expression
    label: str


@dataclass(frozen=True)
class Query:
    rules: tuple = ()
    goal: tuple = ()
    select: tuple | None = None
    having: tuple = ()  # (Agg, op, Var or Const)
    order: tuple = ()  # (item, descending)
    after: tuple = ()
    limit: int | None = None
    offset: int = 0
    labels: dict = field(default_factory=dict, hash=False, compare=False)


def expr_vars(e: object) -> Iterator[str]:
    if isinstance(e, Var):
        yield e.name
    elif isinstance(e, (Op, Call)):
        for a in e.args:
            yield from expr_vars(a)
    elif isinstance(e, Agg):
        yield e.var


def literal_vars(x: object) -> Iterator[str]:
    """Every variable of a literal, in order; those inside braces too."""
    if isinstance(x, Atom):
        for a in x.args:
            yield from expr_vars(a)
        if x.fact:
            yield x.fact
    elif isinstance(x, Not):
        yield from literal_vars(x.atom)
    elif isinstance(x, Compare):
        yield from expr_vars(x.left)
        yield from expr_vars(x.right)
    elif isinstance(x, Reduce):
        yield x.var
        yield from body_vars(x.body)
    elif isinstance(x, Maybe):
        yield from body_vars(x.body)
    elif isinstance(x, Either):
        for b in x.branches:
            yield from body_vars(b)


def body_vars(body: tuple) -> Iterator[str]:
    for x in body:
        yield from literal_vars(x)


def atoms(body: tuple, negated: bool = False) -> Iterator[tuple[Atom, bool]]:
    """(atom, strict): strict if the body needs it complete: under not, an aggregate or optional."""
    for x in body:
        if isinstance(x, Atom):
            yield x, negated
        elif isinstance(x, Not):
            yield x.atom, True
        elif isinstance(x, (Reduce, Maybe)):
            yield from atoms(x.body, True)
        elif isinstance(x, Either):
            for b in x.branches:
                yield from atoms(b, True)


def map_terms(x: object, f) -> object:
    """A literal or expression with f applied to its variables, constants and wildcards."""
    if isinstance(x, (Var, Wild, Const)):
        return f(x)
    if isinstance(x, (Op, Call)):
        return replace(x, args=tuple(map_terms(a, f) for a in x.args))
    if isinstance(x, Agg):
        v = f(Var(x.var))
        return replace(x, var=v.name) if isinstance(v, Var) else x
    if isinstance(x, Atom):
        fact = f(Var(x.fact)).name if x.fact else None
        return replace(x, args=tuple(map_terms(a, f) for a in x.args), fact=fact)
    if isinstance(x, Not):
        return Not(map_terms(x.atom, f))
    if isinstance(x, Compare):
        return Compare(x.op, map_terms(x.left, f), map_terms(x.right, f))
    if isinstance(x, Reduce):
        v = f(Var(x.var))
        return Reduce(v.name if isinstance(v, Var) else x.var, map_terms(x.agg, f), tuple(map_terms(y, f) for y in x.body))
    if isinstance(x, Maybe):
        return Maybe(tuple(map_terms(y, f) for y in x.body))
    if isinstance(x, Either):
        return Either(tuple(tuple(map_terms(y, f) for y in b) for b in x.branches))
    return x
