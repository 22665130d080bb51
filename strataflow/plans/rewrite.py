"""Program rewrites before any DataFrame exists: renaming, macros, linking, components, demand."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from strataflow.errors import CheckError
from strataflow.plans.tree import Agg, Atom, Compare, Const, Either, Maybe, Not, Query, Reduce, Rule, Var, Wild, atoms, body_vars, expr_vars, map_terms


def renamed_literal(x: object, names: dict[str, str]) -> object:
    if isinstance(x, Atom):
        args = x.args
        if x.rel in ("graph.closure", "graph.paths") and args and isinstance(args[0], Const) and args[0].value in names:
            args = (Const(names[args[0].value]), *args[1:])
        return replace(x, rel=names.get(x.rel, x.rel), args=args)
    if isinstance(x, Not):
        return Not(renamed_literal(x.atom, names))
    if isinstance(x, (Reduce, Maybe)):
        return replace(x, body=tuple(renamed_literal(y, names) for y in x.body))
    if isinstance(x, Either):
        return Either(tuple(tuple(renamed_literal(y, names) for y in b) for b in x.branches))
    return x


def renamed(r: Rule, names: dict[str, str]) -> Rule:
    return replace(r, rel=names.get(r.rel, r.rel), body=tuple(renamed_literal(x, names) for x in r.body))


def reads(body: tuple) -> Iterable[tuple[str, bool]]:
    """(relation, strict) for everything a body reads; a walk needs the relation it names complete."""
    for a, strict in atoms(body):
        if a.rel in ("graph.closure", "graph.paths"):
            if a.args and isinstance(a.args[0], Const):
                yield str(a.args[0].value), True
        else:
            yield a.rel, strict


def components(rules: dict[str, list[Rule]]) -> list[list[str]]:
    """Strongly connected relations, each before those that read it."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for r in rules[v]:
            for w, _ in reads(r.body):
                if w not in rules:
                    continue
                if w not in index:
                    visit(w)
                    low[v] = min(low[v], low[w])
                elif w in stack:
                    low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            at = stack.index(v)
            out.append(stack[at:])
            del stack[at:]

    for v in rules:
        if v not in index:
            visit(v)
    return out


def recursive(component: list[str], rules: dict[str, list[Rule]]) -> bool:
    return len(component) > 1 or any(n == component[0] for r in rules[component[0]] for n, _ in reads(r.body))


def unbound_inputs(r: Rule) -> list[str]:
    """Head variables that no positive literal of the body binds: the caller supplies them."""
    bound: set[str] = set()
    for x in r.body:
        if isinstance(x, Atom):
            bound |= set(v for a in x.args for v in expr_vars(a)) | ({x.fact} if x.fact else set())
        elif isinstance(x, Reduce):
            bound.add(x.var)
        elif isinstance(x, Maybe):
            bound |= set(body_vars(x.body))
    more = True
    while more:
        more = False
        for x in r.body:
            if isinstance(x, Compare) and x.op == "=":
                for a, b in ((x.left, x.right), (x.right, x.left)):
                    if isinstance(a, Var) and a.name not in bound and not isinstance(b, Var) and set(expr_vars(b)) <= bound:
                        bound.add(a.name)
                        more = True
    return [a.name for a in r.args if isinstance(a, Var) and a.name not in bound]


def computes_only(r: Rule) -> bool:
    return bool(r.body) and all(isinstance(x, Compare) for x in r.body)


def inline_inputs(q: Query, known: set[str]) -> Query:
    """Rules with inputs are macros: each call is replaced by the body with the call's arguments in it."""
    by: dict[str, list[Rule]] = {}
    for r in q.rules:
        by.setdefault(r.rel, []).append(r)
    macros = {n: rs[0] for n, rs in by.items() if any(unbound_inputs(r) for r in rs)}
    for n in macros:
        lost = set(unbound_inputs(macros[n])) - set(body_vars(macros[n].body))
        if lost:
            raise CheckError("unbound", f"{n}: nothing in the body reads ?{min(lost)}")
        if len(by[n]) > 1:
            raise CheckError("unbound", f"{n} takes inputs, so it can have one rule only")
        if any(m == n for m, _ in reads(macros[n].body)):
            raise CheckError("recursion", f"{n} takes inputs, so it can't read itself")
    if not macros:
        return q
    count = [0]

    def expand(body: tuple) -> tuple:
        out: list[object] = []
        for x in body:
            if isinstance(x, Atom) and x.rel in macros:
                m = macros[x.rel]
                if len(x.args) != len(m.args):
                    raise CheckError("arity", f"{x.rel} has {len(m.args)} arguments")
                count[0] += 1
                fresh = f"_{count[0]}"
                known_names: dict[str, object] = {}
                extra: list[object] = []
                for p, a in zip(m.args, x.args, strict=True):
                    if isinstance(p, Var) and p.name not in known_names:
                        known_names[p.name] = Var(f"w{fresh}{len(known_names)}") if isinstance(a, Wild) else a
                    else:
                        extra.append(Compare("=", known_names[p.name] if isinstance(p, Var) else p, a))
                put = lambda t, k=known_names, f=fresh: k.get(t.name, Var(t.name + f)) if isinstance(t, Var) else t
                out += [*expand(tuple(map_terms(y, put) for y in m.body)), *extra]
            elif isinstance(x, Not) and x.atom.rel in macros:
                raise CheckError("unbound", f"not {x.atom.rel}: a rule with inputs can't be negated")
            elif isinstance(x, (Reduce, Maybe)):
                out.append(replace(x, body=expand(x.body)))
            elif isinstance(x, Either):
                out.append(Either(tuple(expand(b) for b in x.branches)))
            else:
                out.append(x)
        return tuple(out)

    rules = tuple(replace(r, body=expand(r.body)) for r in q.rules if r.rel not in macros)
    return replace(q, rules=rules, goal=expand(q.goal))


def closure_step(name: str, rules: dict[str, list[Rule]]) -> Atom | None:
    """If name is the transitive closure of one atom over (x, y), that atom; its arguments are Var a, Var b or constants.

    r(a, b) :- e(a, b) and one of r(a, c) :- r(a, b), e(b, c); e(a, b), r(b, c); r(a, b), r(b, c).
    """
    own = rules[name]
    if len(own) != 2 or any(len(r.args) != 2 or not all(isinstance(a, Var) for a in r.args) or r.args[0] == r.args[1] for r in own):
        return None
    exits = [r for r in own if not any(n == name for n, _ in reads(r.body))]
    if len(exits) != 1 or len(exits[0].body) != 1 or not isinstance(step := exits[0].body[0], Atom) or step.fact:
        return None
    loop = next(r for r in own if r is not exits[0])
    if len(loop.body) != 2 or not all(isinstance(x, Atom) and not x.fact for x in loop.body):
        return None
    a, b = exits[0].args
    if a not in step.args or b not in step.args or any(isinstance(t, Var) and t not in (a, b) for t in step.args):
        return None

    def shape(x: Atom) -> tuple[object, object] | None:
        if x.rel == name:
            return x.args if all(isinstance(t, Var) for t in x.args) else None
        if x.rel != step.rel or len(x.args) != len(step.args):
            return None
        ends: dict[object, object] = {}
        for p, t in zip(step.args, x.args, strict=True):
            if isinstance(p, Var):
                if not isinstance(t, Var) or ends.setdefault(p, t) != t:
                    return None
            elif p != t:
                return None
        return ends[a], ends[b]

    shapes = [shape(x) for x in loop.body]
    if None in shapes or not any(x.rel == name for x in loop.body):
        return None
    for (p, m), (n, q) in (shapes, shapes[::-1]):
        if m == n and (p, q) == loop.args and len({p, m, q}) == 3:
            return step
    return None


def paired_step(step: Atom, rules: dict[str, list[Rule]]) -> tuple[Atom, Var, bool] | None:
    """If step's relation pairs the members of groups, the atom that has members and groups, its variable for a member, and
    whether members are paired with others only.

    e(x, y) :- m(x, k), m(y, k), with or without x != y: two atoms that are the same but for x and y.
    """
    own = rules.get(step.rel, [])
    if len(own) != 1 or len(own[0].args) != 2 or not all(isinstance(a, Var) for a in own[0].args) or own[0].args[0] == own[0].args[1]:
        return None
    x, y = own[0].args
    pair = [z for z in own[0].body if isinstance(z, Atom)]
    rest = [z for z in own[0].body if not isinstance(z, Atom)]
    if len(pair) != 2 or rest not in ([], [Compare("!=", x, y)], [Compare("!=", y, x)]):
        return None
    one, other = pair if x in pair[0].args else pair[::-1]
    if one.fact or other.fact or one.rel == step.rel or x not in one.args or y in one.args or not all(isinstance(t, (Var, Const, Wild)) for t in one.args):
        return None
    return (one, x, bool(rest)) if other == replace(one, args=tuple(y if t == x else t for t in one.args)) else None


def demanded(q: Query, known: set[str]) -> Query:
    """Magic sets: recursive relations that the goal calls with constants derive only what the call asks for.

    Stands aside for relations whose rules hold anything but atoms and comparisons, and for those that are
    called in more than one way from the goal.
    """
    rules: dict[str, list[Rule]] = {}
    for r in q.rules:
        rules.setdefault(r.rel, []).append(r)
    loops = {n for c in components(rules) if recursive(c, rules) for n in c}
    fine = {n for n in loops if closure_step(n, rules) is None and all(all(isinstance(x, (Atom, Compare)) for x in r.body) and not any(isinstance(a, Agg) for a in r.args) for r in rules[n])}
    called: dict[str, set[tuple[bool, ...]]] = {}
    for body in [q.goal, *[r.body for n, rs in rules.items() if n not in loops for r in rs]]:
        for a, strict in atoms(body):
            if a.rel in loops:
                called.setdefault(a.rel, set()).add(tuple(isinstance(t, Const) for t in a.args) if not strict and body is q.goal else (False,) * len(a.args))
    if len(called) != 1:
        return q
    ((target, ways),) = called.items()
    calls = [x for x in q.goal if isinstance(x, Atom) and x.rel == target]
    group = next(c for c in components(rules) if target in c)
    if len(ways) != 1 or not any(way := next(iter(ways))) or not set(group) <= fine or len(calls) != 1:
        return q
    made: list[Rule] = []
    seen: set[tuple[str, tuple[bool, ...]]] = set()
    todo = [(target, way)]

    def name(n: str, w: tuple[bool, ...]) -> str:
        return f"{n}~{''.join('bf'[not x] for x in w)}"

    def asked(n: str, w: tuple[bool, ...], args: tuple) -> Atom:
        return Atom(f"ask~{name(n, w)}", tuple(a for a, b in zip(args, w, strict=True) if b))

    while todo:
        n, w = todo.pop()
        if (n, w) in seen:
            continue
        seen.add((n, w))
        for r in rules[n]:
            guard = asked(n, w, r.args)
            bound = {v for a in guard.args for v in expr_vars(a)}
            body: list[object] = [guard]
            rest = list(r.body)
            while rest:
                # Comparisons as soon as they can be made, then atoms outside the loop, those with a bound variable first.
                def cost(x: object) -> tuple:
                    names = set(body_vars((x,)))
                    if isinstance(x, Compare):
                        return (0 if names <= bound else 9, 0)
                    return (1 if names & bound else 2, x.rel in group)

                x = min(rest, key=cost)
                rest.remove(x)
                if isinstance(x, Atom) and x.rel in group:
                    v = tuple(isinstance(a, Const) or (isinstance(a, Var) and a.name in bound) for a in x.args)
                    if any(v):
                        made.append(Rule(f"ask~{name(x.rel, v)}", asked(x.rel, v, x.args).args, tuple(body)))
                        x, key = replace(x, rel=name(x.rel, v)), (x.rel, v)
                    else:
                        return q  # an open call asks for everything
                    todo.append(key)
                body.append(x)
                bound |= set(body_vars((x,)))
            made.append(Rule(name(n, w), r.args, tuple(body)))
    seed = Rule(f"ask~{name(target, way)}", tuple(a for a, b in zip(calls[0].args, way, strict=True) if b), ())
    goal = tuple(replace(x, rel=name(target, way)) if x is calls[0] else x for x in q.goal)
    kept = tuple(r for r in q.rules if r.rel not in group)
    return replace(q, rules=(*kept, seed, *[m for m in made if not trivial(m)]), goal=goal)


def trivial(r: Rule) -> bool:
    return len(r.body) == 1 and isinstance(r.body[0], Atom) and r.body[0].rel == r.rel and r.body[0].args == r.args
