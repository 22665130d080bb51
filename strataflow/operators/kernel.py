"""Small recursive components in memory.

A fixpoint over few tuples is all rounds and no work: each round of Spark jobs costs a good part of a
second, however little it derives. Where the tuples that a component begins with and reads are few,
counted first, its rounds run here, on hash indexes. If it derives more than it may, the caller runs the
rounds as Spark jobs instead; the answers are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from strataflow.plans.tree import Atom, Compare, Const, Rule, Var, Wild

#: Tuples that a component may begin with and read, and derive.
READ = 50_000
DERIVED = 300_000


class Table:
    """Tuples with an index for every set of places that a rule looks up."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows: list[tuple] = []
        self.indexes: dict[tuple[int, ...], dict[tuple, list[tuple]]] = {}
        self.extend(rows)

    def extend(self, rows: list[tuple]) -> None:
        self.rows += rows
        for places, index in self.indexes.items():
            for t in rows:
                index.setdefault(tuple(t[i] for i in places), []).append(t)

    def at(self, places: tuple[int, ...], key: tuple) -> list[tuple]:
        if not places:
            return self.rows
        if places not in self.indexes:
            index = self.indexes[places] = {}
            for t in self.rows:
                index.setdefault(tuple(t[i] for i in places), []).append(t)
        return self.indexes[places].get(key, [])


def holds(op: str, a: object, b: object) -> bool:
    number = isinstance(a, (int, float)), isinstance(b, (int, float))
    if op in ("=", "!="):
        return (a == b and number[0] == number[1]) == (op == "=")
    if a is None or b is None or number[0] != number[1]:
        return False
    return a < b if op == "<" else a <= b if op == "<=" else a > b if op == ">" else a >= b  # type: ignore[operator]


def fits(rules: list[Rule]) -> bool:
    """Whether rules are of plain atoms and comparisons of variables and constants."""
    plain = lambda t: isinstance(t, (Var, Const)) and not getattr(t, "unit", "")
    for r in rules:
        if not all(plain(a) for a in r.args):
            return False
        for x in r.body:
            if isinstance(x, Compare):
                if not plain(x.left) or not plain(x.right):
                    return False
            elif not isinstance(x, Atom) or x.fact or x.rel.startswith("graph.") or any(not isinstance(a, (Var, Const, Wild)) for a in x.args):
                return False
    return True


def ordered(r: Rule, first: int) -> list:
    """The body with one atom first, then what is bound most; comparisons as soon as they can be made."""
    rest = [x for i, x in enumerate(r.body) if i != first]
    out, bound = [r.body[first]], {a.name for a in r.body[first].args if isinstance(a, Var)}
    while rest:

        def cost(x: object) -> tuple:
            if isinstance(x, Compare):
                return (0 if {t.name for t in (x.left, x.right) if isinstance(t, Var)} <= bound else 9, 0)
            known = sum(isinstance(a, Const) or (isinstance(a, Var) and a.name in bound) for a in x.args)
            return (1, -known)

        x = min(rest, key=cost)
        rest.remove(x)
        out.append(x)
        if isinstance(x, Atom):
            bound |= {a.name for a in x.args if isinstance(a, Var)}
    return out


def bindings(body: list, at: int, env: dict, tables: dict[str, Table], delta: list[tuple] | None) -> Iterator[dict]:
    if at == len(body):
        yield env
        return
    x = body[at]
    if isinstance(x, Compare):
        a, b = (env[t.name] if isinstance(t, Var) else t.value for t in (x.left, x.right))
        if holds(x.op, a, b):
            yield from bindings(body, at + 1, env, tables, None)
        return
    known = [(i, env[a.name] if isinstance(a, Var) else a.value) for i, a in enumerate(x.args) if isinstance(a, Const) or (isinstance(a, Var) and a.name in env)]
    if delta is not None:
        rows = [t for t in delta if all(same(t[i], v) for i, v in known)]
    else:
        rows = [t for t in tables[x.rel].at(tuple(i for i, _ in known), tuple(v for _, v in known)) if all(same(t[i], v) for i, v in known)]
    for t in rows:
        out = dict(env)
        for i, a in enumerate(x.args):
            if isinstance(a, Var) and not same(out.setdefault(a.name, t[i]), t[i]):
                break
        else:
            yield from bindings(body, at + 1, out, tables, None)


def same(a: object, b: object) -> bool:
    return a == b and isinstance(a, str) == isinstance(b, str)


def fixpoint(component: list[str], loops: dict[str, list[Rule]], start: dict[str, list[tuple]], read: dict[str, list[tuple]], rounds: int, derived: int = DERIVED, most: int | None = None) -> dict[str, list[tuple]] | None:
    """All tuples of the component's relations; None if there are more than `derived`, more than `most` are new, or more rounds are needed."""
    tables = {n: Table(list(dict.fromkeys(rows))) for n, rows in (read | start).items()}
    seen = {n: set(tables[n].rows) for n in component}
    delta = {n: list(tables[n].rows) for n in component}
    plans = [(n, r, ordered(r, i), r.body[i].rel) for n in component for r in loops[n] for i, x in enumerate(r.body) if isinstance(x, Atom) and x.rel in component]
    new = 0
    while any(delta.values()):
        if (rounds := rounds - 1) < 0:
            return None
        fresh: dict[str, list[tuple]] = {n: [] for n in component}
        for n, r, body, source in plans:
            if not delta[source]:
                continue
            for env in bindings(body, 0, {}, tables, delta[source]):
                t = tuple(env[a.name] if isinstance(a, Var) else a.value for a in r.args)
                if t not in seen[n]:
                    seen[n].add(t)
                    fresh[n].append(t)
            if sum(map(len, seen.values())) > derived:
                return None
        new += sum(map(len, fresh.values()))
        if most is not None and new > most:
            return None
        for n in component:
            tables[n].extend(fresh[n])
        delta = fresh
    return {n: tables[n].rows for n in component}
