"""A small evaluator in plain Python: the meaning of programs on a handful of rows.

Tests hold the Spark engine against it, and derivations of returned rows are told by it. Values are None
for absent, floats for numbers and text. It is complete for atoms, negation, comparisons, arithmetic,
braces, recursion and the answer's grouping; of the predicates it knows a few.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from strataflow.plans import rewrite
from strataflow.plans.tree import Agg, Atom, Call, Compare, Const, Either, Maybe, Not, Op, Query, Reduce, Rule, Var, Wild, body_vars, expr_vars

Env = dict[str, object]
PREDICATES: dict[str, Callable] = {
    "str.contains": lambda a, b: (b or "") in (a or ""),
    "str.prefix": lambda a, b: (a or "").startswith(b or ""),
    "str.suffix": lambda a, b: (a or "").endswith(b or ""),
    "absent": lambda a: a is None,
}


def num(x: object) -> object:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rank(x: object) -> tuple:
    return (0,) if x is None else (1, x) if isinstance(x, float) else (2, x)


def less(op: str, a: object, b: object) -> bool:
    if op == "=":
        return type(a) is type(b) and a == b
    if op == "!=":
        return not less("=", a, b)
    if a is None or b is None or type(a) is not type(b):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]  # type: ignore[operator]


@dataclass(frozen=True)
class Derivation:
    """How a tuple came about: a base fact, or a rule with the derivations of its positive atoms and what it found absent."""

    rel: str
    values: tuple
    rule: Rule | None = None
    parts: tuple = ()
    absent: tuple = ()
    id: str = ""  # of a base fact, where it has one

    @property
    def height(self) -> int:
        return 1 + max((p.height for p in self.parts), default=0) if self.rule else 0

    def leaves(self) -> set[str]:
        if self.rule is None:
            return {self.id or f"{self.rel}({', '.join(json.dumps(int(v) if isinstance(v, float) and v.is_integer() else v) for v in self.values)})"}
        return set().union(*[p.leaves() for p in self.parts]) if self.parts else set()


class Naive:
    """Base relations are lists of tuples. Rules are run to a fixpoint, a component at a time."""

    def __init__(self, facts: dict[str, list[tuple]], rules: tuple[Rule, ...] = (), ids: dict[tuple, str] | None = None) -> None:
        self.ids = {(n, tuple(map(num, t))): i for (n, t), i in (ids or {}).items()}
        self.facts = {n: [tuple(map(num, t)) for t in rows] for n, rows in facts.items()}
        self.rules: dict[str, list[Rule]] = {}
        for r in rules:
            self.rules.setdefault(r.rel, []).append(r)
        self.derived: dict[str, dict[tuple, Derivation]] = {n: {} for n in self.rules}
        for group in rewrite.components(self.rules):
            again = True
            while again:
                again = False
                for n in group:
                    for r in self.rules[n]:
                        for values, d in list(self.apply(r)):
                            old = self.derived[n].get(values)
                            if old is None or d.height < old.height:
                                again = True
                                self.derived[n][values] = d

    def rows(self, rel: str) -> Iterator[tuple[tuple, Derivation]]:
        if rel in self.rules:
            yield from list(self.derived[rel].items())
        else:
            for t in self.facts[rel]:
                yield t, Derivation(rel, t, id=self.ids.get((rel, t), ""))

    def apply(self, r: Rule) -> Iterator[tuple[tuple, Derivation]]:
        envs = list(self.solve(r.body, {}))
        if any(isinstance(a, Agg) for a in r.args):
            for values in self.grouped(r.args, [e for e, *_ in envs]):
                yield values, Derivation(r.rel, values, r)
            return
        for env, parts, absent in envs:
            values = tuple(self.value(a, env) for a in r.args)
            if not any(isinstance(a, (Op, Call)) and v is None for a, v in zip(r.args, values, strict=True)):
                yield values, Derivation(r.rel, values, r, parts, absent)

    def value(self, e: object, env: Env) -> object:
        if isinstance(e, Var):
            return env[e.name]
        if isinstance(e, Const):
            return num(e.value)
        if isinstance(e, Op):
            args = [self.value(a, env) for a in e.args]
            if any(not isinstance(a, float) for a in args):
                return None
            if e.name == "neg":
                return -args[0]
            a, b = args
            return a + b if e.name == "+" else a - b if e.name == "-" else a * b if e.name == "*" else a / b if b else None
        raise NotImplementedError(e)

    def solve(self, body: tuple, env: Env) -> Iterator[tuple[Env, tuple, tuple]]:
        """Bindings with the derivations used and the atoms found absent; literals run once they can."""
        rest = list(body)
        x = next((y for y in rest if self.ready(y, env, rest)), None)
        if x is None:
            if not rest:
                yield env, (), ()
            else:
                raise ValueError(f"unbound: {rest[0]}")
            return
        rest.remove(x)
        for env2, used, absent in self.step(x, env):
            for env3, more, gone in self.solve(tuple(rest), env2):
                yield env3, used + more, absent + gone

    def ready(self, x: object, env: Env, rest: list) -> bool:
        names = set(body_vars((x,)))
        others = [y for y in rest if y is not x]
        if isinstance(x, Compare):
            loose = [v for v in names if v not in env]
            waits = any(isinstance(y, (Atom, Maybe, Reduce)) and set(loose) & set(body_vars((y,))) for y in others if not (isinstance(y, Atom) and y.rel in PREDICATES))
            return not loose or (x.op == "=" and len(loose) == 1 and not waits and any(isinstance(a, Var) and a.name == loose[0] and not isinstance(b, Var) for a, b in ((x.left, x.right), (x.right, x.left))))
        if isinstance(x, Atom):
            return x.rel not in PREDICATES or names <= set(env)
        if isinstance(x, Not):
            return not any(isinstance(y, (Atom, Maybe, Reduce, Compare)) for y in others)
        return not any(isinstance(y, Atom) and y.rel not in PREDICATES for y in others)

    def match(self, a: Atom, env: Env) -> Iterator[tuple[Env, Derivation]]:
        for values, d in self.rows(a.rel):
            out = dict(env)
            for t, v in zip(a.args, values, strict=True):
                if isinstance(t, Wild):
                    continue
                if isinstance(t, Var) and t.name not in out:
                    out[t.name] = v
                elif not less("=", self.value(t, out), v):
                    break
            else:
                yield out, d

    def step(self, x: object, env: Env) -> Iterator[tuple[Env, tuple, tuple]]:
        if isinstance(x, Atom) and x.rel in PREDICATES:
            if PREDICATES[x.rel](*[self.value(a, env) for a in x.args]):
                yield env, (), ()
        elif isinstance(x, Atom):
            for out, d in self.match(x, env):
                yield out, (d,), ()
        elif isinstance(x, Not) and x.atom.rel in PREDICATES:
            if not PREDICATES[x.atom.rel](*[self.value(a, env) for a in x.atom.args]):
                yield env, (), ()
        elif isinstance(x, Not):
            if next(self.match(x.atom, env), None) is None:
                yield env, (), (x.atom,)
        elif isinstance(x, Compare):
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if isinstance(a, Var) and a.name not in env:
                    v = self.value(b, env)
                    if v is not None or isinstance(b, Const):
                        yield {**env, a.name: v}, (), ()
                    return
            a, b = self.value(x.left, env), self.value(x.right, env)
            computed = any(isinstance(e, Op) and v is None for e, v in ((x.left, a), (x.right, b)))
            if not computed and less(x.op, a, b):
                yield env, (), ()
        elif isinstance(x, Reduce):
            shared = {n: env[n] for n in body_vars(x.body) if n in env}
            found = [e for e, *_ in self.solve(x.body, shared)]
            yield {**env, x.var: reduced(x.agg, found)}, (), ()
        elif isinstance(x, Maybe):
            names = list(dict.fromkeys(body_vars(x.body)))
            shared = {n: env[n] for n in names if n in env}
            found = {tuple(e[n] for n in names): p for e, p, _ in self.solve(x.body, shared)}
            for values, used in found.items() or [(tuple(env.get(n) for n in names), ())]:
                yield {**env, **dict(zip(names, values, strict=True))}, used, ()
        elif isinstance(x, Either) and any(next(self.solve(b, dict(env)), None) is not None for b in x.branches):
            yield env, (), ()

    def grouped(self, items: tuple, envs: list[Env]) -> Iterator[tuple]:
        groups: dict[tuple, list[Env]] = {}
        plain = [i for i in items if not isinstance(i, Agg)]
        for e in envs:
            groups.setdefault(tuple(self.value(p, e) for p in plain), []).append(e)
        if not plain and not groups:
            groups[()] = []
        for k, rows in groups.items():
            it = iter(k)
            yield tuple(reduced(i, rows) if isinstance(i, Agg) else next(it) for i in items)

    def answer(self, q: Query) -> list[tuple]:
        """The rows of a query over these rules, in order."""
        names = list(dict.fromkeys(body_vars(q.goal)))
        items = tuple(c.item for c in q.select) if q.select is not None else tuple(Var(n) for n in names)
        envs = []
        for e, *_ in self.solve(q.goal, {}):
            if all(self.value(i, e) is not None for i in items if isinstance(i, Op)):
                envs.append(e)
        wanted = (*items, *[a for a, _, _ in q.having])
        if any(isinstance(i, Agg) for i in wanted):
            rows = set()
            for values in self.grouped(wanted, envs):
                extra = values[len(items) :]
                if all(less(op, v, self.value(t, {}) if isinstance(t, Const) else values[items.index(t)]) for v, (_, op, t) in zip(extra, q.having, strict=True)):
                    rows.add(values[: len(items)])
        else:
            rows = {tuple(self.value(i, e) for i in items) for e in envs}
        out = sorted(rows, key=lambda r: tuple(map(rank, r)))
        for item, down in reversed(q.order):
            out.sort(key=lambda r: rank(r[items.index(item)]), reverse=down)  # noqa: B023
        out = out[q.offset :]
        return out[: q.limit] if q.limit is not None else out

    def why(self, q: Query, row: tuple) -> list[Derivation]:
        """The derivations of one answer row: of the first binding that gives it, in the order of the goal's atoms."""
        items = tuple(c.item for c in q.select) if q.select is not None else tuple(Var(n) for n in dict.fromkeys(body_vars(q.goal)))
        want = tuple(map(num, row))
        best: tuple | None = None
        for e, used, _ in self.solve(q.goal, {}):
            if tuple(self.value(i, e) for i in items if not isinstance(i, Agg)) == want:
                key = sum(d.height for d in used)
                if best is None or key < best[0]:
                    best = (key, used)
        return list(best[1]) if best else []


def reduced(agg: Agg, envs: list[Env]) -> object:
    values = [e[agg.var] for e in envs]
    if agg.func == "count":
        return float(len({v for v in values if v is not None and v != ""}) if agg.distinct else len(values))
    if agg.func == "list":
        found = sorted({v for v in values if v is not None} if agg.distinct else [v for v in values if v is not None], key=rank)
        return json.dumps([int(v) if isinstance(v, float) and v.is_integer() else v for v in found], separators=(",", ":"), ensure_ascii=False)
    numbers = [v for v in values if isinstance(v, float)]
    numbers = list(set(numbers)) if agg.distinct else numbers
    if agg.func == "sum":
        return float(sum(numbers))
    if not numbers:
        return None
    return {"min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[agg.func](numbers)


__all__ = ["Derivation", "Naive", "expr_vars"]
