"""Bodies, rules and relations to DataFrames.

A body becomes one plan: atoms are scans with their constants as filters, shared variables are
equi-joins, comparisons are filters, braces are aggregates or distinct sets joined on what they share,
negation is an anti join. Catalyst orders and pushes the rest. Bindings form a bag; sets are made
where the language has them, at rule heads and at the answer, and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow import values as V
from strataflow.errors import CheckError, suggestion
from strataflow.functions import registry
from strataflow.limits import Limits
from strataflow.operators import aggregates, kernel, walks
from strataflow.plans import rewrite
from strataflow.plans.text import show
from strataflow.plans.tree import Agg, Atom, Call, Compare, Const, Either, Maybe, Not, Op, Reduce, Rule, Var, Wild, atoms, body_vars, expr_vars, literal_vars, map_terms
from strataflow.sources.catalog import Catalog, Relation
from strataflow.sources.storage import write
from strataflow.values import Kind, Val

CITES = "__cites"
#: What a tuple carries when citations are asked for: the height of its derivation, the rule's text and the citations.
#: Of several derivations the least is kept, so the shortest. A fixpoint's rounds find heights in order.
CITE_TYPE = "struct<h:int,r:string,c:array<string>>"
#: Functions whose result may be absent.
MAY_BE_ABSENT = ("coalesce", "num.unit")


@dataclass
class Rel:
    """A relation's tuples: columns a0, a1, ... and, when asked for, __cites."""

    df: DataFrame
    kinds: list[Kind]


@dataclass
class Frame:
    """Bindings: a column v_x for each bound variable x."""

    df: DataFrame
    kinds: dict[str, Kind]

    def val(self, name: str) -> Val:
        return Val(F.col(f"`v_{name}`"), self.kinds[name])


class Compiler:
    def __init__(self, catalog: Catalog, rules: tuple[Rule, ...], cites: bool = False, at: int | None = None, versions: list[int] | None = None, limits: Limits | None = None) -> None:
        self.catalog, self.cites, self.at, self.versions = catalog, cites, at, versions
        self.limits = limits or Limits()
        self.rules: dict[str, list[Rule]] = {}
        for r in rules:
            self.rules.setdefault(r.rel, []).append(r)
        self.done: dict[str, Rel] = {}
        self.order = rewrite.components(self.rules)
        self.group = {n: c for c in self.order for n in c}
        self.fresh = 0

    # relations

    def relation(self, name: str) -> Rel:
        if name in self.done:
            return self.done[name]
        if name in self.rules:
            self.derive(self.group[name])
        elif name in self.catalog.relations:
            rel = self.base(name, self.catalog.relations[name])
            if self.catalog.relations[name].reload:
                return rel
            self.done[name] = rel
        else:
            raise CheckError("unknown", f"no relation {name}{suggestion(name, [*self.rules, *self.catalog.names()])}")
        return self.done[name]

    def base(self, name: str, r: Relation) -> Rel:
        df = r.reload() if r.reload else r.df
        labels, kinds = r.labels, r.kinds
        if "__versions" in df.columns:
            inside = lambda v: F.exists("__versions", lambda x: (x["from"] <= v) & (v < x["to"]))
            if self.at is not None:
                df = df.where(inside(F.lit(self.at)))
            elif self.versions is not None:
                df = df.withColumn("~v", F.explode(F.filter(F.array(*map(F.lit, self.versions)), inside)))
                labels, kinds = [*labels, "~v"], [*kinds, Kind("num", "", False, True)]
        cols = [F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(labels)]
        if self.cites:
            own = F.col(CITES) if CITES in df.columns else F.array().cast("array<string>")
            cols.append(cited(F.coalesce(own, F.array().cast("array<string>"))).alias(CITES))
        cols.append(F.col("__id").cast("string").alias("__id") if "__id" in df.columns else F.lit(None).cast("string").alias("__id"))
        return Rel(df.select(*cols), kinds)

    def derive(self, component: list[str]) -> None:
        if not rewrite.recursive(component, self.rules):
            name = component[0]
            self.done[name] = self.union([self.head(r) for r in self.rules[name]])
            return
        for n in component:
            for r in self.rules[n]:
                if any(isinstance(a, Agg) for a in r.args) or any(m in component and strict for m, strict in rewrite.reads(r.body)):
                    raise CheckError("recursion", f"{n} reads itself through negation, an aggregate, an optional or a walk")
                self.refuse_computed(r, component)
        if len(component) == 1 and not self.cites and self.versions is None and (step := rewrite.closure_step(component[0], self.rules)):
            self.done[component[0]] = self.closed(self.rules[component[0]], step, component[0])
            return
        self.fixpoint(component)

    def refuse_computed(self, r: Rule, component: list[str]) -> None:
        computed = {a.name for x in r.body if isinstance(x, Compare) and x.op == "=" for a, b in ((x.left, x.right), (x.right, x.left)) if isinstance(a, Var) and isinstance(b, (Op, Call)) and any(n in component for n, _ in rewrite.reads(r.body))}
        bound = {v for x in r.body if isinstance(x, Atom) for v in literal_vars(x)}
        if any(isinstance(a, (Op, Call)) or (isinstance(a, Var) and a.name in computed - bound) for a in r.args):
            raise CheckError("recursion", f"{r.rel} computes a value that it reads again")

    def closed(self, rules: list[Rule], step: Atom, name: str, start: Const | None = None, end: Const | None = None) -> Rel:
        a = next(r for r in rules if not any(n == name for n, _ in rewrite.reads(r.body))).args
        ends = {k: V.constant(c.value).col for k, c in (("start", start), ("end", end)) if c is not None}
        if (pairs := rewrite.paired_step(step, self.rules)) and (linked := self.links(*pairs)):
            out = walks.together(linked[0], limits=self.limits, **ends)
            return Rel(out.select(F.col("f").alias("a0"), F.col("t").alias("a1")), [linked[1], linked[1]])
        f = self.body((step,))
        edges = f.df.select(f.val(a[0].name).col.alias("f"), f.val(a[1].name).col.alias("t"))
        out = walks.closure(edges, 1, 0, limits=self.limits, **ends)
        return Rel(out.select(F.col("f").alias("a0"), F.col("t").alias("a1")), [f.kinds[a[0].name], f.kinds[a[1].name]])

    def links(self, member: Atom, x: Var, apart: bool) -> tuple[DataFrame, Kind] | None:
        """Each member of a group with the group's least, which connects what all pairs of members connect; with `apart`, of groups
        with two members at least. Nothing where values may be absent or may have an equality of their own."""
        if self.computed(member):
            return None
        f = self.body((member,))
        kind, names = f.kinds[x.name], [n for n in f.kinds if n != x.name]
        if kind.nullable or not all(k.name == "text" or k.whole for k in f.kinds.values()):
            return None
        members = f.df.select(f.val(x.name).col.alias("f"), *[f.val(n).col.alias(f"g{i}") for i, n in enumerate(names)])
        groups = members.groupBy(*[F.col(f"g{i}").alias(f"h{i}") for i in range(len(names))]).agg(F.min("f").alias("t"), F.max("f").alias("most"))
        groups = groups.where("t != most") if apart else groups
        on = [V.same(Val(F.col(f"g{i}"), f.kinds[n]), Val(F.col(f"h{i}"), f.kinds[n])) for i, n in enumerate(names)]
        linked = members.join(groups, V.all_of(on)) if on else members.crossJoin(groups)
        return linked.where("f is not null").select("f", "t").distinct(), kind

    def union(self, parts: list[Rel]) -> Rel:
        kinds = [V.common([p.kinds[i] for p in parts]) for i in range(len(parts[0].kinds))]
        if len({len(p.kinds) for p in parts}) > 1:
            raise CheckError("arity", "a relation's rules have different numbers of arguments")
        df = reduce(lambda x, y: x.union(y), [self.cast(p, kinds).df for p in parts])
        return Rel(self.set(df, kinds), kinds)

    def cast(self, p: Rel, kinds: list[Kind]) -> Rel:
        cols = [V.held(Val(F.col(f"a{i}"), k), want).alias(f"a{i}") for i, (k, want) in enumerate(zip(p.kinds, kinds, strict=True))]
        return Rel(p.df.select(*cols, *([CITES] if self.cites else [])), kinds)

    def set(self, df: DataFrame, kinds: list[Kind]) -> DataFrame:
        names = [f"a{i}" for i in range(len(kinds))]
        if self.cites:
            keys = [V.key(Val(F.col(n), k)).alias(f"k{i}") for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
            return df.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names], F.min(CITES).alias(CITES)).select(*names, CITES) if names else df.limit(1)
        return distinct(df, names, kinds) if names else df.limit(1)

    def head(self, r: Rule, swap: dict[int, Rel] | None = None) -> Rel:
        """The tuples of one rule, as a bag unless it aggregates."""
        if not r.body:
            one = self.catalog.spark.range(1)
            if self.cites:
                one = one.withColumn(CITES, cited())
            vals = [V.constant(a.value, a.unit) if isinstance(a, Const) else self.bad_head(r) for a in r.args]
            return Rel(one.select(*[v.col.alias(f"a{i}") for i, v in enumerate(vals)], *([CITES] if self.cites else [])), [v.kind for v in vals])
        body, args = list(r.body), []
        for i, a in enumerate(r.args):
            if isinstance(a, Wild):
                self.bad_head(r)
            if isinstance(a, (Op, Call)):
                body.append(Compare("=", Var(f"~h{i}"), a))
                a = Var(f"~h{i}")
            args.append(a)
        f = self.body(tuple(body), swap=swap)
        for a in args:
            if isinstance(a, (Var, Agg)) and (a.name if isinstance(a, Var) else a.var) not in f.kinds:
                raise CheckError("unbound", f"{r.rel}: ?{a.name if isinstance(a, Var) else a.var} is bound by nothing")
        if any(isinstance(a, Agg) for a in args):
            if len(self.rules[r.rel]) > 1:
                raise CheckError("aggregate", f"{r.rel} aggregates, so it can have one rule only")
            made = self.grouped(f, args)
            return Rel(made.df.withColumn(CITES, derived(r)), made.kinds) if self.cites else made
        vals = [f.val(a.name) if isinstance(a, Var) else V.constant(a.value, a.unit) for a in args]
        return Rel(f.df.select(*[v.col.alias(f"a{i}") for i, v in enumerate(vals)], *([derived(r).alias(CITES)] if self.cites else [])), [v.kind for v in vals])

    def bad_head(self, r: Rule):
        raise CheckError("unbound", f"{r.rel}: a head's arguments are variables that the body binds, constants or aggregates")

    def grouped(self, f: Frame, items: list, reasons: bool = False) -> Rel:
        """One row for each value of the plain items, the others reduced; one row over nothing where all are reduced.
        With reasons, column w{i} says why item i is absent."""
        plain = [(i, f.val(a.name) if isinstance(a, Var) else V.constant(a.value, a.unit)) for i, a in enumerate(items) if not isinstance(a, Agg)]
        made = [(i, aggregates.reduced(a.func, a.distinct, f.val(a.var))) for i, a in enumerate(items) if isinstance(a, Agg)]
        aggs = [v.col.alias(f"a{i}") for i, v in made]
        aggs += [F.first(v.col).alias(f"a{i}") for i, v in plain if v.kind.name == "any"]
        told = [f"w{i}" for i, a in enumerate(items) if isinstance(a, Agg)] if reasons else []
        aggs += [aggregates.reason(a.func, f.val(a.var)).alias(f"w{i}") for i, a in enumerate(items) if reasons and isinstance(a, Agg)]
        if self.cites:
            aggs.append(gathered().alias(CITES))
        keys = [V.key(v).alias(f"k{i}" if v.kind.name == "any" else f"a{i}") for i, v in plain]
        df = f.df.groupBy(*keys).agg(*aggs) if keys else f.df.agg(*aggs)
        kinds = {i: v.kind for i, v in [*plain, *made]}
        return Rel(df.select(*[f"a{i}" for i in range(len(items))], *told, *([CITES] if self.cites else [])), [kinds[i] for i in range(len(items))])

    def fixpoint(self, component: list[str]) -> None:
        """Semi-naive rounds: a rule reads the last round's new tuples at one recursive atom, all tuples at the others.

        What a round adds is written to the shared folder; all tuples so far are one scan of these files,
        so plans stay the same size however many rounds there are.
        """
        exits = {n: [r for r in self.rules[n] if not any(m in component for m, _ in rewrite.reads(r.body))] for n in component}
        loops = {n: [r for r in self.rules[n] if r not in exits[n]] for n in component}
        first: dict[str, Rel | None] = {n: self.union([self.head(r) for r in exits[n]]) if exits[n] else None for n in component}
        kinds = self.settled(component, first, loops)
        spark = self.catalog.spark
        if self.in_memory(component, first, loops, kinds):
            return
        paths: dict[str, list[str]] = {n: [] for n in component}
        schema, delta, total = {}, {}, {}
        for n in component:
            start = self.cast(first[n], kinds[n]).df if first[n] else self.empty(kinds[n])
            start = self.plain(start, kinds[n])
            paths[n].append(write(start, "start"))
            schema[n] = start.schema
            delta[n] = total[n] = spark.read.schema(schema[n]).parquet(paths[n][0])
        live = {n for n in component if first[n]}
        rounds = rows = 0
        while live:
            rounds += 1
            self.limits.round(rounds, f"{component}")
            found: dict[str, list[Rel]] = {n: [] for n in component}
            for n in component:
                for r in loops[n]:
                    places = [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.rel in component]
                    for p in places:
                        if (rel := r.body[p].rel) in live:
                            swap = {i: Rel(delta[rel] if i == p else total[r.body[i].rel], kinds[r.body[i].rel]) for i in places}
                            found[n].append(self.head(r, swap))
            fresh = {}
            for n, parts in found.items():
                if parts:
                    new = self.plain(self.union([self.cast(p, kinds[n]) for p in parts]).df, kinds[n])
                    old = total[n].select(*[F.col(f"a{i}").alias(f"o{i}") for i in range(len(kinds[n]))])
                    on = [V.same(Val(F.col(f"a{i}"), k), Val(F.col(f"o{i}"), k)) for i, k in enumerate(kinds[n])]
                    fresh[n] = write(new.join(old, V.all_of(on), "left_anti") if on else new.limit(0), "delta")
            live = set()
            for n, path in fresh.items():
                delta[n] = spark.read.schema(schema[n]).parquet(path)
                if count := delta[n].count():
                    live.add(n)
                    rows += count
                    paths[n].append(path)
            self.limits.total(rows, f"{component}")
            for n in component:
                total[n] = spark.read.schema(schema[n]).parquet(*paths[n])
                if n not in live:
                    delta[n] = total[n].limit(0)
        for n in component:
            self.done[n] = Rel(total[n], kinds[n])

    def in_memory(self, component: list[str], first: dict[str, Rel | None], loops: dict[str, list[Rule]], kinds: dict[str, list[Kind]]) -> bool:
        """Runs a small component's rounds on the driver, if it is one; see operators.kernel."""
        rules = [r for n in component for r in loops[n]]
        simple = lambda ks: all(k.name in ("num", "text") and not k.unit for k in ks)
        if self.cites or self.versions is not None or not kernel.fits(rules) or not all(simple(k) for k in kinds.values()):
            return False
        outside = {x.rel for r in rules for x in r.body if isinstance(x, Atom) and x.rel not in component}
        if any(n in self.catalog.predicates or not simple(self.relation(n).kinds) for n in outside):
            return False
        left, found = kernel.READ if self.limits.tuples is None else self.limits.tuples, {}
        if not left:
            return False
        parts = [(n, self.plain(self.cast(first[n], kinds[n]).df, kinds[n])) for n in component if first[n]] + [(n, self.relation(n).df.select(*[f"a{i}" for i in range(len(self.relation(n).kinds))])) for n in sorted(outside)]
        for n, df in parts:
            found[n] = [tuple(t) for t in df.limit(left + 1).collect()]  # never more than READ tuples in all
            left -= len(found[n])
            if left < 0 or any(v != v for t in found[n] for v in t):  # NaN has an equality of its own
                return False
        start = {n: found.get(n, []) for n in component}
        done = kernel.fixpoint(component, loops, start, {n: found[n] for n in outside}, self.limits.rounds, most=self.limits.rows)
        if done is None:
            return False
        for n in component:
            schema = self.empty(kinds[n]).schema
            columns = [pa.array([None if t[i] is None else float(t[i]) if f.dataType.typeName() == "double" else t[i] for t in done[n]], pa_type(f.dataType.typeName())) for i, f in enumerate(schema)]
            self.done[n] = Rel(self.catalog.spark.createDataFrame(pa.table(columns, names=schema.names)), kinds[n])
        return True

    def plain(self, df: DataFrame, kinds: list[Kind]) -> DataFrame:
        """Number columns as long or double, so that every round writes one schema."""
        cols = [F.col(f"a{i}").cast("bigint" if k.whole else "double").alias(f"a{i}") if k.name == "num" else F.col(f"a{i}") for i, k in enumerate(kinds)]
        return df.select(*cols, *([CITES] if self.cites else []))

    def empty(self, kinds: list[Kind]) -> DataFrame:
        ddl = {"num": "double", "text": "string", "any": V.BOX}
        fields = [f"a{i} {'bigint' if k.whole else ddl.get(k.name, k.name)}" for i, k in enumerate(kinds)] + [f"{CITES} {CITE_TYPE}"] * self.cites
        return self.catalog.spark.createDataFrame([], ", ".join(fields))

    def settled(self, component: list[str], first: dict[str, Rel | None], loops: dict[str, list[Rule]]) -> dict[str, list[Kind]]:
        """Kinds that hold for every round, found by compiling the recursive rules without running them."""
        kinds = {n: [k.may for k in r.kinds] if r else None for n, r in first.items()}
        for _ in range(3 * len(component) + 3):
            before = dict(kinds)
            for n in component:
                for r in loops[n]:
                    places = [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.rel in component]
                    if any(kinds[r.body[i].rel] is None for i in places):
                        continue
                    got = self.head(r, {i: Rel(self.empty(kinds[r.body[i].rel]), kinds[r.body[i].rel]) for i in places}).kinds
                    kinds[n] = [V.common([a, b]).may for a, b in zip(kinds[n], got, strict=True)] if kinds[n] else [k.may for k in got]
            if kinds == before:
                break
        for n in component:
            if kinds[n] is None:
                raise CheckError("recursion", f"{n} has no rule to begin with")
        return kinds

    # bodies

    def unit(self) -> Frame:
        df = self.catalog.spark.range(1).select(F.lit(1).alias("~one"))
        return Frame(df.withColumn(CITES, cited()) if self.cites else df, {})

    def body(self, literals: tuple, seed: Frame | None = None, swap: dict[int, Rel] | None = None) -> Frame:
        pending = [(x, (swap or {}).get(i)) for i, x in enumerate(literals)]
        fixed: dict[str, Const] = {}
        for x, _ in pending:
            if isinstance(x, Compare) and x.op == "=":
                for a, b in ((x.left, x.right), (x.right, x.left)):
                    if isinstance(a, Var) and isinstance(b, Const) and a.name not in fixed and not (seed and a.name in seed.kinds):
                        fixed[a.name] = b
                        pending = [p for p in pending if p[0] is not x]
        if fixed:
            put = lambda t: fixed.get(t.name, t) if isinstance(t, Var) else t
            pending = [(map_terms(x, put) if not isinstance(x, Reduce) or x.var not in fixed else x, s) for x, s in pending]
        pending = [(self.filled(y), s) for x, s in pending for y, s in self.without_calls(x, s)]
        f = seed
        while pending:
            i = self.choose(f, pending)
            x, given = pending.pop(i)
            f = self.step(f, x, given, [y for y, _ in pending])
        f = f or self.unit()
        for name, c in fixed.items():
            v = V.constant(c.value, c.unit)
            f = Frame(f.df.withColumn(f"v_{name}", v.col), {**f.kinds, name: v.kind})
        return f

    def filled(self, x: object) -> object:
        """A predicate's atom with the trailing arguments that it may leave out."""
        a = x.atom if isinstance(x, Not) else x
        p = self.catalog.predicates.get(a.rel) if isinstance(a, Atom) else None
        if p is None or p.least is None or not p.least <= len(a.args) < p.arity:
            return x
        a = replace(a, args=(*a.args, *[Wild()] * (p.arity - len(a.args))))
        return Not(a) if isinstance(x, Not) else a

    def without_calls(self, x: object, s: Rel | None) -> list:
        """Calls of relations other than predicates, taken out of comparisons as atoms."""
        extra: list = []

        def walk(e: object) -> object:
            if isinstance(e, (Op, Call)):
                e = replace(e, args=tuple(walk(a) for a in e.args))
            if isinstance(e, Call) and e.name not in self.catalog.predicates:
                self.fresh += 1
                extra.append((Atom(e.name, (*e.args, Var(f"~c{self.fresh}"))), None))
                return Var(f"~c{self.fresh}")
            return e

        if isinstance(x, Compare):
            x = Compare(x.op, walk(x.left), walk(x.right))
        return [*extra, (x, s)]

    def choose(self, f: Frame | None, pending: list) -> int:
        """The next literal that can run: filters and functions first, then atoms that share a variable, braces, negation."""
        bound = set(f.kinds) if f else set()
        best, cost = None, None
        more_atoms = any(isinstance(x, Atom) and not self.computed(x) for x, _ in pending)
        for i, (x, _) in enumerate(pending):
            names = set(literal_vars(x))
            if isinstance(x, Compare):
                c = 0 if names <= bound else 1 if self.solvable(x, bound) and not (more_atoms and self.bindable_later(x, bound, pending)) else None
            elif isinstance(x, Atom) and self.computed(x):
                c = self.predicate_cost(x, bound)
            elif isinstance(x, Atom):
                r = self.catalog.relations.get(x.rel)
                c = 3.5 if f is None and r and r.store and r.store.keys else 3 if f is None else 2 if names & bound else 5 if bound else 4
            elif isinstance(x, Not):
                c = 9 if not more_atoms and not self.pending_binders(pending, i) else None
            elif isinstance(x, Either):
                c = 8 if not more_atoms else None
            else:
                c = 7 if not more_atoms else None
            if c is not None and (cost is None or c < cost):
                best, cost = i, c
        if best is None:
            x = pending[0][0]
            loose = sorted(set(literal_vars(x)) - bound)
            raise CheckError("unbound", f"nothing binds {', '.join('?' + n for n in loose) or 'what it needs'} in {x}")
        return best

    def pending_binders(self, pending: list, at: int) -> bool:
        return any(isinstance(x, (Reduce, Maybe)) or (isinstance(x, Atom) and self.computed(x)) or (isinstance(x, Compare)) for i, (x, _) in enumerate(pending) if i != at)

    def computed(self, a: Atom) -> bool:
        return a.rel in self.catalog.predicates or a.rel.startswith("graph.")

    def solvable(self, x: Compare, bound: set[str]) -> bool:
        if x.op != "=":
            return False
        for a, b in ((x.left, x.right), (x.right, x.left)):
            loose = [v for v in expr_vars(a) if v not in bound]
            if set(expr_vars(b)) <= bound and len(loose) == 1:
                return not isinstance(a, Var) or not isinstance(b, Var)
        return False

    def bindable_later(self, x: Compare, bound: set[str], pending: list) -> bool:
        loose = {v for v in (*expr_vars(x.left), *expr_vars(x.right)) if v not in bound}
        return any(isinstance(y, Atom) and not self.computed(y) and loose & set(literal_vars(y)) for y, _ in pending)

    def predicate_cost(self, x: Atom, bound: set[str]) -> int | None:
        places = {i for i, a in enumerate(x.args) if isinstance(a, Const) or (isinstance(a, Var) and a.name in bound) or (not isinstance(a, (Var, Wild, Const)) and set(expr_vars(a)) <= bound)}
        if x.rel == "graph.closure" or x.rel == "graph.paths":
            return 6 if not ({1, 2} & places) else 2
        p = self.catalog.predicates[x.rel]
        if len(x.args) != p.arity:
            raise CheckError("arity", f"{x.rel} has {p.arity} arguments, not {len(x.args)}")
        if p.test:
            return 0 if len(places) == p.arity else None
        if p.frame:
            return 1 if set(p.frame.needs) | set(p.frame.constants) <= places else None
        return 1 if any(set(m.needs) <= places for m in p.modes) else None

    def step(self, f: Frame | None, x: object, given: Rel | None, rest: list) -> Frame:
        if isinstance(x, Compare):
            return self.compare(f or self.unit(), x)
        if isinstance(x, Atom):
            if x.rel in ("graph.closure", "graph.paths"):
                return self.walk(f, x)
            if x.rel in self.catalog.predicates:
                return self.call(f or self.unit(), x)
            if f is not None and given is None:
                given = self.looked_up(f, x)
            g = self.scan(x, given)
            return self.join(f, g, "left_semi" if f is not None and given is None and self.only_tests(f, x, g) else "inner")
        if isinstance(x, Not):
            return self.negate(f or self.unit(), x.atom)
        if isinstance(x, Reduce):
            return self.reduce(f, x)
        if isinstance(x, Maybe):
            return self.maybe(f, x)
        return self.either(f or self.unit(), x)

    def looked_up(self, f: Frame, x: Atom) -> Rel | None:
        """A store's rows for the keys that the bindings so far hold, if it finds rows by a column that they bind."""
        r = self.catalog.relations.get(x.rel)
        if r is None or r.store is None or x.rel in self.rules or len(x.args) != len(r.labels) or self.cites or self.versions is not None or self.at is not None:
            return None
        kinds = dict(zip(r.labels, r.kinds, strict=True))
        by = {label: a.name for label, a in zip(r.labels, x.args, strict=True) if label in r.store.keys and isinstance(a, Var) and a.name in f.kinds and f.kinds[a.name].name == kinds[label].name}
        if not by:
            return None
        fields = {n: t.dataType for n, t in zip(r.store.schema.names, r.store.schema, strict=True)}
        rows = r.store.fetch(f.df.select(*[F.col(f"`v_{v}`").cast(fields[c]).alias(c) for c, v in by.items()]))
        return Rel(rows.select(*[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(r.labels)], F.lit(None).cast("string").alias("__id")), r.kinds)

    def only_tests(self, f: Frame, x: Atom, g: Frame) -> bool:
        """Whether an atom binds nothing and matches a binding once at most: a semi join says the same."""
        if self.cites or self.versions is not None or not g.kinds or not set(g.kinds) <= set(f.kinds) or x.fact:
            return False
        if x.rel in self.rules:
            return not any(isinstance(a, Wild) for a in x.args)  # a set
        r = self.catalog.relations.get(x.rel)
        return bool(r and r.key) and not any(isinstance(a, Wild) for a, label in zip(x.args, r.labels, strict=True) if label in r.key)

    def scan(self, x: Atom, given: Rel | None = None) -> Frame:
        """An atom's bindings: its relation with constants and repeated variables as filters, and only bound columns kept."""
        rel = given
        if rel is None and x.rel in self.rules and x.rel not in self.done and len(x.args) == 2 and not self.cites and self.versions is None:
            group = self.group[x.rel]
            ends = [a if isinstance(a, Const) else None for a in x.args]
            if len(group) == 1 and any(ends) and rewrite.recursive(group, self.rules) and (step := rewrite.closure_step(x.rel, self.rules)):
                rel = self.closed(self.rules[x.rel], step, x.rel, *ends)  # walked from the bound end alone
        rel = rel or self.relation(x.rel)
        if len(x.args) != len(rel.kinds):
            raise CheckError("arity", f"{x.rel} has {len(rel.kinds)} arguments, not {len(x.args)}")
        df, conditions, first = rel.df, [], {}
        self.check_domain(x)
        for i, a in enumerate(x.args):
            v = Val(F.col(f"a{i}"), rel.kinds[i])
            if isinstance(a, Const):
                conditions.append(V.same(v, coerced(a, v.kind)))
            elif isinstance(a, Var):
                if a.name in first:
                    conditions.append(V.same(v, first[a.name]))
                else:
                    first[a.name] = v
        if x.fact:
            if x.rel not in self.catalog.relations:
                raise CheckError("fact", f"{x.rel} is derived: only facts of base relations have names")
            shown = [F.concat(F.lit('"'), F.col(f"a{i}"), F.lit('"')) if k.name == "text" else V.text(Val(F.col(f"a{i}"), k)) for i, k in enumerate(rel.kinds)]
            name = F.concat(F.lit(f"{x.rel}("), F.array_join(F.array(*[F.coalesce(s, F.lit("absent")) for s in shown]), ", "), F.lit(")"))
            df = df.withColumn("~fact", F.coalesce(F.col("__id"), name))
            first[x.fact] = Val(F.col("~fact"), Kind("text", "", False))
        if conditions:
            df = df.where(V.all_of(conditions))
        cols = [v.col.alias(f"v_{n}") for n, v in first.items()] + ([F.col(CITES)] if self.cites else [])
        return Frame(df.select(*(cols or [F.lit(1).alias("~one")])), {n: v.kind for n, v in first.items()})

    def check_domain(self, x: Atom) -> None:
        r = self.catalog.relations.get(x.rel)
        if r and r.domains:
            for label, a in zip(r.labels, x.args, strict=False):
                if isinstance(a, Const) and label in r.domains and str(a.value) not in map(str, r.domains[label]):
                    raise CheckError("type", f"{x.rel}: {label} is one of {r.domains[label]}, not {a.value!r}")

    def join(self, f: Frame | None, g: Frame, how: str = "inner") -> Frame:
        if f is None:
            return g
        shared = [n for n in g.kinds if n in f.kinds]
        right = g.df.select(*[F.col(f"`v_{n}`").alias(f"r_{n}" if n in shared else f"v_{n}") for n in g.kinds], *([F.col(CITES).alias("~more")] if self.cites else []))
        if not shared:
            if not g.kinds and not self.cites:
                right = g.df.select(F.lit(1).alias("~r"))
            df = f.df.crossJoin(right) if how == "inner" else f.df.join(right, F.lit(True), how)
        else:
            on = [V.same(f.val(n), Val(F.col(f"`r_{n}`"), g.kinds[n])) for n in shared]
            df = f.df.join(right, V.all_of(on), how)
        kinds = dict(f.kinds)
        for n, k in g.kinds.items():
            if n not in shared:
                kinds[n] = k.may if how == "left" else k
            elif how != "left" and not k.nullable and kinds[n].name == k.name:
                kinds[n] = replace(kinds[n], nullable=False)
        df = df.drop(*[f"r_{n}" for n in shared], "~r")
        if self.cites:
            df = df.withColumn(CITES, both_cited(F.col(CITES), F.coalesce("~more", cited()))).drop("~more")
        return Frame(df, kinds)

    def domain(self, f: Frame, names: list[str]) -> Frame:
        """The distinct values of these variables, as bindings of their own."""
        df = f.df.select(*[F.col(f"`v_{n}`") for n in names]).distinct() if names else f.df.limit(1).select(F.lit(1).alias("~one"))
        if self.cites:
            df = df.withColumn(CITES, cited())
        return Frame(df, {n: f.kinds[n] for n in names})

    def inside(self, f: Frame | None, body: tuple) -> tuple[Frame, list[str]]:
        """The bindings of braces, and what they share with the outside. Braces that need something from the
        outside begin with its distinct values."""
        shared = [n for n in dict.fromkeys(body_vars(body)) if f and n in f.kinds]
        try:
            inner = self.body(body)
            if all(n in inner.kinds for n in shared):
                return inner, shared
        except CheckError as e:
            if e.kind != "unbound" or not shared:
                raise
        return self.body(body, seed=self.domain(f, shared)), shared

    def reduce(self, f: Frame | None, x: Reduce) -> Frame:
        if any(isinstance(y, (Reduce, Maybe)) for y in x.body):
            raise CheckError("aggregate", "an aggregate's braces can't hold other braces")
        if x.var in set(body_vars(x.body)):
            raise CheckError("aggregate", f"?{x.var} is used inside its own braces")
        inner, shared = self.inside(f, x.body)
        if x.agg.var not in inner.kinds:
            raise CheckError("unbound", f"?{x.agg.var} isn't bound in the braces")
        made = aggregates.reduced(x.agg.func, x.agg.distinct, inner.val(x.agg.var))
        cites = [gathered().alias(CITES)] if self.cites else []
        col = made.col.alias(f"v_{x.var}")
        df = inner.df.groupBy(*[F.col(f"`v_{n}`") for n in shared]).agg(col, *cites) if shared else inner.df.agg(col, *cites)
        g = Frame(df, {**{n: inner.kinds[n] for n in shared}, x.var: made.kind})
        if f is None:
            return g
        out = self.join(f, g, "left" if shared else "inner")
        empty = aggregates.empty(x.agg.func)
        if empty is not None and shared:
            out = Frame(out.df.withColumn(f"v_{x.var}", F.coalesce(F.col(f"`v_{x.var}`"), empty)), {**out.kinds, x.var: replace(made.kind, nullable=False)})
        return out

    def maybe(self, f: Frame | None, x: Maybe) -> Frame:
        if f is None:
            raise CheckError("unbound", "an optional needs a relation outside it")
        if any(isinstance(y, Maybe) for y in x.body):
            raise CheckError("unbound", "an optional can't hold another")
        inner, shared = self.inside(f, x.body)
        names = [*shared, *[n for n in inner.kinds if n not in shared]]
        df = inner.df.select(*[F.col(f"`v_{n}`") for n in names], *([CITES] if self.cites else [])).distinct() if names else inner.df.limit(1)
        return self.join(f, Frame(df, {n: inner.kinds[n] for n in names}), "left")

    def negate(self, f: Frame, a: Atom) -> Frame:
        p = self.catalog.predicates.get(a.rel)
        if p and not p.frame:
            return Frame(f.df.where(~self.holds(f, a)), f.kinds)
        if p or a.rel.startswith("graph."):
            g = (self.call if p else self.walk)(self.domain(f, [n for n in literal_vars(a) if n in f.kinds]), a)
        else:
            g = self.scan(a)
        shared = [n for n in g.kinds if n in f.kinds]
        if not shared and g.kinds:
            raise CheckError("unbound", f"not {a.rel}(...) shares no variable with the rest")
        if not shared:
            right = g.df.limit(1).select(F.lit(1).alias("~r"))
            return Frame(f.df.join(right, F.lit(True), "left_anti"), f.kinds)
        right = g.df.select(*[F.col(f"`v_{n}`").alias(f"r_{n}") for n in shared])
        on = [V.same(f.val(n), Val(F.col(f"`r_{n}`"), g.kinds[n])) for n in shared]
        return Frame(f.df.join(right, V.all_of(on), "left_anti"), f.kinds)

    def either(self, f: Frame, x: Either) -> Frame:
        """Rows for which some branch holds: one filter if all branches are tests, else a semi join with their union."""
        tests = [[self.test(f, y) for y in b] for b in x.branches]
        if all(t is not None for b in tests for t in b):
            return Frame(f.df.where(reduce(lambda p, q: p | q, [V.all_of(b) if b else F.lit(True) for b in tests])), f.kinds)
        names = [n for n in dict.fromkeys(literal_vars(x)) if n in f.kinds]
        seed = self.domain(f, names)
        found = [self.body(b, seed=seed).df.select(*[F.col(f"`v_{n}`").alias(f"r_{n}") for n in names]) for b in x.branches]
        right = reduce(lambda p, q: p.union(q), found).distinct()
        on = [V.same(f.val(n), Val(F.col(f"`r_{n}`"), f.kinds[n])) for n in names]
        return Frame(f.df.join(right, V.all_of(on), "left_semi"), f.kinds)

    def test(self, f: Frame, y: object) -> Column | None:
        """The literal as a condition on the row, if it is one."""
        if isinstance(y, Compare) and {*expr_vars(y.left), *expr_vars(y.right)} <= set(f.kinds):
            return V.compare(y.op, self.value(f, y.left), self.value(f, y.right))
        if isinstance(y, Atom) and y.rel in self.catalog.predicates and set(literal_vars(y)) <= set(f.kinds):
            return self.holds(f, y)
        if isinstance(y, Not) and y.atom.rel in self.catalog.predicates and set(literal_vars(y)) <= set(f.kinds):
            return ~self.holds(f, y.atom)
        if isinstance(y, Either):
            parts = [[self.test(f, z) for z in b] for b in y.branches]
            if all(t is not None for b in parts for t in b):
                return reduce(lambda p, q: p | q, [V.all_of(b) if b else F.lit(True) for b in parts])
        return None

    # expressions and predicates

    def value(self, f: Frame, e: object) -> Val:
        if isinstance(e, Var):
            if e.name not in f.kinds:
                raise CheckError("unbound", f"nothing binds ?{e.name}")
            return f.val(e.name)
        if isinstance(e, Const):
            return constant_val(e)
        if isinstance(e, Op):
            args = [self.value(f, a) for a in e.args]
            if e.name == "neg":
                return registry.negative(args[0])
            out = registry.arithmetic(e.name, *args)
            return registry.short_of(e.name, out, *args) if self.catalog.simplify else out
        if isinstance(e, Call):
            p = self.catalog.predicates[e.name]
            n = p.arity - 1
            mode = next((m for m in p.modes if m.needs == tuple(range(n)) and m.gives == (n,)), None)
            if mode is None or len(e.args) != n:
                raise CheckError("arity", f"{e.name} isn't a function of {len(e.args)} arguments")
            return mode.run({i: self.value(f, a) for i, a in enumerate(e.args)})[0]
        raise CheckError("unbound", f"{e} has no value")

    def compare(self, f: Frame, x: Compare) -> Frame:
        bound = set(f.kinds)
        if {*expr_vars(x.left), *expr_vars(x.right)} <= bound:
            a, b = self.value(f, x.left), self.value(f, x.right)
            if x.op not in ("=", "!=") and a.kind.unit and b.kind.unit and a.kind.unit != b.kind.unit:
                raise CheckError("type", f"{a.kind.unit} and {b.kind.unit} have no order")
            condition = V.compare(x.op, a, b, filtering=True)
            for side, v in ((x.left, a), (x.right, b)):
                if isinstance(side, (Op, Call)) and getattr(side, "name", "") not in MAY_BE_ABSENT:
                    condition = condition & ~V.is_absent(v)
            return Frame(f.df.where(condition), f.kinds)
        a, b = (x.left, x.right) if not set(expr_vars(x.left)) <= bound else (x.right, x.left)
        return self.solve(f, a, self.value(f, b), isinstance(b, Call) and b.name in MAY_BE_ABSENT)

    def solve(self, f: Frame, e: object, v: Val, may_be_absent: bool = False) -> Frame:
        """Binds the one unbound variable of e so that e equals v; rows where there is no such value go."""
        if isinstance(e, Var):
            df = f.df.withColumn(f"v_{e.name}", v.col)
            kind = v.kind if may_be_absent else replace(v.kind, nullable=v.kind.name == "any")
            out = Frame(df, {**f.kinds, e.name: kind})
            return out if may_be_absent or not v.kind.nullable else Frame(out.df.where(F.col(f"`v_{e.name}`").isNotNull()), out.kinds)
        if isinstance(e, Op):
            if e.name == "neg":
                return self.solve(f, e.args[0], registry.negative(v))
            i = 0 if not set(expr_vars(e.args[0])) <= set(f.kinds) else 1
            known = self.value(f, e.args[1 - i])
            p = self.catalog.predicates[{"+": "num.add", "-": "num.sub", "*": "num.mul", "/": "num.div"}[e.name]]
            mode = next(m for m in p.modes if m.gives == (i,))
            return self.solve(f, e.args[i], mode.run({1 - i: known, 2: v})[0])
        raise CheckError("unbound", "a function can't be solved for its arguments here")

    def holds(self, f: Frame, a: Atom) -> Column:
        """Whether a predicate holds of bound arguments: never null."""
        p = self.catalog.predicates[a.rel]
        if len(a.args) != p.arity:
            raise CheckError("arity", f"{a.rel} has {p.arity} arguments, not {len(a.args)}")
        if p.test:
            return F.coalesce(p.test([self.value(f, t) for t in a.args]), F.lit(False))
        mode = next((m for m in p.modes if all(not isinstance(a.args[i], Wild) for i in m.needs)), None)
        if mode is None:
            raise CheckError("unbound", f"{a.rel} needs bound arguments under not")
        vals = {i: self.value(f, a.args[i]) for i in mode.needs}
        want = [(j, self.value(f, a.args[i])) for j, i in enumerate(mode.gives) if not isinstance(a.args[i], Wild)]
        if not mode.many:
            got = mode.run(vals)
            return F.coalesce(V.all_of([~V.is_absent(got[0]), *[V.same(got[j], v) for j, v in want]]), F.lit(False))
        array, kinds = mode.run(vals)
        return F.coalesce(F.exists(array, lambda s: V.all_of([F.lit(True), *[V.same(Val(s["abc"[j]], kinds[j]), v) for j, v in want]])), F.lit(False))

    def call(self, f: Frame, x: Atom) -> Frame:
        p = self.catalog.predicates[x.rel]
        if p.test and len(x.args) == p.arity:
            return Frame(f.df.where(p.test([self.value(f, t) for t in x.args])), f.kinds)
        if p.frame:
            df, got = self.generated(f, x, p.frame)
            return self.bound_by(f, x, df, got, p.frame.gives, True)
        bound = {i for i, a in enumerate(x.args) if not isinstance(a, (Wild, Var)) or (isinstance(a, Var) and a.name in f.kinds)}
        mode = next((m for m in p.modes if set(m.needs) <= bound), None)
        if mode is None:
            raise CheckError("unbound", f"{x.rel} can't run with what is bound")
        vals = {i: self.value(f, x.args[i]) for i in mode.needs}
        df = f.df
        if mode.many:
            array, kinds = mode.run(vals)
            df = df.withColumn("~x", F.explode(array))
            got = [Val(F.col("`~x`")["abc"[j]], k) for j, k in enumerate(kinds)]
        else:
            got = mode.run(vals)
            df = df.withColumns({f"~x{j}": v.col for j, v in enumerate(got)})
            got = [Val(F.col(f"`~x{j}`"), v.kind) for j, v in enumerate(got)]
            if x.rel not in MAY_BE_ABSENT:
                df = df.where(got[0].col.isNotNull())
        return self.bound_by(f, x, df, got, mode.gives, mode.many)

    def generated(self, f: Frame, x: Atom, g) -> tuple[DataFrame, list[Val]]:
        """The bindings with what a host's generator makes of their distinct inputs, in columns ~x0, ~x1, ..."""
        for i in g.constants:
            if not isinstance(x.args[i], Const):
                raise CheckError("type", f"{x.rel}: argument {i + 1} must be a constant")
        df = f.df.withColumns({f"~n{k}": self.value(f, x.args[i]).col for k, i in enumerate(g.needs)})
        found = g.over(df.select(*[F.col(f"`~n{k}`").alias(f"n{k}") for k in range(len(g.needs))]).distinct(), [x.args[i].value for i in g.constants])
        right = found.select(*[F.col(f"n{k}").alias(f"~m{k}") for k in range(len(g.needs))], *[F.col(f"g{k}").alias(f"~x{k}") for k in range(len(g.gives))])
        on = [F.col(f"`~n{k}`").eqNullSafe(F.col(f"`~m{k}`")) for k in range(len(g.needs))]
        df = (df.join(right, V.all_of(on)) if on else df.crossJoin(right)).drop(*[f"~{c}{k}" for k in range(len(g.needs)) for c in "nm"])
        return df, [Val(F.col(f"`~x{k}`"), kind) for k, kind in enumerate(g.kinds)]

    def bound_by(self, f: Frame, x: Atom, df: DataFrame, got: list[Val], gives: tuple[int, ...], many: bool) -> Frame:
        """df with a call's results bound, or held against what is bound already."""
        kinds, conditions, out = dict(f.kinds), [], {}
        for v, i in zip(got, gives, strict=True):
            a = x.args[i]
            if isinstance(a, Wild):
                continue
            if isinstance(a, Var) and a.name not in kinds:
                kinds[a.name] = v.kind if many or x.rel in MAY_BE_ABSENT else replace(v.kind, nullable=v.kind.name == "any")
                out[f"v_{a.name}"] = v.col
            elif isinstance(a, Var) and f"v_{a.name}" in out:
                conditions.append(V.same(v, Val(out[f"v_{a.name}"], kinds[a.name])))
            else:
                conditions.append(V.same(v, self.value(f, a)))
        if conditions:
            df = df.where(V.all_of(conditions))
        return Frame(df.withColumns(out).drop("~x", *[f"~x{j}" for j in range(len(got))]), kinds)

    # walks

    def walk(self, f: Frame | None, x: Atom) -> Frame:
        if self.versions is not None:
            raise CheckError("version", "a walk across versions: ask one version at a time")
        size = {"graph.closure": 6, "graph.paths": 7}.get(x.rel)
        if size is None:
            raise CheckError("unknown", f"no {x.rel}")
        if len(x.args) != size or not isinstance(x.args[0], Const) or not isinstance(x.args[0].value, str):
            raise CheckError("walk", f"{x.rel} takes a relation's name and {size - 1} more arguments")
        rel = self.relation(x.args[0].value)
        low, high = x.args[4 if size == 7 else 3 : (4 if size == 7 else 3) + 2]
        for b in (low, high):
            if not isinstance(b, Const) or not isinstance(b.value, int) or b.value < 0:
                raise CheckError("walk", f"{x.rel}: bounds are whole numbers from 0")
        if high.value and low.value > high.value:
            raise CheckError("walk", f"{x.rel}: the least is above the most")
        named = size == 7 and len(rel.kinds) == 3
        if len(rel.kinds) != 2 and not named:
            raise CheckError("walk", f"{x.rel} walks a relation of two arguments" + (" or three" if size == 7 else ""))
        edges = rel.df.select(F.col("a0").alias("f"), F.col("a2" if named else "a1").alias("t"), *([F.col("a1").alias("e")] if named else []), *([F.col(CITES)["c"].alias("c")] if self.cites else []))
        kind = V.common([rel.kinds[0], rel.kinds[2 if named else 1]])
        if kind.name == "any":
            raise CheckError("walk", f"{x.args[0].value} mixes kinds of nodes")
        seeds: dict[str, object] = {}
        for name, a in (("start", x.args[1]), ("end", x.args[2])):
            if isinstance(a, Const):
                seeds[name] = coerced(a, kind).col
            elif isinstance(a, Var) and f and a.name in f.kinds and name not in seeds:
                seeds[name] = f.df.select(F.col(f"`v_{a.name}`").alias("s")).distinct()
        if "start" in seeds and "end" in seeds and isinstance(seeds["end"], DataFrame):
            del seeds["end"]  # the join keeps the ends that are asked for
        r = self.catalog.relations.get(x.args[0].value)
        if size == 6 and "start" in seeds and r is not None and r.store is not None and r.store.walk and not self.cites:
            start = seeds["start"]
            asked = start if isinstance(start, DataFrame) else self.catalog.spark.range(1).select(start.alias("s"))
            out = r.store.walked(asked, low.value, high.value, edges.schema["f"].dataType)
            if "end" in seeds and not isinstance(seeds["end"], DataFrame):
                out = out.where(F.col("t").eqNullSafe(seeds["end"]))
            cols, kinds = ["f", "t", "hops"], [kind, kind, Kind("num", "", False, True)]
            args = [x.args[1], x.args[2], x.args[5]]
        elif size == 6:
            out = walks.closure(edges, low.value, high.value, limits=self.limits, **seeds)
            cols, kinds = ["f", "t", "hops"], [kind, kind, Kind("num", "", False, True)]
            args = [x.args[1], x.args[2], x.args[5]]
        else:
            mode = x.args[3]
            if not isinstance(mode, Const) or mode.value not in walks.MODES:
                raise CheckError("walk", f"graph.paths: the mode is one of {', '.join(walks.MODES)}")
            if mode.value == "walk" and not high.value:
                raise CheckError("walk", 'graph.paths: "walk" needs a most')
            out = walks.paths(edges, mode.value, low.value, high.value, named, limits=self.limits, **seeds)
            cols, kinds = ["f", "t", "path"], [kind, kind, Kind("text", "", False)]
            args = [x.args[1], x.args[2], x.args[6]]
        out = out.select(*[F.col(c).alias(f"a{i}") for i, c in enumerate(cols)], *([cited(F.col("c")).alias(CITES)] if self.cites else []))
        return self.join(f, self.scan(Atom("~walk", tuple(args)), Rel(out, [k if k.name == "text" and i == 2 else k for i, k in enumerate(kinds)])))


def cited(cites: Column | None = None) -> Column:
    """What base facts carry; without an argument, what cites nothing."""
    return F.struct(F.lit(0).alias("h"), F.lit("").alias("r"), (F.array() if cites is None else cites).cast("array<string>").alias("c"))


def both_cited(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a["h"], b["h"]).alias("h"), F.lit("").alias("r"), F.array_sort(F.array_union(a["c"], b["c"])).alias("c"))


def derived(r: Rule) -> Column:
    c = F.col(CITES)
    return F.struct((c["h"] + 1).alias("h"), F.lit(show(r)).alias("r"), F.array_sort(c["c"]).alias("c"))


def gathered() -> Column:
    """The citations of a group's bindings together."""
    c = F.col(CITES)
    joined = F.array_sort(F.array_distinct(F.flatten(F.collect_list(c["c"]))))
    return F.struct(F.coalesce(F.max(c["h"]), F.lit(0)).alias("h"), F.lit("").alias("r"), joined.alias("c"))


def pa_type(name: str) -> pa.DataType:
    return {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}[name]


def constant_val(c: Const) -> Val:
    v = V.constant(c.value, c.unit)
    object.__setattr__(v, "constant", c.value)
    return v


def coerced(c: Const, kind: Kind) -> Val:
    """A constant as its column's kind reads it: "3" is 3 in a number column, 3 is "3" in a text column."""
    if kind.name == "num" and isinstance(c.value, str):
        try:
            return V.constant(float(c.value))
        except ValueError:
            return V.constant(c.value)
    if kind.name == "text" and isinstance(c.value, (int, float)):
        return V.constant(f"{c.value:g}{c.unit}")
    if kind.name in ("date", "timestamp", "timestamp_ntz") and isinstance(c.value, str):
        return Val(F.lit(c.value).cast(kind.name), replace(kind, nullable=False))
    return V.constant(c.value, c.unit)


def distinct(df: DataFrame, names: list[str], kinds: list[Kind]) -> DataFrame:
    """The distinct rows by value. Of boxed values that are equal one is kept, one with a unit before one without."""
    if all(k.name != "any" for k in kinds):
        return df.distinct()
    keys = [V.key(Val(F.col(n), k)).alias(f"k{i}") for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
    return df.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names]).select(*names)


def strict_reads(body: tuple) -> set[str]:
    return {a.rel for a, strict in atoms(body) if strict}
