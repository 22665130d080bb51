"""The engine: programs in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow import values as V
from strataflow.errors import BudgetExceeded, CheckError, suggestion
from strataflow.operators import aggregates, versions
from strataflow.plans import rewrite
from strataflow.limits import Limits, cancel, cancellable
from strataflow.plans.compiler import CITES, Compiler, Frame, cited, constant_val, distinct, gathered
from strataflow.plans.text import parse, show
from strataflow.plans.tree import Agg, Atom, Call, Column, Compare, Const, Either, Maybe, Not, Op, Query, Reduce, Rule, Var, Wild, body_vars, expr_vars
from strataflow.sources.catalog import Catalog
from strataflow.sources.storage import cut, dropped, importable

VERSION = "~v"
#: Materialized relations that an engine keeps for the next time.
CACHE = 32


class Engine:
    """A catalog and what can be asked of it. Answers are lazy, but for fixpoints and large walks, whose rounds run
    while the answer is planned."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None) -> None:
        importable(spark)
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.derived: dict[tuple, tuple] = {}  # by what it was derived from, the last used last
        self.kept: dict[str, tuple[str, tuple[Rule, ...]]] = {}  # materialized members of modules, with the modules' rules

    # asking

    def query(self, program: str | Query, params: dict | None = None, names: Iterable[str] | None = None, ordered: bool = False, at: int | None = None, across: Iterable[int] | None = None, cites: bool = False, after: tuple | None = None, limits: Limits | None = None, reasons: bool = False) -> DataFrame:
        """The answer to a program.

        params binds variables of the goal: to a value, or to a list of them, which the goal is joined with.
        names are the answer's columns, in place of the labels as written. at asks one version; across asks
        several at once and adds a column `versions`. cites adds the sources' citations. ordered sorts an
        answer that isn't cut in the default order; without it, as without an order by, Spark gives rows as they come. reasons adds a column `why`: for each aggregate that is absent, by
        its column's name, what for: `no rows`, `no numbers` or `mixed units: ...`.
        """
        if at is not None and across is not None:
            raise CheckError("version", "ask at one version or across several")
        q = self.prepared(parse(program) if isinstance(program, str) else program, params)
        if after is not None:
            q = replace(q, after=tuple(Const(v) for v in after))
        vs = sorted(set(across)) if across is not None else None
        if vs is not None:
            q = self.across(q, vs)
        if not cites and at is None and vs is None:
            q = self.joined_by_stores(q)
        c = Compiler(self.catalog, q.rules, cites, at, vs, (limits or Limits()).started())
        return self.answer(c, q, list(names) if names is not None else None, ordered, vs is not None, params, reasons)

    def prepared(self, q: Query, params: dict | None = None) -> Query:
        """Linked with modules, checked, with macros and demand rewritten."""
        q = self.linked(q)
        for name in params or {}:
            if name not in set(body_vars(q.goal)):
                raise CheckError("bind", f"the goal has no ?{name}")
        single = {k: v for k, v in (params or {}).items() if not isinstance(v, (list, tuple, set))}
        if single:
            # The column stays: a bound variable is an equality with a constant.
            if q.select is None:
                q = replace(q, select=tuple(Column(Var(v), v) for v in dict.fromkeys(body_vars(q.goal)) if not v.startswith("~")))
            q = replace(q, goal=(*[Compare("=", Var(k), Const(v)) for k, v in single.items()], *q.goal))
        q = rewrite.inline_inputs(q, set(self.catalog.names()))
        self.check(q)
        return rewrite.demanded(self.constants_in(q), set(self.catalog.names()))

    def constants_in(self, q: Query) -> Query:
        """Equalities of the goal with constants, put into its recursive atoms so that demand sees them."""
        fixed = {a.name: b for x in q.goal if isinstance(x, Compare) and x.op == "=" for a, b in ((x.left, x.right), (x.right, x.left)) if isinstance(a, Var) and isinstance(b, Const)}
        heads = {r.rel for r in q.rules}
        goal = tuple(replace(x, args=tuple(fixed.get(a.name, a) if isinstance(a, Var) else a for a in x.args)) if isinstance(x, Atom) and x.rel in heads else x for x in q.goal)
        return replace(q, goal=goal)

    def linked(self, q: Query) -> Query:
        """The program with the rules of every module relation that it reaches."""
        exported = self.catalog.exported()
        own = {r.rel for r in q.rules}
        for n in own:
            if n in self.catalog.relations or n in self.catalog.predicates or n in exported or n.startswith("graph."):
                raise CheckError("redefined", f"{n} is already a relation, a predicate or a module's member")
        rules, todo, seen = list(q.rules), [q.goal, *[r.body for r in q.rules]], set()
        while todo:
            for n, _ in rewrite.reads(todo.pop()):
                if n in exported and n not in seen:
                    if n.split(".")[-1].startswith("_") and any(n in {m for m, _ in rewrite.reads(r.body)} for r in q.rules):
                        raise CheckError("unknown", f"{n} is private to its module")
                    seen.add(n)
                    rules += exported[n]
                    todo += [r.body for r in exported[n]]
        return replace(q, rules=tuple(rules))

    def check(self, q: Query) -> None:
        """What can be refused without data or a plan."""
        arity: dict[str, int] = {}
        for r in q.rules:
            if arity.setdefault(r.rel, len(r.args)) != len(r.args):
                raise CheckError("arity", f"{r.rel} has rules of {arity[r.rel]} and of {len(r.args)} arguments")
            if any(isinstance(a, Agg) for a in r.args) and sum(s.rel == r.rel for s in q.rules) > 1:
                raise CheckError("aggregate", f"{r.rel} aggregates, so it can have one rule only")
        for body in [q.goal, *[r.body for r in q.rules]]:
            for n, _ in rewrite.reads(body):
                if n not in arity and n not in self.catalog.relations and n not in self.catalog.predicates and not n.startswith(("graph.", "~")):
                    raise CheckError("unknown", f"no relation {n}{suggestion(n, [*arity, *self.catalog.names()])}")
        if q.select is not None:
            bound = set(body_vars(tuple(x for x in q.goal if not isinstance(x, Not))))
            for col in q.select:
                for v in expr_vars(col.item):
                    if v not in bound:
                        raise CheckError("projection", f"?{v} isn't bound by the goal")
            items = [c.item for c in q.select]
            for item, _ in q.order:
                if item not in items:
                    raise CheckError("order", f"order by {show(item)}: it isn't a column of the answer")
        if q.offset and not q.order:
            raise CheckError("order", "offset needs order by")
        if q.after and len(q.after) != len(q.order):
            raise CheckError("order", "after gives a value for each column of order by")

    def across(self, q: Query, vs: list[int]) -> Query:
        """The program with a version in every versioned relation and in all that reads one."""
        versioned = {n for n, r in self.catalog.relations.items() if "__versions" in r.df.columns}
        more = True
        while more:
            more = False
            for r in q.rules:
                if r.rel not in versioned and any(n in versioned for n, _ in rewrite.reads(r.body)):
                    versioned.add(r.rel)
                    more = True
        self.catalog.rows("~versions", [(v,) for v in vs], "v int", required=["v"])

        def put(x: object) -> object:
            if isinstance(x, Atom) and x.rel in versioned:
                return replace(x, args=(*x.args, Var(VERSION)))
            if isinstance(x, Not):
                return Not(put(x.atom))
            if isinstance(x, (Reduce, Maybe)):
                return replace(x, body=tuple(map(put, x.body)))
            if isinstance(x, Either):
                return Either(tuple(tuple(map(put, b)) for b in x.branches))
            return x

        def body(b: tuple) -> tuple:
            return (*map(put, b), Atom("~versions", (Var(VERSION),)))

        reading = {r.rel for r in q.rules if r.rel in versioned}
        rules = tuple(replace(r, args=(*r.args, Var(VERSION)), body=body(r.body) if r.body else (Atom("~versions", (Var(VERSION),)),)) if r.rel in reading else r for r in q.rules)
        select = q.select or tuple(Column(Var(v), v) for v in dict.fromkeys(body_vars(q.goal)))
        return replace(q, rules=rules, goal=body(q.goal), select=(*select, Column(Var(VERSION), VERSION)))

    def answer(self, c: Compiler, q: Query, names: list[str] | None, ordered: bool, across: bool, params: dict | None, reasons: bool = False) -> DataFrame:
        goal = list(q.goal)
        select = list(q.select) if q.select is not None else [Column(Var(v), v) for v in dict.fromkeys(body_vars(q.goal)) if not v.startswith("~")]
        for i, col in enumerate(select):
            if isinstance(col.item, (Op, Call)):
                goal.append(Compare("=", Var(f"~s{i}"), col.item))
        if not params and not across and not c.cites and c.at is None and (answered := self.by_store(q, select, names, reasons)) is not None:
            return answered
        f = c.body(tuple(goal))
        for k, v in (params or {}).items():
            if isinstance(v, (list, tuple, set)):
                given = self.spark.createDataFrame([(x,) for x in v], f"v_{k} {'string' if all(isinstance(x, str) for x in v) else 'double' if any(isinstance(x, float) for x in v) else 'bigint'}") if v else f.df.select(f"v_{k}").limit(0)
                kind = V.kind_of(given.schema[0].dataType, False)
                if c.cites:
                    given = given.withColumn(CITES, cited())
                f = c.join(f, Frame(given.distinct(), {k: kind}))
        if q.select is None:
            f = Frame(f.df, f.kinds)
        items = [Var(f"~s{i}") if isinstance(col.item, (Op, Call)) else col.item for i, col in enumerate(select)]
        for item in items:
            name = item.var if isinstance(item, Agg) else item.name if isinstance(item, Var) else None
            if name is not None and name not in f.kinds:
                raise CheckError("projection", f"?{name} isn't bound by the goal")
        wanted = [*items, *[a for a, _, _ in q.having]]
        if any(isinstance(i, Agg) for i in wanted):
            if reasons and across:
                raise CheckError("version", "reasons are told for one version at a time")
            rel = c.grouped(f, wanted, reasons)
            df, kinds = rel.df, rel.kinds
            for n, (_, op, term) in enumerate(q.having, len(items)):
                other = constant_val(term) if isinstance(term, Const) else V.Val(F.col(f"a{items.index(term)}"), kinds[items.index(term)])
                df = df.where(V.compare(op, V.Val(F.col(f"a{n}"), kinds[n]), other))
        else:
            vals = [constant_val(i) if isinstance(i, Const) else f.val(i.name) for i in items]
            kinds = [v.kind for v in vals]
            df = f.df.select(*[v.col.alias(f"a{i}") for i, v in enumerate(vals)], *([CITES] if c.cites else []))
            if c.cites:
                keys = [V.key(V.Val(F.col(f"a{i}"), k)).alias(f"k{i}") for i, k in enumerate(kinds)]
                df = df.groupBy(*keys).agg(*[F.max(f"a{i}").alias(f"a{i}") for i in range(len(kinds))], gathered().alias(CITES))
            elif not self.tells_apart(c, tuple(goal), items):
                df = distinct(df, df.columns, kinds)
        shown = list(range(len(items)))
        labels = [col.label for col in select]
        if across:
            shown.pop()
            labels.pop()
            if q.limit is not None or q.offset:
                df, q = self.paged_by_version(df, q, select, kinds, shown), replace(q, limit=None, offset=0)
            keep = [f"a{i}" for i in shown]
            df = df.groupBy(*keep).agg(F.array_sort(F.collect_set(f"a{len(items) - 1}")).alias("versions"), *([gathered().alias(CITES)] if c.cites else []))
        df = self.paged(df, q, select, kinds, shown, ordered)
        if names is not None:
            if len(names) != len(shown):
                raise CheckError("projection", f"the answer has {len(shown)} columns, not {len(names)}")
            labels = names
        out = [V.text(V.Val(F.col(f"a{i}"), kinds[i])).alias(n) if kinds[i].name == "any" else F.col(f"a{i}").alias(n) for i, n in zip(shown, labels, strict=True)]
        if reasons:
            told = [x for i, n in zip(shown, labels, strict=True) if isinstance(items[i], Agg) for x in (F.lit(n), F.col(f"w{i}"))]
            why = F.map_filter(F.create_map(*told), lambda _, w: w.isNotNull()) if told else F.create_map().cast("map<string,string>")
            out.append(why.alias("why"))
        return df.select(*out, *(["versions"] if across else []), *([F.col(CITES)["c"].alias("cites")] if c.cites else []))

    def by_store(self, q: Query, select: list[Column], names: list[str] | None, reasons: bool) -> DataFrame | None:
        """The answer to a goal of one atom that its store groups, or pages, itself; nothing for others."""
        if len(q.goal) != 1 or not isinstance(x := q.goal[0], Atom) or q.rules or x.fact or reasons:
            return None
        r = self.catalog.relations.get(x.rel)
        if r is None or r.store is None or len(x.args) != len(r.labels) or any(not isinstance(a, (Var, Const, Wild)) or getattr(a, "unit", "") for a in x.args):
            return None
        variables = [a.name for a in x.args if isinstance(a, Var)]
        column = {a.name: label for a, label in zip(x.args, r.labels, strict=True) if isinstance(a, Var)}
        bound = {label: [a.value] for a, label in zip(x.args, r.labels, strict=True) if isinstance(a, Const)}
        items = [c.item for c in select]
        if len(set(variables)) < len(variables) or q.after or any(not isinstance(i, (Var, Agg)) for i in items):
            return None
        types = {f.name: f.dataType for f in r.store.schema}
        labels = names or [c.label for c in select]
        if r.store.summarize and any(isinstance(i, Agg) for i in items) and not q.having and not q.order and q.limit is None and all(not isinstance(i, Agg) or (i.func in ("count", "sum", "min", "max") and not i.distinct) for i in items):
            groups, made = [column[i.name] for i in items if isinstance(i, Var)], [(i.func, column[i.var]) for i in items if isinstance(i, Agg)]
            fields = [T.StructField(f"k{k}", types[g]) for k, g in enumerate(groups)] + [T.StructField(f"m{k}", T.LongType() if f == "count" else types[g]) for k, (f, g) in enumerate(made)]
            summarize = r.store.summarize
            out = r.store.told(self.spark, T.StructType(fields), lambda: summarize(bound, groups, made))
            keys, values = iter(f"k{k}" for k in range(len(groups))), iter(f"m{k}" for k in range(len(made)))
            return out.select(*[F.col(next(values) if isinstance(i, Agg) else next(keys)).alias(n) for i, n in zip(items, labels, strict=True)])
        shown = [i.name for i in items if isinstance(i, Var)]
        if r.store.page and q.limit is not None and len(shown) == len(items) and set(shown) == set(variables):
            order = [(column[i.name], down) for i, down in q.order] + [(column[n], False) for n in shown if q.order]
            page, n = r.store.page, q.limit + q.offset
            rows = r.store.told(self.spark, r.store.schema, lambda: page(bound, order, n))
            held = Catalog(self.spark)
            held.predicates = self.catalog.predicates
            held.add(x.rel, rows, required=r.required)
            return Engine(self.spark, held).query(q, names=names)
        return None

    def joined_by_stores(self, q: Query) -> Query:
        """The goal with atoms of one home, two or more, replaced by one relation: what their store finds when it joins them."""
        plain = lambda x: not x.fact and all(isinstance(a, (Var, Const, Wild)) and not getattr(a, "unit", "") for a in x.args)
        homes: dict[str, list[Atom]] = {}
        for x in q.goal:
            r = self.catalog.relations.get(x.rel) if isinstance(x, Atom) else None
            if r is not None and r.store is not None and r.store.push and r.store.home and plain(x) and len(x.args) == len(r.labels):
                homes.setdefault(r.store.home, []).append(x)
        for home, found in homes.items():
            if len(found) < 2:
                continue
            fields: dict[str, T.StructField] = {}
            required: set[str] = set()
            for x in found:
                r = self.catalog.relations[x.rel]
                for a, f, label in zip(x.args, r.store.schema, r.labels, strict=True):
                    if isinstance(a, Var):
                        fields.setdefault(a.name, T.StructField(a.name, f.dataType))
                        required |= {a.name} if label in r.required else set()
            store, names = self.catalog.relations[found[0].rel].store, list(fields)
            asked = [(x.rel, [("var", a.name) if isinstance(a, Var) else ("const", a.value) if isinstance(a, Const) else None for a in x.args]) for x in found]
            push = store.push
            self.catalog.add(f"~{home}", store.told(self.spark, T.StructType([fields[n] for n in names]), lambda push=push, asked=asked, names=names: push(asked, names)), required=required)
            joined = Atom(f"~{home}", tuple(Var(n) for n in names))
            select = q.select if q.select is not None else tuple(Column(Var(v), v) for v in dict.fromkeys(body_vars(q.goal)) if not v.startswith("~"))
            q = replace(q, select=select, goal=(joined, *[x for x in q.goal if not any(x is y for y in found)]))
        return q

    def tells_apart(self, c: Compiler, goal: tuple, items: list) -> bool:
        """Whether the answer's columns tell all bindings apart, by declared keys: then they hold no row twice."""
        shown = {i.name for i in items if isinstance(i, Var)}
        tells = lambda args: all(isinstance(a, Const) or (isinstance(a, Var) and a.name in shown) for a in args)
        for x in goal:
            if isinstance(x, Maybe):
                return False
            if not isinstance(x, Atom):
                continue
            if p := self.catalog.predicates.get(x.rel):
                if p.frame or any(m.many for m in p.modes):
                    return False
            elif x.rel in c.rules:
                if not tells(x.args):
                    return False
            else:
                r = self.catalog.relations.get(x.rel)
                if r is None or not r.key or c.versions is not None or not tells([a for a, label in zip(x.args, r.labels, strict=True) if label in r.key]):
                    return False
        return any(isinstance(x, Atom) for x in goal)

    def paged(self, df: DataFrame, q: Query, select: list[Column], kinds: list, shown: list[int], ordered: bool) -> DataFrame:
        vals = [V.Val(F.col(f"a{i}"), kinds[i]) for i in shown]
        asked = [(vals[[c.item for c in select].index(item)], down) for item, down in q.order]
        keys = [k for v, down in asked for k in V.order_keys(v, down)]
        default = [k for v in vals for k in V.order_keys(v)]
        if q.after:
            df = df.where(V.after([v for v, _ in asked], [constant_val(t) for t in q.after], [d for _, d in asked]))
        if q.order and (q.limit is not None or q.offset):
            df = df.orderBy(*keys, *default)
            if q.offset:
                df = df.offset(q.offset)
            return df.limit(q.limit) if q.limit is not None else df
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.orderBy(*keys, *default) if ordered or q.order else df

    def cypher(self, graph, text: str, params: dict | None = None, **more) -> DataFrame:
        """The answer to a Cypher query over a graph view of the catalog."""
        from strataflow.cypher import compile_query

        graph.validate(self.catalog)
        program, columns = compile_query(graph, text, params)
        return self.query(program, names=columns, **more)

    def paged_by_version(self, df: DataFrame, q: Query, select: list[Column], kinds: list, shown: list[int]) -> DataFrame:
        """Each version's own page, before versions with equal rows are brought together."""
        vals = [V.Val(F.col(f"a{i}"), kinds[i]) for i in shown]
        keys = [k for item, down in q.order for k in V.order_keys(vals[[c.item for c in select].index(item)], down)]
        order = Window.partitionBy(f"a{len(shown)}").orderBy(*keys, *[k for v in vals for k in V.order_keys(v)])
        place = F.row_number().over(order)
        most = q.offset + q.limit if q.limit is not None else None
        df = df.withColumn("~place", place).where(F.col("~place") > q.offset)
        return (df if most is None else df.where(F.col("~place") <= most)).drop("~place")

    # around asking

    def total(self, program: str, **more) -> int:
        """The number of rows before after, offset and limit."""
        return self.query(replace(parse(program), limit=None, offset=0, after=(), order=()), **more).count()

    def validate(self, program: str, params: dict | None = None) -> None:
        """Raises what asking would raise for the program itself, without running it over data."""
        q = self.prepared(parse(program), params)
        heads = {r.rel for r in q.rules}
        rules = {n: [r for r in q.rules if r.rel == n] for n in heads}
        for group in rewrite.components(rules):
            if rewrite.recursive(group, rules):
                for n in group:
                    for r in rules[n]:
                        if any(m in group and strict for m, strict in rewrite.reads(r.body)) or any(isinstance(a, Agg) for a in r.args):
                            raise CheckError("recursion", f"{n} reads itself through negation, an aggregate, an optional or a walk")

    def explain(self, program: str, **more) -> str:
        """The program as rewritten, its components in order, and Spark's plan of the answer."""
        q = self.prepared(parse(program), more.get("params"))
        rules: dict[str, list[Rule]] = {}
        for r in q.rules:
            rules.setdefault(r.rel, []).append(r)
        parts = [f"{', '.join(g)}{' (fixpoint)' if rewrite.recursive(g, rules) else ''}" for g in rewrite.components(rules)]
        df = self.query(program, **more)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return f"{show(q)}\n\ncomponents: {'; '.join(parts) or 'none'}\n\n{plan}"

    def kinds(self, program: str, **more) -> list[tuple[str, str]]:
        """The answer's columns with the Spark types that hold them."""
        return [(f.name, f.dataType.simpleString()) for f in self.query(program, **more).schema]

    def cites_at(self, program: str, row: tuple, version: int, **more) -> list[str]:
        """What one answer row cites at one version; nothing if it doesn't hold then."""
        df = self.query(program, at=version, cites=True, **more)
        for name, value in zip(df.columns[:-1], row, strict=True):
            df = df.where(F.col(f"`{name}`").eqNullSafe(F.lit(value)))
        found = df.select("cites").limit(1).collect()
        return list(found[0][0]) if found else []

    def why(self, program: str, row: tuple, most: int = 20_000, at: int | None = None) -> list:
        """The derivations of one answer row, as trees down to base facts, at a version if one is named; facts that have an id tell it.

        Told by the plain evaluator over the base relations that the program reads, which must hold
        `most` rows at most together: trees are for looking at, not for large data.
        """
        from strataflow.naive import Naive

        q = self.prepared(parse(program))
        todo, seen = [q.goal, *[r.body for r in q.rules]], set()
        for body in todo:
            seen |= {n for n, _ in rewrite.reads(body) if n in self.catalog.relations}
        facts, left, ids = {}, most, {}
        for n in sorted(seen):
            r = self.catalog.relations[n]
            df = versions.at(r.df, at) if at is not None and "__versions" in r.df.columns else r.df
            rows = df.select(*r.labels, *(["__id"] if "__id" in df.columns else [])).limit(left + 1).collect()
            left -= len(rows)
            if left < 0:
                raise BudgetExceeded(f"more than {most} base facts")
            facts[n] = [tuple(x)[: len(r.labels)] for x in rows]
            ids |= {(n, tuple(x)[: len(r.labels)]): x["__id"] for x in rows if "__id" in df.columns and x["__id"] is not None}
        return Naive(facts, q.rules, ids).why(q, row)

    def why_empty(self, program: str) -> str:
        """Of a goal without rows, the first literal at which none were left, as written."""
        q = self.prepared(parse(program))
        for i in range(1, len(q.goal) + 1):
            try:
                f = Compiler(self.catalog, q.rules).body(q.goal[:i])
            except CheckError:
                continue
            if f.df.limit(1).isEmpty():
                return show(q.goal[i - 1])
        return ""

    def lint(self, program: str) -> list[str]:
        """Pairs of atoms of one relation that may bind one fact twice: their variables differ and nothing keeps them apart."""
        q, out = parse(program), []
        for body in [q.goal, *[r.body for r in q.rules]]:
            found = [x for x in body if isinstance(x, Atom)]
            apart = {frozenset((a.name, b.name)) for x in body if isinstance(x, Compare) and x.op in ("!=", "<", ">") for a, b in [(x.left, x.right)] if isinstance(a, Var) and isinstance(b, Var)}
            for i, a in enumerate(found):
                for b in found[i + 1 :]:
                    if a.rel == b.rel and len(a.args) == len(b.args):
                        pairs = [frozenset((x.name, y.name)) for x, y in zip(a.args, b.args, strict=True) if isinstance(x, Var) and isinstance(y, Var) and x != y]
                        if pairs and any(x == y for x, y in zip(a.args, b.args, strict=True)) and not any(p in apart for p in pairs):
                            out.append(f"{show(a)} and {show(b)} may be the same fact")
        return out

    def materialize(self, name: str, rules: str = "") -> Engine:
        """Derives a relation once, writes it to the shared folder and registers it as a base relation.

        What was derived by the same rules from the same versions of the same relations is used again, the last CACHE of them;
        a relation without a version token counts as the same while it is the same registration.
        """
        from strataflow.plans.text import parse_rules

        q = self.linked(Query(rules=parse_rules(rules) if rules else (), goal=(Atom(name, ()),)))
        read = {n for r in q.rules for n, _ in rewrite.reads(r.body)}
        tokens = [(n, repr(r.version()) if r.version else id(r)) for n, r in sorted(self.catalog.relations.items()) if n in read]
        key = (name, tuple(sorted(map(show, q.rules))), tuple(tokens))
        if key not in self.derived:
            rel = Compiler(self.catalog, q.rules).relation(name)
            self.derived[key] = cut(rel.df.select(*[f"a{i}" for i in range(len(rel.kinds))]), "derived"), [f"a{i}" for i, k in enumerate(rel.kinds) if not k.nullable], [self.catalog.relations[n] for n in read if n in self.catalog.relations]
            if len(self.derived) > CACHE:
                dropped(self.derived.pop(next(iter(self.derived)))[0])
        df, required, _ = self.derived[key] = self.derived.pop(key)
        for module, own in list(self.catalog.modules.items()):
            self.catalog.modules[module] = tuple(r for r in own if r.rel != name)
            if len(self.catalog.modules[module]) < len(own):
                self.kept[name] = (module, own)
        self.catalog.add(name, df, required=required)
        return self

    def forget(self, name: str) -> Engine:
        """Drops a materialized relation; a module's relation is derived by its rules again."""
        self.catalog.relations.pop(name, None)
        if name in self.kept:
            module, own = self.kept.pop(name)
            self.catalog.modules[module] = own
        return self

    def cancellable(self, tag: str):
        """A context whose jobs `cancel(tag)` stops, from another thread: those of planning and of reading the answer inside it."""
        return cancellable(self.spark, tag)

    def cancel(self, tag: str) -> None:
        cancel(self.spark, tag)

    def diff(self, name: str, old: int, new: int) -> DataFrame:
        return versions.difference(self.catalog.relations[name].df, old, new)


__all__ = ["Engine", "aggregates"]
