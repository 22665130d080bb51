"""Cypher clauses to a program's tree.

Every stage up to a WITH becomes a rule, every part of a UNION another; patterns become atoms, several
types or directions a helper relation with a rule for each, variable lengths walks. Disjunctions stay
disjunctions, for Spark to evaluate as filters or semi joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import count

from strataflow.cypher.graph import Edge, Graph, Node
from strataflow.cypher.parse import Parser, Refused
from strataflow.plans.tree import Agg, Atom, Call, Column, Compare, Const, Either, Maybe, Not, Op, Query, Reduce, Rule, Var, Wild, body_vars

AGGREGATES = {"count": "present", "sum": "sum", "avg": "avg", "min": "min", "max": "max", "collect": "list"}
TEXT = {"tolower": "str.lower", "lower": "str.lower", "toupper": "str.upper", "upper": "str.upper", "replace": "str.replace"}
FLIP = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


@dataclass
class Scope:
    """What a stage has bound: labels of nodes, kinds of other values, and the atoms that read properties."""

    body: list = field(default_factory=list)
    labels: dict[str, list[str]] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)
    loose: set[str] = field(default_factory=set)  # may be absent
    reads: dict[tuple[str, str], dict[int, object]] = field(default_factory=dict)
    types: dict[str, list[str]] = field(default_factory=dict)  # of relationship variables
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    paths: set[str] = field(default_factory=set)
    outer: Scope | None = None

    def bound(self, name: str) -> bool:
        return name in self.known or (self.outer is not None and self.outer.bound(name))


class Compiler:
    def __init__(self, graph: Graph, params: dict | None) -> None:
        self.graph, self.params = graph, params or {}
        self.rules: list[Rule] = []
        self.ids = count(1)
        self.labels = {n.label: n for n in graph.nodes}
        self.edge_types = {e.type: e for e in graph.edges}

    def fresh(self, what: str = "x") -> str:
        return f"{what}__{next(self.ids)}"

    # patterns

    def node(self, s: Scope, n: tuple) -> str:
        _, var, labels, props, where = n
        name = var or self.fresh("n")
        if var and not s.bound(name):
            s.known.add(name)
        for label in labels:
            if label not in self.labels:
                raise Refused(f"no label {label}")
            if label not in s.labels.setdefault(name, []):
                s.labels[name].append(label)
            s.reads.setdefault((name, label), {})
        for key, e in props:
            self.pin(s, name, key, self.value(s, e))
        if where is not None:
            s.known.add(name)
            self.condition(s, where, s.body)
        return name

    def pin(self, s: Scope, name: str, key: str, value: object) -> None:
        for label in self.labels_of(s, name):
            node = self.labels[label]
            if key in node.props and node.props[key] == node.key:
                s.body.append(Compare("=", Var(name), value))
                return
            if key in node.props and node.props[key] not in s.reads.setdefault((name, label), {}) and isinstance(value, Const):
                s.reads[(name, label)][node.props[key]] = value
                return
        s.body.append(Compare("=", self.property(s, name, key), value))

    def labels_of(self, s: Scope, name: str) -> list[str]:
        return s.labels.get(name) or (self.labels_of(s.outer, name) if s.outer else [])

    def property(self, s: Scope, name: str, key: str) -> Var:
        """The variable of a node's or relationship's property, with the atom that reads it."""
        if name in s.types or (s.outer and name in s.outer.types):
            return self.edge_property(s, name, key)
        for label in self.labels_of(s, name):
            node = self.labels[label]
            if key in node.props:
                at = node.props[key]
                if at == node.key:
                    return Var(name)
                reads = s.reads.setdefault((name, label), {})
                if isinstance(reads.get(at), Const):
                    value, reads[at] = reads[at], Var(f"{name}__{key}")
                    s.body.append(Compare("=", reads[at], value))
                got = reads.setdefault(at, Var(f"{name}__{key}"))
                s.loose.add(got.name)
                s.known.add(got.name)
                return got
        v = Var(f"{name}__{key}")
        if key in self.graph.derived:
            atom = Atom(self.graph.derived[key], (Var(name), v))
        elif self.graph.props:
            rel, node_at, key_at, value_at = self.graph.props
            args: list = [Wild()] * 3
            args[node_at], args[key_at], args[value_at] = Var(name), Const(key), v
            atom = Atom(rel, tuple(args))
        else:
            raise Refused(f"{name} has no property {key}")
        if atom not in s.body:
            s.body.append(atom)
            s.known.add(v.name)
        return v

    def edge_property(self, s: Scope, name: str, key: str) -> Var:
        types = s.types.get(name) or (s.outer.types[name] if s.outer else [])
        v = Var(f"{name}__{key}")
        edge = self.edge_types[types[0]] if len(types) == 1 else None
        for i, x in enumerate(s.body):
            if edge and key in edge.props and isinstance(x, Atom) and x.fact == name:
                args = list(x.args)
                args[edge.props[key]] = v
                s.body[i] = Atom(x.rel, tuple(args), name)
                s.loose.add(v.name)
                s.known.add(v.name)
                return v
        if not self.graph.props:
            raise Refused(f"{name} has no property {key}")
        rel = self.graph.props[0]
        s.body.append(Atom(rel, (Var(name), Const(key), v)))
        s.known.add(v.name)
        return v

    def edge_atom(self, e: Edge, a: object, b: object, fact: str | None = None) -> Atom:
        args: list = [Wild()] * e.arity
        for i, value in e.fixed.items():
            args[i] = Const(value)
        args[e.start], args[e.end] = a, b
        return Atom(e.relation, tuple(args), fact)

    def step(self, types: list[str], way: str) -> str:
        """A relation of two arguments: the steps of these types, in this direction."""
        name = self.fresh("cypher_step")
        for t in types:
            e = self.edge_types[t]
            if way in ">-":
                self.rules.append(Rule(name, (Var("a"), Var("b")), (self.edge_atom(e, Var("a"), Var("b")),)))
            if way in "<-":
                self.rules.append(Rule(name, (Var("a"), Var("b")), (self.edge_atom(e, Var("b"), Var("a")),)))
        return name

    def chain(self, s: Scope, path: tuple) -> None:
        var, shortest, elements = path
        names = [self.node(s, n) for n in elements[::2]]
        if var is not None and len(elements) != 3:
            raise Refused("a path variable over more or less than one relationship", gap=True)
        for i, (_, r, types, props, span, way) in enumerate(elements[1::2]):
            a, b = Var(names[i]), Var(names[i + 1])
            s.known |= {n for n in (names[i], names[i + 1])}
            for t in types:
                if t not in self.edge_types:
                    raise Refused(f"no relationship type {t}")
            used = types or list(self.edge_types)
            if var is not None or shortest:
                low, high = span or (1, 1)
                p = var or self.fresh("p")
                s.known.add(p)
                s.paths.add(p)
                s.body.append(Atom("graph.paths", (Const(self.step(used, way)), a, b, Const("shortest" if shortest else "trail"), Const(low), Const(high), Var(p) if var else Wild())))
            elif span:
                s.body.append(Atom("graph.closure", (Const(self.step(used, way)), a, b, Const(span[0]), Const(span[1]), Wild())))
            elif way != "-" and len(used) == 1:
                e = self.edge_types[used[0]]
                if way == "<":
                    a, b = b, a
                fact = (r or self.fresh("r")) if (r or props) else None
                s.body.append(self.edge_atom(e, a, b, fact))
                if fact:
                    s.known.add(fact)
                    s.types[fact], s.ends[fact] = used, (a.name, b.name)
                    for key, value in props:
                        s.body.append(Compare("=", self.edge_property(s, fact, key), self.value(s, value)))
            else:
                if r or props:
                    raise Refused("a variable or properties on a relationship of several types or either direction", gap=True)
                s.body.append(Atom(self.step(used, way), (a, b)))
        if len(elements) == 1 and not self.labels_of(s, names[0]) and not any(names[0] in body_vars((x,)) for x in s.body) and not s.bound(names[0]):
            raise Refused("a node needs a label or a relationship", gap=True)

    def settle(self, s: Scope) -> None:
        """The atoms of the nodes' labels, with the properties that were read."""
        for (name, label), reads in s.reads.items():
            n: Node = self.labels[label]
            args: list = [Wild()] * n.arity
            for i, value in n.fixed.items():
                args[i] = Const(value)
            for i, v in reads.items():
                args[i] = v
            args[n.key] = Var(name)
            s.body.insert(0, Atom(n.relation, tuple(args)))
        s.reads = {}

    # values and conditions

    def value(self, s: Scope, e: tuple) -> object:
        kind = e[0]
        if kind == "const":
            return Const(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise Refused(f"${e[1]} has no value")
            v = self.params[e[1]]
            return Const(json.dumps(v, separators=(",", ":")) if isinstance(v, (list, tuple)) else v)
        if kind == "list":
            if any(x[0] != "const" for x in e[1]):
                raise Refused("lists of more than constants", gap=True)
            return Const(json.dumps([x[1] for x in e[1]], separators=(",", ":"), ensure_ascii=False))
        if kind == "var":
            if not s.bound(e[1]):
                raise Refused(f"{e[1]} isn't matched")
            return Var(e[1])
        if kind == "prop":
            if e[1][0] != "var":
                raise Refused("a property of a value", gap=True)
            if not s.bound(e[1][1]):
                raise Refused(f"{e[1][1]} isn't matched")
            return self.property(s, e[1][1], e[2])
        if kind == "neg":
            return Op("neg", (self.value(s, e[1]),))
        if kind == "op":
            a, b = self.value(s, e[2]), self.value(s, e[3])
            if e[1] == "+" and any(self.is_text(x, v) for x, v in ((e[2], a), (e[3], b))):
                return Call("str.concat", (a, b))
            return Op(e[1], (a, b))
        if kind == "index":
            inner = e[1]
            if inner[0] == "call" and inner[1] == "split":
                return Call("str.split", (*[self.value(s, x) for x in inner[3]], self.value(s, e[2])))
            return Call("list.at", (self.value(s, inner), self.value(s, e[2])))
        if kind == "call":
            return self.function(s, e)
        if kind == "count{}":
            name = self.fresh("c")
            inner = self.inner(s, e[1], e[2])
            counted = next(v for v in body_vars(tuple(inner)) if not s.bound(v)) if any(not s.bound(v) for v in body_vars(tuple(inner))) else next(iter(body_vars(tuple(inner))))
            s.body.append(Reduce(name, Agg("count", counted), tuple(inner)))
            s.known.add(name)
            return Var(name)
        raise Refused(f"{kind} as a value", gap=True)

    def is_text(self, e: tuple, v: object) -> bool:
        return (isinstance(v, Const) and isinstance(v.value, str)) or (isinstance(v, Call) and v.name.startswith("str.") and v.name != "str.distance")

    def function(self, s: Scope, e: tuple) -> object:
        _, name, _, args = e
        if name in TEXT:
            return Call(TEXT[name], tuple(self.value(s, a) for a in args))
        if name in ("type", "id", "startnode", "endnode") and args and args[0][0] == "var" and args[0][1] in s.types:
            r = args[0][1]
            return {"type": Const(s.types[r][0]), "id": Var(r), "startnode": Var(s.ends[r][0]), "endnode": Var(s.ends[r][1])}[name]
        path = args and args[0][0] == "var" and args[0][1] in s.paths
        if name == "length" and path:
            return Call("path.length", (Var(args[0][1]),))
        if name in ("nodes", "relationships") and path:
            return Call("path.nodes" if name == "nodes" else "path.edges", (Var(args[0][1]),))
        if name == "size":
            return Call("list.length", (self.value(s, args[0]),))
        if name in ("head", "last"):
            return Call("list.at", (self.value(s, args[0]), Const(0 if name == "head" else -1)))
        if name == "coalesce" and len(args) == 2:
            return Call("coalesce", tuple(self.value(s, a) for a in args))
        raise Refused(f"the function {name}", gap=True)

    def guards(self, s: Scope, out: list, *values: object) -> None:
        for v in values:
            for name in [v.name] if isinstance(v, Var) else []:
                if name in s.loose or (s.outer and name in s.outer.loose):
                    out.append(Not(Atom("absent", (Var(name),))))

    def condition(self, s: Scope, e: tuple, out: list, positive: bool = True) -> None:
        """Literals that hold when the expression is true, or with positive False when it is false; unknown is neither."""
        kind = e[0]
        if kind == "not":
            self.condition(s, e[1], out, not positive)
        elif kind in ("and", "or") and (kind == "and") == positive:
            self.condition(s, e[1], out, positive)
            self.condition(s, e[2], out, positive)
        elif kind in ("and", "or"):
            branches: list[list] = [[], []]
            for b, x in zip(branches, e[1:], strict=True):
                self.condition(s, x, b, positive)
            out.append(Either(tuple(map(tuple, branches))))
        elif kind == "xor":
            yes: list[list] = [[], []]
            for b, (p, q) in zip(yes, ((True, not positive), (False, positive)), strict=True):
                self.condition(s, e[1], b, p)
                self.condition(s, e[2], b, q)
            out.append(Either(tuple(map(tuple, yes))))
        elif kind == "compare":
            a, b = self.value(s, e[2]), self.value(s, e[3])
            self.guards(s, out, a, b)
            out.append(Compare(e[1] if positive else FLIP[e[1]], a, b))
        elif kind == "null":
            a = self.value(s, e[1])
            test = Atom("absent", (a,))
            out.append(test if positive else Not(test))
        elif kind in ("test", "match"):
            args = [self.value(s, x) for x in e[-2:]]
            self.guards(s, out, *args)
            if kind == "match":
                if not isinstance(args[1], Const):
                    raise Refused("=~ takes a constant pattern", gap=True)
                args[1] = Const(f"^(?:{args[1].value})$")
            test = Atom(e[1] if kind == "test" else "str.match", tuple(args))
            out.append(test if positive else Not(test))
        elif kind == "in":
            a = self.value(s, e[1])
            self.guards(s, out, a)
            if e[2][0] == "list" or (e[2][0] == "param" and isinstance(self.params.get(e[2][1]), (list, tuple))):
                values = [x[1] for x in e[2][1]] if e[2][0] == "list" else list(self.params[e[2][1]])
                tests = [Compare("=" if positive else "!=", a, Const(v)) for v in values]
                out += tests if not positive else [Either(tuple((t,) for t in tests))] if tests else [Compare("=", Const(0), Const(1))]
            else:
                if e[2][0] == "call" and e[2][1] == "nodes" and e[2][3][0][1] in s.paths:
                    test = Atom("path.node", (Var(e[2][3][0][1]), Wild(), a))
                else:
                    test = Atom("list.member", (self.value(s, e[2]), Wild(), a))
                # Whether a value is a member, not how often.
                out.append(Not(test) if not positive else Either(((test,),)))
        elif kind == "label":
            n = self.labels.get(e[2])
            if n is None:
                raise Refused(f"no label {e[2]}")
            args: list = [Wild()] * n.arity
            for i, v in n.fixed.items():
                args[i] = Const(v)
            args[n.key] = Var(e[1][1])
            name = self.fresh("cypher_label")
            self.rules.append(Rule(name, (Var(e[1][1]),), (Atom(n.relation, tuple(args)),)))
            atom = Atom(name, (Var(e[1][1]),))
            out.append(atom if positive else Not(atom))
        elif kind in ("pattern", "exists{}"):
            inner = self.inner(s, [(None, False, e[1])] if kind == "pattern" else e[1], None if kind == "pattern" else e[2])
            shared = [v for v in dict.fromkeys(body_vars(tuple(inner))) if s.bound(v)]
            name = self.fresh("cypher_exists")
            self.rules.append(Rule(name, tuple(Var(v) for v in shared), tuple(inner)))
            atom = Atom(name, tuple(Var(v) for v in shared))
            out.append(atom if positive else Not(atom))
        else:
            raise Refused("a value as a condition", gap=True)

    def inner(self, s: Scope, patterns: list, where: tuple | None) -> list:
        """The body of braces over what s has bound; nodes of s keep their labels for properties read inside."""
        t = Scope(outer=s)
        for p in patterns:
            self.chain(t, p)
        if where is not None:
            self.condition(t, where, t.body)
        self.settle(t)
        return t.body

    # clauses

    def part(self, clauses: list) -> tuple[Scope, list, tuple]:
        s, matched = Scope(), False
        for c in clauses:
            if c[0] == "match" and not c[1]:
                for p in c[2]:
                    self.chain(s, p)
                if c[3] is not None:
                    self.condition(s, c[3], s.body)
                matched = True
            elif c[0] == "match":
                if not matched:
                    raise Refused("an OPTIONAL MATCH before any MATCH", c[4], True)
                self.optional(s, c)
            elif c[0] == "unwind":
                source = self.value(s, c[1])
                s.body.append(Atom("list.member", (source, Wild(), Var(c[2]))))
                s.known.add(c[2])
                matched = True
            elif c[0] == "call":
                s.body.append(Atom(c[1], (*[self.value(s, a) for a in c[2]], *[Var(alias) for _, alias in c[3]])))
                s.known |= {alias for _, alias in c[3]}
                if c[4] is not None:
                    self.condition(s, c[4], s.body)
                matched = True
            elif c[0] == "with":
                s = self.stage(s, c)
                matched = True
            else:
                if not matched:
                    raise Refused("a query with no MATCH before its RETURN", c[-1], True)
                items = self.items(s, c[1])
                return s, items, c
        raise Refused("a query ends in RETURN")

    def optional(self, s: Scope, c: tuple) -> None:
        self.settle(s)
        t = Scope(outer=s)
        for p in c[2]:
            self.chain(t, p)
        if c[3] is not None:
            self.condition(t, c[3], t.body)
        fresh = {n for n in t.known if not s.bound(n)}
        # Properties read later of what only the braces bind are read inside them.
        for n in fresh:
            for label in t.labels.get(n, []):
                for key, at in self.labels[label].props.items():
                    if at != self.labels[label].key:
                        self.property(t, n, key)
        fresh = {n for n in t.known if not s.bound(n)}
        self.settle(t)
        s.body.append(Maybe(tuple(t.body)))
        s.known |= fresh
        s.loose |= fresh
        for n in fresh:
            if n in t.labels:
                s.labels[n] = []
                self.carried[n] = {key: f"{n}__{key}" if at != self.labels[label].key else n for label in t.labels[n] for key, at in self.labels[label].props.items()}

    carried: dict[str, dict[str, str]] = {}

    def items(self, s: Scope, items: list) -> list[tuple[object, str]]:
        """(Var, Agg, constant or expression, alias), properties of optional nodes as the braces read them."""
        out = []
        for e, alias in items:
            if e == ("*",):
                out += [(Var(n), n) for n in sorted(s.known) if "__" not in n]
            else:
                out.append((self.item(s, e), alias))
        return out

    def item(self, s: Scope, e: tuple) -> object:
        if e[0] == "call" and e[1] in AGGREGATES:
            arg = e[3][0]
            if arg == ("*",):
                return Agg("count", next(iter(sorted(n for n in s.known if "__" not in n) or sorted(s.known))))
            v = self.read(s, arg)
            if not isinstance(v, Var):
                name = self.fresh("e")
                s.body.append(Compare("=", Var(name), v))
                s.known.add(name)
                v = Var(name)
            return Agg("count" if e[1] == "count" and e[2] else AGGREGATES[e[1]], v.name, e[2])
        if e[0] == "call" and e[1].startswith(("stdev", "percentile")):
            raise Refused(f"the function {e[1]}", gap=True)
        return self.read(s, e)

    def read(self, s: Scope, e: tuple) -> object:
        if e[0] == "prop" and e[1][0] == "var" and e[2] in self.carried.get(e[1][1], {}):
            return Var(self.carried[e[1][1]][e[2]])
        return self.value(s, e)

    def stage(self, s: Scope, c: tuple) -> Scope:
        """A WITH as a rule, and a scope that reads it."""
        items = self.items(s, c[2])
        self.settle(s)
        name = self.fresh("cypher_with")
        self.rules.append(Rule(name, tuple(i for i, _ in items), tuple(s.body)))
        t = Scope(known={a for _, a in items}, loose={a for i, a in items if isinstance(i, (Var, Call)) and (not isinstance(i, Var) or i.name in s.loose)})
        t.labels = {a: s.labels[i.name] for i, a in items if isinstance(i, Var) and i.name in s.labels}
        t.paths = {a for i, a in items if isinstance(i, Var) and i.name in s.paths}
        t.body = [Atom(name, tuple(Var(a) for _, a in items))]
        if c[3] is not None:
            self.condition(t, c[3], t.body)
        return t

    def query(self, parts: list) -> tuple[Query, list[str]]:
        self.carried = {}
        built = [self.part(clauses) for _, clauses in parts]
        s, items, ret = built[0]
        columns = [a for _, a in items]
        if len(built) > 1:
            name = self.fresh("cypher_union")
            for t, found, r in built:
                if [a for _, a in found] != columns:
                    raise Refused("UNION's parts return different columns")
                if r[2] or r[3] or r[4] is not None:
                    raise Refused("an order or a limit in a part of a UNION", r[-1], True)
                self.settle(t)
                part = self.fresh("cypher_part")
                self.rules.append(Rule(part, tuple(i for i, _ in found), tuple(t.body)))
                variables = tuple(Var(f"c{i}") for i in range(len(columns)))
                self.rules.append(Rule(name, variables, (Atom(part, variables),)))
            variables = tuple(Var(f"c{i}") for i in range(len(columns)))
            return Query(tuple(self.rules), (Atom(name, variables),), tuple(Column(v, c) for v, c in zip(variables, columns, strict=True))), columns
        order = []
        for e, down in ret[2]:
            alias = e[1] if e[0] == "var" and e[1] in columns else None
            item = items[columns.index(alias)][0] if alias else self.item(s, e)
            if item not in [i for i, _ in items]:
                raise Refused("ORDER BY something that isn't returned", gap=True)
            order.append((item, down))
        self.settle(s)
        if ret[3] and not order:
            raise Refused("rows can only be skipped in a stated order", gap=True)
        return Query(tuple(self.rules), tuple(s.body), tuple(Column(i, a) for i, a in items), (), tuple(order), (), ret[4], ret[3]), columns


def compile_query(graph: Graph, text: str, params: dict | None = None) -> tuple[Query, list[str]]:
    """The program of a Cypher query and its columns' names; ask it with Engine.query(program, names=columns)."""
    return Compiler(graph, params).query(Parser(text).statement())
