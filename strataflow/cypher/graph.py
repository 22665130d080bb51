"""How relations read as a property graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from strataflow.errors import CheckError
from strataflow.sources.catalog import Catalog


@dataclass(frozen=True)
class Node:
    """One label: the relation of its nodes, the argument that is a node's key, constants that pin arguments, and
    properties by argument."""

    label: str
    relation: str
    arity: int
    key: int = 0
    props: dict = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    """One relationship type, from one argument of its relation to another."""

    type: str
    relation: str
    arity: int
    start: int = 0
    end: int = 1
    props: dict = field(default_factory=dict)
    fixed: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Graph:
    """props is a key-value relation (name, node argument, key argument, value argument) for properties that no node
    lists; derived names a relation of (node, value) for a property of any node."""

    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    props: tuple[str, int, int, int] | None = None
    derived: dict = field(default_factory=dict)

    def validate(self, catalog: Catalog) -> None:
        for kind, names in (("label", [n.label for n in self.nodes]), ("type", [e.type for e in self.edges])):
            if len(set(names)) != len(names):
                raise CheckError("unknown", f"a {kind} is named twice")
        for x in (*self.nodes, *self.edges):
            r = catalog.relations.get(x.relation)
            if r is not None and len(r.labels) != x.arity:
                raise CheckError("arity", f"{x.relation} has {len(r.labels)} arguments, not {x.arity}")


    def describe(self) -> str:
        """The labels with their properties and the relationship types, one a line."""
        lines = [f"({n.label} {{{', '.join(n.props)}}})" for n in self.nodes]
        return "\n".join(lines + [f"-[:{e.type}{' {' + ', '.join(e.props) + '}' if e.props else ''}]->" for e in self.edges])


#: Kinds of nodes or of edges that a graph may have.
KINDS = 10_000


def kinds_of(catalog: Catalog, node: str = "node", edge: str = "edge") -> tuple[list[str], list[str]]:
    """The node and edge kinds that a node-edge-attr store holds, read from its data: one row a kind, KINDS at most."""
    found = []
    for name in (node, edge):
        r = catalog.relations[name]
        rows = r.df.select(r.labels[1]).distinct().limit(KINDS + 1).collect()
        if len(rows) > KINDS:
            raise CheckError("unknown", f"{name} has more than {KINDS} kinds: its second column doesn't name kinds")
        found.append(sorted(x[0] for x in rows if x[0] is not None))
    return found[0], found[1]


def store(node_kinds: list[str], edge_kinds: list[str], node: str = "node", edge: str = "edge", attr: str = "attr") -> Graph:
    """The view of a store that keeps node(id, kind), edge(from, kind, to) and attr(id, key, value)."""
    label = lambda k: "".join(p.capitalize() for p in k.split("_"))
    return Graph(
        tuple(Node(label(k), node, 2, 0, {}, {1: k}) for k in node_kinds),
        tuple(Edge(k.upper(), edge, 3, 0, 2, {}, {1: k}) for k in edge_kinds),
        (attr, 0, 1, 2),
    )
