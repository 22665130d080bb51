"""A read-only part of Cypher, compiled to programs over a property-graph view of relations."""

from strataflow.cypher.compile import Refused, compile_query
from strataflow.cypher.grammar import explained, grammar
from strataflow.cypher.graph import Edge, Graph, Node, kinds_of, store

__all__ = ["Edge", "Graph", "Node", "Refused", "compile_query", "explained", "grammar", "kinds_of", "store"]
