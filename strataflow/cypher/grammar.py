"""What of Cypher is compiled, as a grammar over a graph's own names, and what a query becomes."""

from __future__ import annotations

from strataflow.cypher.compile import compile_query
from strataflow.cypher.graph import Graph
from strataflow.plans.text import show


def grammar(graph: Graph) -> str:
    """Queries over this graph as GBNF: labels, relationship types and properties are its own. It holds a model's output to
    forms that are compiled; the parser takes more ways of writing them."""
    quoted = lambda names: " | ".join(f'"{n}"' for n in names) or '"none"'
    props = sorted({p for x in (*graph.nodes, *graph.edges) for p in x.props} | set(graph.derived))
    rules = {
        "root": 'part (" UNION " part)*',
        "part": 'match (" " match)* (" WITH " items where?)? (" " match)* " RETURN " ("DISTINCT ")? items order? skip? limit?',
        "match": '("OPTIONAL ")? "MATCH " pattern (", " pattern)* where?',
        "where": '" WHERE " condition',
        "pattern": "node (step node)*",
        "node": '"(" name? (":" label)? (" {" pair (", " pair)* "}")? ")"',
        "step": '"<"? "-[" name? ":" type ("|" type)* ("*" [0-9]* (".." [0-9]*)?)? "]-" ">"?',
        "pair": 'property ": " value',
        "condition": '("NOT ")? test ((" AND " | " OR " | " XOR ") ("NOT ")? test)*',
        "test": 'value op value | value " IS " ("NOT ")? "NULL" | value " IN [" value (", " value)* "]" | "EXISTS { " pattern " }" | "(" condition ")"',
        "op": '" = " | " <> " | " < " | " <= " | " > " | " >= " | " CONTAINS " | " STARTS WITH " | " ENDS WITH " | " =~ "',
        "items": 'item (", " item)*',
        "item": '(value | aggregate) " AS " name',
        "aggregate": '("count" | "sum" | "avg" | "min" | "max" | "collect") "(" ("DISTINCT ")? value ")"',
        "order": '" ORDER BY " name (" DESC")? (", " name (" DESC")?)*',
        "skip": '" SKIP " [0-9]+',
        "limit": '" LIMIT " [1-9] [0-9]*',
        "value": 'name "." property | name | string | number | "$" name',
        "label": quoted(n.label for n in graph.nodes),
        "type": quoted(e.type for e in graph.edges),
        "property": quoted(props) if not graph.props else "name",
        "name": "[a-z] [a-zA-Z0-9_]*",
        "string": "\"'\" [^']* \"'\"",
        "number": '"-"? [0-9]+ ("." [0-9]+)?',
    }
    return "\n".join(f"{k} ::= {v}" for k, v in rules.items()) + "\n"


def explained(graph: Graph, text: str, params: dict | None = None) -> str:
    """The program that a query is compiled to, with the answer's columns."""
    program, columns = compile_query(graph, text, params)
    return f"{show(program)}\ncolumns: {', '.join(columns)}"
