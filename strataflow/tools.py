"""What an agent server offers: the engine behind functions from JSON to JSON. Answers are cut at a stated number of rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strataflow.engine import Engine
from strataflow.errors import BudgetExceeded, CheckError, SyntaxRefused

ROWS = 200


class Tools:
    def __init__(self, engine: Engine, graph=None, rows: int = ROWS) -> None:
        self.engine, self.graph, self.rows = engine, graph, rows

    def call(self, name: str, arguments: dict) -> str:
        """The result of a tool, or what is wrong with the question, as JSON."""
        tool = {"query": self.query, "cypher": self.cypher, "schema": self.schema, "look": self.look, "values": self.values, "find": self.find, "explain": self.explain}.get(name)
        if tool is None:
            return json.dumps({"error": f"no tool {name}"})
        try:
            return json.dumps(tool(**arguments), ensure_ascii=False, default=str)
        except (CheckError, SyntaxRefused, BudgetExceeded, ValueError, TypeError) as e:
            return json.dumps({"error": str(e), "kind": getattr(e, "kind", "syntax")}, ensure_ascii=False)

    def table(self, df) -> dict:
        found = df.limit(self.rows + 1).collect()
        return {"columns": df.columns, "rows": [list(r) for r in found[: self.rows]], "more": len(found) > self.rows}

    def query(self, program: str, params: dict | None = None) -> dict:
        return self.table(self.engine.query(program, params=params, ordered=True))

    def cypher(self, query: str, params: dict | None = None) -> dict:
        if self.graph is None:
            raise CheckError("unknown", "no graph view")
        return self.table(self.engine.cypher(self.graph, query, params, ordered=True))

    def schema(self, prefix: str = "") -> dict:
        c = self.engine.catalog
        return {"relations": [c.describe(n) for n in c.members(prefix) if n in c.relations], "predicates": [n for n in c.members(prefix) if n in c.predicates], "modules": sorted(c.modules)}

    def look(self, name: str) -> dict:
        """A relation's columns and a few of its rows, or a predicate's modes."""
        c = self.engine.catalog
        out: dict = {"about": c.describe(name)}
        if name in c.relations:
            out |= self.table(c.relations[name].df.select(*c.relations[name].labels).limit(5))
        return out

    def values(self, relation: str, column: str) -> dict:
        """A column's commonest values."""
        r = self.engine.catalog.relations[relation]
        return self.table(r.df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.asc(column)).limit(50))

    def find(self, text: str) -> dict:
        """Columns of text that hold a value with this in it."""
        out = []
        for name, r in self.engine.catalog.relations.items():
            for column, kind in zip(r.labels, r.kinds, strict=True):
                if kind.name == "text" and (hit := r.df.where(F.contains(F.lower(F.col(column)), F.lit(text.lower()))).select(column).limit(1).collect()):
                    out.append({"relation": name, "column": column, "value": hit[0][0]})
        return {"found": out}

    def explain(self, program: str) -> dict:
        return {"plan": self.engine.explain(program), "empty": self.engine.why_empty(program), "warnings": self.engine.lint(program)}
