"""A host's own generators in Python, and walks over steps that a host defines.

Functions that Spark's columns can't express run over whole frames: the distinct inputs are dealt to
tasks in Arrow batches, the function is called once for each, and what it returns is joined back. So
a generator is called as often as there are distinct inputs, whatever the number of bindings.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataflow.functions.registry import Predicate
from strataflow.values import Kind, kind_of

ROWS = 10_000


@dataclass(frozen=True)
class Generator:
    """Arguments that a call must give, those that it makes, their Spark types, and the function from values of the former to
    rows of the latter. Arguments in `constants` are handed over as they are written, and no column is made of them.
    A volatile one is called again for every place of a program, so that equal calls may differ."""

    needs: tuple[int, ...]
    gives: tuple[int, ...]
    types: tuple[str, ...]
    call: Callable[..., Iterable]
    constants: tuple[int, ...] = ()
    volatile: bool = False

    @property
    def kinds(self) -> list[Kind]:
        return [kind_of(t) for t in self.schema()]

    def schema(self) -> list[T.DataType]:
        return [T.DataType.fromDDL(t) for t in self.types]

    def over(self, asked: DataFrame, fixed: list) -> DataFrame:
        """asked (n0, n1, ...), with the columns g0, g1, ... of every row that the function returns for it."""
        if self.volatile:
            # A column of its own keeps Spark from answering two equal calls with one.
            asked = asked.withColumn("~once", F.lit(uuid.uuid4().hex))
        schema = T.StructType([*asked.schema.fields, *[T.StructField(f"g{i}", t) for i, t in enumerate(self.schema())]])
        shape, call, inputs = to_arrow_schema(schema), self.call, len(self.needs)

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list = []
            for batch in batches:
                for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    for out in call(*values[:inputs], *fixed) or ():
                        rows.append((*values, *(out if isinstance(out, tuple) else (out,))))
                        if len(rows) >= ROWS:
                            yield made(rows)
                            rows = []
            yield made(rows)

        return asked.mapInArrow(run, schema).drop("~once")


def generator(call: Callable[..., Iterable], name: str, needs: tuple[int, ...], gives: tuple[int, ...], types: tuple[str, ...], **more) -> Predicate:
    """A predicate that a Python function generates: it gets the needed values, then the constant ones, and returns tuples of
    the given ones, or single values where there is one. Null is a value like others."""
    doc, least = more.pop("doc", ""), more.pop("least", None)
    g = Generator(needs, gives, types, call, **more)
    return Predicate(name, len(needs) + len(gives) + len(g.constants), doc=doc, constants=g.constants, frame=g, least=least)


def reached(step: Callable[[object], Iterable], start: object) -> Iterator[tuple[object, int]]:
    """(node, fewest steps) of what steps lead to from a start, in one or more."""
    level, seen, depth = {start}, set(), 0
    while level:
        depth += 1
        level = {n for x in level for n in step(x)} - seen
        seen |= level
        for n in level:
            yield n, depth


def reach(name: str, step: Callable[[object], Iterable], node: str = "string") -> Predicate:
    """name(start, node): what a host's step leads to from a bound start."""
    return generator(lambda s: (n for n, _ in reached(step, s)), name, (0,), (1,), (node,))


def hops(name: str, step: Callable[[object], Iterable], node: str = "string") -> Predicate:
    """name(start, node, steps): the same with the fewest steps."""
    return generator(lambda s: reached(step, s), name, (0,), (1, 2), (node, "bigint"))


def shown(nodes: list, edges: list | None) -> str:
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), default=str)
    nodes = [plain(x) for x in nodes]
    return dump(nodes) if edges is None else dump({"nodes": nodes, "edges": [plain(x) for x in edges]})


def simple_paths(step: Callable[[object], Iterable], start: object, most: int, named: bool) -> Iterator[tuple[object, str]]:
    """Paths of one to `most` steps that pass no node twice."""
    stack: list[tuple[list, list]] = [([start], [])]
    while stack:
        nodes, edges = stack.pop()
        if edges:
            yield nodes[-1], shown(nodes, edges if named else None)
        if len(edges) < most:
            for found in step(nodes[-1]):
                edge, n = found if named else (None, found)
                if n not in nodes:
                    stack.append(([*nodes, n], [*edges, edge]))


def paths(name: str, step: Callable[[object], Iterable], most: int, node: str = "string") -> Predicate:
    """name(start, node, path): the acyclic paths of at most so many steps, each once."""
    return generator(lambda s: dict.fromkeys(simple_paths(step, s, most, False)), name, (0,), (1, 2), (node, "string"))


def edge_paths(name: str, step: Callable[[object], Iterable], most: int, node: str = "string") -> Predicate:
    """The same for a step that returns (edge, node): paths tell their edges."""
    return generator(lambda s: dict.fromkeys(simple_paths(step, s, most, True)), name, (0,), (1, 2), (node, "string"))
