"""Relations, predicates and modules by name.

A relation is any DataFrame: Parquet files, a JDBC table, rows of the program. What the reference
design does with lookups, pushed joins, pages and summaries is left to Spark's planner, which sees
the whole plan: filters and columns reach the scan, aggregates are partial before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.errors import CheckError, suggestion
from strataflow.functions.registry import Predicate, simplifying, standard
from strataflow.functions.units import base
from strataflow.plans.text import parse_rules
from strataflow.plans.tree import Rule
from strataflow.values import Kind, kind_of

HIDDEN = ("__cites", "__id", "__versions")


@dataclass
class Relation:
    """df's visible columns are the arguments, in order. `required` columns hold no null, which spares joins
    null-safe keys; those of `key` tell facts apart, which spares answers that show them a distinct; `units`, `domains` and `entities` (what a column's values name) are by column; `__cites`, `__id` and `__versions` are hidden columns. `reload` opens a source anew
    for every atom, for those that keep what was pushed to them."""

    df: DataFrame
    required: frozenset[str] = frozenset()
    units: dict[str, str] = field(default_factory=dict)
    domains: dict[str, tuple] = field(default_factory=dict)
    doc: str = ""
    entities: dict[str, str] = field(default_factory=dict)
    reload: Callable[[], DataFrame] | None = None
    key: tuple[str, ...] = ()
    store: object = None  # what a store can do beyond being read: see sources.lookup
    version: Callable[[], object] | None = None  # a token that changes with the facts

    @property
    def labels(self) -> list[str]:
        return [c for c in self.df.columns if c not in HIDDEN]

    @property
    def kinds(self) -> list[Kind]:
        fields = {f.name: f for f in self.df.schema}
        return [kind_of(fields[c].dataType, fields[c].nullable and c not in self.required, self.units.get(c, "")) for c in self.labels]


class Catalog:
    """simplify cuts results of arithmetic to 15 digits where both operands can still be had back; it costs time."""

    def __init__(self, spark: SparkSession, simplify: bool = False) -> None:
        self.spark, self.simplify = spark, simplify
        self.relations: dict[str, Relation] = {}
        self.predicates: dict[str, Predicate] = standard() | (simplifying() if simplify else {})
        self.modules: dict[str, tuple[Rule, ...]] = {}

    def add(self, name: str, df: DataFrame, **more) -> Catalog:
        """A base relation. Units given with a prefix are folded: values are kept in base units."""
        if name in self.predicates or name.startswith("graph."):
            raise CheckError("redefined", f"{name} is a predicate")
        units = {}
        for column, unit in dict(more.pop("units", {})).items():
            factor, of = base(unit)
            units[column] = of
            if factor != 1:
                df = df.withColumn(column, F.col(column) * factor)
        self.relations[name] = Relation(df, frozenset(more.pop("required", ())), units, **more)
        return self

    def rows(self, name: str, rows: Iterable[tuple], schema: str, **more) -> Catalog:
        """A base relation from rows in the program."""
        return self.add(name, self.spark.createDataFrame(list(rows), schema), **more)

    def parquet(self, folder: str, names: Iterable[str], required: dict[str, Iterable[str]] | None = None, keys: dict[str, Iterable[str]] | None = None) -> Catalog:
        for name in names:
            self.add(name, self.spark.read.parquet(f"{folder}/{name}.parquet"), required=(required or {}).get(name, ()), key=tuple((keys or {}).get(name, ())))
        return self

    def predicate(self, p: Predicate) -> Catalog:
        if p.name in self.relations:
            raise CheckError("redefined", f"{p.name} is a relation")
        self.predicates[p.name] = p
        return self

    def module(self, name: str, text: str) -> Catalog:
        """Rules by name: their heads are read as name.head elsewhere, and those that begin with _ stay private."""
        rules = parse_rules(text)
        own = {r.rel for r in rules}
        from strataflow.plans.rewrite import renamed

        self.modules[name] = tuple(renamed(r, {n: f"{name}.{n}" for n in own}) for r in rules)
        return self

    def modules_in(self, folder: str, suffix: str = ".dl") -> Catalog:
        for f in sorted(Path(folder).rglob(f"*{suffix}")):
            self.module(".".join(f.relative_to(folder).with_suffix("").parts), f.read_text())
        return self

    def exported(self) -> dict[str, list[Rule]]:
        out: dict[str, list[Rule]] = {}
        for rules in self.modules.values():
            for r in rules:
                out.setdefault(r.rel, []).append(r)
        return out

    def names(self) -> list[str]:
        return [*self.relations, *self.predicates, *self.exported(), "graph.closure", "graph.paths"]

    def members(self, prefix: str = "") -> list[str]:
        """Names under a dotted prefix, for browsing; private ones are left out."""
        dot = f"{prefix}." if prefix else ""
        return sorted(n for n in self.names() if n.startswith(dot) and not n[len(dot) :].split(".")[-1].startswith("_"))

    def describe(self, name: str) -> str:
        if r := self.relations.get(name):
            args = ", ".join(f"{c}: {k.name}{f'[{k.unit}]' if k.unit else ''}" for c, k in zip(r.labels, r.kinds, strict=True))
            return f"{name}({args})" + (f"  {r.doc}" if r.doc else "")
        if p := self.predicates.get(name):
            ways = "test" if p.test else "; ".join(f"{m.needs}->{m.gives}" for m in p.modes)
            return f"{name}/{p.arity} {ways}" + (f"  {p.doc}" if p.doc else "")
        raise CheckError("unknown", f"no {name}{suggestion(name, self.names())}")


def prefixed(cites: Column, prefix: str) -> Column:
    return F.transform(cites, lambda c: F.concat(F.lit(prefix), c))


def federated(members: dict[str, DataFrame], holds: dict[str, Callable] | None = None) -> DataFrame:
    """The union of members' relations; citations get the member's name in front. A member's `holds`, a function
    from its DataFrame to a condition, says which facts it may have; Spark prunes what can't match. Facts of a member without
    versions hold in every version that others tell."""
    parts = []
    timed = any("__versions" in df.columns for df in members.values())
    for name, df in members.items():
        if timed and "__versions" not in df.columns:
            df = df.withColumn("__versions", F.expr(f"array(named_struct('from', 0L, 'to', {1 << 62}L))"))
        if "__cites" in df.columns:
            df = df.withColumn("__cites", prefixed(F.col("__cites"), f"{name}/"))
        parts.append(df.where(holds[name](df)) if holds and name in holds else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def overlaid(df: DataFrame, removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """df without the removed facts and with the added ones; facts are compared by value, absent equal to absent."""
    names = [c for c in df.columns if c not in HIDDEN]
    if removed is not None:
        gone = removed.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(names)])
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r{i}")) for i, c in enumerate(names)])
        df = df.join(gone, on, "left_anti")
    return df if added is None else df.unionByName(added, allowMissingColumns=True)
