"""Relations that live in another store, read through a host's own functions.

A host registers a function from bound columns to rows. As a Spark data source it takes Spark's pushed
filters, equalities as the bound columns and other tests beside them, so a goal with a constant asks
the store for what it needs only; what the store returns beyond it, Spark filters. A partition function
splits a whole read among tasks.

What else a store may offer is used where a program asks for it: the columns that it finds rows by
quickly, which a join then sends in batches of keys, from the tasks that hold them; walks, groups and
pages, which it answers itself.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema

from strataflow.sources.catalog import Catalog

TESTS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "prefix", StringEndsWith: "suffix", StringContains: "contains"}


class Asked(dict):
    """Bound columns, {column: list of values}; `tests` are further conditions (operator, column, value) that rows must meet."""

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self.tests: list[tuple[str, str, object]] = []


Lookup = Callable[[Asked, object], Iterable[tuple]]
#: Rows that each worker keeps of looked-up keys, by store and version: those of the keys that were asked for last.
_kept: dict[tuple, OrderedDict] = {}


@dataclass
class Store:
    """keys are the columns that rows are found by quickly. walk(starts, low, high) returns (start, node, steps) of the relation's
    own closure; summarize(bound, columns, aggregates) a row a group, the columns' values and then those of the aggregates
    (function, column); page(bound, order, n) the first n rows by (column, descending), any n without an order.
    push(atoms, variables) joins atoms of relations with the same `home` and returns a row of the variables' values for each way that
    they hold together; an atom is (relation, arguments), an argument ("var", name), ("const", value) or None. batch is the keys of one call."""

    name: str
    schema: T.StructType
    lookup: Lookup
    partitions: tuple = (None,)
    keys: tuple[str, ...] = ()
    walk: Callable | None = None
    summarize: Callable | None = None
    page: Callable | None = None
    push: Callable | None = None
    home: str = ""
    batch: int = 1_000
    cache: int = 0
    token: object = None

    def fetch(self, asked: DataFrame) -> DataFrame:
        """The rows for the distinct keys of `asked`, whose columns are some of `keys`: a call a batch, in the tasks that hold them."""
        names, schema = asked.columns, self.schema
        shape, places = to_arrow_schema(schema), [schema.names.index(n) for n in names]
        lookup, parts, size, cache, token = self.lookup, self.partitions, self.batch, self.cache, (self.name, repr(self.token))

        def found(keys: list[tuple]) -> list[tuple]:
            held = _kept.setdefault(token, OrderedDict()) if cache else OrderedDict()
            for old in [t for t in _kept if t[0] == token[0] and t != token]:
                del _kept[old]
            new = [k for k in keys if k not in held]
            rows = {k: [] for k in new}
            if new:
                bound = Asked({n: list(dict.fromkeys(k[i] for k in new)) for i, n in enumerate(names)})
                for part in parts:
                    for r in lookup(bound, part):
                        if (k := tuple(r[p] for p in places)) in rows:
                            rows[k].append(tuple(r))
            out = [r for k in keys for r in (held[k] if k in held else rows[k])]
            if cache:
                for k in keys:
                    held[k] = held.pop(k, None) or rows.get(k, [])
                while len(held) > 1 and sum(len(v) + 1 for v in held.values()) > cache:
                    held.popitem(last=False)
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = list(zip(*[c.to_pylist() for c in b.columns], strict=True))
                for i in range(0, len(keys), size):
                    yield record(found(keys[i : i + size]), shape)

        return asked.distinct().mapInArrow(run, schema)

    def walked(self, starts: DataFrame, low: int, high: int, node: T.DataType) -> DataFrame:
        """(f, t, hops) from the distinct starts, as the store tells."""
        schema = T.StructType([T.StructField("f", node), T.StructField("t", node), T.StructField("hops", T.LongType())])
        shape, walk, size = to_arrow_schema(schema), self.walk, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                nodes = b.column(0).to_pylist()
                for i in range(0, len(nodes), size):
                    yield record(list(walk(nodes[i : i + size], low, high)), shape)

        return starts.distinct().mapInArrow(run, schema)

    def told(self, spark: SparkSession, schema: T.StructType, call: Callable[[], Iterable[tuple]]) -> DataFrame:
        """What one call returns, made in a task."""
        shape = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in batches):
                rows: list[tuple] = []
                for r in call():
                    rows.append(tuple(r))
                    if len(rows) >= 10_000:
                        yield record(rows, shape)
                        rows = []
                yield record(rows, shape)

        return spark.range(1).coalesce(1).mapInArrow(run, schema)


def record(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)


class Part(InputPartition):
    pass


def source_of(name: str, schema: str, lookup: Lookup, partitions: Iterable[object] = (None,)) -> type[DataSource]:
    """A data source class; lookup gets what is asked for and one of the partitions, and may return too many rows."""
    parts = list(partitions)

    class Reader(DataSourceReader):
        def __init__(self) -> None:
            self.asked = Asked()
            self.tests: list[tuple[str, str, object]] = []

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                if len(getattr(f, "attribute", ())) == 1:
                    column = f.attribute[0]
                    if isinstance(f, EqualTo):
                        self.asked[column] = [f.value]
                    elif isinstance(f, In):
                        self.asked[column] = list(f.value)
                    elif type(f) in TESTS:
                        self.tests.append((TESTS[type(f)], column, f.value))
                yield f  # Spark checks every row again

        def partitions(self) -> list[InputPartition]:
            return [Part(p) for p in parts]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            asked = Asked(self.asked)
            asked.tests = self.tests
            yield from lookup(asked, partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return Reader()

    return Source


def register(catalog: Catalog, name: str, schema: str, lookup: Lookup, partitions: Iterable[object] = (None,), offers: dict | None = None, **more) -> Catalog:
    """Adds the store's relation to a catalog; offers are Store's further fields. It is opened anew for every atom, as a reader
    keeps the filters it was given. Sets spark.sql.python.filterPushdown.enabled for the session, which other Python data
    sources of the session see too."""
    spark = catalog.spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    parts = tuple(partitions)
    spark.dataSource.register(source_of(name, schema, lookup, parts))
    opened = lambda: spark.read.format(name).load()
    df = opened()
    return catalog.add(name, df, reload=opened, store=Store(name, df.schema, lookup, parts, **(offers or {})), **more)
