"""Facts and changes as text: a loader for small files of facts, and a wire form of changes."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from strataflow.errors import SyntaxRefused
from strataflow.plans.text import Reader
from strataflow.plans.tree import Const, Wild
from strataflow.sources.catalog import Catalog
from strataflow.sources.storage import file_system, write


def read_facts(text: str) -> tuple[dict[str, list[tuple]], dict[str, list[str]], dict[str, list[str]]]:
    """Rows, column names and units by relation, from lines such as `edge("a", "b")` or `volts("r1", 3.3V)`.

    A line `#: edge(from, to)` names columns; `_` is an absent value; other lines that begin with # are comments.
    """
    rows: dict[str, list[tuple]] = {}
    names: dict[str, list[str]] = {}
    units: dict[str, list[str]] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if line.startswith("#:"):
            head, _, inside = line[2:].strip().rstrip(")").partition("(")
            names[head.strip()] = [c.strip() for c in inside.split(",") if c.strip()]
            continue
        if not line or line.startswith("#"):
            continue
        try:
            atom = Reader(line.rstrip(".;")).atom()
        except SyntaxRefused as e:
            raise SyntaxRefused(f"line {number}: {e}", e.at) from None
        if any(not isinstance(a, (Const, Wild)) for a in atom.args):
            raise SyntaxRefused(f"line {number}: a fact holds constants only")
        values = tuple(None if isinstance(a, Wild) else a.value for a in atom.args)
        if rows.setdefault(atom.rel, []) and len(rows[atom.rel][0]) != len(values):
            raise SyntaxRefused(f"line {number}: {atom.rel} has {len(rows[atom.rel][0])} arguments")
        rows[atom.rel].append(values)
        known = units.setdefault(atom.rel, [""] * len(values))
        for i, a in enumerate(atom.args):
            if isinstance(a, Const) and a.unit:
                known[i] = a.unit
    return rows, names, units


def load(catalog: Catalog, text: str) -> Catalog:
    """Registers the relations of a text of facts. A column of whole numbers is long, of other numbers double, else text."""
    rows, names, units = read_facts(text)
    for rel, tuples in rows.items():
        columns = names.get(rel) or [f"c{i}" for i in range(len(tuples[0]))]
        kinds = []
        for i in range(len(columns)):
            found = [t[i] for t in tuples if t[i] is not None]
            numbers = bool(found) and all(isinstance(v, (int, float)) for v in found)
            kinds.append("string" if not numbers else "bigint" if all(isinstance(v, int) for v in found) else "double")
        cast = {"string": lambda v: v if v is None or isinstance(v, str) else f"{v:g}", "bigint": lambda v: v, "double": lambda v: None if v is None else float(v)}
        clean = [tuple(cast[k](v) for k, v in zip(kinds, t, strict=True)) for t in tuples]
        schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True))
        catalog.rows(rel, clean, schema, units={c: u for c, u in zip(columns, units[rel], strict=True) if u})
    return catalog


def encode_changes(changes: Iterable[tuple[str, str, tuple]]) -> str:
    """(added or removed, relation, values) in order, as lines of JSON."""
    return "".join(json.dumps({"op": op, "rel": rel, "values": list(values)}, ensure_ascii=False) + "\n" for op, rel, values in changes)


def decode_changes(text: str) -> list[tuple[str, str, tuple]]:
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if line.strip():
            entry = json.loads(line)
            if entry.get("op") not in ("added", "removed"):
                raise SyntaxRefused(f"line {number}: op is added or removed")
            out.append((entry["op"], entry["rel"], tuple(entry["values"])))
    return out


def changes_of(spark: SparkSession, rel: DataFrame, name: str, changes: Iterable[tuple[str, str, tuple]]) -> DataFrame:
    """The changes of one relation as rows (seq, change, its columns), for versions.applied and versions.committed."""
    from pyspark.sql import types as T

    from strataflow.sources.catalog import HIDDEN

    fields = [f for f in rel.schema if f.name not in HIDDEN]
    schema = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("change", T.StringType()), *[T.StructField(f.name, f.dataType) for f in fields]])
    return spark.createDataFrame([(i, op, *values) for i, (op, r, values) in enumerate(changes) if r == name], schema)


class Conflict(RuntimeError):
    """Changes to a version that isn't the latest any more."""


class Store:
    """A relation kept in a folder as numbered versions of Parquet. A version is there once it is written whole, and is never
    changed, so readers see one version or the next. Of two writers that change the same version one is refused."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        fs, path = file_system(self.spark, f"{self.folder}/v*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()[1:]) for s in (fs.globStatus(path) or []))

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        at = self.latest() if version is None else version
        if at is None:
            raise FileNotFoundError(f"{self.folder} holds no version")
        return self.spark.read.parquet(f"{self.folder}/v{at}")

    def create(self, df: DataFrame) -> int:
        return self._write(df, 0)

    def _write(self, df: DataFrame, version: int) -> int:
        try:
            df.write.mode("error").parquet(f"{self.folder}/v{version}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise Conflict(f"version {version} is already there") from None
            raise
        return version

    def apply(self, changes: DataFrame, base: int | None = None) -> int:
        """The version that the changes (seq, change, values) make of the latest one, which must be `base` if that is given."""
        from strataflow.operators.versions import applied

        now = self.latest()
        if now is None or (base is not None and base != now):
            raise Conflict(f"the latest version is {now}, not {base}")
        return self._write(applied(self.read(now), changes), now + 1)


class Session:
    """Changes of one relation of a store, gathered and seen before they are made."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name, self.base = store, name, store.latest()
        self.changes: list[tuple[str, str, tuple]] = []

    def add(self, *values: object) -> Session:
        self.changes.append(("added", self.name, values))
        return self

    def remove(self, *values: object) -> Session:
        self.changes.append(("removed", self.name, values))
        return self

    def rows(self) -> DataFrame:
        return changes_of(self.store.spark, self.store.read(self.base), self.name, self.changes)

    def view(self) -> DataFrame:
        from strataflow.operators.versions import applied

        return applied(self.store.read(self.base), self.rows())

    def commit(self) -> int:
        self.base = self.store.apply(self.rows(), self.base)
        self.changes = []
        return self.base


def save(df: DataFrame, path: str | None = None) -> str:
    """Writes a relation as Parquet and returns where; without a path, to the shared folder."""
    if path is None:
        return write(df, "saved")
    df.write.mode("overwrite").parquet(path)
    return path
