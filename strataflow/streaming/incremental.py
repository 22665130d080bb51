"""A monotone program kept up to date as facts arrive.

Without negation, aggregates and optionals new facts only add answers, so each micro-batch of a
stream is a delta for the semi-naive step: rules run with the batch in place of its relation, and what
is new feeds the recursive rules until nothing is. State is Parquet in the shared folder, one file
set a batch, and a batch that is delivered again adds nothing. With a folder of its own the state
outlives the session: a manifest, written after each batch, names its file sets and the last batch, and
whoever is started on that folder again goes on from there. Many file sets are joined into one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.engine import Engine
from strataflow.errors import CheckError
from strataflow.plans import rewrite
from strataflow.plans.compiler import Compiler, Rel
from strataflow.plans.text import parse_rules
from strataflow.plans.tree import Agg, Atom, Compare
from strataflow.sources.storage import drop_path, file_system, shared_folder, write
from strataflow.values import Kind

#: File sets of a relation that are joined into one.
SETS = 24


class Maintained:
    """The tuples of `target` under rules over one growing base relation and others that stay as they are."""

    def __init__(self, engine: Engine, rules: str, target: str, grows: str, folder: str | None = None) -> None:
        self.engine, self.target, self.grows = engine, target, grows
        self.rules = parse_rules(rules)
        for r in self.rules:
            if any(not isinstance(x, (Atom, Compare)) for x in r.body) or any(isinstance(a, Agg) for a in r.args):
                raise CheckError("recursion", "only programs of atoms and comparisons can be maintained")
        self.spark = engine.spark
        shared_folder(self.spark)
        self.schema = engine.catalog.relations[grows].df.schema
        self.folder, self.saved = folder, 0
        self.paths: dict[str, list[str]] = {r.rel: [] for r in self.rules}
        self.kinds: dict[str, list] = {}
        self.last = -1
        if self.resumed():
            return
        self.facts = [write(engine.catalog.relations[grows].df, "facts", folder)]
        self.advance(self.spark.read.schema(self.schema).parquet(self.facts[0]), None)

    def resumed(self) -> bool:
        """Takes up what the newest manifest of the folder names."""
        if not self.folder:
            return False
        fs, path = file_system(self.spark, f"{self.folder}/manifest-*/_SUCCESS")
        names = sorted(s.getPath().getParent().getName() for s in (fs.globStatus(path) or []))
        if not names:
            return False
        found = json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}").first()[0])
        self.saved, self.facts, self.paths, self.last = found["saved"], found["facts"], found["paths"], found["last"]
        self.kinds = {n: [Kind(**k) for k in ks] for n, ks in found["kinds"].items()}
        return True

    def save(self) -> None:
        """Joins file sets where there are many, and writes the manifest; what it no longer names goes after it is written."""
        gone: list[str] = []
        for held, label in [(self.facts, "facts"), *[(p, f"state-{n}") for n, p in self.paths.items()]]:
            if len(held) > SETS:
                gone += held
                held[:] = [write(self.spark.read.parquet(*held), label, self.folder)]
                self.compiler()  # the catalog's relation reads what is kept
        if self.folder:
            self.saved += 1
            text = json.dumps({"saved": self.saved, "facts": self.facts, "paths": self.paths, "last": self.last, "kinds": {n: [asdict(k) for k in ks] for n, ks in self.kinds.items()}})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.saved:012d}")
            if self.saved > 2:
                gone.append(f"{self.folder}/manifest-{self.saved - 2:012d}")
        for path in gone:
            drop_path(self.spark, path)

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self.paths[name])

    def compiler(self) -> Compiler:
        e = self.engine
        old = e.catalog.relations[self.grows]
        e.catalog.add(self.grows, self.spark.read.schema(self.schema).parquet(*self.facts), required=old.required)
        return Compiler(e.catalog, self.rules)

    def advance(self, batch: DataFrame, batch_id: int | None) -> int:
        """Takes a batch of facts in; the number of new tuples of the target."""
        if batch_id is not None:
            if batch_id <= self.last:
                return 0
            self.last = batch_id
            self.facts.append(write(batch.select(*self.schema.names), "facts", self.folder))
        c = self.compiler()
        if not self.kinds:
            for group in rewrite.components(c.rules):
                for n in group:
                    self.kinds[n] = c.relation(n).kinds
            for n in self.kinds:
                self.paths[n].append(write(c.relation(n).df, f"state-{n}", self.folder))
            self.save()
            return self.stored(self.target).count()
        base = c.relation(self.grows)
        delta: dict[str, Rel] = {self.grows: Rel(self.spark.read.schema(self.schema).parquet(self.facts[-1]).toDF(*[f"a{i}" for i in range(len(self.schema))]).withColumn("__id", F.lit(None).cast("string")), base.kinds)}
        total = {n: Rel(self.stored(n), self.kinds[n]) for n in self.kinds}
        added = 0
        while delta:
            found: dict[str, list[Rel]] = {}
            for r in self.rules:
                for i, x in enumerate(r.body):
                    if isinstance(x, Atom) and x.rel in delta:
                        swap = {j: delta[x.rel] if j == i else total[y.rel] for j, y in enumerate(r.body) if isinstance(y, Atom) and (j == i or y.rel in total)}
                        found.setdefault(r.rel, []).append(c.head(r, swap))
            delta = {}
            for n, parts in found.items():
                new = c.plain(c.union([c.cast(p, self.kinds[n]) for p in parts]).df, self.kinds[n])
                old = total[n].df.toDF(*[f"o{i}" for i in range(len(self.kinds[n]))])
                on = [F.col(f"a{i}").eqNullSafe(F.col(f"o{i}")) for i in range(len(self.kinds[n]))]
                condition = on[0]
                for x in on[1:]:
                    condition = condition & x
                path = write(new.join(old, condition, "left_anti"), f"state-{n}", self.folder)
                count = self.spark.read.parquet(path).count()
                if count:
                    self.paths[n].append(path)
                    delta[n] = Rel(self.spark.read.parquet(path), self.kinds[n])
                    total[n] = Rel(self.stored(n), self.kinds[n])
                    added += count if n == self.target else 0
        self.save()
        return added

    def answer(self) -> DataFrame:
        """The target's tuples so far; to be read before later batches join file sets."""
        return self.stored(self.target)

    def start(self, stream: DataFrame, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None):
        """A streaming query that takes in every micro-batch; `after` sees the answer following each."""

        def take(batch: DataFrame, batch_id: int) -> None:
            self.advance(batch, batch_id)
            if after:
                after(self.answer(), batch_id)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
