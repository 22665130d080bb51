"""Walks of a relation of edges (f, t) or (f, e, t): reachability with fewest steps, and paths.

Either walk runs in one of two ways with the same answers and under the same limits. A relation of few
edges, counted first, is sent to every task as an adjacency table, and each task walks from its own
starts: one job however deep the graph is. A larger one is walked by joins, a round a step; each round's
rows are written to the shared folder, so that plans stay small and a lost executor costs a round.

Edges may carry citations, in a column c: a walk then tells those of its edges together, sorted. Of several
shortest walks between two nodes it keeps, step by step, the one whose citations are least.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.errors import BudgetExceeded
from strataflow.limits import Limits
from strataflow.sources.storage import cut, write

MODES = ("walk", "trail", "acyclic", "simple", "shortest")
#: Edges up to this number are sent to every task.
SMALL = 200_000
#: Pairs of connected nodes that one task makes, and the most tasks they are dealt to.
PAIRS, MOST_TASKS = 4_000_000, 10_000


def closure(edges: DataFrame, low: int, high: int, start=None, end=None, limits: Limits | None = None) -> DataFrame:
    """(f, t, hops), and c if the edges have it: t is reached from f in low to high steps, high 0 for any number; hops is the fewest.

    start and end are a value, a DataFrame of values s, or nothing. One given end is walked from; a second
    one filters. Nodes repeat below low, as in a walk. With low 0 each node of the relation reaches itself in none.
    """
    if start is None and end is not None:
        rest = [c for c in edges.columns if c not in ("f", "t")]
        back = closure(edges.select(F.col("t").alias("f"), F.col("f").alias("t"), *rest), low, high, end, None, limits)
        return back.select(F.col("t").alias("f"), F.col("f").alias("t"), "hops", *rest)
    limits = limits or Limits()
    edges = least_cited(edges, ["f", "t"])
    nodes = edges.select("f").union(edges.select("t")).distinct()
    starts = seeds(nodes, start)
    if "c" not in edges.columns and (known := small(edges, limits)) is not None:
        out = ran(by_tables(known, starts, low, high, edges.schema, limits.rounds), len(known) + low, limits)
    else:
        out = by_joins(edges, starts, low, high, limits)
    if end is not None:
        out = out.join(end.select(F.col("s").alias("~e")), F.col("t").eqNullSafe(F.col("~e")), "left_semi") if isinstance(end, DataFrame) else out.where(F.col("t").eqNullSafe(end))
    return out


def together(links: DataFrame, limits: Limits | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(f, t) for any two nodes, or one and itself, that the links (f, t), taken either way, connect. Nodes are whole numbers
    or text, none is absent. Few links are put together on the driver, more of them by rounds of joins."""
    limits = limits or Limits()
    known = small(links, limits)
    if known is not None:
        roots = components(known)
        sizes = Counter(roots.values())
        pairs = sum(n * n for n in sizes.values())
        made = pa.table([pa.array(list(x), pa.string() if links.schema["f"].dataType.typeName() == "string" else pa.int64()) for x in (roots.keys(), roots.values())], names=["node", "root"])
        labels = links.sparkSession.createDataFrame(made).select(*[F.col(c).cast(links.schema["f"].dataType) for c in ("node", "root")])
    else:
        labels = components_by_joins(links, limits)
        pairs = int(labels.groupBy("root").count().agg(F.coalesce(F.sum(F.col("count").cast("decimal(38,0)") * F.col("count")), F.lit(0))).head()[0])
    here = labels.select(F.col("node").alias("f"), "root")
    there = labels.select(F.col("node").alias("t"), F.col("root").alias("~r"))
    if start is not None:
        here = here.where(F.col("f").eqNullSafe(start))
    elif pairs > PAIRS:
        here = here.repartition(min(MOST_TASKS, pairs // PAIRS + 1), "f")
    if end is not None:
        there = there.where(F.col("t").eqNullSafe(end))
    out = here.join(there if known is None else F.broadcast(there), F.col("root") == F.col("~r")).select("f", "t")
    if limits.counts:
        limits.total(pairs if start is None and end is None else out.count(), "a walk")
    return out


def components(links: list) -> dict:
    """The root of every node of the links: one node for all that are connected."""
    up: dict = {}

    def root(n: object) -> object:
        while (above := up.setdefault(n, n)) != n:
            up[n] = up[above]
            n = above
        return n

    for f, t in links:
        up[root(f)] = root(t)
    return {n: root(n) for n in list(up)}


def components_by_joins(links: DataFrame, limits: Limits) -> DataFrame:
    """(node, root) for every node of the links: root is the least node that it reaches. Each round a node, and the node it has
    for a label, take the least label among the node's neighbours, and then the label of that."""
    both = cut(links.select(F.inline(F.array(F.struct("f", "t"), F.struct(F.col("t").alias("f"), F.col("f").alias("t"))))).distinct(), "edges")
    labels = cut(both.groupBy("f").agg(F.min("t").alias("t")).select(F.col("f").alias("node"), F.least("f", "t").alias("root")), "labels")
    depth = 0
    while True:
        depth += 1
        limits.round(depth, "a walk")
        near = both.join(labels, F.col("t") == F.col("node")).groupBy("f").agg(F.min("root").alias("near"))
        found = labels.join(near, F.col("node") == F.col("f"))
        own = F.struct("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        hooked = F.struct(F.col("root").alias("node"), F.col("near").alias("root"), F.lit(None).cast(labels.schema["root"].dataType).alias("old"))
        moved = cut(found.select(F.inline(F.array(own, hooked))).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), "labels")
        above = moved.select(F.col("node").alias("up"), F.col("root").alias("top"))
        labels = cut(moved.join(above, F.col("root") == F.col("up")).select("node", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("fresh")), "labels")
        if labels.where("fresh").isEmpty():
            return labels.select("node", "root")


def seeds(nodes: DataFrame, start) -> DataFrame:
    """The nodes to start from; values that the relation doesn't hold start nothing."""
    nodes = nodes.select(F.col(nodes.columns[0]).alias("f"))
    if start is None:
        return nodes
    if isinstance(start, Column):
        return nodes.where(F.col("f").eqNullSafe(start))
    return nodes.join(start.select(F.col("s").alias("~s")), F.col("f").eqNullSafe(F.col("~s")), "left_semi")


def least_cited(edges: DataFrame, names: list[str]) -> DataFrame:
    """The distinct edges, each with its least citations if it has any."""
    if "c" not in edges.columns:
        return edges.select(*names).distinct()
    return edges.groupBy(*names).agg(F.min(F.array_sort(F.array_distinct("c"))).alias("c"))


def small(edges: DataFrame, limits: Limits) -> list | None:
    """The edges, if they are few: no more than SMALL, or what the limits say, are ever taken."""
    most = SMALL if limits.edges is None else limits.edges
    if not most:
        return None
    rows = edges.limit(most + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= most else None


def ran(out: DataFrame, rounds: int, limits: Limits) -> DataFrame:
    """out, run at once where it might go beyond the limits. `rounds` is the most that a walk without repetitions can take."""
    if limits.rounds > rounds + 1 and not limits.counts:
        return out
    try:
        out = cut(out, "walk")
    except Exception as e:
        if "BudgetExceeded" in str(e):
            raise BudgetExceeded(f"a walk: more than {limits.rounds} rounds") from None
        raise
    if limits.counts:
        limits.total(out.count(), "a walk")
    return out


def by_tables(known: list, starts: DataFrame, low: int, high: int, schema: T.StructType, rounds: int) -> DataFrame:
    table: dict = {}
    for f, t in known:
        table.setdefault(f, []).append(t)
    shared = starts.sparkSession.sparkContext.broadcast(table)
    kind = schema["f"].dataType

    def reach(start: object) -> Iterator[tuple[object, int]]:
        after = shared.value
        level, depth = {start}, 0
        seen: set = set()
        if low == 0:
            seen.add(start)
            yield start, 0
        while level and (not high or depth < high):
            depth += 1
            if depth > rounds:
                raise BudgetExceeded("rounds")
            level = {t for n in level for t in after.get(n, ())}
            if depth >= low:
                level -= seen
                seen |= level
                for n in level:
                    yield n, depth
            elif depth > len(after) * (len(after) + 1):
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list = []
            for s in batch["f"].astype(object):
                s = None if s is None or s is pd.NA or s != s else s
                rows += [(s, t, d) for t, d in reach(s)]
                if len(rows) > 50_000:
                    yield frame(rows, kind)
                    rows = []
            yield frame(rows, kind)

    def frame(rows: list, kind: T.DataType) -> pd.DataFrame:
        return pd.DataFrame({"f": pd.Series([r[0] for r in rows], dtype=object), "t": pd.Series([r[1] for r in rows], dtype=object), "hops": pd.Series([r[2] for r in rows], dtype="int64")})

    return starts.mapInPandas(run, f"f {kind.simpleString()}, t {kind.simpleString()}, hops long")


def by_joins(edges: DataFrame, starts: DataFrame, low: int, high: int, limits: Limits) -> DataFrame:
    spark, cited = edges.sparkSession, "c" in edges.columns
    step = cut(edges.select(F.col("f").alias("ef"), F.col("t").alias("et"), *([F.col("c").alias("ec")] if cited else [])), "edges")
    none = F.array().cast("array<string>").alias("c")
    level = starts.select("f", F.col("f").alias("t"), *([none] if cited else []))
    own = ["f", "t", *(["c"] if cited else [])]
    paths: list[str] = []
    if low == 0:
        paths.append(write(level.withColumn("hops", F.lit(0).cast("long")), "walk"))
    depth, rows = 0, 0
    schema = None
    while not high or depth < high:
        depth += 1
        limits.round(depth, "a walk")
        union = [F.array_sort(F.array_union("c", "ec")).alias("c")] if cited else []
        level = level.join(step, F.col("t").eqNullSafe(F.col("ef"))).select("f", F.col("et").alias("t"), *union)
        level = level.groupBy("f", "t").agg(F.min("c").alias("c")) if cited else level.distinct()
        if depth >= low:
            if paths:
                seen = spark.read.schema(schema or spark.read.parquet(paths[0]).schema).parquet(*paths).select(F.col("f").alias("sf"), F.col("t").alias("st"))
                level = level.join(seen, F.col("f").eqNullSafe(F.col("sf")) & F.col("t").eqNullSafe(F.col("st")), "left_anti")
            path = write(level.withColumn("hops", F.lit(depth).cast("long")), "walk")
            found = spark.read.parquet(path)
            schema = found.schema
            if found.isEmpty():
                break
            paths.append(path)
            if limits.counts:
                rows += found.count()
                limits.total(rows, "a walk")
            level = found.select(*own)
        else:
            level = cut(level, "walk")
            if level.isEmpty():
                break
    if not paths:
        return starts.select("f", F.col("f").alias("t"), F.lit(0).cast("long").alias("hops"), *([none] if cited else [])).limit(0)
    return spark.read.schema(schema or spark.read.parquet(paths[0]).schema).parquet(*paths).select("f", "t", "hops", *own[2:])


def node_text(x: object) -> str:
    """What shortest paths are ordered by."""
    return f"{x:g}" if isinstance(x, float) else str(x)


def path_json(nodes: list, edges: list | None) -> str:
    clean = [int(x) if isinstance(x, float) and x.is_integer() else x for x in nodes]
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), default=str)
    return dump(clean) if edges is None else dump({"nodes": clean, "edges": edges})


def with_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds name_text, the node_text of each named column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pa.array([node_text(x) for x in batch.column(n).to_pylist()], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *texts], names=[*batch.schema.names, *[f"{n}_text" for n in names]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(f"{n}_text", T.StringType()) for n in names]]))


def with_json(found: DataFrame, named: bool) -> DataFrame:
    """(f, t, path) of rows (f, t, nodes, taken), and c if they have it."""
    rest = ["c"] if "c" in found.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("nodes").to_pylist(), batch.column("taken").to_pylist(), strict=True)
            shown = pa.array([path_json(nodes, taken if named else None) for nodes, taken in both], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("t"), shown, *[batch.column(c) for c in rest]], names=["f", "t", "path", *rest])

    schema = T.StructType([found.schema["f"], found.schema["t"], T.StructField("path", T.StringType()), *[found.schema[c] for c in rest]])
    return found.select("f", "t", "nodes", "taken", *rest).mapInArrow(run, schema)


def paths(edges: DataFrame, mode: str, low: int, high: int, named: bool, start=None, end=None, limits: Limits | None = None) -> DataFrame:
    """(f, t, path): each path of low to high steps in the mode, as JSON. With named edges, the path tells them
    and a trail takes each edge once, whichever way. `shortest` gives one path of the fewest steps, at least low,
    for each pair: the first by its nodes' text, then by the nodes, its edges' text and the edges."""
    names = ["f", "t", *(["e"] if named else [])]
    limits = limits or Limits()
    edges = least_cited(edges, names)
    nodes = edges.select("f").union(edges.select("t")).distinct()
    starts = seeds(nodes, start)
    if "c" not in edges.columns and (known := small(edges, limits)) is not None:
        out = ran(paths_by_tables(known, starts, mode, low, high, named, edges.schema["f"].dataType, limits.rounds), max(len(known), high) + low, limits)
    else:
        out = paths_by_joins(edges, starts, mode, low, high, named, limits)
    if end is not None:
        out = out.join(end.select(F.col("s").alias("~e")), F.col("t").eqNullSafe(F.col("~e")), "left_semi") if isinstance(end, DataFrame) else out.where(F.col("t").eqNullSafe(end))
    return out


def paths_by_tables(known: list, starts: DataFrame, mode: str, low: int, high: int, named: bool, kind: T.DataType, rounds: int) -> DataFrame:
    table: dict = {}
    for row in known:
        table.setdefault(row[0], []).append((row[1], row[2] if named else None))
    for steps in table.values():
        steps.sort(key=lambda s: (node_text(s[0]), node_text(s[1])))
    order_of = lambda found: ([node_text(x) for x in found[0]], found[0], [node_text(e) for e in found[1]], found[1])
    shared = starts.sparkSession.sparkContext.broadcast(table)

    def shortest(start: object) -> Iterator[tuple[list, list]]:
        level = [([start], [])]
        seen: set = set()
        depth = 0
        if low == 0:
            seen.add(start)
            yield level[0]
        while level and (not high or depth < high):
            depth += 1
            if depth > rounds:
                raise BudgetExceeded("rounds")
            best: dict = {}
            for nodes, taken in level:
                for n, e in shared.value.get(nodes[-1], ()):
                    found = ([*nodes, n], [*taken, e])
                    order = order_of(found)
                    if (depth < low or n not in seen) and (n not in best or order < best[n][0]):
                        best[n] = (order, found)
            level = [f for _, f in best.values()]
            if depth >= low:
                seen |= set(best)
                yield from level

    def all_of(start: object) -> Iterator[tuple[list, list]]:
        stack = [([start], [])]
        while stack:
            nodes, taken = stack.pop()
            if len(taken) >= low:
                yield nodes, taken
            if len(taken) >= rounds and not (high and len(taken) >= high):
                raise BudgetExceeded("rounds")
            if (high and len(taken) >= high) or (mode == "simple" and len(nodes) > 1 and nodes[-1] == nodes[0]):
                continue
            used = set(taken) if named else set(zip(nodes, nodes[1:], strict=False))
            for n, e in shared.value.get(nodes[-1], ()):
                if mode == "trail" and ((e if named else (nodes[-1], n)) in used):
                    continue
                if (mode == "acyclic" and n in nodes) or (mode == "simple" and n in nodes[1:]):
                    continue
                stack.append(([*nodes, n], [*taken, e]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list = []
            for s in batch["f"].astype(object):
                s = None if s is None or s is pd.NA or s != s else s
                for nodes, taken in (shortest if mode == "shortest" else all_of)(s):
                    rows.append((s, nodes[-1], path_json(nodes, taken if named else None)))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=["f", "t", "path"])
                        rows = []
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("f", "t", "path"))})

    return starts.mapInPandas(run, f"f {kind.simpleString()}, t {kind.simpleString()}, path string")


def paths_by_joins(edges: DataFrame, starts: DataFrame, mode: str, low: int, high: int, named: bool, limits: Limits) -> DataFrame:
    spark, cited = edges.sparkSession, "c" in edges.columns
    step = edges.select(F.col("f").alias("ef"), F.col("t").alias("et"), *([F.col("e").alias("ee")] if named else []), *([F.col("c").alias("ec")] if cited else []))
    kind = step.schema["ee"].dataType.simpleString() if named else "string"
    level = starts.select("f", F.col("f").alias("t"), F.array("f").alias("nodes"), F.array().cast(f"array<{kind}>").alias("taken"), *([F.array().cast("array<string>").alias("c")] if cited else []))
    if mode == "shortest":
        step = with_texts(step, ["et", *(["ee"] if named else [])])
        level = with_texts(level, ["f"]).withColumns({"texts": F.array("f_text"), "marks": F.array().cast("array<string>")}).drop("f_text")
    step, level = cut(step, "edges"), cut(level, "paths")
    schema, kept, depth, rows = level.schema, [], 0, 0
    carried = ["c"] if cited else []
    if low == 0:
        kept.append(write(level, "paths"))
    holds = lambda values, x: F.exists(values, lambda v: v.eqNullSafe(x))
    while not high or depth < high:
        depth += 1
        limits.round(depth, "a walk")
        mark = F.col("ee") if named else F.to_json(F.struct(F.col("ef"), F.col("et")))
        far = level.join(step, F.col("t").eqNullSafe(F.col("ef")))
        if mode == "trail":
            far = far.where(~holds("taken", mark))
        elif mode == "acyclic":
            far = far.where(~holds("nodes", F.col("et")))
        elif mode == "simple":
            far = far.where(((F.size("nodes") == 1) | ~F.col("t").eqNullSafe(F.col("f"))) & ~holds(F.slice("nodes", 2, F.size("nodes")), F.col("et")))
        longer = [F.array_append("nodes", F.col("et")).alias("nodes"), F.array_append("taken", mark).alias("taken")]
        if cited:
            longer.append(F.array_sort(F.array_union("c", "ec")).alias("c"))
        if mode == "shortest":
            longer += [F.array_append("texts", F.col("et_text")).alias("texts"), F.array_append("marks", F.col("ee_text") if named else F.lit("")).alias("marks")]
        level = far.select("f", F.col("et").alias("t"), *longer)
        if mode == "shortest":
            level = level.groupBy("f", "t").agg(F.min(F.struct("texts", "nodes", "marks", "taken", *carried)).alias("best")).select("f", "t", "best.nodes", "best.taken", *[f"best.{c}" for c in carried], "best.texts", "best.marks")
            if depth >= low and kept:
                seen = spark.read.schema(schema).parquet(*kept).select(F.col("f").alias("sf"), F.col("t").alias("st"))
                level = level.join(seen, F.col("f").eqNullSafe(F.col("sf")) & F.col("t").eqNullSafe(F.col("st")), "left_anti")
        path = write(level, "paths")
        level = spark.read.schema(schema).parquet(path)
        if level.isEmpty():
            break
        if depth >= low:
            kept.append(path)
            if limits.counts:
                rows += level.count()
                limits.total(rows, "a walk")
    found = spark.read.schema(schema).parquet(*kept) if kept else level.limit(0)
    return with_json(found, named)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
