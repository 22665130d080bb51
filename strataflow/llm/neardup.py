"""Near-duplicates: MinHash bands for candidates, odd sketches to sift them, full sets to confirm links.

A document's set of word shingles is hashed to 64 bits. MinHash samples of it serve twice: bands of
samples put similar sets into common buckets, and all samples folded into a bitmap by parity make its
odd sketch, whose exclusive-or with another's has a population count that tells high similarities
apart precisely. Links are confirmed on the full sets alone.

Equal sets are one class from the start, so a group of exact copies of any size is one row in every
bucket. A bucket's rows are held against its least class only, in a join; a bucket that this leaves
apart is compared whole if it is small, and is one family if it is large. Families are what links may
lie in. A small one is compared whole, in a tile; a tile reports no more links than it has rows, as a
spanning forest loses none of the links' components. In a large one the pairs that the sketches found
are confirmed, and what that leaves apart is joined on rare shingles: sets of the similarity share one
of their rarest shingles, at places that still leave room for the rest, so text that all of a family
has in common brings no two rows together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import cut, dropped, table
from strataflow.llm.components import components
from strataflow.llm.textnp import LOWER, U64, buffers, mix, release, slices, span_hashes, word_bounds

#: Samples; bands of ROWS samples, dealt from BANDS * ROWS / SAMPLES shuffles of them. At a similarity of
#: 0.8 two sets share no band once in about a million times, above 0.85 practically never.
SAMPLES = 168
ROWS = 6
BANDS = 56
#: Bits of an odd sketch, and the most that may differ between sets of similarity 0.8: five deviations above what is expected.
BITS = 1024
MOST_BITS = 118
#: Rows of a bucket or a family that is compared whole, in one tile.
BLOCK = 128


def constants(seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
    shuffles = np.concatenate([rng.permutation(SAMPLES) for _ in range(BANDS * ROWS // SAMPLES)])
    return a, b, shuffles.reshape(BANDS, ROWS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and offsets.

    Shingles are k words; a text with fewer words is one shingle of them all; one without words has none.
    """
    starts, ends, at = word_bounds(data, offsets)
    h = span_hashes(LOWER[data], starts, ends)
    n = np.diff(at)
    rolled = np.zeros(len(h), U64)
    for o in range(min(k, len(h))):
        m = len(h) - o
        rolled[:m] = mix(rolled[:m] * U64(0x9E3779B97F4A7C15) + h[o:])
    sets = []
    for i in range(len(n)):
        words = h[at[i] : at[i + 1]]
        if n[i] >= k:
            sets.append(np.unique(rolled[at[i] : at[i + 1] - k + 1]))
        elif n[i]:
            one = np.zeros(1, U64)
            for w in words:
                one = mix(one * U64(0x9E3779B97F4A7C15) + w)
            sets.append(mix(one + U64(len(words))))
        else:
            sets.append(np.zeros(0, U64))
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), cuts


def sketched(x: np.ndarray, cuts: np.ndarray, consts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, texts x BANDS, and odd sketches, texts x BITS / 64, of non-empty sets."""
    a, b, bands = consts
    n = len(cuts) - 1
    least = np.empty((SAMPLES, n), U64)
    for k in range(SAMPLES):
        least[k] = np.minimum.reduceat(x * a[k] + b[k], cuts[:-1])
    keys = np.empty((n, BANDS), U64)
    for j, rows in enumerate(bands):
        key = np.full(n, j, U64)
        for r in rows:
            key = mix(key * U64(0x9E3779B97F4A7C15) + least[r])
        keys[:, j] = key
    sketch = np.zeros((n, BITS // 64), U64)
    every = np.arange(n)
    for k in range(SAMPLES):
        bit = mix(least[k] + U64(k)) % U64(BITS)
        np.bitwise_xor.at(sketch, (every, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return keys, sketch


def fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of longs."""
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, d1, d2, keys, sketch) of every row: the set's size and digest, band keys and odd sketch; null for empty sets."""
    consts = constants()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                x, cuts = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.diff(cuts)
                full = np.flatnonzero(n)
                d = np.zeros((2, len(n)), U64)
                keys, sketch = np.zeros((len(n), BANDS), U64), np.zeros((len(n), BITS // 64), U64)
                if len(full):
                    at = np.append(cuts[:-1][full], cuts[-1])
                    d[0, full] = np.add.reduceat(mix(x + U64(1)), at[:-1])
                    d[1, full] = np.add.reduceat(mix(x * U64(3) + U64(7)), at[:-1])
                    keys[full], sketch[full] = sketched(x, at, consts)
                none = pa.array(n == 0)
                lists = [pa.compute.if_else(none, None, fixed(v)) for v in (keys, sketch)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n), *[pa.array(v.view(np.int64)) for v in d], *lists], names=["id", "n", "d1", "d2", "keys", "sketch"])
            release()

    schema = "id long, n long, d1 long, d2 long, keys array<long>, sketch array<long>"
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def differ(x: Column, y: Column) -> Column:
    """The number of differing bits of two odd sketches."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(BITS // 64)), F.lit(0))


def may_link(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns, which the batches come sorted by."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        at = 0
        rows = list(zip(*columns, strict=True))
        t = pa.Table.from_batches([batch])
        for i in range(len(rows) + 1):
            if i == len(rows) or rows[i] != (last if i == at == 0 and held else rows[at]):
                if i > at:
                    held.append(t.slice(at, i - at))
                    last = rows[i - 1]
                if i < len(rows):
                    if held:
                        yield pa.concat_tables(held)
                    held, at = [], i
                    last = rows[i]
    if held:
        yield pa.concat_tables(held)


class Forest:
    """Union-find over a tile's rows; rows of one component start as one."""

    def __init__(self, comp: np.ndarray) -> None:
        self.up = np.unique(comp, return_inverse=True)[1].copy()
        self.of = self.up.copy()
        self.up = np.arange(len(self.up))

    def root(self, i: int) -> int:
        i = self.of[i]
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(links: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of the links, a symmetric matrix, those that join what comp has apart: a forest."""
    forest = Forest(comp)
    a, b = np.nonzero(np.triu(links & (comp[:, None] != comp[None]), 1))
    return [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if forest.join(i, j)]


def close_sketches(t: pa.Table, percent: int) -> np.ndarray:
    s = np.array(t["payload"].combine_chunks().values.to_numpy(), copy=False).view(U64).reshape(t.num_rows, -1)
    n = t["n"].to_numpy()
    bits = np.zeros((len(n), len(n)), np.int64)
    for w in range(s.shape[1]):
        bits += np.bitwise_count(s[:, None, w] ^ s[None, :, w])
    return (bits <= MOST_BITS) & (100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None]))


def linked_sets(t: pa.Table, percent: int) -> np.ndarray:
    """Exact: intersections of the rows' full sets, through the shingles that two rows have at least."""
    lists = t["payload"].combine_chunks()
    values = lists.values.to_numpy()[lists.offsets[0].as_py() :]
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    column = np.full(len(count), -1)
    column[common] = np.arange(len(common))
    both = np.zeros((len(size), len(size)), np.float64)
    hit = column[place]
    for low in range(0, len(common), 4096):
        sel = (hit >= low) & (hit < low + 4096)
        m = np.zeros((len(size), min(4096, len(common) - low)), np.float32)
        m[row[sel], hit[sel] - low] = 1
        both += m @ m.T
    union = size[:, None] + size[None] - both
    return (100 * both >= percent * union) & (union > 0)


def tiled(items: DataFrame, test: Callable[[pa.Table, int], np.ndarray], percent: int) -> DataFrame:
    """Edges (a, b) for items (g, id, comp, n, payload), each g a tile: a forest for every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            comp, ids = t["comp"].to_numpy(), t["id"].to_numpy()
            found = spanning(test(t, percent), comp) if t.num_rows > 1 and comp.min() != comp.max() else []
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])
        release()

    tiles = items.select("g", "id", "comp", "n", "payload").repartition("g").sortWithinPartitions("g")
    return tiles.mapInArrow(run, "a long, b long")


def label(items: DataFrame, comps: DataFrame) -> DataFrame:
    """items with comp: the root of their id, or the id itself."""
    return items.join(comps, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "id")).drop("node", "root")


def families(sig: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, root): classes that may belong together, as far as buckets and odd sketches tell; and the pairs (a, b)
    that the sketches found close."""
    rows = cut(sig.select("id", F.explode("keys").alias("key")), "bands")
    heads = rows.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("rows"))
    heads = cut(heads.where(F.col("rows") > 1).select(F.col("key").alias("bucket"), "head", "rows"), "buckets")
    shared = cut(rows.join(heads, F.col("key") == F.col("bucket")).select("key", "head", "rows", "id"), "shared")
    dropped(rows, heads)
    pairs = cut(shared.where("id != head").select("head", "id").distinct(), "pairs")
    own = sig.select(F.col("id").alias("of"), "n", "sketch")
    one = cut(pairs.join(own, F.col("id") == F.col("of")).select("head", "id", "n", "sketch"), "pairs")
    both = one.alias("p").join(own.alias("o"), F.col("p.head") == F.col("o.of"))
    close = (differ(F.col("p.sketch"), F.col("o.sketch")) <= MOST_BITS) & may_link(F.col("p.n"), F.col("o.n"), percent)
    links = cut(both.where(close).select(F.col("p.head").alias("a"), F.col("p.id").alias("b")), "links")
    dropped(pairs, one)
    spread = label(shared, components(links))
    open_ = spread.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select(F.col("key").alias("bucket"))
    left = cut(spread.where("rows > 2").join(cut(open_, "open"), F.col("key") == F.col("bucket")).select("key", "head", "rows", "id", "comp"), "left")
    # Small buckets are looked at pair by pair; the rows of a large one may all belong together.
    items = left.where(F.col("rows") <= BLOCK).join(own, F.col("id") == F.col("of")).select(F.col("key").alias("g"), "id", "comp", "n", F.col("sketch").alias("payload"))
    more = cut(links.union(tiled(items, close_sketches, percent)).distinct(), "links")
    wide = left.where(F.col("rows") > BLOCK).where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    found = components(more.union(wide))
    dropped(links, shared, left)
    return found, more


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are linked."""
    own = sets.select(F.col("id").alias("of"), "payload")
    one = pairs.join(own, F.col("b") == F.col("of")).select("a", "b", F.col("payload").alias("mine"))
    both = one.join(own, F.col("a") == F.col("of")).select("a", "b", "mine", "payload", F.size(F.array_intersect("mine", "payload")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.size("mine") + F.size("payload") - F.col("common"))).select("a", "b")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(g, x, id, n, place): the shingles of each set, rarest of its family first, by one of which it meets all it is linked with.

    Sets of n shingles that are linked have percent of n in common, so they meet in the first n - percent of n + 1 of them.
    Shingles of one set only come first; they are counted, and meet nothing. Those that more than half of a family's sets
    hold, of which there are twice as many as an average set has at most, come last in one order; they are told apart
    inside the rows, and become rows only where a set has too few others.
    """
    one = sets.withColumn("set", F.xxhash64("payload")).dropDuplicates(["id", "set"])  # a key may have several, or one repeatedly
    members = one.groupBy("g").agg(F.count(F.lit(1)).alias("half")).select(F.col("g").alias("h"), (F.col("half") / 2).alias("half"))
    counts = one.select("g", F.explode("payload").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    counts = cut(counts.join(members, F.col("g") == F.col("h")).drop("h"), "counts")
    most = counts.where("sets > half").groupBy(F.col("g").alias("h")).agg(F.collect_list("x").alias("most"))
    none = F.array().cast("array<long>")
    split = one.join(most, F.col("g") == F.col("h"), "left").withColumn("most", F.coalesce("most", none))
    split = split.select("g", "id", "set", "n", F.array_except("payload", "most").alias("rest"), F.array_intersect("payload", "most").alias("last"))
    split = cut(split, "split")
    need = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    met = split.select("g", "id", "set", "n", F.size("rest").alias("few"), F.explode("rest").alias("x")).join(counts.where("sets <= half").drop("half"), ["g", "x"])
    of = Window.partitionBy("id", "set")
    place = F.row_number().over(of.orderBy("sets", "x")) - 1 + F.col("few") - F.count(F.lit(1)).over(of)
    rare = met.withColumn("place", place.cast("long")).where(F.col("place") < need).select("g", "x", "id", "n", "place")
    more = F.slice("last", F.lit(1), F.greatest(F.lit(0), need - F.size("rest")).cast("int"))
    late = split.select("g", "id", "n", F.size("rest").alias("few"), F.posexplode(more).alias("at", "x"))
    return rare.union(late.select("g", "x", "id", "n", (F.col("few") + F.col("at")).cast("long").alias("place")))


def room(n: Column, place: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes that meet first at these places may be linked."""
    return may_link(n, m, percent) & ((100 + percent) * F.least(n - place, m - other) >= percent * (n + m))


def rare_links(sets: DataFrame, percent: int, edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges, whose components are given, with what links the components that they leave in these families: sets (g, id, n, payload).

    Twice over pairs of sets that share a rare shingle and belong to different components: first each set with one of
    another component, which joins most of what is linked, then every pair that is still apart.
    """
    prefix = cut(rare_shingles(sets, percent), "rare")
    for every in (False, True):
        now = label(prefix, components(edges) if every else comps)
        if every:
            p, q = now.alias("p"), now.alias("q")
            fits = room(F.col("p.n"), F.col("p.place"), F.col("q.n"), F.col("q.place"), percent)
            pairs = p.join(q, (F.col("p.g") == F.col("q.g")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.comp") < F.col("q.comp")) & fits)
            pairs = pairs.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
        else:
            one = F.struct("comp", "id", "n", "place")
            ends = now.groupBy("g", "x").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.comp != hi.comp")
            met = now.join(ends, ["g", "x"]).withColumn("other", F.when(F.col("comp") == F.col("lo.comp"), F.col("hi")).otherwise(F.col("lo")))
            fits = room(F.col("n"), F.col("place"), F.col("other.n"), F.col("other.place"), percent)
            pairs = met.where(fits).select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b"))
        pairs = cut(pairs.distinct(), "pairs")
        edges = cut(edges.union(confirmed(pairs, sets, percent)), "links")
        dropped(pairs)
    dropped(prefix)
    return edges


def sets_of(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(g, id, n, members, payload): full sets of the wanted (node, root, members), with g, the family; one row a node."""
    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, F.col("id") == F.col("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets, 1 << 20):
                x, cuts = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(np.diff(cuts)), batch.column(3)[i:j], lists], names=["g", "id", "n", "members", "payload"])
            release()

    return picked.select(F.col("root").alias("g"), "id", "text", "members").mapInArrow(run, "g long, id long, n long, members long, payload array<long>")


def near_duplicates(docs: DataFrame, key: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) of every row: links at 100 * intersection >= percent * union.

    The key is a long; component is the least key reachable. Rows of one key may differ in text: each has the component
    of its own text, and texts of which it is the least key are in one component. A row with a null key
    is linked with nothing, and its component is null. Null and wordless texts have an empty set and are linked with
    nothing. Repeated texts are one class. Percent is 80 at least, as the bands are laid out for that. An empty table
    gives an empty one. Other columns play no part, whatever their names. A text and its shingles fit in memory.
    """
    if percent < 80:
        raise ValueError("the bands find similarities of 0.8 and above")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sig = cut(signatures(docs, "id", "text", k), "signatures")
    keyed = sig.where("n > 0 AND id IS NOT NULL")
    classes = cut(keyed.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    # One row stands for a class.
    chosen = keyed.join(classes.withColumnsRenamed({"d1": "e1", "d2": "e2", "n": "m"}), (F.col("id") == F.col("rep")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    chosen = cut(chosen.dropDuplicates(["id", "d1", "d2"]).select("id", "n", "keys", "sketch"), "chosen")
    family, close = families(chosen, percent)
    sizes = family.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    family = cut(family.join(cut(sizes.withColumnRenamed("root", "r"), "sizes"), F.col("root") == F.col("r")).select("node", "root", "members"), "family")
    sets = cut(sets_of(docs.where("id IS NOT NULL"), "id", "text", k, family), "sets")
    small, large = sets.where(F.col("members") <= BLOCK), sets.where(F.col("members") > BLOCK)
    edges = tiled(small.withColumn("comp", F.col("id")), linked_sets, percent)
    if not large.isEmpty():
        own = large.select(F.col("id").alias("member"))
        edges = cut(edges.union(confirmed(close.join(own, F.col("a") == F.col("member"), "left_semi"), large, percent)), "links")
        comps = components(edges)
        apart = label(large.select("g", "id"), comps).groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
        apart = cut(apart.select(F.col("g").alias("h")), "apart")
        if not apart.isEmpty():
            edges = rare_links(cut(large.join(apart, F.col("g") == F.col("h")).select("g", "id", "n", "payload"), "apart"), percent, edges, comps)
    comps = components(cut(edges, "links"))
    roots = cut(label(classes.withColumn("id", F.col("rep")), comps).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), "comp"), "roots")
    dropped(chosen, family, sets, close, classes)
    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m"))
    # Empty sets all have digest 0; a pairing of their own keeps them from meeting in one task.
    alone = sig.where("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    full = keyed.select("id", "n", "d1", "d2").join(roots, same).select("id", F.col("n").alias("n_shingles"), F.col("comp").alias("component"))
    return full.union(alone)


def deduplicate(docs: DataFrame, key: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the least of their component, as they are.

    Rows with a null key stay. Rows that are alike in key and text stay or go together. Where some key has several
    texts, rows are told apart by a hash of both, and the least of a component is that of the least hash: no text is
    lost. Columns may have any names.
    """
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    own, body = F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}")
    mark = F.xxhash64(body)
    several = flat.where(own.isNotNull()).groupBy(own.alias("k")).agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo != hi")
    row = own.cast("long") if several.isEmpty() else F.when(own.isNotNull(), F.xxhash64(own, body))
    flat = flat.withColumn("row", row)
    gone = near_duplicates(flat.where(F.col("row").isNotNull()).select("row", body.alias("body")), "row", "body", k, percent).where("id != component").select("id").distinct()
    return flat.join(gone, F.col("row") == F.col("id"), "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: classes of near-duplicates on two-word shingles, linked at 0.8, confirmed on full sets.

    A document without an id is one of its own: its component_id is null, and it is kept.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", k=2)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
