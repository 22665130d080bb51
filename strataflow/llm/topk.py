"""Exact top-k search for the largest inner products, by cover trees over queries and data together.

Vectors are integers. A net of pivots, chosen farthest first from a bounded sample, is the top of one tree
over both sides: a row belongs to the cell of its nearest pivot, and a cell's candidates are cut into blocks
of bounded size. Below that, every block has a cover tree of its own, and so has every batch of queries.

The search goes down both at once, twice. First every query asks one block, that of the pivot it scores
best with, which gives a kth score to beat. Then cells are asked only by queries whose bound beats it: no
product of points of two nodes exceeds q.r + Rq |r| + Rr |q| + Rq Rr for centres q, r and radii Rq, Rr, nor
the product of their longest vectors, and a pair of nodes is dropped once that is below the worst kth score
of all queries in its query node. Pairs of cells are tested so first, then the queries of what is left one by
one; inside a block the same test runs over pairs of nodes, starting with the scores carried from the first
pass. Leaves are compared as matrices. Candidates are shuffled once a pass; queries go to the blocks that they ask.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import cut, dropped, table

#: Rows of a block of candidates: BLOCK at most; fewer, down to LEAST_BLOCK, while that gives the session's cores work.
BLOCK = 32_768
LEAST_BLOCK = 2_048
#: Queries that one search takes, and queries that one copy of a block answers; a block is copied again for more.
QUERIES = 1_024
TURN = 1 << 18
#: Pivots are chosen from so many rows and are so many, and take so many bytes, at most: they're sent to every task.
SAMPLE = 4_096
CELLS = 256
PIVOT_BYTES = 16 << 20
#: A node with so many points or fewer isn't divided; a child with fewer than SMALL shares its parent's leaf, and after
#: so many of these in a row so do all points that are left.
LEAF = 256
SMALL = 16
MISSES = 32
#: A child's radius, as a part of its parent's.
SHRINK = 0.8
#: Products are exact in floating point while they are below this.
EXACT = float(1 << 53)
#: Scores that need more than so many bits are ranked by all their digits.
LONG = 1 << 62


class Tree:
    """A cover tree over the rows of a matrix. Nodes are parallel lists; each owns a run of `order`."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order = np.zeros(0, np.int64)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._build()

    def _build(self) -> None:
        runs: list[np.ndarray] = []
        used = 0

        def leaf(center: int, members: np.ndarray, radius: float) -> int:
            nonlocal used
            self.center.append(center)
            self.radius.append(radius)
            self.span.append((used, used + len(members)))
            self.children.append([])
            runs.append(members)
            used += len(members)
            return len(self.center) - 1

        def node(center: int, members: np.ndarray, far: np.ndarray) -> int:
            radius = float(far.max())
            if len(members) <= LEAF or radius == 0:
                return leaf(center, members, radius)
            k = len(self.center)
            self.center.append(center)
            self.radius.append(radius)
            self.span.append((used, used + len(members)))
            self.children.append([])
            # The centre is its own first child; points beyond a child's radius found children in turn.
            left, here, few, missed = members, center, [], 0
            while len(left) and missed < MISSES:
                near = far <= radius * SHRINK
                if near.sum() >= SMALL and not near.all():
                    self.children[k].append(node(here, left[near], far[near]))
                    missed = 0
                else:
                    few.append(left[near])
                    missed += 1
                left = left[~near]
                if len(left):
                    here = int(left[0])
                    far = distances(self.points[left], self.points[here])
            rest = np.concatenate([*few, left])
            if len(rest):
                self.children[k].append(leaf(center, rest, float(distances(self.points[rest], self.points[center]).max())))
            return k

        node(0, np.arange(len(self.points)), distances(self.points, self.points[0]))
        self.order = np.concatenate(runs)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(1))


def distinct(ids: np.ndarray, raw: np.ndarray, most: int) -> np.ndarray:
    """The rows to keep, by id: a repeated row once, and of equal vectors the `most` smallest ids."""
    rows = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1] * raw.itemsize)))[:, 0] if raw.shape[1] else np.zeros(len(raw), "V1")
    _, group = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))[: len(order)]
    order, g = order[fresh], g[fresh]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    kept = order[np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g)))) < most]
    return kept[np.argsort(ids[kept], kind="stable")]


def unit(peak: np.ndarray) -> np.ndarray:
    """The powers of two that bring these largest components to 1 at most: products stay finite, whatever the vectors."""
    return np.ldexp(1.0, np.minimum(1000, -np.frexp(np.where(peak > 0, peak, 1.0))[1]))


class Block:
    """Candidates (ids, whole numbers as doubles) with their cover tree. Every query, and the block, has a scale of its own;
    `shrink`, the scale of either side in the bounds that searches take and give, is common to all."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, shrink: float, k: int) -> None:
        # Of equal vectors only the k + 1 smallest ids can be among any query's k best and its own row.
        kept = distinct(ids, raw, k + 1)
        self.ids, self.raw, self.shrink, self.k = ids[kept], raw[kept], shrink, k
        self.scale = float(unit(np.abs(self.raw).max(initial=0)))
        self.points = self.raw * self.scale
        self.norms = np.sqrt((self.points**2).sum(1))
        self.tree = Tree(self.points)
        self.longest = [float(self.norms[self.tree.order[a:b]].max()) for a, b in self.tree.span]

    def search(self, ids: np.ndarray, raw: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, int]:
        """(query id, id, score, at least, products made) of the k best of each query; fewer where fewer reach `least`,
        a lower bound of its kth score. `at least` bounds the scores found. A query's own id is no candidate."""
        k, m, points = self.k, len(self.ids), self.points
        scale = unit(np.abs(raw).max(axis=1, initial=0))
        queries = raw * scale[:, None]
        qn = np.sqrt((queries**2).sum(1))
        tree = Tree(queries)
        longest = float(self.norms.max(initial=0))
        whole = longest / self.scale * float((qn / scale).max(initial=0)) < EXACT
        margin = np.zeros(len(ids)) if whole else 4 * (points.shape[1] + 2) * 2.0**-53 * qn * longest
        with np.errstate(over="ignore"):
            bar = least * (scale / self.shrink) * (self.scale / self.shrink) - margin  # what a product must reach
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = made = 0

        def settle() -> None:
            """Keeps the k best of each query found so far, and those too close to tell, and raises the bars."""
            nonlocal found, pending
            q, r, s = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            start = np.searchsorted(q, np.arange(len(ids)))
            rank = np.arange(len(q)) - start[q]
            kth = np.flatnonzero(rank == k - 1)
            bar[q[kth]] = np.maximum(bar[q[kth]], s[kth] - 2 * margin[q[kth]])
            keep = (rank < k) | ((s >= bar[q]) & (margin[q] > 0))
            found, pending = [(q[keep], r[keep], s[keep])], 0

        def bound(a: int, b: int) -> float:
            q, r = tree.center[a], self.tree.center[b]
            rq, rr = tree.radius[a], self.tree.radius[b]
            top = min(float(queries[q] @ points[r]) + rq * self.norms[r] + rr * qn[q] + rq * rr, (qn[q] + rq) * self.longest[b])
            return top + abs(top) * 1e-9 + 1e-9 * qn[q] * self.norms[r]

        def worst(a: int) -> float:
            lo, hi = tree.span[a]
            return float(bar[tree.order[lo:hi]].min())

        def leaves(a: int, b: int) -> None:
            nonlocal pending, made
            qs, every = tree.order[slice(*tree.span[a])], self.tree.order[slice(*self.tree.span[b])]
            for low in range(0, len(every), 4096):
                rs = every[low : low + 4096]
                s = queries[qs] @ points[rs].T
                made += s.size
                s[ids[qs][:, None] == self.ids[rs][None]] = -np.inf
                over = s >= np.maximum(bar[qs], np.finfo(float).min)[:, None]
                if len(rs) > k and over.sum(1).max(initial=0) > 4 * k:
                    near = np.partition(s, len(rs) - k, axis=1)[:, len(rs) - k] - 2 * margin[qs]
                    over &= s >= near[:, None]
                q, r = np.nonzero(over)
                if len(q):
                    found.append((qs[q], rs[r], s[q, r]))
                    pending += len(q)
                    if pending > 2 * k * len(ids) or not np.isfinite(bar[qs]).all():
                        settle()

        heap = [(-math.inf, 0, 0)] if len(ids) and m else []
        while heap:
            top, a, b = heapq.heappop(heap)
            if -top < worst(a):
                continue
            split_q = tree.children[a] and (not self.tree.children[b] or tree.radius[a] > self.tree.radius[b])
            pairs = [(c, b) for c in tree.children[a]] if split_q else [(a, c) for c in self.tree.children[b]]
            if not pairs:
                leaves(a, b)
                continue
            for c, d in pairs:
                if (top := bound(c, d)) >= worst(c):
                    heapq.heappush(heap, (-top, c, d))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0), made
        settle()
        q, r, s = found[0]
        if whole:
            scores = [int(x) for x in (s / scale[q] / self.scale).tolist()]
        else:
            asked, held = whole_numbers(raw, q), whole_numbers(self.raw, r)
            scores = [sum(x * y for x, y in zip(asked[i], held[j], strict=True)) for i, j in zip(q.tolist(), r.tolist(), strict=True)]
            order = sorted(range(len(q)), key=lambda i: (q[i], -scores[i], r[i]))
            counts: dict[int, int] = {}
            best = []
            for i in order:
                counts[q[i]] = counts.get(q[i], 0) + 1
                if counts[q[i]] <= k:
                    best.append(i)
            q, r, s, scores = q[best], r[best], s[best], [scores[i] for i in best]
        low = np.nextafter((s - margin[q]) * (self.shrink / scale[q]) * (self.shrink / self.scale), -np.inf)
        return ids[q], self.ids[r], scores, low, made


def whole_numbers(raw: np.ndarray, used: np.ndarray) -> dict[int, list[int]]:
    return {i: [int(x) for x in raw[i].tolist()] for i in np.unique(used).tolist()}


def digits(score: int) -> str | None:
    """Text that sorts as the score does, for scores that a long may not hold."""
    if abs(score) < LONG:
        return None
    shown = str(abs(score))
    up = f"{len(shown):05d}{shown}"
    return "1" + up if score > 0 else "0" + up.translate(str.maketrans("0123456789", "9876543210")) + "~"


def whole(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component, x as double; rows that are null, or hold a null or a component
    that is not finite, before or after scaling, are left out. A double of 2^53 or more is whole and stays as it is."""
    scaled = lambda e: e.cast("double") * scale
    x = F.transform(F.col(vector), lambda e: F.when(F.abs(scaled(e)) < EXACT, F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull()
    bad = F.exists(F.col(vector), lambda e: e.isNull() | F.isnan(scaled(e)) | (F.abs(scaled(e)) == float("inf")))
    return vectors.where(fine & ~F.coalesce(bad, F.lit(False))).select(F.col(key).cast("long").alias("id"), x.alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out + 0.0  # -0 is 0


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Pivots chosen farthest first: every prefix covers the points within the distance that the next one stands apart."""
    chosen, near = [0], distances(points, points[0])
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1]]))
    return points[chosen]


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest pivot and its distance from it."""
    best = (points @ pivots.T - (pivots**2).sum(1) / 2).argmax(1)
    return best, distances(points, pivots[best])


def in_cells(rows: DataFrame, pivots: np.ndarray, shrink: float) -> DataFrame:
    """(id, v, cell, far, long) of rows (id, v): the nearest pivot, the distance from it and the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), pivots.shape[1]) * shrink
            cell, far = nearest(x, pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(np.sqrt((x**2).sum(1)))], names=["id", "v", "cell", "far", "long"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cell long, far double, long double")


class Cells:
    """The top of the tree: pivots, and of each cell the radius, the longest vector and its blocks."""

    def __init__(self, pivots: np.ndarray, shrink: float, stats: list[tuple[int, int, float, float]], block: int) -> None:
        self.pivots, self.shrink = pivots, shrink
        self.radius, self.longest = np.zeros(len(pivots)), np.zeros(len(pivots))
        self.blocks = np.zeros(len(pivots), np.int64)
        for cell, n, far, long in stats:
            self.radius[cell], self.longest[cell], self.blocks[cell] = far, long, -(-n // block)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])

    def best(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """One block for each query to begin with."""
        scores = np.where(self.blocks > 0, queries @ self.pivots.T, -np.inf)
        cell = scores.argmax(1)
        return self.first[cell] + ids % self.blocks[cell]

    def asked(self, queries: np.ndarray, cell: np.ndarray, far: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which cells each query must ask: queries x cells."""
        out = np.zeros((len(queries), len(self.pivots)), bool)
        length, norms = np.sqrt((self.pivots**2).sum(1)), np.sqrt((queries**2).sum(1))
        slack = 1e-9
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            rq, long, worst = far[own].max(), norms[own].max(), least[own].min()
            top = np.minimum(self.pivots @ self.pivots[c] + rq * length + self.radius * length[c] + rq * self.radius, long * self.longest)
            live = np.flatnonzero((top + np.abs(top) * slack + slack * long * self.longest >= worst) & (self.blocks > 0))
            top = np.minimum(queries[own] @ self.pivots[live].T + norms[own][:, None] * self.radius[live], norms[own][:, None] * self.longest[live])
            out[np.ix_(own, live)] = top + np.abs(top) * slack + slack * norms[own][:, None] * self.longest[live] >= least[own][:, None]
        return out


def dealt(rows: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """Queries (id, v, cell, far, least), a row for every block that they ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell, far, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            x = matrix(batch.column(1), cells.pivots.shape[1]) * cells.shrink
            if first:
                counts, blocks = np.ones(len(ids), np.int64), cells.best(x, ids)
            else:
                q, c = np.nonzero(cells.asked(x, cell, far, least))
                many = cells.blocks[c]
                blocks = np.repeat(cells.first[c] - np.cumsum(many) + many, many) + np.arange(many.sum())
                counts = np.bincount(np.repeat(q, many), minlength=len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), lists], names=["id", "v", "least", "blocks"])

    out = rows.select("id", "v", "cell", "far", "least").mapInArrow(run, "id long, v array<double>, least double, blocks array<long>")
    return out.select(F.explode("blocks").alias("block"), "id", "v", "least")


FOUND = "query_id long, vec_id long, score long, exact string, at_least double, products long"


def met(placed: DataFrame, asking: DataFrame, cells: Cells, k: int, turns: int) -> DataFrame:
    """What the queries (block, id, v, least) find in the blocks that they ask: FOUND; products are those of a search, at its first row.

    A block's candidates and, after them, its queries stream through one task; turns copies of a block share its queries.
    """
    shrink, width = cells.shrink, cells.pivots.shape[1]
    first, many = (F.array(*map(F.lit, a.tolist())) for a in (cells.first[:-1], np.maximum(1, cells.blocks)))
    cell = F.col("cell").cast("int")
    block = first[cell] + F.pmod(F.xxhash64("id"), many[cell])
    none = F.lit(None).cast("double")
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0)
    data = placed.select(block.alias("block"), turn.alias("turn"), F.lit(0).alias("kind"), "id", "v", none.alias("least"))
    asked = asking.select("block", F.pmod(F.xxhash64("id", F.lit("turn")), F.lit(turns)).cast("int").alias("turn"), F.lit(1).alias("kind"), "id", "v", "least")
    parts = int(min(8192, max(1, 2 * turns * cells.first[-1])))
    rows = data.union(asked).repartition(parts, "block", "turn").sortWithinPartitions("block", "turn", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[pa.RecordBatch] = []
        asked: list[pa.RecordBatch] = []
        built: Block | None = None

        def gathered(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])
            least = np.concatenate([p.column(5).to_numpy(zero_copy_only=False) for p in parts])
            return ids, np.concatenate([matrix(p.column(4), width) for p in parts]), least.astype(float)

        def searched() -> Iterator[pa.RecordBatch]:
            nonlocal asked, built, held
            if built is None and held:
                ids, raw, _ = gathered(held)
                built, held = Block(ids, raw, shrink, k), []
            if asked and built is not None:
                q, d, scores, low, made = built.search(*gathered(asked))
                if len(q):
                    cut_ = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores]
                    products = np.zeros(len(q), np.int64)
                    products[0] = made
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q), pa.array(d), pa.array(cut_, pa.int64()), pa.array([digits(s) for s in scores], pa.string()), pa.array(low), pa.array(products)], names=[x.split()[0] for x in FOUND.split(", ")]
                    )
            asked = []

        for batch in batches:
            if not batch.num_rows:
                continue
            b, t, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero((b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
                if (b[lo], t[lo]) != at:
                    yield from searched()
                    at, held, built = (b[lo], t[lo]), [], None
                for low in range(lo, hi, QUERIES):
                    part = batch.slice(low, min(QUERIES, hi - low))
                    if kinds[lo] == 0:
                        held.append(part)
                        continue
                    if asked and sum(p.num_rows for p in asked) + part.num_rows > QUERIES:
                        yield from searched()
                    asked.append(part)
        yield from searched()

    return rows.mapInArrow(run, FOUND)


def indexed(candidates: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, Cells, int] | None:
    """Both sides placed in the cells of one net, and the copies that a block needs; nothing if there are no candidates."""
    spark = candidates.sparkSession
    size, peak = F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))
    n, width, top = candidates.agg(F.count(F.lit(1)), size, peak).first()
    asked, wide, high = queries.agg(F.count(F.lit(1)), size, peak).first()
    if not n or not asked:
        return None
    width, top = max(width, wide, 1), max(top or 0.0, high or 0.0)
    shrink = 2.0 ** -max(0, math.frexp(top)[1] - 20)
    block = max(LEAST_BLOCK, min(BLOCK, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    most = max(1, min(CELLS, PIVOT_BYTES // (8 * width), -(-n // block)))
    rows = candidates.orderBy(F.xxhash64("id", F.lit("net")), "id", "v").limit(min(SAMPLE, PIVOT_BYTES // (8 * width) + 1)).select("v").collect()
    points = matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), width) * shrink
    pivots = net(points, most)
    placed = cut(in_cells(candidates, pivots, shrink), "placed")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("far"), F.max("long")).collect()  # a row a cell
    # A query id that occurs more than once is asked with its least vector.
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    asking = cut(in_cells(one, pivots, shrink).withColumn("least", F.lit(float("-inf"))), "asking")
    return placed, asking, Cells(pivots, shrink, [tuple(r) for r in stats], block), -(-asked // TURN)


def found_by(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    """FOUND of all searches that decide the answer: the second pass, or the first where there is one block only."""
    ready = indexed(candidates, queries)
    if ready is None:
        return None
    placed, asking, cells, turns = ready
    first = met(placed, dealt(asking, cells, True), cells, k, turns)
    if cells.first[-1] <= 1:
        return first
    reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("at_least").alias("low")).where(F.col("n") >= k)
    reached = cut(reached.select("query_id", "low"), "reached")
    again = asking.drop("least").join(reached, F.col("id") == F.col("query_id"), "left").withColumn("least", F.coalesce("low", F.lit(float("-inf"))))
    again = cut(again.select("id", "v", "cell", "far", "least"), "asking")
    dropped(asking, reached)
    return met(placed, dealt(again, cells, False), cells, k, turns)


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for whole vectors (id, v); further columns play no part, whatever their names.

    Scores are exact; one beyond a long is ranked by its true value and told as the nearest long. Ties go to smaller
    ids. Vectors of different lengths are filled up with zeros; an empty one scores 0 with all. A repeated row counts
    once; an id with several vectors is a candidate with each and asks with its least one. All of a query's own id
    are no candidates for it. No candidates or no queries: no rows.
    """
    found = found_by(candidates.select("id", "v"), queries.select("id", "v"), k)
    if found is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("exact").desc_nulls_last(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20 with all others."""
    rows = cut(whole(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64), "vectors")
    return top_k(rows, rows.where(F.col("id") % 20 == 0), 20)
