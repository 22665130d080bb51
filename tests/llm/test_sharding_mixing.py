import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strataflow.llm import mixing, sharding

SCHEMA = "doc_id long, size long, crc long"


def test_shards_are_gapless_and_stable(spark):
    rows = [(i, i % 7, zlib.crc32(b"%d" % i)) for i in range(3000)] + [(5, 5, 1), (5, 5, 1), (None, None, None), (None, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharding.numbered(sharding.shards(df, "doc_id", [1.0] * 16, 1.0), "doc_id", "size", "crc").collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r.grown_shard == 16 for r in out)
    assert 0.03 < moved / len(out) < 0.09
    assert len({r.shard for r in out if r.doc_id == 5}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1


def test_growth_is_what_more_shards_give(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    small = sharding.shards(df, "doc_id", [1.0] * 4, 1.0)
    large = sharding.shards(df, "doc_id", [1.0] * 5).select("doc_id", F.col("shard").alias("five"))
    assert small.join(large, "doc_id").where("five != grown_shard").count() == 0


def test_weights_share_the_rows(spark):
    df = spark.range(20000).withColumnRenamed("id", "k").withColumn("shard", F.lit("an old column"))
    got = {r["shard"]: r["count"] for r in sharding.shards(df, "k", [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert all(abs(got[i] / 20000 - w / 8) < 0.02 for i, w in enumerate((1, 2, 5)))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.numbered(sharding.shards(df, "doc_id", [1.0] * 3, 1.0), "doc_id", "size", "crc").count() == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, size long, source string"), "doc_id", "size", "source", [1.0]).count() == 0


def filled(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Targets by sharing again and again until no source is above its cap."""
    total, out, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(out.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def test_mixing_by_brute_force(spark):
    rows = [(i, (i * 7919) % 50, ["a", "b", "é", None, "Z"][min(4, i % 17)]) for i in range(2000)] + [(7, 9, "a"), (7, 9, "a"), (None, 4, None), (9999, 0, "none")]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string").withColumns({"target": F.lit("old"), "source_size": F.lit("old")})
    out = mixing.mix(df, "doc_id", "size", "source", [3.0, 1.0, 2.0]).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights, 1.5, 2.0)
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    # Rows are cut in the order of their hash keys: within a source those of full size come first.
    key = lambda r: int(hashlib.md5(f"mix/{r.doc_id if r.doc_id is not None else 'null'}".encode()).hexdigest()[:12], 16)
    for s in sizes:
        own = sorted((r for r in out if r.source == s and r.size), key=key)
        epochs = int(want[s] + 1e-9) // sizes[s] if sizes[s] else 0
        extra = [r.taken - epochs * r.size for r in own]
        full = [x == r.size for x, r in zip(extra, own, strict=True)]
        assert full == sorted(full, reverse=True) and sum(0 < x < r.size for x, r in zip(extra, own, strict=True)) <= 1


def test_words_are_counted_as_stated(spark):
    df = spark.createDataFrame([("a b\u00a0c  d\te\x0bf\n",), ("",), (" \n",), ("é",)], "text string")
    assert [r[0] for r in df.select(mixing.count_words(F.col("text"))).collect()] == [5, 0, 0, 1]


def test_names_that_clash(spark):
    """An input's columns may be named like the operators' own; those named like an added one are replaced."""
    names = ["shard", "grown_shard", "slot", "won", "bucket", "__won", "__b", "__g0", "c0", "taken", "target", "source_size", "before", "draw"]
    df = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("size"), F.lit("s").alias("source"), (F.col("id") * 2).alias("crc"), *[F.lit(n).alias(n) for n in names])
    out = sharding.numbered(sharding.shards(df, "doc_id", [1.0, 1.0], 1.0), "doc_id", "size", "crc")
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    assert {r.shard for r in rows} == {0, 1} and all(r[n] == n for r in rows for n in names if n not in ("shard", "grown_shard", "slot"))
    assert sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows)))
    mixed = mixing.mix(df, "doc_id", "size", "source", [1.0])
    assert sorted(mixed.columns) == sorted(df.columns)
    assert sum(r.taken for r in mixed.collect()) == 90 and all(r[n] == n for r in mixed.collect() for n in names if n not in ("taken", "target", "source_size"))
