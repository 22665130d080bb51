"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a number for a record from a hash of the record's key and the shard's name; the
shard with the best draw, scaled by its weight, takes the record. A new shard changes a record's
place only by winning its draw, so rows move only into the new shard, about 1/(n + 1) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import prefix_sums, set_apart, table, text_or_empty

#: The rows of a shard are numbered bucket by bucket; this many buckets share its rows.
SLOT_BUCKETS = 1024


def draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for a uniform u in (0, 1] that key and shard decide; smaller is better."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("long").cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def choose(key: Column, weights: list[float]) -> Column:
    """struct(draw, shard) of the winning shard. Weights are positive; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and there must be one at least")
    draws = [F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*draws) if len(draws) > 1 else draws[0]


def shards(df: DataFrame, key: str, weights: list[float], new_weight: float | None = None) -> DataFrame:
    """Adds `shard` and, with `new_weight`, `grown_shard`: the place once a shard of that weight joins.

    A null key has a draw of its own and so a place; equal keys, so repeated rows, share a place; draws that tie go to the
    smaller shard. Other columns have no say and may have any names; those named like an added one are replaced. An
    empty table stays empty. Texts are not read.
    """
    flat, at, back = set_apart(df)
    name = F.coalesce(F.concat(F.lit("k"), F.col(at[key]).cast("string")), F.lit("null"))
    out = flat.withColumn("won", choose(name, weights))
    added = {"shard": F.col("won.shard")}
    if new_weight is not None:
        n = len(weights)
        added["grown_shard"] = F.when(draw(name, n, new_weight) < F.col("won.draw"), F.lit(n)).otherwise(F.col("won.shard"))
    return back(out, added)


def numbered(df: DataFrame, key: str, size: str, check: str, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds `slot`, from 0 without gaps within each `shard`: two small shuffles, no task per shard.

    Rows come in the order of a hash of key, size and check, then of these, nulls first; rows alike in all of them are
    exchangeable. Columns may have any names; one named slot is replaced. An empty table stays empty.
    """
    flat, at, back = set_apart(df)
    name = F.concat_ws("/", F.lit("slot"), *[F.coalesce(F.col(at[c]).cast("string"), F.lit("null")) for c in (key, size, check)])
    bucket = F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    dealt = flat.withColumns({"bucket": bucket, "one": F.lit(1)})
    order = [F.col(at[c]).asc_nulls_first() for c in (key, size, check)]
    return back(prefix_sums(dealt, [at["shard"]], "bucket", order, "one", "slot"), {"slot": F.col("slot")})


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight under the law `key`.

    Null text: no bytes, size 1. Repeated rows each get a slot of their own.
    """
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    placed = shards(docs, "doc_id", [1.0] * 16, 1.0)
    return numbered(placed, "doc_id", "size", "text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
