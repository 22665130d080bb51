"""Mixing sources to target weights.

Targets are water-filled: every source gets its weight's share until it reaches its cap, and what a
capped source can't take is shared again. Within a source the rows are put in the order of a hash
key; distributed prefix sums of their sizes say where the budget ends. Budgets beyond one epoch take
every row again, in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import WORD, cut, prefix_sums, set_apart, table, text_or_empty

#: The hash keys of a source are cut into this many ranges.
RANGES = 1024


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """From (source, source_size), one row a source: adds `target`.

    Sources by code point, null last, weigh `weights` in turn. A source of rank k in the order of
    cap / weight is capped if the level that the rest would reach is above its own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    listed = listed.withColumns({"most": F.lit(cap) * F.col("source_size"), "ratio": F.lit(cap) * F.col("source_size") / F.col("w")})
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    listed = listed.withColumn(
        "level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    )
    # The first source whose level isn't above its own ratio sets the level of all from there on.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return listed.withColumn("top", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("most"), F.col("w") * F.col("top")), F.col("most")).alias("target")
    )


def hash_key(key: Column) -> Column:
    """48 bits that the key decides, the same in every run and on every system."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix/"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def mix(df: DataFrame, key: str, size: str, source: str, weights: list[float], share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds source_size, target and `taken`: how much of each row's size the mix takes.

    Sizes are long, not null. The sum of `taken` over a source is the whole part of its target. Rows of size 0 take 0; rows
    alike in key and size are told apart by position only. A null source is a source, a null key a key. Other columns may
    have any names; those named like an added one are replaced. An empty table stays empty. The table of sources, one row
    each, is the only thing that meets in one task.
    """
    flat, at, back = set_apart(df)
    own, n, of = at[key], at[size], at[source]
    sums = flat.groupBy(F.col(of).alias("source")).agg(F.sum(n).alias("source_size"))
    plan = targets(sums, weights, share, cap).select(F.col("source").alias("s"), F.col("source_size").alias("whole"), "target")
    # Written first, its size is known when the join below is planned: few sources are sent to the rows, not the rows shuffled.
    plan = cut(plan, "targets")
    bits = RANGES.bit_length() - 1
    keyed = flat.withColumn("draw", hash_key(F.col(own))).withColumn("range", F.shiftright("draw", 48 - bits))
    order = [F.col(c).asc_nulls_first() for c in ("draw", own, n)]
    summed = prefix_sums(keyed, [of], "range", order, n, "before")
    out = summed.join(plan, F.col(of).eqNullSafe(F.col("s")), "left")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("whole") > 0, F.expr("floor(target) div whole")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("whole") - F.col("before")
    taken = epochs * F.col(n) + F.greatest(F.lit(0), F.least(F.col(n), rest))
    return back(out, {"source_size": F.col("whole"), "target": F.col("target"), "taken": taken.cast("long")})


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 3, 1, 2 in turn, 150 % of all words, at most twice a source's own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(text_or_empty()).alias("size"))
    return mix(docs, "doc_id", "size", "source", [3.0, 1.0, 2.0]).select("doc_id", "size", "source_size", "target", "taken")
