"""Versioned facts: a hidden column __versions of ranges [from, to), and what is done with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strataflow.sources.catalog import HIDDEN, overlaid

RANGES = "array<struct<from:bigint,to:bigint>>"
#: The end of a range that is still open.
OPEN = 1 << 62


def contains(ranges: Column, v: Column) -> Column:
    return F.exists(ranges, lambda r: (r["from"] <= v) & (v < r["to"]))


def normal(ranges: Column) -> Column:
    """Sorted, without empty ranges, overlapping and touching ones joined."""
    full = F.array_sort(F.filter(ranges, lambda r: r["from"] < r["to"]))

    def add(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))))
        return F.when((F.size(out) > 0) & (r["from"] <= last["to"]), grown).otherwise(F.array_append(out, r))

    return F.aggregate(full, F.array().cast(RANGES), add)


def both(a: Column, b: Column) -> Column:
    """The versions in a and in b."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["from"], y["from"]).alias("from"), F.least(x["to"], y["to"]).alias("to")))))
    return normal(pairs)


def either(a: Column, b: Column) -> Column:
    return normal(F.concat(a, b))


def minus(a: Column, b: Column) -> Column:
    """The versions in a that aren't in b: what is left between b's ranges."""
    inner = normal(b)
    lows = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(inner, lambda r: r["to"]))
    highs = F.concat(F.transform(inner, lambda r: r["from"]), F.array(F.lit(OPEN)))
    gaps = F.zip_with(lows, highs, lambda x, y: F.struct(x.alias("from"), y.alias("to")))
    return both(a, gaps)


def at(df: DataFrame, version: int) -> DataFrame:
    """The facts of one version."""
    return df.where(contains(F.col("__versions"), F.lit(version)))


def difference(df: DataFrame, old: int, new: int) -> DataFrame:
    """Facts by value that one of two versions has alone: change is `added` or `removed`."""
    names = [c for c in df.columns if c not in HIDDEN]
    before, after = (at(df, v).select(*names).distinct() for v in (old, new))
    added = overlaid(after, removed=before).withColumn("change", F.lit("added"))
    return added.unionByName(overlaid(before, removed=after).withColumn("change", F.lit("removed")))


def latest(changes: DataFrame) -> DataFrame:
    """Of ordered changes (seq, change, values) the last one for each fact."""
    names = [c for c in changes.columns if c not in ("seq", "change")]
    order = Window.partitionBy(*names).orderBy(F.desc("seq"))
    return changes.withColumn("~n", F.row_number().over(order)).where("`~n` = 1").drop("~n")


def applied(df: DataFrame, changes: DataFrame) -> DataFrame:
    """A relation with ordered changes made: a session's view."""
    last = latest(changes)
    names = [c for c in df.columns if c not in HIDDEN]
    adds = last.where("change = 'added'").select(*names)
    return overlaid(df, removed=last.select(*names), added=adds)


def committed(df: DataFrame, changes: DataFrame, base: int, version: int) -> DataFrame:
    """A new version made from an old one: facts of `base` that aren't removed hold in `version` too, added ones from then on."""
    names = [c for c in df.columns if c not in HIDDEN]
    last = latest(changes).select(*[F.col(c).alias(f"~{c}") for c in names], F.col("change").alias("~change"))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"~{c}")) for c in names])
    span = lambda a, b: F.array(F.struct(F.lit(a).cast("bigint").alias("from"), F.lit(b).cast("bigint").alias("to")))
    joined = df.join(last, on, "left")
    lives = ((F.col("~change").isNull() & contains(F.col("__versions"), F.lit(base))) | (F.col("~change") == "added"))
    up_to = minus(F.col("__versions"), span(version, OPEN))
    kept = joined.withColumn("__versions", F.when(F.coalesce(lives, F.lit(False)), either(up_to, span(version, OPEN))).otherwise(up_to)).select(*df.columns)
    fresh = overlaid(latest(changes).where("change = 'added'").select(*names), removed=df.select(*names)).withColumn("__versions", span(version, OPEN))
    return kept.unionByName(fresh, allowMissingColumns=True).where(F.size("__versions") > 0)
