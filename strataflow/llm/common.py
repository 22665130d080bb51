"""What the operators of this subpackage share: inputs, shared storage, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.sources.storage import cut, drop_path, dropped, fresh_path, shared_folder

__all__ = ["SPACE", "SPACES", "WORD", "cut", "drop_path", "dropped", "fresh_path", "prefix_sums", "set_apart", "shared_folder", "table", "text_or_empty"]

#: The word pattern of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark from any store it knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before.

    Rows come in order of (`bucket`, `order`). `bucket` deals the rows of a group, even of a
    very large one, to many tasks: only a row for each group and bucket meets in the window
    that sums the buckets, and the rows of one bucket in the window that numbers them.
    Null groups are groups. The rows' own order must be total for the result to be defined;
    rows alike in all of `order` are exchangeable.
    """
    names = [f"__g{i}" for i in range(len(group))]
    # Text keys without nulls: the join below then meets the rows where the window has put them.
    keyed = df.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(f"`{g}`").cast("string")), F.lit("-")) for n, g in zip(names, group, strict=True)})
    keyed = keyed.withColumn("__b", F.col(bucket))
    base = keyed.groupBy(*names, "__b").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*names, "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    local = Window.partitionBy(*names, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("__local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    joined = rows.join(base, [*names, "__b"], "left")
    return joined.withColumn(out, (F.col("__base") + F.col("__local")).cast("long")).drop("__base", "__local", "__b", *names)


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame, dict[str, Column]], DataFrame]]:
    """df with its columns named by place, the place of each name, and the way back: the columns under their own names again,
    with further ones, which replace those of the same name. In between an operator's names meet no one else's."""
    names = df.columns
    flat = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])

    def back(out: DataFrame, added: dict[str, Column]) -> DataFrame:
        return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in added], *[c.alias(n) for n, c in added.items()])

    return flat, {n: f"c{i}" for i, n in enumerate(names)}, back


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
