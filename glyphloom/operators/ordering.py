"""Running totals along an ordered id, without bringing the rows of a key together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str, total: str, width: int = WIDTH, below: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the key, and over all its rows.

    Rows are cut into ranges of ``width`` ids; sums run within a range, and a small table of range sums gives where
    each range starts. ``order`` must be an integer column without repeats within a key. With ``below`` (values must not be
    negative) ranges that start at that sum or after it are left out before rows are moved; one row for each key says where.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long")).withColumn("_value", value.cast("long"))
    by = [*keys, "_range"]
    sums = ranged.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(*keys)).alias(total))
    if below is not None:
        last = starts.where(F.col("_start") < below).groupBy(*keys).agg(F.max("_range").alias("_last"))
        ranged = ranged.join(F.broadcast(last), keys).where("_range <= _last").drop("_last")
    here = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_here", F.coalesce(F.sum("_value").over(here), F.lit(0)))
    return inner.join(starts, by).withColumn(out, F.col("_start") + F.col("_here")).drop("_range", "_value", "_start", "_here")
