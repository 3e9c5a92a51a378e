"""Running sums and ranks without one task for a whole key: totals of buckets first, then inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphlode.storage import broadcast_if_small, stash


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the same keys before this one, by (bucket, order).

    Keys compare null-safely. df is read twice, so it should be a stored table or cheap.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, bucket])), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, bucket])]
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(broadcast_if_small(base, 16 * (len(keys) + 2)), on)
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).select(*df.columns, out)


def ordinals(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with out: how many rows come before this one by `order`, which no two rows share.

    The rows are parted by ranges of the whole order first, so no task has more than its range, however many are equal in
    the order's first column.
    """
    ranged = df.repartitionByRange(*order).withColumns({"__range": F.spark_partition_id(), "__one": F.lit(1)})
    return running(stash(ranged, "ranged"), [], "__range", order, "__one", out).drop("__range", "__one")
