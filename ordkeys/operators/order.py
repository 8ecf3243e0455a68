"""Running sums and ranks over a global order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordkeys.functions.storage import materialize


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df in order, dealt into ranges and written; with __range, the range's number, and __row, which grows with the order.

    Spark chooses the number of ranges by their size. Rows that are equal in the order
    are told apart by a hash of their place, so that many of them don't fill one range;
    for that, df must give the same rows in the same order when a task is repeated, or
    have no such rows.
    """
    tied = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    return materialize(dealt.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__row")), name)


def _offsets(rows: DataFrame, value: Column) -> DataFrame:
    """__range, __first, __offset: of each range its first row, and the sum over the ranges before. One row a range."""
    before = Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__range").agg(F.min("__row").alias("__first"), F.sum(value).alias("__sum"))
    return sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")


def rank_before(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with ``name``: how many rows come before the row. One shuffle by ranges; ranges and rows are numbered as they are written."""
    rows = ranged(df, order, "ranked")
    ranks = rows.join(F.broadcast(_offsets(rows, F.lit(1))), "__range")  # as many rows as ranges
    return ranks.withColumn(name, (F.col("__offset") + F.col("__row") - F.col("__first")).cast("bigint")).drop("__range", "__row", "__first", "__offset")


def running_sum_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before the row in the given order.

    df is run once. Sums within ranges are taken apart; one sum a range, added up over
    the ranges before, is their offset.
    """
    rows = ranged(df, order, "ranges")
    value_of = F.col(value).cast("bigint")
    w = Window.partitionBy("__range").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("__within", F.coalesce(F.sum(value_of).over(w), F.lit(0)))
    joined = within.join(F.broadcast(_offsets(rows, value_of)), "__range")  # as many rows as ranges
    return joined.withColumn(name, (F.col("__offset") + F.col("__within")).cast("bigint")).drop("__range", "__row", "__first", "__offset", "__within")
