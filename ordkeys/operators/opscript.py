"""Scripts of adds, deletes and lookups in which each op sees all before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordkeys.functions import bytes as B


def replay(ops: DataFrame) -> DataFrame:
    """ops (seq, op: add, del or lookup, key) with result.

    A key's state depends on the last add or del of the same key only, so a window
    over each key's ops replays the script. add: 1 new, 0 there already; del: 1
    deleted, 0 absent; both -1 for a null or too long key; lookup: 1 or 0.
    """
    bad = F.col("key").isNull() | (F.octet_length("key") > B.MAX_KEY)
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("op").isin("add", "del"), F.col("op"))
    live = F.coalesce(F.last(change, ignorenulls=True).over(before) == "add", F.lit(False))
    result = (
        F.when(F.col("op") == "lookup", F.when(bad, 0).otherwise(live.cast("int")))
        .when(bad, -1).when(F.col("op") == "add", (~live).cast("int")).when(F.col("op") == "del", live.cast("int"))
    )
    return ops.withColumn("result", result)


def history(ops: DataFrame, *, upto: int | None = None) -> DataFrame:
    """key, live after the ops up to a number: every key ever added."""
    changes = ops.filter(F.col("op").isin("add", "del") & F.col("key").isNotNull())
    if upto is not None:
        changes = changes.filter(F.col("seq") <= upto)
    done = changes.groupBy("key").agg(F.max(F.col("op") == "add").alias("added"), (F.max_by("op", "seq") == "add").alias("live"))
    return done.filter("added").select("key", "live")
