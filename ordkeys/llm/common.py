"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkeys.functions.storage import materialize, new_path  # noqa: F401

#: A word: a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with one of so many parts of all rows, or more, is dealt to several tasks in joins; but none with fewer rows than the least.
HOT_PARTS, HOT_LEAST = 200, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df in the given order, dealt into ranges and written; with ``range``, the range's number, and ``row``, which grows with the order in a range.

    A group of any size lies in as many ranges as it needs, rows that are equal in the
    order included: a hash of their place tells them apart. df must give the same rows
    in the same order when a task is repeated, as scans of files do.
    """
    tied = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    return materialize(dealt.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")), name)


def hot_join(rows: DataFrame, others: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with others, whose key is unique, on key: by sort and merge, without a task that gets all rows of a frequent key.

    Such a key's rows are dealt out by a hash of ``by``, and its one row of others is
    repeated as often. At most HOT_PARTS keys are frequent, so their list is small.
    rows should be written, as it is read twice.
    """
    least = max(HOT_LEAST, -(-rows.count() // HOT_PARTS))
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).collect()  # at most HOT_PARTS rows
    if not hot:
        return rows.join(others.hint("merge"), key, how)
    salts = rows.sparkSession.createDataFrame([(r[key], -(-r["__n"] // least)) for r in hot], f"`{key}` {dict(rows.dtypes)[key]}, __salts int")
    n = F.coalesce("__salts", F.lit(1))
    left = rows.join(F.broadcast(salts), key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), n).cast("int")).drop("__salts")
    right = others.join(F.broadcast(salts), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__salts")
    return left.join(right.hint("merge"), [key, "__salt"], how).drop("__salt")
