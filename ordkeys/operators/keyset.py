"""Sets of byte-string keys as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkeys.functions import bytes as B
from ordkeys.operators.order import rank_before, running_sum_before


class KeySet:
    """A set of distinct keys. Immutable: what changes it returns another.

    df: one BINARY column ``key``, distinct, no nulls. Methods give DataFrames or key
    sets and run nothing, but for those that give one number, and for order statistics,
    which write the keys once in ranges.
    """

    def __init__(self, df: DataFrame, *, ranked: DataFrame | None = None):
        self.df = df
        self._ranked = ranked

    # sources

    @staticmethod
    def empty(spark: SparkSession) -> KeySet:
        return KeySet(spark.createDataFrame([], "key binary"))

    @staticmethod
    def of(spark: SparkSession, keys: Iterable[bytes | str]) -> KeySet:
        """From a few keys at hand. Sorting isn't needed; repeated keys count once."""
        rows = [(bytearray(k.encode() if isinstance(k, str) else k),) for k in keys]
        return KeySet.from_binary(spark.createDataFrame(rows, "key binary"), "key")

    @staticmethod
    def from_binary(df: DataFrame, column: str | Column) -> KeySet:
        """Distinct non-null values of a column. A key of more than 65,536 bytes is an error."""
        key = F.col(column) if isinstance(column, str) else column
        key = F.when(F.octet_length(key) > B.MAX_KEY, F.raise_error(F.lit("a key is longer than 65536 bytes"))).otherwise(key)
        return KeySet(df.select(key.alias("key")).filter(F.col("key").isNotNull()).dropDuplicates(["key"]))

    @staticmethod
    def from_strings(df: DataFrame, column: str | Column) -> KeySet:
        return KeySet.from_binary(df, B.key_of(F.col(column) if isinstance(column, str) else column))

    @staticmethod
    def read(spark: SparkSession, path: str) -> KeySet:
        """A set saved by save()."""
        return KeySet(spark.read.parquet(path).select("key"))

    def save(self, path: str) -> None:
        """As Parquet, in key order over all files, so that ranges of keys skip files and row groups."""
        self.df.orderBy("key").write.mode("overwrite").parquet(path)

    def cache(self) -> KeySet:
        self.df.cache()
        return self

    def release(self) -> None:
        self.df.unpersist()

    # set operations

    def add(self, other: KeySet) -> KeySet:
        return KeySet(self.df.unionByName(other.df).dropDuplicates(["key"]))

    def remove(self, other: KeySet) -> KeySet:
        return KeySet(self.df.join(other.df, "key", "left_anti"))

    def intersect(self, other: KeySet) -> KeySet:
        return KeySet(self.df.join(other.df, "key", "left_semi"))

    def _marked(self, batch: DataFrame, found: int, missing: int, null: int) -> DataFrame:
        mine = self.df.select(F.col("key").alias("__key"), F.lit(1).alias("__found"))
        n = F.octet_length("key")
        result = F.when(F.col("key").isNull() | (n > B.MAX_KEY), null).when(F.col("__found") == 1, found).otherwise(missing)
        return batch.join(mine, batch["key"] == mine["__key"], "left").withColumn("result", result).drop("__key", "__found")

    def add_results(self, batch: DataFrame) -> DataFrame:
        """What adding each key alone gives: 1 new, 0 there already, -1 null or too long. Repeats within the batch aren't ordered; see opscript for that."""
        return self._marked(batch, 0, 1, -1)

    def delete_results(self, batch: DataFrame) -> DataFrame:
        """1 deleted, 0 absent, -1 null or too long."""
        return self._marked(batch, 1, 0, -1)

    def lookup(self, batch: DataFrame) -> DataFrame:
        """result 1 if the key is in the set, else 0; null keys are in none."""
        return self._marked(batch, 1, 0, 0)

    def contains(self, key: bytes) -> bool:
        return bool(self.df.filter(F.col("key") == B.binary(key)).limit(1).count())

    # scans

    def scan(self) -> DataFrame:
        return self.df.orderBy("key")

    def count(self) -> int:
        return self.df.count()

    def range(self, lo: bytes, hi: bytes) -> DataFrame:
        """Keys in [lo, hi); none if hi <= lo."""
        return self.df.filter((F.col("key") >= B.binary(lo)) & (F.col("key") < B.binary(hi)))

    def starting_with(self, prefix: bytes) -> DataFrame:
        return self.df.filter(B.in_prefix(F.col("key"), prefix))

    def first(self, k: int) -> DataFrame:
        return self.df.orderBy("key").limit(k)

    def last(self, k: int) -> DataFrame:
        return self.df.orderBy(F.desc("key")).limit(k)

    def prefix_enum(self, word: bytes, *, most: int | None = None) -> DataFrame:
        """Payloads, in order, of the keys word, NUL, payload. The payload may be empty; word may hold NULs. most: stop after so many."""
        head = word + B.NUL
        if len(word) > B.MAX_KEY:
            return self.df.limit(0).select(F.col("key").alias("payload"))
        out = self.df.filter(B.in_prefix(F.col("key"), head)).select(F.substring("key", len(head) + 1, B.MAX_KEY + 1).alias("payload")).orderBy("payload")
        return out if most is None else out.limit(most)

    def prefix_enum_batch(self, words: DataFrame) -> DataFrame:
        """word, payload for a table of words without NULs: an equi-join on what stands before a key's first NUL.

        A word that holds NULs matches no first part; it is enumerated by prefix_enum.
        """
        parts = self.df.select(B.word_of(F.col("key")).alias("word"), B.payload_of(F.col("key")).alias("payload")).filter(F.col("word").isNotNull())
        return words.select("word").distinct().join(parts, "word")

    # order statistics

    def ranked(self) -> DataFrame:
        """key, rank: keys before it."""
        if self._ranked is None:
            self._ranked = rank_before(self.df, ["key"], "rank")
        return self._ranked

    def rank(self, probes: DataFrame) -> DataFrame:
        """probes with rank: keys strictly less than each key, in the set or not. A null key is the empty one.

        Keys and distinct probes are ordered together, probes first among equals, and
        counted in a running sum; no inequality join.
        """
        wanted = probes.select(F.coalesce("key", B.binary(b"")).alias("key")).distinct()
        both = self.df.select("key", F.lit(1).alias("own")).unionByName(wanted.select("key", F.lit(0).alias("own")))
        sums = running_sum_before(both, ["key", "own"], "own", "rank").filter("own = 0").select(F.col("key").alias("__key"), "rank")
        return probes.join(sums, F.coalesce(probes["key"], B.binary(b"")) == F.col("__key")).drop("__key")

    def select(self, places: DataFrame) -> DataFrame:
        """places (k) with key: the k-th key from 0; null where there is none."""
        r = self.ranked().withColumnRenamed("rank", "__rank")
        return places.join(r, places["k"] == r["__rank"], "left").drop("__rank")

    def range_count(self, ranges: DataFrame) -> DataFrame:
        """ranges (lo, hi) with n: keys in [lo, hi); 0 if hi <= lo. Null bounds are the empty key."""
        lo, hi = (F.coalesce(c, B.binary(b"")) for c in ("lo", "hi"))
        ends = ranges.select(lo.alias("key")).unionByName(ranges.select(hi.alias("key"))).distinct()
        ranks = self.rank(ends)
        a = ranks.select(F.col("key").alias("__lo"), F.col("rank").alias("__a"))
        b = ranks.select(F.col("key").alias("__hi"), F.col("rank").alias("__b"))
        return (
            ranges.join(a, lo == F.col("__lo")).join(b, hi == F.col("__hi"))
            .withColumn("n", F.greatest(F.lit(0), F.col("__b") - F.col("__a")).cast("bigint")).drop("__lo", "__hi", "__a", "__b")
        )

    # below a prefix

    def bound(self, prefix: bytes) -> KeySet:
        """The rests of the keys that begin with prefix. An absent prefix gives the empty set."""
        rest = F.substring("key", len(prefix) + 1, B.MAX_KEY + 1)
        return KeySet(self.starting_with(prefix).select(rest.alias("key")))

    def rank_from(self, probes: DataFrame) -> DataFrame:
        """probes (prefix, key) with rank: keys of the prefix whose rest is less than key.

        Keys from prefix up to prefix + key all begin with prefix, so it is the
        difference of two ranks.
        """
        whole = probes.withColumn("lo", F.col("prefix")).withColumn("hi", F.concat("prefix", F.coalesce("key", B.binary(b""))))
        return self.range_count(whole).withColumnRenamed("n", "rank").drop("lo", "hi")

    def select_from(self, places: DataFrame) -> DataFrame:
        """places (prefix, k) with rest: of the k-th key of the prefix; null where there is none."""
        start = self.rank(places.select(F.col("prefix").alias("key")).distinct()).select(F.col("key").alias("__prefix"), F.col("rank").alias("__start"))
        at = places.join(start, places["prefix"] == start["__prefix"]).withColumn("__at", F.col("__start") + F.col("k"))
        r = self.ranked().withColumnRenamed("key", "__key").withColumnRenamed("rank", "__rank")
        found = at.join(r, (at["__at"] == r["__rank"]) & (F.col("k") >= 0), "left")
        inside = F.substring("__key", F.lit(1), F.octet_length("prefix")) == F.col("prefix")
        rest = F.when(inside, F.substring("__key", F.octet_length("prefix") + 1, F.octet_length("__key")))
        return found.withColumn("rest", rest).drop("__prefix", "__start", "__at", "__key", "__rank")

    def range_count_from(self, ranges: DataFrame) -> DataFrame:
        """ranges (prefix, lo, hi) with n: keys of the prefix with rests in [lo, hi)."""
        whole = ranges.withColumnRenamed("lo", "__l").withColumnRenamed("hi", "__h")
        whole = whole.withColumn("lo", F.concat("prefix", "__l")).withColumn("hi", F.concat("prefix", "__h"))
        return self.range_count(whole).drop("lo", "hi").withColumnRenamed("__l", "lo").withColumnRenamed("__h", "hi")
