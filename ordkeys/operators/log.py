"""Logs of adds and deletes, and reads of a base set under a log.

A log is lsn (any increasing number), op (1 add, 2 delete), key (1 to 65,545 bytes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordkeys.functions import bytes as B
from ordkeys.operators.keyset import KeySet

ADD, DELETE = 1, 2
#: Bytes of a payload that layered reads understand.
PAYLOAD = 8
#: Bytes of the file header, and of a record besides its key.
HEADER_BYTES, RECORD_BYTES = 16, 9


class Log:
    def __init__(self, df: DataFrame):
        self.df = df.select(F.col("lsn").cast("bigint").alias("lsn"), F.col("op").cast("tinyint").alias("op"), "key")

    @staticmethod
    def accepted(df: DataFrame) -> DataFrame:
        """df with result: 0 if a record can be logged, else -1 (null, empty or too long key, unknown op)."""
        ok = F.col("key").isNotNull() & F.octet_length("key").between(1, B.MAX_LOG_KEY) & F.col("op").isin(ADD, DELETE)
        return df.withColumn("result", F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(-1))

    def append(self, df: DataFrame) -> Log:
        """With the records of df that can be logged; its lsns must be above those here."""
        return Log(self.df.unionByName(Log(Log.accepted(df).filter("result = 0")).df))

    def replay(self) -> DataFrame:
        return self.df.orderBy("lsn")

    def size(self) -> DataFrame:
        """One row: bytes of the file that holds these records."""
        return self.df.agg((F.lit(HEADER_BYTES) + F.coalesce(F.sum(F.octet_length("key") + RECORD_BYTES), F.lit(0))).cast("bigint").alias("bytes"))

    def collapse(self) -> DataFrame:
        """key, op: the last record of each key."""
        return self.df.groupBy("key").agg(F.max_by("op", "lsn").alias("op"))

    def overlay(self) -> DataFrame:
        """word, payload, op: the last record of each key of the form word, NUL, 8 bytes; others don't count in layered reads."""
        key = F.col("key")
        ok = (B.nul_at(key) > 0) & (F.octet_length(key) - B.nul_at(key) == PAYLOAD)
        return self.collapse().filter(ok).select(B.word_of(key).alias("word"), B.payload_of(key).alias("payload"), "op")

    def history(self) -> DataFrame:
        """key, live: every key that was ever added, and whether it still is there."""
        return self.df.groupBy("key").agg(F.max(F.col("op") == ADD).alias("added"), (F.max_by("op", "lsn") == ADD).alias("live")).filter("added").select("key", "live")


class Layered:
    """A base set under a log, as of now. Order statistics are the base's own: base.rank and so on."""

    def __init__(self, base: KeySet, log: Log):
        self.base, self.log = base, log

    def _overlay_keys(self) -> DataFrame:
        return self.log.overlay().select(B.composite(F.col("word"), F.col("payload")).alias("__key"), F.col("op").alias("__op"))

    def lookup(self, batch: DataFrame) -> DataFrame:
        """batch with result: what the log says of a key of the layered form, else whether the base has it."""
        o = self._overlay_keys()
        base = self.base.lookup(batch).withColumnRenamed("result", "__base")
        return base.join(o, base["key"] == o["__key"], "left").withColumn("result", F.when(F.col("__op") == ADD, 1).when(F.col("__op") == DELETE, 0).otherwise(F.col("__base"))).drop("__base", "__op", "__key")

    def merged(self) -> KeySet:
        """What layered reads see: base, less deleted, with added keys of the layered form."""
        o = self._overlay_keys()
        gone = o.select(F.col("__key").alias("key"))
        added = o.filter(F.col("__op") == ADD).select(F.col("__key").alias("key"))
        return KeySet(self.base.df.join(gone, "key", "left_anti").unionByName(added))

    def prefix_enum(self, word: bytes) -> DataFrame:
        """Payloads in order. All are in byte order, also those that only the log has."""
        return self.merged().prefix_enum(word)

    def prefix_enum_batch(self, words: DataFrame) -> DataFrame:
        return self.merged().prefix_enum_batch(words)

    def compact(self) -> KeySet:
        """A new base with every record applied, of whatever form its key is."""
        last = self.log.collapse()
        return KeySet(self.base.df.join(last.select("key"), "key", "left_anti").unionByName(last.filter(F.col("op") == ADD).select("key")))
