"""A log as a stream: the last record of each key, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkeys.operators.keyset import KeySet
from ordkeys.operators.log import Layered, Log

LOG_SCHEMA = "lsn bigint, op tinyint, key binary"


def read_log_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Parquet files of records that appear in a folder."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def last_records(stream: DataFrame) -> DataFrame:
    """key, op, lsn: the record with the largest lsn. Records may come twice or late; the largest lsn wins. For output modes update and complete."""
    return stream.groupBy("key").agg(F.max_by("op", "lsn").alias("op"), F.max("lsn").alias("lsn"))


def live_keys(stream: DataFrame) -> DataFrame:
    return last_records(stream).filter("op = 1").select("key")


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the finished folders name=number below path, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    folders = [x.getPath() for x in store.listStatus(place) if x.isDirectory() and x.getPath().getName().startswith(f"{name}=")]
    done = [x for x in folders if store.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().partition("=")[2]) for x in done)


def _drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Put the last records of all batches up to a number into one folder.

    What the fold before has replaced is dropped only now, so that a reader that began
    before this fold still finds its folders.
    """
    before = _numbers(spark, path, "folded")
    if before and before[-1] >= upto:
        return
    last_records(_parts(spark, path, upto)).write.mode("overwrite").parquet(f"{path}/folded={upto}")
    for number in before[:-1]:
        _drop(spark, f"{path}/folded={number}")
    for number in _numbers(spark, path, "batch"):
        if before and number <= before[-1]:
            _drop(spark, f"{path}/batch={number}")


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of the last fold and of the batches after it."""
    folded = [n for n in _numbers(spark, path, "folded") if upto is None or n <= upto][-1:]
    batches = [n for n in _numbers(spark, path, "batch") if (not folded or n > folded[0]) and (upto is None or n <= upto)]
    found = [f"{path}/folded={n}" for n in folded] + [f"{path}/batch={n}" for n in batches]
    return spark.read.schema(LOG_SCHEMA).parquet(*found) if found else spark.createDataFrame([], LOG_SCHEMA)


def maintain(stream: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, fold_every: int = 20):
    """Keep a table of the last record of each key below path: one folder a batch, each written once under its number.

    A batch that is delivered again overwrites its own folder, so the table counts
    each record once; one that a fold holds already is only written, not read. After
    every fold_every batches their folders are folded into one, so that reading takes
    a bounded number of them.
    """
    def write(batch: DataFrame, number: int) -> None:
        last_records(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % fold_every == 0:
            fold(batch.sparkSession, path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """key, op, lsn of what maintain has written."""
    return last_records(_parts(spark, path))


def layered(spark: SparkSession, base: KeySet, path: str) -> Layered:
    """A base set under the log that maintain keeps below path, as of now."""
    return Layered(base, Log(read_table(spark, path)))
