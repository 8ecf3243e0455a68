"""Automaton and log files as Spark sources and sinks.

Files come through Spark's binaryFile source, so they may be in any store that Spark
reads; one task holds one file. ``register`` adds the formats to spark.read as well.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ordkeys.functions import bytes as B
from ordkeys.operators.automaton import Automaton
from ordkeys.operators.keyset import KeySet
from ordkeys.operators.log import Log
from ordkeys.operators.order import running_sum_before
from ordkeys.sources import files

_BATCH = 50_000
LOG_SCHEMA = "file string, lsn bigint, op tinyint, key binary"


def _rows(spark: SparkSession, path: str, schema: str, kinds: list[tuple[str, pa.DataType]], rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema(kinds)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held = []
                for row in rows_of(name, content.as_py()):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _none_empty(spark: SparkSession, path: str) -> None:
    """Spark passes over files without bytes; here they are damaged ones."""
    place, store = _path(spark, path)
    for found in store.globStatus(place) or []:
        for status in store.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if not status.isDirectory() and status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
                raise files.Damaged(f"{status.getPath()} is empty")


def read_keys(spark: SparkSession, path: str) -> KeySet:
    """The keys of one or more automaton files. A damaged file is an error."""
    _none_empty(spark, path)
    found = _rows(spark, path, "key binary", [("key", pa.binary())], lambda _, data: ((k,) for k in files.keys_of(*files.read_automaton(data))))
    return KeySet.from_binary(found, "key")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """state_id, is_final, n_trans of an automaton file."""
    def rows(_, data):
        finals, edges = files.read_automaton(data)
        return ((i, f, len(e)) for i, (f, e) in enumerate(zip(finals, edges, strict=True), 1))

    return _rows(spark, path, "state_id int, is_final boolean, n_trans int", [("state_id", pa.int32()), ("is_final", pa.bool_()), ("n_trans", pa.int32())], rows)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, sym, dst of an automaton file."""
    def rows(_, data):
        return ((i, sym, to) for i, own in enumerate(files.read_automaton(data)[1], 1) for sym, to in own)

    return _rows(spark, path, "src int, sym smallint, dst int", [("src", pa.int32()), ("sym", pa.int16()), ("dst", pa.int32())], rows)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """key, live of an automaton file that may hold dead branches."""
    _none_empty(spark, path)
    kinds = [("key", pa.binary()), ("live", pa.bool_())]
    return _rows(spark, path, "key binary, live boolean", kinds, lambda _, data: files.history_of(*files.read_automaton(data)))


def _packed(rows: DataFrame, pack) -> Iterator[bytes]:
    """rows as bytes, some thousand at a time, as they stream to the driver."""
    held = []
    for r in rows.toLocalIterator():
        held.append(pack(r))
        if len(held) == 10_000:
            yield b"".join(held)
            held = []
    yield b"".join(held)


def automaton_parts(automaton: Automaton) -> Iterator[bytes]:
    """The file of an automaton, part by part. Offsets and lengths are computed by Spark; the driver holds one part, and one bit a state."""
    length = (F.lit(1) + B.varint_length(F.col("dst"))).cast("bigint")
    own = automaton.edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum(length).alias("bytes"))
    states = automaton.states.select("state_id", "is_final").join(own, F.col("state_id") == F.col("src"), "left").select(
        "state_id", "is_final", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    states = running_sum_before(states, ["state_id"], "bytes", "start")
    total = states.agg(F.count("*").alias("n"), F.sum("degree").alias("trans"), F.sum(F.col("is_final").cast("int")).alias("finals"), F.sum("bytes").alias("csr")).first()
    in_order = states.orderBy("state_id")
    offsets = files.offsets_fit(total.n, total.csr)
    check = sent = 0

    def sum_up(part: bytes) -> bytes:
        nonlocal check, sent
        check, sent = crc32(part, check), sent + len(part)
        return part

    yield sum_up(files.header_of_automaton(total.n, total.trans, total.finals, offsets) + b"\0\0")
    bits = bytearray((total.n + 8) // 8)

    def degree(r) -> bytes:
        bits[r.state_id >> 3] |= r.is_final << (r.state_id & 7)
        return struct.pack("<H", r.degree)

    for part in _packed(in_order, degree):
        yield sum_up(part)
    yield sum_up(bytes(bits))
    if offsets:
        yield sum_up(bytes(-sent % 8) + struct.pack("<Q", 0))
        for part in _packed(in_order, lambda r: struct.pack("<Q", r.start)):
            yield sum_up(part)
        yield sum_up(struct.pack("<Q", total.csr))
    for part in _packed(automaton.edges.orderBy("src", "sym"), lambda r: bytes([r.sym]) + files.varint(r.dst)):
        yield sum_up(part)
    yield struct.pack("<I", check)


def automaton_bytes(automaton: Automaton) -> bytes:
    """The file of a small automaton."""
    return b"".join(automaton_parts(automaton))


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_whole(spark: SparkSession, path: str, parts: Iterable[bytes]) -> int:
    """Write a file in any store that Spark writes to; its length. It appears whole: parts go to a file beside it, which then takes its name."""
    place, store = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    store.setWriteChecksum(False)  # other programs write such files, too
    out, length = store.create(beside, True), 0
    try:
        for part in parts:
            for at in range(0, len(part), 1 << 20):
                out.write(bytearray(part[at : at + (1 << 20)]))
            length += len(part)
        out.close()
        if store.exists(place):
            store.delete(place, False)
        if not store.rename(beside, place):
            raise OSError(f"{path} can't be written")
    finally:
        if store.exists(beside):
            store.delete(beside, False)
    return length


def read_parts(spark: SparkSession, path: str) -> Iterator[bytes]:
    """A file of any store that Spark reads, a megabyte at a time."""
    place, store = _path(spark, path)
    stream = store.open(place)
    try:
        while part := bytes(stream.readNBytes(1 << 20)):
            yield part
    finally:
        stream.close()


def save_automaton(spark: SparkSession, automaton: Automaton, path: str) -> int:
    """Write the file of an automaton; its length."""
    return write_whole(spark, path, automaton_parts(automaton))


class LogFile:
    """A log file that records are added to.

    Opening it for writing makes it if it isn't there or holds no byte, and cuts what
    follows the last sound record. A file with a bad header is an error, but one of the
    header's length only, which is begun anew. Opened to be read, it must be there and
    is left as it is.
    """

    def __init__(self, spark: SparkSession, path: str, *, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path, read_only
        place, store = _path(spark, path)
        length = store.getFileStatus(place).getLen() if store.exists(place) else 0
        if read_only and length < files.HEADER_BYTES:
            raise files.Damaged("no log file")
        if length == 0 or not read_only and length == files.HEADER_BYTES and next(read_parts(spark, path)) != files.log_header():
            self.size = write_whole(spark, path, [files.log_header()])
            return
        self.size = sum(map(len, files.sound_parts(read_parts(spark, path))))
        if not read_only and self.size < length:
            self._write([])

    def _write(self, records: Iterable[bytes]) -> None:
        sound = files.sound_parts(read_parts(self.spark, self.path))
        self.size = write_whole(self.spark, self.path, chain(sound, records))

    def append(self, records: DataFrame) -> DataFrame:
        """Add the records (lsn, op, key) that can be logged, in order of lsn; gives what Log.accepted says of all of them."""
        if self.read_only:
            raise ValueError("the log was opened to be read")
        marked = Log.accepted(records)
        good = marked.filter("result = 0").orderBy("lsn").select(F.col("op").cast("int").alias("op"), "key")
        self._write(_packed(good, lambda r: files.log_record(r.op, bytes(r.key))))
        return marked

    def records(self) -> DataFrame:
        return read_log(self.spark, self.path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """file, lsn (byte offset in the file), op, key: all up to each file's first bad record. A file with a bad header is an error."""
    kinds = [("file", pa.string()), ("lsn", pa.int64()), ("op", pa.int8()), ("key", pa.binary())]
    return _rows(spark, path, LOG_SCHEMA, kinds, lambda name, data: ((name, *r) for r in files.read_log(data)))


def log_bytes(log: Log) -> bytes:
    """The file of a small log, record by record."""
    return files.log_header() + b"".join(_packed(log.replay(), lambda r: files.log_record(r.op, bytes(r.key))))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows_of):
        self.path, self.rows_of = path, rows_of

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_Part(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from self.rows_of(partition.path, f.read())


class AutomatonSource(DataSource):
    """spark.read.format("pdwg").load(path): keys. For paths that all executors can open; read_keys reads any store."""

    @classmethod
    def name(cls) -> str:
        return "pdwg"

    def schema(self) -> str:
        return "key binary"

    def reader(self, schema):
        return _Reader(self.options["path"], lambda _, data: ((k,) for k in files.keys_of(*files.read_automaton(data))))


class LogSource(DataSource):
    """spark.read.format("dawl").load(path): records."""

    @classmethod
    def name(cls) -> str:
        return "dawl"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], lambda name, data: ((name, *r) for r in files.read_log(data)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AutomatonSource)
    spark.dataSource.register(LogSource)


def open_layered(spark: SparkSession, base_path: str, log_path: str):
    """A layered view of an automaton file and a log file; a log that is missing or empty adds nothing."""
    from ordkeys.operators.log import Layered

    base = read_keys(spark, base_path)
    try:
        records = read_log(spark, log_path)
        sizes = spark.read.format("binaryFile").load(log_path).agg(F.max("length")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        sizes = 0
    if sizes < 16:
        records = spark.createDataFrame([], LOG_SCHEMA)
    return Layered(base, Log(records))
