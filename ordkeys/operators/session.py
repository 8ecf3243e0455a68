"""Scripts of all operations on a set, a view and a log, one a line, with one result line each.

A line is an operation and its arguments; keys are in hex, numbers decimal, files are
names below the session's folder. Results are lines that begin with ``= ``, followed by
payload lines where an operation enumerates.

Operations aren't run one by one: adds, deletes and lookups between two changes of the
set's origin are one replay by window, and so are reads of the same state of a set.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkeys import ABI_VERSION
from ordkeys.functions import bytes as B
from ordkeys.functions.storage import materialize
from ordkeys.operators import opscript
from ordkeys.operators.automaton import Automaton
from ordkeys.operators.keyset import KeySet
from ordkeys.operators.log import Layered, Log

#: Results for a key that isn't in hex.
_BAD = {"add": "-1", "del": "-1", "lookup": "0", "rank": "0", "vlookup": "0", "vprefix": "0", "vrank": "0", "wadd": "-1", "wdel": "-1", "fromstate": "0"}
_COUNTS = {"rancount": "rc", "vrancount": "vrc"}
_HISTORY = "key binary, live boolean"


def parse_key(text: str) -> bytes | None:
    try:
        return bytes.fromhex(text) if " " not in text else None
    except ValueError:
        return None


class _Reads:
    """Rank, select, range count and lookup on one state of a set, run together."""

    def __init__(self, session: Session, keys: KeySet, lookup=None):
        self.session, self.keys, self.lookup = session, keys, lookup or keys.lookup
        self.held: dict[str, list[tuple]] = {}

    def add(self, kind: str, name: str, prefix: bytes, *args) -> None:
        self.held.setdefault(kind, []).append((self.session.slot(), name, prefix, *args))

    def run(self) -> None:
        spark, out, held = self.session.spark, self.session.out, self.held
        self.held = {}
        rows = lambda kind, columns: spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in held[kind]], f"slot int, name string, prefix binary, {columns}")
        if "lookup" in held:
            for r in self.lookup(rows("lookup", "key binary")).collect():
                out[r.slot] = [f"= {r.name} {r.result}"]
        if "rank" in held:
            for r in self.keys.rank_from(rows("rank", "key binary")).collect():
                out[r.slot] = [f"= {r.name} {r['rank']}"]
        if "count" in held:
            for r in self.keys.range_count_from(rows("count", "lo binary, hi binary")).collect():
                out[r.slot] = [f"= {_COUNTS[r.name]} {r.n}"]
        if "select" in held:
            for r in self.keys.select_from(rows("select", "k bigint")).collect():
                out[r.slot] = [f"= {r.name} -1" if r.rest is None else f"= {r.name} {len(r.rest)} {bytes(r.rest).hex()}"]


class Session:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.out: list[list[str]] = []
        self.origin: DataFrame | None = None  # history that the set was made with; None: no set
        self.changes: list[tuple[int, str, bytes]] = []
        self.building: list[bytes] | None = None
        self.built_well = True
        self.prefix = b""
        self.reads: _Reads | None = None
        self.view: _Reads | None = None
        self.enumerate = None
        self.log = None
        self.logged: list[tuple[int, int, bytes]] = []

    def slot(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def say(self, *lines: str) -> None:
        self.out.append(list(lines))

    def run(self, lines: Iterable[str]) -> list[str]:
        """The result lines of a script. Of ``stats``, the two figures that aren't functions of the history are question marks."""
        for line in lines:
            line = line.rstrip("\n").lstrip(" ")
            if line:
                name, _, rest = line.partition(" ")
                self._one(name, rest)
        self._settle()
        self._end_reads()
        self._end_log()
        return [x for lines in self.out for x in lines]

    # the set

    def _history_ops(self) -> DataFrame:
        """All adds and deletes so far as a script; the origin's come first."""
        ops = self.spark.createDataFrame([(i, o, bytearray(k)) for i, o, k in self.changes], "seq bigint, op string, key binary")
        added = self.origin.select(F.lit(-2).cast("bigint").alias("seq"), F.lit("add").alias("op"), "key")
        dropped = self.origin.filter("not live").select(F.lit(-1).cast("bigint").alias("seq"), F.lit("del").alias("op"), "key")
        return added.unionByName(dropped).unionByName(ops)

    def _settle(self) -> None:
        """Run the point operations that are open; what they leave becomes the origin."""
        if not self.changes:
            return
        ops = self._history_ops()
        for r in opscript.replay(ops).filter("seq >= 0").select("seq", "op", "result").collect():
            self.out[r.seq] = [f"= {r.op} {r.result}"]
        usable = ops.filter(F.octet_length("key") <= B.MAX_KEY)
        self.origin = materialize(opscript.history(usable), "history")
        self.changes = []

    def _end_reads(self) -> None:
        for reads in (self.reads, self.view):
            if reads:
                reads.run()

    def _change_origin(self, history: DataFrame | None) -> None:
        self._settle()
        self._end_reads()
        self.origin, self.reads = history, None

    def _set_reads(self) -> _Reads:
        if self.changes or not self.reads:
            self._settle()
            self.reads = _Reads(self, KeySet(self.origin.filter("live").select("key")))
        return self.reads

    def _made(self, keys: Iterable[bytes]) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k), True) for k in keys], _HISTORY).dropDuplicates(["key"])

    def _loaded(self, name: str) -> DataFrame | None:
        from ordkeys.sources import io

        return self._try(lambda: materialize(io.read_history(self.spark, self._place(name)), "loaded"))

    def _place(self, name: str) -> str:
        return f"{self.folder}/{name}"

    @staticmethod
    def _try(f):
        """None where a file is missing or damaged."""
        from ordkeys.sources.files import Damaged

        try:
            return f()
        except Damaged:
            return None
        except Exception as e:
            if "Damaged" in str(e) or "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return None
            raise

    # the log

    def _end_log(self) -> None:
        if self.log and self.logged:
            self.log.append(self.spark.createDataFrame([(i, o, bytearray(k)) for i, o, k in self.logged], "lsn bigint, op int, key binary"))
        self.logged = []

    def _open_view(self, name: str, base: str, log: str | None) -> None:
        from ordkeys.sources import io

        def opened():
            keys = materialize(io.read_keys(self.spark, self._place(base)).df, "view")
            if log is None:
                return KeySet(keys), KeySet(keys)
            layered = io.open_layered(self.spark, self._place(base), self._place(log))
            return KeySet(keys), Layered(KeySet(keys), Log(materialize(layered.log.df, "view-log")))

        self._end_log()
        found = self._try(opened)
        if found:
            if self.view:
                self.view.run()
            base_keys, whole = found
            self.view, self.enumerate = _Reads(self, base_keys, whole.lookup), whole.prefix_enum
        self.say(f"= {name} {int(found is not None)}")

    def _one(self, name: str, rest: str) -> None:
        from ordkeys.sources.io import LogFile

        key = parse_key(rest)
        if name in _BAD and key is None and (name[0] in "vw" or self.origin is not None):
            self.say(f"= {name} {_BAD[name]}")
        elif name == "buildbegin":
            self.building, self.built_well = [], True
        elif name == "bkey" and self.building is not None:
            self.built_well &= key is not None
            self.building.append(key or b"")
        elif name == "buildend":
            well = self.built_well and all(len(k) <= B.MAX_KEY for k in self.building or [])
            if well:
                self._change_origin(self._made(self.building or []))
            self.building = None
            self.say(f"= build {int(well)}")
        elif name in ("create", "free"):
            self._change_origin(self._made([]) if name == "create" else None)
            self.say(f"= {name} 1")
        elif name == "vopen":
            self._open_view(name, rest, None)
        elif name == "lopen":
            base, _, log = rest.partition(" ")
            self._open_view(name, base, log)
        elif name == "vclose":
            if self.view:
                self.view.run()
            self.view = self.enumerate = None
            self.say("= vclose")
        elif name == "vprefix":
            found = [bytes(r.payload).hex() for r in self.enumerate(key).collect()] if self.enumerate else []
            self.say(f"= vprefix {len(found)}", *found)
        elif name in ("vlookup", "vrank", "vselect", "vrancount"):
            self._read(self.view, name, rest, key, b"")
        elif name in ("wopen", "wopenro"):
            self._end_log()
            opened = self._try(lambda: LogFile(self.spark, self._place(rest), read_only=name == "wopenro"))
            self.log = opened or self.log
            self.say(f"= {name} {int(opened is not None)}")
        elif name in ("wadd", "wdel"):
            well = self.log is not None and not self.log.read_only and 1 <= len(key) <= B.MAX_LOG_KEY
            if well:
                self.logged.append((len(self.logged), 1 if name == "wadd" else 2, key))
            self.say(f"= {name} {0 if well else -1}")
        elif name == "wsize":
            self._end_log()
            self.say(f"= wsize {self.log.size if self.log else 0}")
        elif name == "wreplay":
            self._end_log()
            rows = self.log.records().orderBy("lsn").collect() if self.log else []
            self.say(f"= wreplay {len(rows)}", *(f"{r.op} {bytes(r.key).hex()}" for r in rows))
        elif name == "wclose":
            self._end_log()
            self.log = None
            self.say("= wclose")
        elif self.origin is None:
            self.say("= error NOTIMPL")
        elif name == "abi":
            self.say(f"= abi {ABI_VERSION}")
        elif name in ("add", "del", "lookup"):
            if self.reads and name != "lookup":
                self.reads.run()
                self.reads = None
            self.changes.append((self.slot(), name, key))
        elif name == "stats":
            self._settle()
            r = Automaton.of(self.origin, live="live").stats().first()
            self.say(f"= stats ? {r.n_states} {r.n_final} {r.n_trans} ?")
        elif name == "save":
            from ordkeys.sources.io import save_automaton

            self._settle()
            save_automaton(self.spark, Automaton.of(self.origin, live="live"), self._place(rest))
            self.say("= save 0")
        elif name in ("load", "loadro"):
            found = self._loaded(rest)
            if found is not None:
                self._change_origin(found)
            self.say(f"= {name} {int(found is not None)}")
        elif name == "fromstate":
            self._settle()
            there = key == b"" or self.origin.filter(B.in_prefix(F.col("key"), key)).limit(1).count()
            self.prefix = key if there else b""
            self.say(f"= fromstate {int(bool(there))}")
        elif name in ("rank", "select", "rancount"):
            self._read(self._set_reads(), name, rest, key, self.prefix)
        else:
            self.say("= error NOTIMPL")

    def _read(self, reads: _Reads | None, name: str, rest: str, key: bytes | None, prefix: bytes) -> None:
        if name.endswith("rancount"):
            ends = [parse_key(x) for x in rest.split(" ")]
            if reads is None or len(ends) != 2 or None in ends:
                self.say(f"= {_COUNTS[name]} 0")
            else:
                reads.add("count", name, prefix, *ends)
        elif name.endswith("select"):
            if reads is None:
                self.say(f"= {name} -1")
            else:
                reads.add("select", name, prefix, int(rest) if rest.isdigit() else 0)
        elif reads is None:
            self.say(f"= {name} 0")
        else:
            reads.add(name.removeprefix("v"), name, prefix, key)
