"""The minimal acyclic automaton of a key set, derived as DataFrames.

Keys are put in order and numbered. Each gives one row of fixed size for each of its
prefixes, with 128-bit hashes of the prefix and of the rest, so that work is linear in
the keys' bytes however long a key is. A prefix's rests are told by their number and
the exclusive or of their hashes, pre-aggregated, so that the root, whose rests are all
keys, gathers nowhere. Prefixes with equal rests are one state.

The order of equally long prefixes is that of their first keys, so states are numbered
by (length, first key), by ranges, without comparing strings. ``conflicts`` checks the
merging exactly: prefixes of a state must agree in finality and in where each byte
leads, which by induction over the height is that they have the same rests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordkeys.functions import bytes as B
from ordkeys.functions.storage import materialize
from ordkeys.operators.order import rank_before, ranged

_NODE, _CLASS = ["id1", "id2"], ["n", "x1", "x2"]
_ROWS = "place bigint, depth int, sym smallint, id1 bigint, id2 bigint, up1 bigint, up2 bigint, rest1 bigint, rest2 bigint, ends boolean, live boolean"
#: Bytes of keys that are hashed at a time; one key may be more.
_BYTES = 1_000_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Spreads all bits of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 + 1 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _prefix_rows(keys: list[bytes], places: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
    """Columns of _ROWS for all prefixes of the keys.

    A byte's hash goes by its place from the start, for prefixes, or from the end, for
    rests; hashes of prefixes and rests are sums of their bytes' hashes.
    """
    data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(keys)), lengths)
    at = np.arange(len(data)) - starts[of]
    key = np.repeat(np.arange(len(keys)), lengths + 1)
    depth = np.arange(len(key)) - (starts + np.arange(len(keys)))[key]
    here, whole = starts[key] + depth, starts[key] + lengths[key]
    rest = (lengths[key] - depth).astype(np.uint64)
    ids, rests = [], []
    for seed in (1, 2):
        upto = lambda place, seed: np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(place.astype(np.uint64) << np.uint64(8) | data, seed), dtype=np.uint64)))
        ahead, back = upto(at, seed), upto(lengths[of] - at, seed + 2)
        ids.append(_mix((ahead[here] - ahead[starts[key]]) ^ depth.astype(np.uint64) << np.uint64(40), seed).view(np.int64))
        rests.append(_mix((back[whole] - back[here]) ^ (rest << np.uint64(1) | live[key]) << np.uint64(40), seed + 4))
    first = depth == 0
    up = [np.where(first, 0, np.concatenate((x[:1], x[:-1]))) for x in ids]
    sym = np.where(first, -1, np.append(data, 0)[here - 1]).astype(np.int16)
    return [places[key], depth.astype(np.int32), sym, *ids, *up, *(r.view(np.int64) for r in rests), rest == 0, live[key]]


def _prefixes(keys: DataFrame) -> DataFrame:
    """A row of _ROWS for each prefix of each key. keys: key, place, live."""
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_keys = batch.column("key").to_pylist()
            places, live = batch.column("place").to_numpy(), batch.column("live").to_numpy(zero_copy_only=False)
            start = held = 0
            for i, k in enumerate(all_keys):
                held += len(k) + 1
                if held >= _BYTES or i + 1 == len(all_keys):
                    columns = _prefix_rows(all_keys[start : i + 1], places[start : i + 1], live[start : i + 1])
                    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                    yield from (rows.slice(a, 100_000) for a in range(0, rows.num_rows, 100_000))
                    start, held = i + 1, 0

    return keys.select("key", "place", "live").mapInArrow(run, _ROWS)


class Automaton:
    """states: state_id, is_final, n_keys, access. edges: src, sym, dst. Ids from 1 by length, then bytes, of the shortest least access string; that is breadth-first order."""

    def __init__(self, states: DataFrame, nodes: DataFrame, classes: DataFrame):
        """nodes: the prefixes; classes: what they are merged by, numbered. Edges are derived when they are asked for."""
        self.states = states
        self._nodes, self._classes = nodes, classes
        self._found: DataFrame | None = None

    @staticmethod
    def of(keys: DataFrame, *, live: str | None = None) -> Automaton:
        """keys: key. With live, a boolean column, keys holds every key ever added, once; those no longer live keep their branches.

        Without keys there is one state, not final.
        """
        own = keys.select("key", (F.lit(True) if live is None else F.col(live)).alias("live"))
        own = ranged(own, ["key"], "keys").select("key", "live", F.col("__row").alias("place"))
        if live is not None:
            # a dead key that begins another one leaves no trace of its own
            ends = F.max(F.when(F.col("ends"), F.col("place")))
            inner = _prefixes(own).groupBy(*_NODE).agg(F.count("*").alias("n"), ends.alias("place")).filter("n > 1 and place is not null").select("place")
            own = materialize(own.filter("live").unionByName(own.filter("not live").join(inner, "place", "left_anti").select(own.columns)), "keys")
        final = F.max(F.col("ends") & F.col("live"))
        nodes = _prefixes(own).groupBy(*_NODE).agg(
            F.min("place").alias("place"), F.first("depth").alias("depth"), F.first("sym").alias("sym"), F.first("up1").alias("up1"), F.first("up2").alias("up2"),
            F.count("*").alias("n"), F.bit_xor("rest1").alias("x1"), F.bit_xor("rest2").alias("x2"), final.alias("is_final"), F.count(F.when(F.col("live"), 1)).alias("n_keys"),
        )
        nodes = materialize(nodes, "nodes")
        classes = nodes.groupBy(*_CLASS).agg(
            F.min(F.struct("depth", "place")).alias("least"), F.count("*").alias("members"), F.min("is_final").alias("never"), F.max("is_final").alias("is_final"), F.max("n_keys").alias("n_keys")
        ).select(*_CLASS, "least.depth", "least.place", "members", "never", "is_final", "n_keys")
        numbered = rank_before(classes, ["depth", "place"], "state_id").withColumn("state_id", (F.col("state_id") + 1).cast("int"))

        access = F.substring("key", F.lit(1), F.col("depth"))
        states = numbered.join(own.select("key", "place"), "place").select("state_id", "is_final", "n_keys", access.alias("access"))
        no_keys = keys.sparkSession.range(1).select(F.lit(1).alias("state_id"), F.lit(False).alias("is_final"), F.lit(0).cast("bigint").alias("n_keys"), B.binary(b"").alias("access"))
        states = states.unionByName(no_keys.join(nodes.limit(1), F.lit(True), "left_anti"))
        return Automaton(states, nodes, numbered)

    def _led(self) -> DataFrame:
        """src, sym, dst, most, times: where each byte leads from the members of a state, the least and the greatest, and from how many."""
        if self._found is None:
            numbers = self._classes.select(*_CLASS, "state_id")
            of_node = materialize(self._nodes.join(numbers, _CLASS).select(*_NODE, "up1", "up2", "sym", "state_id"), "members")
            parents = of_node.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("state_id").alias("src"))
            led = of_node.filter("sym >= 0").join(parents, ["up1", "up2"]).groupBy("src", "sym")
            self._found = materialize(led.agg(F.min("state_id").alias("dst"), F.max("state_id").alias("most"), F.count("*").alias("times")), "edges")
        return self._found

    @property
    def edges(self) -> DataFrame:
        return self._led().select("src", "sym", "dst")

    def conflicts(self) -> DataFrame:
        """state_id of states whose prefixes differ in finality or in where a byte leads: none, unless hashes collide."""
        members = self._classes.select(F.col("state_id").alias("src"), "members")
        split = self._led().join(members, "src").filter("dst <> most or times <> members").select(F.col("src").alias("state_id"))
        mixed = self._classes.filter("never <> is_final").select("state_id")
        return split.unionByName(mixed).distinct()

    def stats(self) -> DataFrame:
        """One row: n_states, n_final (states, not keys), n_trans, n_keys. Figures of an allocator or hash table have no counterpart."""
        s = self.states.agg(
            F.count("*").alias("n_states"), F.sum(F.col("is_final").cast("bigint")).alias("n_final"), F.max(F.when(F.col("state_id") == 1, F.col("n_keys"))).alias("n_keys")
        )
        e = self.edges.agg(F.count("*").alias("n_trans"))
        return s.select("*", e.scalar().alias("n_trans")).select("n_states", "n_final", "n_trans", "n_keys")

    def subtree_counts(self) -> DataFrame:
        return self.states.select("state_id", "n_keys")

    def edge(self, src: int, sym: int) -> DataFrame:
        return self.edges.filter((F.col("src") == src) & (F.col("sym") == sym))

    def edges_of(self, src: int) -> DataFrame:
        return self.edges.filter(F.col("src") == src).orderBy("sym")

    def find_edges(self, probes: DataFrame) -> DataFrame:
        """probes (src, sym) with dst: where the byte leads; null if nowhere."""
        return probes.join(self.edges, ["src", "sym"], "left")

    def keys_below(self, keys: DataFrame, state_id: int) -> DataFrame:
        """Rests, in order, of the keys below a state: those of its access string."""
        at = self.states.filter(F.col("state_id") == state_id).select("access")
        n = F.octet_length("access")
        joined = keys.join(F.broadcast(at), F.substring("key", F.lit(1), n) == F.col("access"))  # one row
        return joined.select(F.substring("key", n + 1, F.octet_length("key")).alias("rest")).orderBy("rest")

    def dot(self) -> DataFrame:
        """Lines of a Graphviz graph: line_no, line."""
        states = self.states.select(
            F.col("state_id").alias("a"), F.lit(-1).alias("b"),
            F.format_string('  %d [shape=%s];', "state_id", F.when(F.col("is_final"), "doublecircle").otherwise("circle")).alias("line"),
        )
        edges = self.edges.select(
            F.col("src").alias("a"), F.col("sym").cast("int").alias("b"),
            F.concat(F.format_string('  %d -> %d [label="', "src", "dst"), F.when(F.col("sym").isin(34, 92), F.concat(F.lit("\\"), B.label_of(F.col("sym")))).otherwise(B.label_of(F.col("sym"))), F.lit('"];')).alias("line"),
        )
        ends = self.states.sparkSession.createDataFrame([(0, -1, "digraph keys {"), ((1 << 31) - 1, 999, "}")], "a int, b int, line string")
        rows = ends.unionByName(states).unionByName(edges)
        return rank_before(rows, ["a", "b"], "line_no").select((F.col("line_no") + 1).cast("int").alias("line_no"), "line")
