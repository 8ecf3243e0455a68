import bisect
import random

import pytest
from pyspark.sql import functions as F

from ordkeys.functions import bytes as B
from ordkeys.operators import opscript
from ordkeys.operators.automaton import Automaton
from ordkeys.operators.keyset import KeySet
from ordkeys.operators.log import Layered, Log
from ordkeys.operators.order import rank_before, ranged, running_sum_before


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], schema)


def values(df, *names):
    return [tuple(bytes(v) if isinstance(v, bytearray | bytes) else v for v in (r[n] for n in names)) for r in df.collect()]


KEYS = [b"a", b"ab", b"abc", b"abd", b"ac", b"b", b"bc", b"bd", b"c", b"c\x00", b"", b"\xff", b"\xff\xff", "é".encode(), b"a\x00c", b"p\x00x", b"p\x00", b"p\x00\x00z"]


@pytest.fixture(scope="module")
def keys(spark):
    return KeySet.of(spark, KEYS + KEYS[:4]).cache()


def test_order_is_by_unsigned_bytes(keys):
    assert [k for (k,) in values(keys.scan(), "key")] == sorted(KEYS)
    assert keys.count() == len(KEYS)


def test_rank_select_and_ranges(spark, keys):
    order = sorted(KEYS)
    probes = [*KEYS, b"abb", b"zz", b"\x00", b"\xff\xff\xff", b"ab\x00", None]
    got = dict(values(keys.rank(frame(spark, [(p,) for p in probes], "key binary")), "key", "rank"))
    assert got == {p: bisect.bisect_left(order, p or b"") for p in probes}
    got = dict(values(keys.select(frame(spark, [(k,) for k in (-1, 0, 3, len(order) - 1, len(order), 99)], "k bigint")), "k", "key"))
    assert got == {-1: None, 0: order[0], 3: order[3], len(order) - 1: order[-1], len(order): None, 99: None}
    pairs = [(b"a", b"b"), (b"", b"\xff"), (b"\xff", b""), (b"ac", b"ac"), (None, b"b")]
    got = values(keys.range_count(frame(spark, pairs, "lo binary, hi binary")), "lo", "hi", "n")
    assert sorted(got, key=str) == sorted(((a, b, sum((a or b"") <= k < b for k in order)) for a, b in pairs), key=str)


def test_below_a_prefix(spark, keys):
    rests = {p: sorted(k[len(p) :] for k in KEYS if k.startswith(p)) for p in (b"a", b"ab", b"q", b"", b"\xff")}
    probes = [(p, k) for p in rests for k in (b"", b"b", b"c", b"\xff", b"\xff\xff")]
    assert sorted(values(keys.rank_from(frame(spark, probes, "prefix binary, key binary")), "prefix", "key", "rank")) == sorted((p, k, bisect.bisect_left(rests[p], k)) for p, k in probes)
    places = [(p, k) for p in rests for k in (-1, 0, 1, 2, 50)]
    got = {(p, k): r for p, k, r in values(keys.select_from(frame(spark, places, "prefix binary, k bigint")), "prefix", "k", "rest")}
    assert got == {(p, k): rests[p][k] if 0 <= k < len(rests[p]) else None for p, k in places}
    spans = [(p, b"b", b"d") for p in rests] + [(b"a", b"d", b"b")]
    assert sorted(values(keys.range_count_from(frame(spark, spans, "prefix binary, lo binary, hi binary")), "prefix", "lo", "n")) == sorted((p, lo, sum(lo <= r < hi for r in rests[p])) for p, lo, hi in spans)
    for p, own in rests.items():
        assert [k for (k,) in values(keys.bound(p).scan(), "key")] == own


def test_prefix_enum_needs_the_nul(keys):
    assert [p for (p,) in values(keys.prefix_enum(b"p"), "payload")] == [b"", b"\x00z", b"x"]
    assert [p for (p,) in values(keys.prefix_enum(b"p\x00"), "payload")] == [b"z"]
    assert [p for (p,) in values(keys.prefix_enum(b"p", most=1), "payload")] == [b""]
    assert values(keys.prefix_enum(b"ab"), "payload") == []
    assert values(keys.prefix_enum(b"x" * 70_000), "payload") == []


def test_results_of_batches(spark, keys):
    batch = frame(spark, [(b"a",), (b"zz",), (None,), (b"x" * 65_537,), (b"",)], "key binary")
    by = lambda df: {k if k is None or len(k) < 9 else "long": r for k, r in values(df, "key", "result")}
    assert by(keys.add_results(batch)) == {b"a": 0, b"zz": 1, None: -1, "long": -1, b"": 0}
    assert by(keys.delete_results(batch)) == {b"a": 1, b"zz": 0, None: -1, "long": -1, b"": 1}
    assert by(keys.lookup(batch)) == {b"a": 1, b"zz": 0, None: 0, "long": 0, b"": 1}
    other = KeySet.of(spark, [b"a", b"new"])
    assert keys.add(other).count() == len(KEYS) + 1
    assert keys.remove(other).count() == len(KEYS) - 1
    assert keys.intersect(other).count() == 1
    assert keys.contains(b"c\x00") and not keys.contains(b"c\x01")


def test_empty_set_and_bad_keys(spark):
    none = KeySet.empty(spark)
    assert none.count() == 0
    assert values(none.rank(frame(spark, [(b"x",)], "key binary")), "rank") == [(0,)]
    assert values(Automaton.of(none.df).stats(), "n_states", "n_final", "n_trans", "n_keys") == [(1, 0, 0, 0)]
    with pytest.raises(Exception, match="NUL"):
        KeySet.from_strings(spark.createDataFrame([("a\x00b",)], "s string"), "s").count()
    with pytest.raises(Exception, match="65536"):
        KeySet.from_binary(frame(spark, [(b"x" * 65_537,)], "key binary"), "key").count()


def test_saved_set_is_read_with_pushed_ranges(spark, keys, tmp_path):
    keys.save(str(tmp_path / "set"))
    back = KeySet.read(spark, str(tmp_path / "set"))
    assert back.count() == len(KEYS)
    plan = back.starting_with(b"ab")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_running_sums_over_ranges(spark):
    data = [(i, (i * 7919) % 1000, i % 5) for i in range(3000)] + [(7, 500, 1)] * 1000  # many equal rows
    want, total = [], 0
    for k, i, v in sorted((k, i, v) for i, k, v in data):
        want.append((k, i, v, total))
        total += v
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(data, "id int, k int, v int")
        got = running_sum_before(rows, ["k", "id"], "v", "s")
        assert sorted(values(got, "k", "id", "v", "s")) == want
        ranks = rank_before(rows, ["k", "id"], "r")
        assert sorted(r for (r,) in values(ranks, "r")) == list(range(4000)) and values(ranks.orderBy("r"), "k", "id") == [w[:2] for w in want]
        sizes = [r["count"] for r in ranged(rows, ["k", "id"], "sizes").groupBy("__range").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def minimal(words, live=None):
    """States, final states and edges by brute force over classes of prefixes."""
    live = set(words) if live is None else live
    nodes = {w[:i] for w in words for i in range(len(w) + 1)} or {b""}
    rests = {p: frozenset((q[len(p) :], q in live) for q in nodes if q.startswith(p)) for p in nodes}
    return len(set(rests.values())), len({c for p, c in rests.items() if p in live}), len({(rests[p[:-1]], p[-1]) for p in nodes if p})


def test_automaton_by_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        words = {bytes(rng.choice(b"abc\x00") for _ in range(rng.randrange(0, 6))) for _ in range(40)}
        a = Automaton.of(KeySet.of(spark, words).df)
        assert values(a.stats(), "n_states", "n_final", "n_trans", "n_keys") == [(*minimal(words), len(words))]
        edges: dict[int, list] = {}
        for src, sym, dst in values(a.edges.orderBy("src", "sym"), "src", "sym", "dst"):
            edges.setdefault(src, []).append((sym, dst))
        # breadth-first numbering from 1
        order, seen = [1], {1}
        for s in order:
            for _, t in edges.get(s, []):
                if t not in seen:
                    seen.add(t)
                    order.append(t)
        assert order == list(range(1, len(order) + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_automaton_keeps_dead_branches(spark, seed):
    rng = random.Random(seed)
    words = {b"abc", b"abd", b"x", b"ab"} | {bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(0, 7))) for _ in range(40)}
    live = {b"abc", b"x"} | {w for w in words if rng.random() < 0.4}
    words |= {b"pq", b"pr", b"sq", b"sr"}  # two dead rests in one place, the same two alive in another
    live = live - {b"pq", b"pr"} | {b"sq", b"sr"}
    history = frame(spark, [(w, w in live) for w in words], "key binary, live boolean")
    a = Automaton.of(history, live="live")
    assert values(a.stats(), "n_states", "n_final", "n_trans", "n_keys") == [(*minimal(words, live), len(live))]
    assert a.conflicts().count() == 0


def test_automaton_of_a_very_long_key(spark):
    long = b"ab" * 30_000
    a = Automaton.of(frame(spark, [(long,), (long[:-1] + b"c",), (b"zz" + long[2:],)], "key binary"))
    # two spines over a common tail: aba.. and zzab..; and the end that two keys share
    assert values(a.stats(), "n_final", "n_keys") == [(1, 3)]
    n, e = values(a.stats(), "n_states", "n_trans")[0]
    assert n < 120_010 and e < 120_012 and a.conflicts().count() == 0
    top = values(a.edges_of(1), "sym")
    assert [s for (s,) in top] == [ord("a"), ord("z")]


def test_conflicts_are_found(spark, monkeypatch):
    from ordkeys.operators import automaton

    keys = frame(spark, [(w,) for w in (b"ab", b"ac", b"bd", b"be")], "key binary")
    assert Automaton.of(keys).conflicts().count() == 0
    original = automaton._prefixes

    def prefixes(rows):  # rests are told by their number only
        return original(rows).withColumn("rest1", F.lit(0).cast("bigint")).withColumn("rest2", F.lit(0).cast("bigint"))

    monkeypatch.setattr(automaton, "_prefixes", prefixes)
    assert Automaton.of(keys).conflicts().count() > 0


def test_walking_and_dot(spark):
    keys = KeySet.of(spark, [b"ab", b"ac", b"b", b'"', b"\x01"])
    a = Automaton.of(keys.df)
    assert [s for (s,) in values(a.edges_of(1), "sym")] == [1, 34, 97, 98]
    (to,) = values(a.edge(1, 97), "dst")[0]
    assert [r for (r,) in values(a.keys_below(keys.df, to), "rest")] == [b"b", b"c"]
    assert [r for (r,) in values(a.keys_below(keys.df, 1), "rest")] == sorted([b"ab", b"ac", b"b", b'"', b"\x01"])
    lines = [x for (x,) in values(a.dot().orderBy("line_no"), "line")]
    assert lines[0] == "digraph keys {" and lines[-1] == "}"
    assert any('label="\\""' in x for x in lines) and any('label="?"' in x for x in lines)


def test_script_replay_by_brute_force(spark):
    rng = random.Random(1)
    ops = [(i, rng.choice(["add", "add", "lookup", "del"]), bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 4)))) for i in range(600)]
    ops.append((600, "add", None))
    ops.append((601, "lookup", None))
    have, want = set(), []
    for i, op, k in ops:
        r = (0 if op == "lookup" else -1) if k is None else int(k in have) if op != "add" else int(k not in have)
        want.append((i, r))
        if k is not None and op != "lookup":
            (have.add if op == "add" else have.discard)(k)
    df = frame(spark, ops, "seq int, op string, key binary")
    assert sorted(values(opscript.replay(df), "seq", "result")) == want
    assert {k for k, live in values(opscript.history(df), "key", "live") if live} == have


def test_layered_reads(spark):
    eight = lambda n: n.to_bytes(8, "big")
    base = KeySet.of(spark, [b"a\x00" + eight(1), b"a\x00" + eight(2), b"b\x00" + eight(1), b"plain"])
    records = [(1, 1, b"a\x00" + eight(3)), (2, 1, b"a\x00" + eight(1)), (3, 2, b"b\x00" + eight(1)), (4, 2, b"plain"), (5, 1, b"odd\x00x"), (6, 2, b"a\x00" + eight(2)), (7, 1, b"a\x00" + eight(2))]
    log = Log(frame(spark, [], "lsn bigint, op tinyint, key binary")).append(frame(spark, [*records, (8, 1, b""), (9, 1, None), (10, 3, b"x")], "lsn int, op int, key binary"))
    assert log.df.count() == len(records)
    assert values(log.size(), "bytes") == [(16 + sum(9 + len(k) for _, _, k in records),)]
    view = Layered(base, log)
    assert [p for (p,) in values(view.prefix_enum(b"a"), "payload")] == [eight(1), eight(2), eight(3)]
    assert values(view.prefix_enum(b"b"), "payload") == []
    probes = frame(spark, [(b"a\x00" + eight(n),) for n in (1, 2, 3, 4)] + [(b"b\x00" + eight(1),), (b"plain",), (b"odd\x00x",)], "key binary")
    assert dict(values(view.lookup(probes), "key", "result")) == {b"a\x00" + eight(1): 1, b"a\x00" + eight(2): 1, b"a\x00" + eight(3): 1, b"a\x00" + eight(4): 0, b"b\x00" + eight(1): 0, b"plain": 1, b"odd\x00x": 0}
    assert {k for (k,) in values(view.compact().df, "key")} == {b"a\x00" + eight(1), b"a\x00" + eight(2), b"a\x00" + eight(3), b"odd\x00x"}


def test_byte_functions(spark):
    df = frame(spark, [(b"ab\xff\xff", "61ZZ"), (b"\xff", "616"), (b"", "6162"), ("é\x00x".encode(), "")], "key binary, h string")
    rows = df.select("key", B.successor_column(F.col("key")).alias("s"), B.word_of(F.col("key")).alias("w"), B.payload_of(F.col("key")).alias("p"), B.from_hex(F.col("h")).alias("x"), B.fnv1a64(F.col("key")).alias("f"))
    got = {k: rest for k, *rest in values(rows, "key", "s", "w", "p", "x", "f")}
    assert [got[k][0] for k, *_ in values(df, "key")] == [B.successor(k) for k, *_ in values(df, "key")]
    assert got["é\x00x".encode()][1:3] == ["é".encode(), b"x"]
    assert [got[k][3] for k, *_ in values(df, "key")] == [None, None, b"ab", b""]
    assert got[b""][4] == 0xCBF29CE484222325 - (1 << 64)
    assert values(spark.range(1).select(B.crc32(F.lit("123456789").cast("binary")).alias("c"), B.varint_length(F.lit(127)).alias("a"), B.varint_length(F.lit(128)).alias("b")), "c", "a", "b") == [(0xCBF43926, 1, 2)]


def test_checksums_over_parts_and_by_table():
    register = B.crc32_init()
    for part in (b"1234", b"", b"56789"):
        register = B.crc32_update(register, part)
    table, by_table = B.crc32_table(), 0xFFFFFFFF
    for b in b"123456789":
        by_table = by_table >> 8 ^ table[(by_table ^ b) & 255]
    assert B.crc32_finalize(register) == by_table ^ 0xFFFFFFFF == 0xCBF43926


def test_varints_of_any_length(spark):
    from ordkeys.sources import files

    numbers = [0, 1, 127, 128, 16_383, 16_384, 1 << 28, (1 << 56) - 1, 1 << 56, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", B.varint(F.col("n")).alias("v"), B.varint_length(F.col("n")).alias("size"))
    assert values(rows, "n", "v", "size") == [(n, files.varint(n), len(files.varint(n))) for n in numbers]
