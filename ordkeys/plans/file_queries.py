"""Registered queries over files, automaton edges and byte functions, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordkeys import ABI_VERSION
from ordkeys.functions import bytes as B
from ordkeys.functions.storage import materialize, new_path
from ordkeys.operators.automaton import Automaton
from ordkeys.operators.keyset import KeySet
from ordkeys.operators.log import Log
from ordkeys.plans import keyset_queries as K
from ordkeys.sources import io
from ordkeys.streaming.log_stream import layered, maintain, read_log_stream, read_table

_query, _t, _hex = K._query, K._t, K._hex
_NAMES_OF = "SELECT DISTINCT p_name AS k FROM part"
#: Strings whose characters are their bytes; DuckDB has no order of bytes within such lists otherwise.
_BYTES = "list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1)))"


def _saved(spark, d) -> str:
    """An automaton file of the part names."""
    path = f"{new_path(spark, 'automaton')}.pdwg"
    io.save_automaton(spark, Automaton.of(K._names(spark, d).df), path)
    return path


# lifecycle


@_query(f"SELECT {ABI_VERSION}::INT AS abi_version, 0::BIGINT AS n_keys, 1::BIGINT AS n_states, 0::BIGINT AS n_final")
def empty_set(spark, d):
    """A set as it is created: one state, not final. Released at the end of its use."""
    empty = KeySet.empty(spark).cache()
    stats = materialize(Automaton.of(empty.df).stats(), "stats")
    empty.release()
    return stats.select(F.lit(ABI_VERSION).alias("abi_version"), F.coalesce("n_keys", F.lit(0)).cast("bigint").alias("n_keys"), "n_states", "n_final")


# automaton files


@_query(f"SELECT hex(encode(k)) AS key FROM ({_NAMES_OF})")
def automaton_file_keys(spark, d):
    """Saved as a file, read back as keys."""
    return io.read_keys(spark, _saved(spark, d)).df.select(_hex("key"))


@_query(f"""WITH {K._NAMES}, {K._AUTOMATON}
SELECT s.state_id::INT AS state_id, s.is_final, count(e.src)::INT AS n_trans FROM s LEFT JOIN e ON e.src = s.state_id GROUP BY s.state_id, s.is_final""")
def automaton_file_states(spark, d):
    return io.read_states(spark, _saved(spark, d))


@_query(f"WITH {K._NAMES}, {K._AUTOMATON} SELECT src::INT AS src, sym::SMALLINT AS sym, dst::INT AS dst FROM e")
def automaton_file_edges(spark, d):
    return io.read_edges(spark, _saved(spark, d))


@_query(f"""WITH {K._NAMES}, {K._AUTOMATON},
l AS (SELECT s.state_id, s.is_final, coalesce(sum(CASE WHEN dst IS NULL THEN 0 WHEN dst < 128 THEN 2 WHEN dst < 16384 THEN 3 ELSE 4 END), 0) AS n FROM s LEFT JOIN e ON e.src = s.state_id GROUP BY s.state_id, s.is_final)
SELECT state_id::INT AS state_id, (sum(n) OVER (ORDER BY state_id) - n)::BIGINT AS start, (sum(is_final::INT) OVER ())::BIGINT AS n_final FROM l""")
def automaton_file_offsets(spark, d):
    """Where each state's edges start in a file, rebuilt from the edges; and the set bits of its bitmap."""
    path = _saved(spark, d)
    from ordkeys.operators.order import running_sum_before

    edges, states = io.read_edges(spark, path), io.read_states(spark, path)
    own = edges.groupBy("src").agg(F.sum(F.lit(1) + B.varint_length(F.col("dst"))).alias("bytes"))
    rows = states.join(own, F.col("state_id") == F.col("src"), "left").select("state_id", "is_final", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    placed = running_sum_before(rows, ["state_id"], "bytes", "start")
    n = rows.agg(F.sum(F.col("is_final").cast("bigint")).alias("n"))
    return placed.select("state_id", "start", n.scalar().alias("n_final"))


@_query(f"{'WITH ' + K._OPS}, {K._HISTORY} SELECT hex(encode(k)) AS key FROM m WHERE live")
def automaton_file_with_dead_branches(spark, d):
    """The live keys of a file that holds dead branches."""
    path = f"{new_path(spark, 'automaton')}.pdwg"
    from ordkeys.operators import opscript

    io.save_automaton(spark, Automaton.of(opscript.history(K._ops(spark, d)), live="live"), path)
    return io.read_history(spark, path).filter("live").select(_hex("key"))


@_query(f"WITH {K._NAMES}, {K._AUTOMATON} SELECT 0::BIGINT AS n_conflicts, count(*)::BIGINT AS n_states FROM s")
def automaton_conflicts(spark, d):
    """States whose prefixes don't agree: none, or the merge was wrong."""
    a = K._automaton(spark, d)
    return a.states.agg(F.count("*").alias("n_states")).select(a.conflicts().agg(F.count("*").alias("n")).scalar().alias("n_conflicts"), "n_states")


# walks


@_query(f"""WITH {K._NAMES}, {K._AUTOMATON}, q AS (SELECT DISTINCT state_id AS src, ascii(substr(p_name, 1, 1)) AS sym FROM s, (SELECT DISTINCT p_name FROM part))
SELECT q.src::INT AS src, q.sym::SMALLINT AS sym, e.dst::INT AS dst FROM q LEFT JOIN e ON e.src = q.src AND e.sym = q.sym""")
def find_edges(spark, d):
    """Where the first letters of names lead from every state, found or not."""
    a = K._automaton(spark, d)
    syms = _t(spark, d, "part").select(F.ascii(F.substring("p_name", 1, 1)).cast("smallint").alias("sym")).distinct()
    firsts = [r.sym for r in syms.collect()]  # letters, of which there are few
    probes = a.states.select(F.col("state_id").alias("src"), F.explode(F.array(*[F.lit(s).cast("smallint") for s in firsts])).alias("sym"))
    return a.find_edges(probes)


@_query(f"WITH {K._NAMES}, {K._AUTOMATON} SELECT sym::SMALLINT AS sym, dst::INT AS dst, (row_number() OVER (ORDER BY sym) - 1)::INT AS place FROM e WHERE src = 1")
def edges_in_order(spark, d):
    """The edges of the first state, in order."""
    found = K._automaton(spark, d).edges_of(1).select(F.sort_array(F.collect_list(F.struct("sym", "dst"))).alias("e"))  # at most 256
    return found.select(F.posexplode("e").alias("place", "x")).select("x.sym", "x.dst", "place")


@_query(f"""WITH {K._NAMES}, {K._AUTOMATON}, x AS (SELECT access FROM s WHERE state_id = 2)
SELECT hex(encode(substr(p_name, length(access) + 1))) AS rest FROM (SELECT DISTINCT p_name FROM part), x WHERE starts_with(p_name, access)""")
def keys_below_state(spark, d):
    return K._automaton(spark, d).keys_below(K._names(spark, d).df, 2).select(_hex("rest"))


# log files


def _log_file(spark, d) -> str:
    """The log written to a file in two appends."""
    path = f"{new_path(spark, 'log')}.dawl"
    log, records = io.LogFile(spark, path), materialize(K._log(spark, d).df, "records")
    half = records.agg(F.percentile_approx("lsn", 0.5)).first()[0]
    log.append(records.filter(F.col("lsn") <= half))
    log.append(records.filter(F.col("lsn") > half))
    return path


_PLACED = f"WITH {K._LOG}, f AS (SELECT op, hex(word) || '00' || upper(lpad(printf('%x', id), 16, '0')) AS key, octet_length(word) AS n, (16 + coalesce(sum(18 + octet_length(word)) OVER (ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lsn FROM lg)"


@_query(f"{_PLACED} SELECT lsn, op::TINYINT AS op, key FROM f")
def log_file_records(spark, d):
    """Appended to a file, read back with their places in it."""
    return io.read_log(spark, _log_file(spark, d)).select("lsn", "op", _hex("key"))


@_query(f"{_PLACED} SELECT lsn, op::TINYINT AS op, key FROM f WHERE lsn < (SELECT max(lsn) FROM f)")
def log_file_mended(spark, d):
    """A log whose last record is torn, opened to be written: what is left, and no byte more."""
    path = _log_file(spark, d)
    parts = list(io.read_parts(spark, path))
    io.write_whole(spark, path, [*parts[:-1], parts[-1][:-1]])
    log = io.LogFile(spark, path)
    return log.records().filter(F.col("lsn") < log.size).select("lsn", "op", _hex("key"))


@_query(f"WITH {K._POST}, {K._LOG}, {K._LAST}, {K._MERGED} SELECT upper(lpad(printf('%x', id), 16, '0')) AS payload FROM mg WHERE word = encode('with') AND id < 1000000")
def layered_files(spark, d):
    """A base and a log, both opened from files: payloads of a word."""
    base = f"{new_path(spark, 'base')}.pdwg"
    with_word = K._postings(spark, d).starting_with(b"with\x00")
    io.save_automaton(spark, Automaton.of(with_word), base)
    return io.open_layered(spark, base, _log_file(spark, d)).prefix_enum(b"with").select(_hex("payload"))


@_query("""SELECT event_id AS lsn, (CASE WHEN value > 50 THEN -1 ELSE 0 END)::INT AS result FROM events""")
def log_accepts(spark, d):
    """Records that a log takes; empty keys and unknown ops it doesn't."""
    rows = _t(spark, d, "events").select(
        F.col("event_id").alias("lsn"), F.when((F.col("value") > 50) & (F.col("event_id") % 2 == 0), 3).otherwise(1).alias("op"),
        F.when((F.col("value") > 50) & (F.col("event_id") % 2 == 1), B.binary(b"")).otherwise(F.encode("event_type", "UTF-8")).alias("key"),
    )
    return Log.accepted(rows).select("lsn", "result")


@_query(f"WITH {K._POST}, {K._LOG}, {K._LAST}, {K._MERGED} SELECT hex(word) AS word, count(*)::BIGINT AS n FROM mg GROUP BY word")
def layered_stream(spark, d):
    """A base under a log that a stream keeps, delivered twice."""
    source, kept = new_path(spark, "log"), new_path(spark, "kept")
    log = materialize(K._log(spark, d).df, "records")
    reduce(DataFrame.unionByName, [log, log]).repartition(4).write.parquet(source)
    maintain(read_log_stream(spark, source, max_files=1), kept, new_path(spark, "progress"), fold_every=2).awaitTermination()
    merged = layered(spark, K._postings(spark, d), kept).merged().df
    return merged.groupBy(F.hex(B.word_of(F.col("key"))).alias("word")).agg(F.count("*").alias("n"))


@_query(f"WITH {K._LOG}, {K._LAST} SELECT count(*)::BIGINT AS n_keys, (SELECT max(lsn) FROM lg) AS last FROM ov")
def log_redelivered(spark, d):
    """A log delivered twice counts each record once."""
    source, kept = new_path(spark, "log"), new_path(spark, "kept")
    log = materialize(K._log(spark, d).df, "records")
    log.coalesce(1).write.parquet(source)
    log.coalesce(1).write.mode("append").parquet(source)
    maintain(read_log_stream(spark, source, max_files=1), kept, new_path(spark, "progress")).awaitTermination()
    return read_table(spark, kept).agg(F.count("*").alias("n_keys"), F.max("lsn").alias("last"))


# byte functions; CRC-32 and FNV-1a by their definitions

@_query(f"""WITH k AS ({_NAMES_OF}), t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
c AS (SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}), lambda x, b: xor(x >> 8, t[xor(x, b) % 256 + 1])))::BIGINT AS crc32 FROM k, t)
SELECT hex(encode(k)) AS key, crc32 FROM c""")
def crc32_keys(spark, d):
    return K._names(spark, d).df.select(_hex("key"), B.crc32(F.col("key")).alias("crc32"))


@_query(f"""WITH k AS ({_NAMES_OF}),
f AS (SELECT k, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform({_BYTES}, lambda b: b::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM k)
SELECT hex(encode(k)) AS key, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS fnv FROM f""")
def fnv_keys(spark, d):
    return K._names(spark, d).df.select(_hex("key"), B.fnv1a64(F.col("key")).alias("fnv"))


@_query("""WITH n AS (SELECT DISTINCT unnest([o_orderkey, o_orderkey * 1000003, o_orderkey % 128]) AS n FROM orders),
l AS (SELECT n, len(list_filter([1, 128, 16384, 2097152, 268435456, 34359738368, 4398046511104], lambda p: n >= p OR p = 1)) AS size FROM n)
SELECT n::BIGINT AS n, size::INT AS size, array_to_string(list_transform(range(size), lambda i: upper(lpad(printf('%x', ((n >> (7 * i)) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END), 2, '0'))), '') AS varint FROM l""")
def varints(spark, d):
    key = F.col("o_orderkey")
    n = _t(spark, d, "orders").select(F.explode(F.array(key, key * 1000003, key % 128)).alias("n")).distinct()
    return n.select("n", B.varint_length(F.col("n")).alias("size"), F.hex(B.varint(F.col("n"))).alias("varint"))
