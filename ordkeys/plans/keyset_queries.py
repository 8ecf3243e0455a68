"""Registered queries of the key-set engine and the SQL that checks them.

Keys come from names in part and customer, from the words of documents, and from
words with document ids as payloads. Keys are returned as upper-case hex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkeys.functions import bytes as B
from ordkeys.functions.storage import new_path
from ordkeys.operators import opscript
from ordkeys.operators.automaton import Automaton
from ordkeys.operators.keyset import KeySet
from ordkeys.operators.log import Layered, Log
from ordkeys.streaming.log_stream import maintain, read_log_stream, read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hex(name: str, alias: str | None = None) -> Column:
    return F.hex(name).alias(alias or name)


def _words(spark: SparkSession, d: str, table: str) -> DataFrame:
    """id, word (BINARY) of the texts' words, split at blanks and line ends."""
    key = {"documents": "doc_id", "benchmark": "item_id"}[table]
    words = F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"))
    return _t(spark, d, table).select(F.col(key).alias("id"), words.alias("w")).filter("w <> ''").select("id", F.encode("w", "UTF-8").alias("word"))


def _doc_words(spark, d) -> KeySet:
    return KeySet.from_binary(_words(spark, d, "documents"), "word")


def _postings(spark, d) -> KeySet:
    """word, NUL, eight bytes of doc_id. The payload's length is fixed, so different pairs give different keys."""
    pairs = _words(spark, d, "documents").filter("id is not null").distinct()
    return KeySet(pairs.select(B.composite(F.col("word"), B.u64_be(F.col("id"))).alias("key")))


def _probes(spark, d) -> DataFrame:
    return _words(spark, d, "benchmark").select(F.col("word").alias("key")).distinct()


def _names(spark, d) -> KeySet:
    return KeySet.from_strings(_t(spark, d, "part"), "p_name")


_DOC_WORDS = "dw AS (SELECT DISTINCT encode(w) AS key FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \\n]+')) AS w FROM documents) WHERE w <> '')"
_PROBES = "pw AS (SELECT DISTINCT encode(w) AS key FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \\n]+')) AS w FROM benchmark) WHERE w <> '')"
_POST = "po AS (SELECT DISTINCT encode(w) AS word, doc_id FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\n]+')) AS w FROM documents) WHERE w <> '')"


# scans and membership


@_query("SELECT DISTINCT hex(encode(p_name)) AS key FROM part")
def key_scan(spark, d):
    return _names(spark, d).scan().select(_hex("key"))


@_query("SELECT count(DISTINCT p_name)::BIGINT AS n_names, (SELECT count(DISTINCT c_name)::BIGINT FROM customer) AS n_customers FROM part")
def key_count(spark, d):
    names = _names(spark, d).df.agg(F.count("*").alias("n_names"))
    customers = KeySet.from_strings(_t(spark, d, "customer"), "c_name").df.agg(F.count("*").alias("n"))
    return names.select("n_names", customers.scalar().alias("n_customers"))


@_query("SELECT DISTINCT p_name, hex(encode(p_name)) AS key FROM part WHERE p_name >= 'cold' AND p_name < 'cole'")
def range_scan(spark, d):
    return _names(spark, d).starting_with(b"cold").orderBy("key").select(F.decode("key", "UTF-8").alias("p_name"), _hex("key"))


@_query(f"WITH {_DOC_WORDS}, {_PROBES} SELECT hex(pw.key) AS key, (dw.key IS NOT NULL)::INT AS result FROM pw LEFT JOIN dw ON pw.key = dw.key")
def lookup_batch(spark, d):
    return _doc_words(spark, d).lookup(_probes(spark, d)).select(_hex("key"), "result")


@_query(f"WITH {_DOC_WORDS}, {_PROBES} SELECT hex(pw.key) AS key, (dw.key IS NULL)::INT AS result FROM pw LEFT JOIN dw ON pw.key = dw.key")
def add_result(spark, d):
    return _doc_words(spark, d).add_results(_probes(spark, d)).select(_hex("key"), "result")


@_query(f"WITH {_DOC_WORDS}, {_PROBES} SELECT hex(pw.key) AS key, (dw.key IS NOT NULL)::INT AS result FROM pw LEFT JOIN dw ON pw.key = dw.key")
def delete_result(spark, d):
    return _doc_words(spark, d).delete_results(_probes(spark, d)).select(_hex("key"), "result")


@_query(f"""WITH {_DOC_WORDS}, {_PROBES}
SELECT (SELECT count(*)::BIGINT FROM (SELECT key FROM dw UNION SELECT key FROM pw)) AS n_union,
       (SELECT count(*)::BIGINT FROM (SELECT key FROM dw EXCEPT SELECT key FROM pw)) AS n_removed,
       (SELECT count(*)::BIGINT FROM (SELECT key FROM dw INTERSECT SELECT key FROM pw)) AS n_both""")
def set_operations(spark, d):
    a, b = _doc_words(spark, d), KeySet(_probes(spark, d))
    n = lambda s: s.df.agg(F.count("*").alias("n")).scalar()
    return spark.range(1).select(n(a.add(b)).alias("n_union"), n(a.remove(b)).alias("n_removed"), n(a.intersect(b)).alias("n_both"))


@_query("SELECT DISTINCT hex(encode(p_name)) AS key FROM part ORDER BY key LIMIT 10")
def first_keys(spark, d):
    return _names(spark, d).first(10).select(_hex("key"))


@_query("SELECT DISTINCT hex(encode(p_name)) AS key FROM part ORDER BY key DESC LIMIT 10")
def last_keys(spark, d):
    return _names(spark, d).last(10).select(_hex("key"))


# words and payloads


@_query(f"WITH {_POST} SELECT upper(lpad(printf('%x', doc_id), 16, '0')) AS payload, doc_id FROM po WHERE word = encode('the')")
def prefix_enum(spark, d):
    return _postings(spark, d).prefix_enum(b"the").select(_hex("payload"), B.be_to_long(F.col("payload")).alias("doc_id"))


@_query(f"WITH {_POST} SELECT upper(lpad(printf('%x', doc_id), 16, '0')) AS payload, doc_id FROM po WHERE word = encode('the')")
def saved_prefix_enum(spark, d):
    """From a set saved in key order: the word's range is pushed to the scan, which skips files and row groups."""
    path = new_path(spark, "postings")
    _postings(spark, d).save(path)
    return KeySet.read(spark, path).prefix_enum(b"the").select(_hex("payload"), B.be_to_long(F.col("payload")).alias("doc_id"))


@_query(f"WITH {_POST}, {_PROBES} SELECT hex(word) AS word, count(*)::BIGINT AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM po JOIN pw ON pw.key = po.word GROUP BY word")
def prefix_enum_batch(spark, d):
    found = _postings(spark, d).prefix_enum_batch(_probes(spark, d).withColumnRenamed("key", "word"))
    doc = B.be_to_long(F.col("payload"))
    return found.groupBy("word").agg(F.count("*").alias("n"), F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc")).withColumn("word", F.hex("word"))


@_query(f"WITH {_POST} SELECT hex(word) AS word, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS doc_ids FROM po GROUP BY word")
def split_composite(spark, d):
    parts = _postings(spark, d).df.select(B.word_of(F.col("key")).alias("word"), B.payload_of(F.col("key")).alias("payload"))
    return parts.groupBy("word").agg(F.count("*").alias("n"), F.sum(B.be_to_long(F.col("payload"))).alias("doc_ids")).withColumn("word", F.hex("word"))


@_query(f"WITH {_POST} SELECT doc_id FROM po WHERE word IN (encode('the'), encode('with')) GROUP BY doc_id HAVING count(*) = 2")
def doc_search_and(spark, d):
    keys = _postings(spark, d)
    return keys.prefix_enum(b"the").join(keys.prefix_enum(b"with"), "payload", "left_semi").select(B.be_to_long(F.col("payload")).alias("doc_id"))


@_query(f"WITH {_POST} SELECT DISTINCT doc_id FROM po WHERE word IN (encode('the'), encode('les'))")
def doc_search_or(spark, d):
    keys = _postings(spark, d)
    return keys.prefix_enum(b"the").union(keys.prefix_enum(b"les")).distinct().select(B.be_to_long(F.col("payload")).alias("doc_id"))


# order statistics

_RANKED = "r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM dw)"


@_query(f"WITH {_DOC_WORDS}, {_RANKED} SELECT hex(key) AS key, rank FROM r")
def ranked_keys(spark, d):
    return _doc_words(spark, d).ranked().select(_hex("key"), "rank")


_RANK_OF = "(SELECT key, (sum(own) OVER (ORDER BY key, own ROWS UNBOUNDED PRECEDING) - own)::BIGINT AS rank, own FROM (SELECT key, 1 AS own FROM dw UNION ALL SELECT key, 0 FROM {p}))"


@_query(f"WITH {_DOC_WORDS}, {_PROBES} SELECT hex(key) AS key, rank FROM {_RANK_OF.format(p='pw')} WHERE own = 0")
def rank_batch(spark, d):
    return _doc_words(spark, d).rank(_probes(spark, d)).select(_hex("key"), "rank")


@_query(f"WITH {_DOC_WORDS}, {_RANKED}, k AS (SELECT DISTINCT p_size * 100 AS k FROM part) SELECT k.k, hex(r.key) AS key FROM k LEFT JOIN r ON r.rank = k.k")
def select_batch(spark, d):
    places = _t(spark, d, "part").select((F.col("p_size") * 100).alias("k")).distinct()
    return _doc_words(spark, d).select(places).select("k", _hex("key"))


_RANGES = "g AS (SELECT DISTINCT encode(p_name) AS lo, encode(lower(p_type)) AS hi FROM part)"


@_query(f"WITH {_DOC_WORDS}, {_RANGES} SELECT hex(lo) AS lo, hex(hi) AS hi, (SELECT count(*)::BIGINT FROM dw WHERE dw.key >= lo AND dw.key < hi) AS n FROM g")
def range_count_batch(spark, d):
    ranges = _t(spark, d, "part").select(F.encode("p_name", "UTF-8").alias("lo"), F.encode(F.lower("p_type"), "UTF-8").alias("hi")).distinct()
    return _doc_words(spark, d).range_count(ranges).select(_hex("lo"), _hex("hi"), "n")


_HEADS = "h AS (SELECT DISTINCT encode(substr(p_name, 1, 2)) AS prefix, encode(substr(p_name, 2, 2)) AS lo, encode(substr(p_name, 3, 2)) AS hi FROM part)"
_BELOW = "starts_with(hex(dw.key), hex(prefix))"


def _heads(spark, d) -> DataFrame:
    part = _t(spark, d, "part")
    return part.select(*[F.encode(F.substring("p_name", a, 2), "UTF-8").alias(n) for a, n in ((1, "prefix"), (2, "lo"), (3, "hi"))]).distinct()


@_query(f"WITH {_DOC_WORDS}, {_HEADS} SELECT hex(prefix) AS prefix, hex(lo) AS key, (SELECT count(*)::BIGINT FROM dw WHERE {_BELOW} AND dw.key < prefix || lo) AS rank FROM (SELECT DISTINCT prefix, lo FROM h)")
def rank_from(spark, d):
    probes = _heads(spark, d).select("prefix", F.col("lo").alias("key")).distinct()
    return _doc_words(spark, d).rank_from(probes).select(_hex("prefix"), _hex("key"), "rank")


@_query(f"""WITH {_DOC_WORDS}, {_HEADS}, q AS (SELECT DISTINCT prefix, octet_length(hi) * 3 AS k FROM h),
x AS (SELECT prefix, key, row_number() OVER (PARTITION BY prefix ORDER BY key) - 1 AS k FROM (SELECT DISTINCT prefix FROM h) JOIN dw ON {_BELOW})
SELECT hex(q.prefix) AS prefix, q.k, substr(hex(x.key), 2 * octet_length(q.prefix) + 1) AS rest FROM q LEFT JOIN x ON x.prefix = q.prefix AND x.k = q.k""")
def select_from(spark, d):
    places = _heads(spark, d).select("prefix", (F.octet_length("hi") * 3).cast("bigint").alias("k")).distinct()
    return _doc_words(spark, d).select_from(places).select(_hex("prefix"), "k", _hex("rest"))


@_query(f"WITH {_DOC_WORDS}, {_HEADS} SELECT hex(prefix) AS prefix, hex(lo) AS lo, hex(hi) AS hi, (SELECT count(*)::BIGINT FROM dw WHERE {_BELOW} AND dw.key >= prefix || lo AND dw.key < prefix || hi) AS n FROM h")
def range_count_from(spark, d):
    return _doc_words(spark, d).range_count_from(_heads(spark, d)).select(_hex("prefix"), _hex("lo"), _hex("hi"), "n")


@_query("SELECT hex(encode(substr(p_name, 3))) AS rest, row_number() OVER (ORDER BY encode(p_name)) - 1 AS rank FROM (SELECT DISTINCT p_name FROM part WHERE p_name >= 'co' AND p_name < 'cp')")
def bound_scan(spark, d):
    return _names(spark, d).bound(b"co").ranked().select(_hex("key", "rest"), "rank")


# automaton

# rests as ordered lists of (rest, live), so that classes are exact
_AUTOMATON = """p AS (SELECT k[1:i] AS prefix, k[i+1:] AS rest, live FROM (SELECT k, live, unnest(range(0, length(k) + 1)) AS i FROM n)),
c AS (SELECT prefix, list(rest || (CASE WHEN live THEN '+' ELSE '-' END) ORDER BY rest) AS class, bool_or(live AND rest = '') AS is_final, count(*) FILTER (live)::BIGINT AS n_keys FROM p GROUP BY prefix),
a AS (SELECT class, arg_min(prefix, (length(prefix), prefix)) AS access, bool_or(is_final) AS is_final, max(n_keys) AS n_keys FROM c GROUP BY class),
s AS (SELECT row_number() OVER (ORDER BY length(access), access) AS state_id, is_final, n_keys, access, class FROM a),
e AS (SELECT s.state_id AS src, ascii(right(c.prefix, 1)) AS sym, t.state_id AS dst
      FROM c JOIN s ON s.access = left(c.prefix, length(c.prefix) - 1) JOIN s t ON t.class = c.class WHERE c.prefix <> '')"""
_NAMES = "n AS (SELECT DISTINCT p_name AS k, true AS live FROM part)"
_STATS = "SELECT (SELECT count(*)::BIGINT FROM s) AS n_states, (SELECT count(*) FILTER (is_final)::BIGINT FROM s) AS n_final, (SELECT count(*)::BIGINT FROM e) AS n_trans, (SELECT n_keys FROM s WHERE state_id = 1) AS n_keys"


def _automaton(spark, d) -> Automaton:
    return Automaton.of(_names(spark, d).df)


@_query(f"WITH {_NAMES}, {_AUTOMATON} SELECT state_id::INT AS state_id, is_final, n_keys, hex(encode(access)) AS access FROM s")
def automaton_states(spark, d):
    return _automaton(spark, d).states.select("state_id", "is_final", "n_keys", _hex("access"))


@_query(f"WITH {_NAMES}, {_AUTOMATON} SELECT src::INT AS src, sym::SMALLINT AS sym, dst::INT AS dst FROM e")
def automaton_edges(spark, d):
    return _automaton(spark, d).edges


@_query(f"WITH {_NAMES}, {_AUTOMATON} SELECT state_id::INT AS state_id, n_keys FROM s")
def subtree_counts(spark, d):
    return _automaton(spark, d).subtree_counts()


@_query(f"WITH {_NAMES}, {_AUTOMATON} {_STATS}")
def stats_minimal(spark, d):
    return _automaton(spark, d).stats()


# adds on purchase, deletes on errors, of type and user; the history keeps dead branches
_OPS = "o AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'del' WHEN 'view' THEN 'lookup' ELSE 'add' END AS op, user_id::VARCHAR AS k FROM events)"
_HISTORY = "n AS (SELECT k, arg_max(op, seq) = 'add' AS live0, bool_or(op = 'add') AS added FROM o WHERE op <> 'lookup' GROUP BY k), m AS (SELECT k, live0 AS live FROM n WHERE added)"


def _ops(spark, d) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "view", "lookup").otherwise("add")
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"))


@_query(f"""WITH {_OPS}, {_HISTORY},
g AS (SELECT DISTINCT k[1:i] AS k FROM (SELECT k, unnest(range(0, length(k) + 1)) AS i FROM m)),
{_AUTOMATON.replace("FROM n))", "FROM (SELECT g.k, coalesce(m.live, false) AS live FROM g LEFT JOIN m ON m.k = g.k)))")} {_STATS}""")
def stats_with_ghosts(spark, d):
    return Automaton.of(opscript.history(_ops(spark, d)), live="live").stats()


@_query(f"""WITH {_OPS}, x AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'lookup' THEN op END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'add', false) AS live FROM o)
SELECT seq, op, hex(encode(k)) AS key, (CASE WHEN op = 'add' THEN NOT live ELSE live END)::INT AS result FROM x""")
def op_script_replay(spark, d):
    return opscript.replay(_ops(spark, d)).select("seq", "op", _hex("key"), "result")


@_query(f"""WITH {_NAMES}, {_AUTOMATON},
l AS (SELECT 0 AS a, -1 AS b, 'digraph keys {{' AS line UNION ALL SELECT 2147483647, 999, '}}'
      UNION ALL SELECT state_id, -1, printf('  %d [shape=%s];', state_id, CASE WHEN is_final THEN 'doublecircle' ELSE 'circle' END) FROM s
      UNION ALL SELECT src, sym, printf('  %d -> %d [label="%s"];', src, dst, CASE WHEN sym BETWEEN 32 AND 126 THEN chr(sym) ELSE '?' END) FROM e)
SELECT row_number() OVER (ORDER BY a, b)::INT AS line_no, line FROM l""")
def dot_export(spark, d):
    return _automaton(spark, d).dot()


# log and layered reads: the log adds and deletes words with document ids, made from events

_LOG = "lg AS (SELECT event_id AS lsn, CASE WHEN event_type IN ('error', 'view') THEN 2 ELSE 1 END AS op, encode(CASE WHEN event_type = 'click' THEN 'the' ELSE 'with' END) AS word, user_id AS id FROM events)"
_LAST = "ov AS (SELECT word, id, arg_max(op, lsn) AS op FROM lg GROUP BY word, id)"
_MERGED = "mg AS (SELECT word, doc_id AS id FROM po WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.word = po.word AND ov.id = po.doc_id) UNION ALL SELECT word, id FROM ov WHERE op = 1)"


def _log(spark, d) -> Log:
    word = F.when(F.col("event_type") == "click", "the").otherwise("with")
    op = F.when(F.col("event_type").isin("error", "view"), 2).otherwise(1)
    return Log(_t(spark, d, "events").select(F.col("event_id").alias("lsn"), op.alias("op"), B.composite(F.encode(word, "UTF-8"), B.u64_be(F.col("user_id"))).alias("key")))


def _layered(spark, d) -> Layered:
    return Layered(_postings(spark, d), _log(spark, d))


@_query(f"WITH {_LOG}, {_LAST} SELECT hex(word) AS word, upper(lpad(printf('%x', id), 16, '0')) AS payload, op::TINYINT AS op FROM ov")
def log_collapse(spark, d):
    return _log(spark, d).overlay().select(_hex("word"), _hex("payload"), "op")


@_query(f"WITH {_LOG} SELECT (16 + sum(9 + octet_length(word) + 9))::BIGINT AS bytes FROM lg")
def log_size(spark, d):
    return _log(spark, d).size()


@_query(f"WITH {_LOG} SELECT lsn, op::TINYINT AS op, hex(word) || '00' || upper(lpad(printf('%x', id), 16, '0')) AS key FROM lg")
def log_replay(spark, d):
    return _log(spark, d).replay().select("lsn", "op", _hex("key"))


@_query(f"""WITH {_POST}, {_LOG}, {_LAST}, {_MERGED}, q AS (SELECT encode('the') AS word, c_custkey AS id FROM customer)
SELECT q.id, (mg.id IS NOT NULL)::INT AS result FROM q LEFT JOIN mg ON mg.word = q.word AND mg.id = q.id""")
def layered_lookup(spark, d):
    probes = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), B.composite(F.encode(F.lit("the"), "UTF-8"), B.u64_be(F.col("c_custkey"))).alias("key"))
    return _layered(spark, d).lookup(probes).select("id", "result")


@_query(f"WITH {_POST}, {_LOG}, {_LAST}, {_MERGED} SELECT upper(lpad(printf('%x', id), 16, '0')) AS payload FROM mg WHERE word = encode('with')")
def layered_prefix_enum(spark, d):
    return _layered(spark, d).prefix_enum(b"with").select(_hex("payload"))


@_query(f"WITH {_POST}, {_LOG}, {_LAST}, {_MERGED} SELECT hex(word) AS word, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM mg GROUP BY word")
def compact(spark, d):
    parts = _layered(spark, d).compact().df.select(B.word_of(F.col("key")).alias("word"), B.payload_of(F.col("key")).alias("payload"))
    return parts.groupBy("word").agg(F.count("*").alias("n"), F.sum(B.be_to_long(F.col("payload"))).alias("ids")).withColumn("word", F.hex("word"))


@_query(f"WITH {_LOG}, {_LAST}, n AS (SELECT word, id, max(lsn) AS lsn FROM lg GROUP BY word, id) SELECT hex(word) || '00' || upper(lpad(printf('%x', id), 16, '0')) AS key, op::TINYINT AS op, lsn FROM ov JOIN n USING (word, id)")
def log_stream(spark, d):
    """The log written as two files, taken in as a stream, and the table that it keeps."""
    source, kept = new_path(spark, "log"), new_path(spark, "kept")
    _log(spark, d).df.repartition(2).write.parquet(source)
    maintain(read_log_stream(spark, source, max_files=1), kept, new_path(spark, "progress")).awaitTermination()
    return read_table(spark, kept).select(_hex("key"), "op", "lsn")


# functions


@_query("SELECT DISTINCT hex(encode(c_name)) AS key, hex(encode(c_name)) AS round_trip, octet_length(encode(c_name))::INT AS n_bytes, upper(lpad(printf('%x', c_custkey), 8, '0')) AS packed FROM customer")
def key_encodings(spark, d):
    key = F.encode("c_name", "UTF-8")
    return _t(spark, d, "customer").select(F.hex(key).alias("key"), F.hex(B.from_hex(B.to_hex(key))).alias("round_trip"), F.octet_length(key).alias("n_bytes"), F.hex(B.u32_be(F.col("c_custkey"))).alias("packed")).distinct()


@_query("""WITH k AS (SELECT DISTINCT p_name AS k FROM part), a AS (SELECT k, lag(k) OVER (ORDER BY k) AS b FROM k)
SELECT hex(encode(k)) AS key, coalesce((SELECT max(i) FROM range(0, least(length(k), length(b)) + 1) t(i) WHERE left(k, i) = left(b, i)), 0)::INT AS lcp FROM a""")
def neighbour_lcp(spark, d):
    from pyspark.sql import Window

    keys = _names(spark, d).df.withColumn("before", F.lag("key").over(Window.partitionBy().orderBy("key")))
    return keys.select(_hex("key"), F.coalesce(B.common_prefix_length(F.col("key"), F.col("before")), F.lit(0)).alias("lcp"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
