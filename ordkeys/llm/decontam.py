"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows scans each text once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordkeys.llm.common import materialize

#: Consecutive words of an item that make a window.
WINDOW = 8
#: Items whose windows occur from which a document counts as contaminated.
MIN_ITEMS = 2
#: UTF-8 bytes of items in one automaton, which takes some 400 times as many in each worker. More items go into further automata, one pass over the texts each.
MAX_BLOCK_BYTES = 500_000

#: Of UTF-8 bytes: A-Z lowered, digits, a-z and all of non-ASCII characters kept, others blanks. Byte offsets stay.
_FLAT = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def flat(text: str) -> bytes:
    """The text's UTF-8 with blanks for all that isn't in words; each byte stays in its place."""
    return text.encode("utf-8", "surrogatepass").translate(_FLAT)


def windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = flat(text or "").split()
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


class Automaton:
    """Finds all windows of items. Words stand between single blanks, so a match begins and ends at whole words."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        import ahocorasick

        of: dict[tuple[bytes, ...], set[int]] = {}
        for place, (_, text) in enumerate(items):
            for key in windows(text, window):
                of.setdefault(key, set()).add(place)
        self.items = [x for x, _ in items]
        self.machine = ahocorasick.Automaton()
        for key, places in of.items():
            self.machine.add_word((b" " + b" ".join(key) + b" ").decode("latin-1"), (len(key), tuple(places)))
        self.empty = not of
        if of:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[int, ...]]]:
        """Matches as first word, word after the last, places of the items."""
        if self.empty or not words:
            return []
        hay = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.machine.iter(hay))
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(hay.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(blanks, [end for end, _ in found])
        return [(int(b) - n, int(b), places) for b, (_, (n, places)) in zip(last, found, strict=True)]


_built: dict[str, Automaton] = {}


def _automaton(key: str, shared, window: int) -> Automaton:
    """A worker keeps the last one that it built; a pass needs no other."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value, window)
    return _built[key]


def _n_blocks(items: DataFrame, max_block_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 if total <= max_block_bytes else -(-3 * total // (2 * max_block_bytes))


def _shared_block(items: DataFrame, k: int, n: int) -> tuple[str, object]:
    """A key of its own and the broadcast of one of n blocks of items, dealt by a hash. The driver holds no more than a block."""
    block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in block])


def _scan_batch(texts: list[str | None], block: tuple[str, object], window: int) -> list[dict]:
    machine = _automaton(*block, window)
    out = []
    for t in texts:
        words = flat(t).split() if t else []
        found = machine.scan(words)
        out.append({"n_words": len(words), "items": list({machine.items[p] for *_, places in found for p in places}), "runs": [(first, end) for first, end, _ in found]})
    return out


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _numbered(docs: DataFrame) -> DataFrame:
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _found(rows: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """__row, items, runs of the rows (__row, text) with hits: one pass, written, for each of n blocks of items."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = items.schema["item_id"].dataType
    parts = []
    for k in range(n):
        block = _shared_block(items, k, n)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _scan_batch(batch.column("text").to_pylist(), block, window)
                hit = [i for i, f in enumerate(found) if f["runs"]]
                runs = [[{"first": a, "end": b} for a, b in found[i]["runs"]] for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").take(pa.array(hit, pa.int64())), pa.array([found[i]["items"] for i in hit], pa.list_(to_arrow_type(kind))), pa.array(runs, _RUNS)], ["__row", "items", "runs"]
                )

        part = rows.select("__row", "text").mapInArrow(run, f"__row bigint, items array<{kind.simpleString()}>, runs array<struct<first:bigint,end:bigint>>")
        parts.append(materialize(part, "hits"))
        block[1].destroy()
    return reduce(DataFrame.unionByName, parts).groupBy("__row").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as character offsets of the original text."""
    raw = np.frombuffer(flat(text), np.uint8)
    inside = np.concatenate(([0], (raw != 32).astype(np.int8), [0]))
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in runs]


def scan_documents(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Where windows of benchmark items occur in every document.

    docs: doc_id, text; items: item_id, text; other columns are ignored. An item's
    windows are its runs of ``window`` words, or all of it if it has fewer.
    Returns doc_id, n_words, n_hit (words inside any occurrence), items (ids of the
    items with occurring windows, each once), spans (start, end: character offsets of
    the hit runs in the original text). One row per input row.

    Null or empty text: no words, no hits. Null or empty items have no window.
    Repeated items or windows count once. Empty benchmark: no hits.

    Scale: one pass over the texts, no shuffle, for a benchmark of up to
    max_block_bytes. A larger one is dealt into blocks; each is scanned for in a pass of
    its own, whose hits are written, so that a worker holds one automaton of bounded
    size and the driver one block.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    n = _n_blocks(items, max_block_bytes)
    block = _shared_block(items, 0, 1) if n == 1 else None
    kind = dict(docs.dtypes)["doc_id"]
    item_kind = items.schema["item_id"].dataType
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, items array<{item_kind.simpleString()}>, spans array<struct<start:bigint,end:bigint>>"
    if block:
        rows = docs.select("doc_id", "text")
    else:
        own = _numbered(docs.select("doc_id", "text"))
        rows = own.join(_found(own, items, n, window).hint("merge"), "__row", "left").select("doc_id", "text", "items", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if block:
                found = _scan_batch(texts, block, window)
            else:
                pairs = zip(batch.column("items").to_pylist(), batch.column("runs").to_pylist(), strict=True)
                found = [{"n_words": len(flat(t).split()) if t else 0, "items": i or [], "runs": [(r["first"], r["end"]) for r in x or []]} for t, (i, x) in zip(texts, pairs, strict=True)]
            runs = [_merged(f["runs"]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                    pa.array([f["items"] for f in found], pa.list_(to_arrow_type(item_kind))),
                    pa.array([_offsets(t, r) if r else [] for t, r in zip(texts, runs, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return rows.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, min_items: int = MIN_ITEMS, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents without a passage of the benchmark, with all their columns.

    A document goes if a whole window of any item occurs in it. Items of fewer words
    than a window may occur by chance; such ones count from min_items items on. Passes
    are as in scan_documents.
    """
    n = _n_blocks(items, max_block_bytes)
    if n > 1:
        rows = _numbered(docs)
        bad = (F.size("items") >= min_items) | F.exists("runs", lambda r: r["end"] - r["first"] >= window)
        return rows.join(_found(rows, items, n, window).filter(bad).hint("merge"), "__row", "left_anti").drop("__row")
    block = _shared_block(items, 0, 1)

    def clean(found: dict) -> bool:
        return len(found["items"]) < min_items and all(end - first < window for first, end in found["runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scan_batch(batch.column("text").to_pylist(), block, window)
            yield batch.filter(pa.array([clean(f) for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256)


def op9_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = scan_documents(docs, items)
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest(F.col("items")).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, w[i : i + least(len(w), 8) - 1] AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
l AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n),
h AS (SELECT o.r, o.i, o.n, p.item_id FROM o JOIN p ON p.n = o.n AND p.win = o.w[o.i : o.i + o.n - 1]),
x AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
y AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""
