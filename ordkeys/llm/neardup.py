"""MinHash near-dedup with odd sketches.

1. One pass over the texts gives each document's set of word shingles, its size, a
   digest of the set, MinHash samples folded into band keys, and an odd sketch: the
   parity bitmap of the samples, whose XOR with another's counts how far two sets are.
2. Documents with equal sets form a class; the rest works on classes.
3. Within each bucket of a band, members are held against the bucket's most central
   class only, the one that shares buckets with most others; of each class the leader
   that it shares most bands with is confirmed on full sets. Linked classes get a label.
4. Where a bucket still holds several labels, its classes get wider odd sketches. Each
   class's nearest one of another label is confirmed, then all pairs of different
   labels that the sketches don't tell apart for sure.

So a group of copies costs one confirmed pair per class, not one per pair. Sketches
are compared all with all only between labels: those of a bucket's most frequent label
with the others, and the others with each other. For it buckets are cut into slices, so
that a task holds two slices at a time. Joins by leaders, buckets, centres of stars and
copies deal frequent keys to several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from zlib import adler32, crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordkeys.llm.common import hot_join, materialize, n_words

#: Words of a shingle; least similarity, in hundredths.
SHINGLE, SIMILAR = 5, 75
#: Bands and samples of a band: a pair at the threshold shares no band with a chance of 2e-5.
BANDS, ROWS = 40, 5
#: Bits of an odd sketch.
BITS = 512
#: Standard deviations by which a sketch's distance may exceed what is expected at the threshold.
MARGIN = 5.0
#: Samples and bits of the wider sketches, and their margin.
WIDE_SAMPLES, WIDE_BITS, WIDE_MARGIN = 1024, 2048, 4.0
#: Classes of a bucket that are compared at a time.
SLICE = 512
#: Bits of the filter that keeps texts without candidates out of the shuffle; it only saves work.
FILTER_BITS = 1 << 22

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_K = BANDS * ROWS
#: Shingles of the documents that are sampled at a time.
_BLOCK = 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWER = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(SHINGLE)]
_draws = np.random.default_rng(23)
_A = _draws.integers(0, 1 << 31, max(_K, WIDE_SAMPLES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _draws.integers(0, 1 << 32, max(_K, WIDE_SAMPLES), dtype=np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes. Fewer words than a shingle has are one shingle; no words, none."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = _mix((np.fromiter(map(crc32, w), np.uint64, len(w)) << np.uint64(32)) | np.fromiter(map(adler32, w), np.uint64, len(w)))
    n = min(len(w), SHINGLE)
    out = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _POWER[j]
    return np.unique(_mix(out))


def samples(sets: list[np.ndarray], k: int = _K) -> np.ndarray:
    """k MinHash samples of each of the non-empty sets, a row each."""
    out = np.empty((len(sets), k), np.uint32)
    a, b, block = _A[:k, None], _B[:k, None], max(1, _BLOCK * _K // k)
    i = 0
    while i < len(sets):
        j, held = i + 1, len(sets[i])
        while j < len(sets) and held + len(sets[j]) <= block:
            held += len(sets[j])
            j += 1
        least = None
        flat = np.concatenate(sets[i:j])
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        if j - i > 1:
            x = (flat >> np.uint64(32)).astype(np.uint32)
            least = np.minimum.reduceat(a * x[None, :] + b, starts, axis=1)
        else:
            for at in range(0, len(flat), block):
                x = (flat[at : at + block] >> np.uint64(32)).astype(np.uint32)
                part = (a * x[None, :] + b).min(axis=1, keepdims=True)
                least = part if least is None else np.minimum(least, part)
        out[i:j] = least.T
        i = j
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, different for equal samples of different bands."""
    parts = sample.reshape(len(sample), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], parts.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def odd_sketches(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps of the (place, sample) pairs: bits / 64 numbers a row."""
    place = np.arange(sample.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)
    bit = (_mix(place | sample.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
    at = bit + np.arange(len(sample), dtype=np.int64)[:, None] * bits
    odd = (np.bincount(at.ravel(), minlength=len(sample) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sample), bits), axis=1, bitorder="little").view(np.int64)


def max_distance(k: int = _K, bits: int = BITS, margin: float = MARGIN, similar: float = SIMILAR / 100) -> int:
    """Bits by which sketches of sets at the threshold differ at most, but for margin standard deviations."""
    shrink = math.exp(-4 * k * (1 - similar) / bits)
    mean = bits / 2 * (1 - shrink)
    of_bits = math.sqrt(bits / 4 * (1 - shrink**2))
    of_samples = shrink * 2 * math.sqrt(k * similar * (1 - similar))
    return math.floor(mean + margin * math.hypot(of_bits, of_samples))


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, and for documents with words digest, bands, sketch."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                sets = [shingles(x.as_py()) for x in batch.column("text")]
                full = [s for s in sets if len(s)]
                sample = samples(full)
                bands, sketches = iter(band_keys(sample)), iter(odd_sketches(sample))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(sketches) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def _near(a: Column, b: Column) -> Column:
    """Whether two sketches are near enough to be confirmed."""
    apart = F.lit(0)
    for i in range(BITS // 64):
        apart = apart + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return apart <= max_distance()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a (a, b) table: node, label (the smallest node), for nodes that have an edge.

    Large-star and small-star turns until the edges stay the same. Each turn is two
    aggregations and joins by node, pre-aggregated; its result is written to the
    shared folder, which cuts the lineage.
    """
    def drawn(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = materialize(e.distinct(), "stars")
        return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    stars, mark = drawn(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hot_join(both, least, "u", "v").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hot_join(large, low, "a", "b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        stars, now = drawn(small)
        if now == mark:
            break
        mark = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _in_filter(ids: DataFrame) -> DataFrame:
    """One row with a bitmap of fixed size of the ids' hashes."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("slot")).select(F.floor(F.col("slot") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    words = words.groupBy("w").agg(F.bit_or("bit").alias("bits"))
    full = ids.sparkSession.range(0, FILTER_BITS // 64, 1, 1).select(F.col("id").cast("int").alias("w")).join(words, "w", "left").na.fill(0)
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("bits"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its set, for wanted nodes (node, doc_id, digest)."""
    bits = materialize(_in_filter(wanted), "filter")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    some = (
        docs.select("doc_id", "text", bits.scalar().alias("__bits"), slot.alias("__slot"))
        .filter(F.expr("(shiftright(get(__bits, cast(__slot div 64 as int)), cast(__slot % 64 as int)) & 1) = 1"))
        .select("doc_id", "text")
    )
    w = wanted.select(F.col("doc_id").alias("id"), "node", "digest").hint("merge")
    texts = some.join(w, some.doc_id.eqNullSafe(w.id)).select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(x.as_py()) for x in batch.column("text")]
                own = [blake2b(s.tobytes(), digest_size=16).digest() == d.as_py() for s, d in zip(sets, batch.column("digest"), strict=True)]
                keep = [i for i, ok in enumerate(own) if ok]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["node", "shingles"]
                )

    return texts.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), written, whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    held = materialize(hot_join(pairs, left, "a", "b"), "half-pairs")
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        hot_join(held, right, "b", "a")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
        .filter(100 * F.col("both") >= SIMILAR * (F.col("sizes") - F.col("both")))
        .select("a", "b")
    )


def _wide(sets: DataFrame) -> DataFrame:
    """node and its wider odd sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                own = [np.asarray(x.values, np.int64).view(np.uint64) for x in batch.column("shingles")]
                sketches = odd_sketches(samples(own, WIDE_SAMPLES), WIDE_BITS)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in sketches], pa.binary())], ["node", "wide"])

    return sets.mapInArrow(run, "node bigint, wide binary")


def near_pairs(key: int, node: np.ndarray, label: np.ndarray, part: np.ndarray, across: bool, bands: np.ndarray, wide: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket with different labels whose wider sketches don't differ too much, and by how much.

    wide is unsigned, as bitwise_count takes absolute values.

    across: only pairs from one part to the other. nearest: of each class only the
    nearest one. Else a pair is given in the first bucket that both are in.
    """
    limit = max_distance(WIDE_SAMPLES, WIDE_BITS, WIDE_MARGIN)
    found = ([], [], [])
    if across and part.min() == part.max():  # the other slice has no class
        return node[:0], node[:0], np.zeros(0, np.int32)
    columns = np.flatnonzero(part == part.max()) if across else np.arange(len(node))
    rows = np.flatnonzero(part == part.min()) if across else columns
    for start in range(0, len(rows), 64):
        own = rows[start : start + 64]
        apart = label[own][:, None] != label[columns][None, :]
        if not apart.any():
            continue
        far = np.bitwise_count(wide[own][:, None, :] ^ wide[columns][None, :, :]).sum(axis=2, dtype=np.int32)
        far[~apart] = WIDE_BITS + 1
        if nearest:
            best = far.argmin(axis=1)
            least = far[np.arange(len(own)), best]
            ok = least <= limit
            pairs = (own[ok], columns[best[ok]], least[ok])
            if across:  # what lies in the other part has its nearest here, too
                best = far.argmin(axis=0)
                least = far[best, np.arange(len(columns))]
                ok = least <= limit
                pairs = tuple(np.concatenate(x) for x in zip(pairs, (columns[ok], own[best[ok]], least[ok]), strict=True))
        else:
            i, j = np.nonzero(far <= limit)
            a, b = own[i], columns[j]
            if not across:
                keep = node[a] < node[b]
                i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            first = np.array([bands[x][np.argmax(bands[x] == bands[y])] == key for x, y in zip(a, b, strict=True)], bool)
            pairs = (a[first], b[first], far[i, j][first])
        for held, new in zip(found, pairs, strict=True):
            held.append(new)
    a, b, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    return node[a], node[b], far


def _open_pairs(opened: DataFrame, payload: DataFrame, *, nearest: bool) -> DataFrame:
    """a, b, far of the buckets in opened (key, node, label, major, n, n_major). payload: node, bands, wide.

    A bucket's classes of labels other than the major one are cut into slices by a
    hash, and so are those of the major label. Each pair of slices is a cell of its
    own, dealt out apart; major slices don't meet each other.
    """
    minor = F.ceil((F.col("n") - F.col("n_major")) / SLICE).cast("int")
    major = F.ceil(F.col("n_major") / SLICE).cast("int")
    at_home = F.col("label") == F.col("major")
    own = F.when(at_home, F.col("minor") + F.pmod(F.xxhash64("node"), F.col("slices") - F.col("minor"))).otherwise(F.pmod(F.xxhash64("node"), F.col("minor"))).cast("int")
    last = F.when(at_home, F.col("minor")).otherwise(F.col("slices")) - 1
    cells = (
        opened.join(payload.hint("merge"), "node").withColumn("minor", minor).withColumn("slices", F.col("minor") + major).withColumn("part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "label", "part", "bands", "wide")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cell: pa.Table) -> pa.RecordBatch:
            column = lambda name: cell.column(name).to_numpy()
            bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            wide = np.frombuffer(b"".join(cell.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)
            across = cell.column("i")[0].as_py() != cell.column("j")[0].as_py()
            a, b, far = near_pairs(cell.column("key")[0].as_py(), column("node"), column("label"), column("part"), across, bands, wide, nearest)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(far, pa.int32())], ["a", "b", "far"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            starts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:], strict=False):
                if start == end:
                    continue
                name = tuple(int(x[start]) for x in at)
                if held and name != last:
                    yield done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                last = name
        if held:
            yield done(pa.Table.from_batches(held))

    return cells.mapInArrow(run, "a bigint, b bigint, far int")


def _connect(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, label of the classes that are linked with others. reps: node, doc_id, digest, bands, sketch."""
    members = materialize(reps.select("node", F.explode("bands").alias("key")), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(hot_join(members, sizes, "key", "node"), "buckets")
    central = buckets.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    leaders = buckets.join(central.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))

    # every class with the leader that it shares most bands with
    best = (
        hot_join(buckets, leaders, "key", "node").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
        .groupBy("node").agg(F.max(F.struct("n", "leader")).alias("top"))
        .select(F.col("node").alias("a"), F.col("top.leader").alias("b"))
    )
    x, y = (reps.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}")) for n in "ab")
    best = materialize(best.join(x.hint("merge"), "a"), "best")
    first = materialize(hot_join(best, y, "b", "a").filter(_near(F.col("sa"), F.col("sb"))).select("a", "b"), "pairs")
    wanted = buckets.select("node").distinct().join(reps.select("node", "doc_id", "digest").hint("merge"), "node")
    sets = materialize(_sets_of(docs, wanted), "sets")
    labels = components(materialize(_confirmed(first, sets), "links"))

    def opened() -> DataFrame:
        """Rows of buckets that hold several labels: key, node, n, label; the label most classes have, and how many."""
        now = materialize(buckets.join(labels.hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")), "labelled")
        per = now.groupBy("key", "label").agg(F.count("*").alias("m"))
        split = per.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("m", "label")).alias("top")).filter("k > 1")
        return hot_join(now, split.select("key", F.col("top.label").alias("major"), F.col("top.m").alias("n_major")), "key", "node")

    still = materialize(opened(), "open")
    own = still.select("node").distinct()
    payload = materialize(_wide(sets.join(own.hint("merge"), "node")).join(reps.select("node", "bands").hint("merge"), "node"), "wide")
    for nearest in (True, False):
        pairs = _open_pairs(still, payload, nearest=nearest)
        if nearest:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("far", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
        more = materialize(_confirmed(materialize(pairs.select("a", "b"), "pairs"), sets), "links")
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
        if nearest:
            still = materialize(opened(), "open")
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of near-duplicate documents.

    docs: doc_id, text; other columns are ignored. Two documents are linked if their
    sets of five-word shingles (A-Z lowered) are similar to 0.75 or more; groups are
    connected components. Returns doc_id, n_shingles, component_id (smallest doc_id
    of the group), kept (doc_id is component_id). One row per input row.

    Null or empty text, or white space only: n_shingles 0, a group of its own. Null
    doc_id: takes part, but gives no component_id; kept is null there. Repeated rows
    are one class. Empty table: empty result.

    Links are confirmed on full sets of 64-bit shingle hashes. A pair exactly at the
    threshold shares no band with a chance of 2e-5, and its wider sketches are taken
    for too far with one of 3e-5; more similar pairs are missed far more rarely.

    Scale: nothing is collected but lists of frequent keys, at most HOT_PARTS each.
    Buckets and copies are pre-aggregated; what is shuffled is band keys, and the texts
    of documents that share a band. Documents without words are in no join.
    """
    base = materialize(sketch_documents(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    reps = materialize(
        base.filter("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    labels = materialize(_connect(docs, reps), "labels")
    labelled = reps.select("node", "digest", "doc_id").join(labels.hint("merge"), "node", "left")
    classes = materialize(labelled.select("digest", "doc_id", F.coalesce("label", "node").alias("label")), "labelled-classes")
    smallest = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = hot_join(classes, smallest, "label", "digest").select("digest", "component_id")
    own = ["doc_id", "n_shingles"]
    grouped = hot_join(base.filter("n_shingles > 0").select(*own, "digest", "row"), of_class, "digest", "row").select(*own, "component_id")
    alone = base.filter("n_shingles = 0").select(*own, F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def first_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id, nulls last.

    Rows are told apart by a number given when they are written, so that of rows that
    share the smallest doc_id, or have none, one stays. Rows without words are groups
    of their own; of repeated ones one stays.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    grouped = found.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id").hint("merge"), "__row")
    first = grouped.groupBy("component_id").agg(F.min_by("__row", order).alias("__row")).select("__row")
    wordless = rows.filter(n_words(F.col("text")) == 0).groupBy("doc_id", "text").agg(F.min("__row").alias("__row")).select("__row")
    return rows.join(first.unionByName(wordless).hint("merge"), "__row").select(*docs.columns)


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + least(len(w), 5) - 1] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_common >= 75 * (na.n + nb.n - n_common)),
r AS (
  WITH RECURSIVE c(id, seen) AS (SELECT a, b FROM l UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.seen)
  SELECT id, min(seen) AS least FROM c GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(r.least, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id
"""
