import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LONG, ODD, collected, documents, lower, words
from pyspark.sql import functions as F

from ordkeys.llm import common, decontam, neardup

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window):
    w = ITEM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, t in items:
        own = ITEM_WORD.findall(lower(t))
        wins = {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else set()
        for i in range(len(w)):
            for win in wins:
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item_id)
    return len(w), len(hit), len(found), ",".join(sorted(map(str, found)))


def test_hits_by_brute_force(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice(["a", "b", "Ab", "é", "9"]) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.randrange(0, 9))) for i in range(25)] + [(30, None), (31, "..."), (31, "a b"), (100, "é"), (9, "9 9")]
    rows = ODD + [(200 + i, text(r.randrange(0, 40)), "s") for i in range(60)]
    for window, limit in ((4, 10**9), (4, 90)):  # the second in several passes, an automaton each
        found = decontam.scan_documents(documents(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int"), window=window, max_block_bytes=limit)
        got = [(x.doc_id, x.n_words, x.n_hit, len(x["items"]), ",".join(sorted(map(str, x["items"])))) for x in found.collect()]
        assert sorted(got, key=str) == sorted(((i, *brute_hits(t, items, window)) for i, t, _ in rows), key=str)


def test_blocks_of_items_clean_as_one_automaton(spark):
    passage = " ".join(f"p{i}" for i in range(9))
    items = spark.createDataFrame([(1, passage), (2, "p0"), (3, "q0"), (4, "r0 r1")], "item_id long, text string")
    docs = documents(spark, [(1, f"x {passage.upper()}", "a"), (2, "p0 alone", "a"), (3, "p0 and q0", "a"), (4, "R0, r1 p0", "a"), (5, None, "a"), (6, "r1 r0", "a")])
    assert decontam._n_blocks(items, 10) > 3
    for limit in (10, 10**9):
        clean = decontam.clean_documents(docs, items, max_block_bytes=limit)
        assert collected(clean, "doc_id") == [(2,), (5,), (6,)] and clean.columns == docs.columns


def test_a_worker_builds_each_automaton_once(monkeypatch):
    class Shared:
        value = [(1, "a b"), (2, "c")]

    built = []
    monkeypatch.setattr(decontam, "Automaton", lambda items, window, make=decontam.Automaton: built.append(1) or make(items, window))
    for key in ("one", "two"):
        for _ in range(20):
            decontam._scan_batch(["a b c"], (key, Shared), 8)
    assert len(built) == 2


def test_spans_are_of_the_original(spark):
    items = spark.createDataFrame([(1, "alpha Beta gämma"), (2, "delta")], "item_id long, text string")
    said = "«É» x ALPHA,\n\tbeta--GÄMMA; gämma! Delta\U0001f600 delta"
    text = said.replace("GÄMMA", "gämma")
    r = decontam.scan_documents(documents(spark, [(1, text, "a")]), items).first()
    assert [text[s.start : s.end] for s in r.spans] == ["ALPHA,\n\tbeta--gämma", "delta"] and sorted(r["items"]) == [1, 2]


def test_clean_documents_and_digest(spark):
    items = spark.createDataFrame([(10, "one two"), (9, "three four")], "item_id long, text string")
    docs = documents(spark, [(1, "one two", "a"), (2, "One; two three. FOUR", "a"), (3, None, "a"), (3, LONG, None)])
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and collected(clean, "doc_id") == [(1,), (3,), (3,)]
    assert decontam.clean_documents(docs, items.limit(0)).count() == 4 and decontam.scan_documents(docs.limit(0), items).count() == 0
    passage = " ".join(f"p{i}" for i in range(9))
    whole = spark.createDataFrame([(1, passage), (2, "p0")], "item_id long, text string")
    some = documents(spark, [(1, f"x {passage.upper()}", "a"), (2, passage[:20], "a"), (3, "p0 alone", "a")])
    assert collected(decontam.clean_documents(some, whole), "doc_id") == [(2,), (3,)]
    got = {r.doc_id: r.s for r in decontam.scan_documents(docs, items).select("doc_id", decontam.digest(decontam.F.col("items")).alias("s")).collect()}
    assert got[2] == hashlib.sha256(b"10,9").hexdigest() and got[3] == hashlib.sha256(b"").hexdigest()


def brute_groups(rows):
    sets = []
    for _, t, _ in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)]


def near_rows():
    r = random.Random(6)
    rows, n = [x for x in ODD if x[0] != 5], 100
    for group in range(12):
        base = [f"g{group}w{r.randrange(400)}" for _ in range(r.choice([6, 9, 40, 120]))]
        for _ in range(r.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10_000)}"
            rows.append((n, " ".join(copy).upper() if r.random() < 0.3 else " \n".join(copy), "s"))
            n += 1
    chain = [f"c{i}" for i in range(200)]  # neighbours are similar, ends aren't
    for k in range(12):
        rows.append((n + k, " ".join(chain[k * 8 : k * 8 + 104]), "s"))
    passage = " ".join(f"common{i}" for i in range(60))  # shared by documents that aren't similar
    rows += [(2_000 + k, passage + " " + " ".join(f"d{k}x{i}" for i in range(60)), "s") for k in range(25)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [None, 2])
def test_groups_by_brute_force(spark, monkeypatch, least):
    if least:  # nearly every key is dealt to several tasks, and nearly every bucket cut
        monkeypatch.setattr(common, "HOT_LEAST", least)
        monkeypatch.setattr(common, "HOT_PARTS", 1_000)
        monkeypatch.setattr(neardup, "SLICE", 3)
    rows = near_rows()
    got = neardup.near_duplicates(documents(spark, rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == sorted(brute_groups(rows), key=str)
    assert all(x.kept == (None if x.component_id is None or x.doc_id is None else x.doc_id == x.component_id) for x in got.collect())


def test_frequent_keys_fill_no_task(spark, monkeypatch):
    """Half of all rows have one key; the joined rows of a task are counted before anything is coalesced."""
    monkeypatch.setattr(common, "HOT_LEAST", 100)
    monkeypatch.setattr(common, "HOT_PARTS", 40)
    rows = spark.range(8_000).selectExpr("id as place", "if(id % 2 = 0, 7L, if(id % 16 = 1, null, id)) as k").cache()
    others = rows.select("k").dropna().distinct().selectExpr("k", "k * 10 as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        for how, n in (("inner", 7_500), ("left", 8_000)):
            out = common.hot_join(rows, others, "k", "place", how)
            tasks = [r["count"] for r in out.filter("k is not null").groupBy(F.spark_partition_id()).count().collect()]
            assert out.count() == n and out.filter("k is not null and not v <=> k * 10").count() == 0 and max(tasks) < 4 * sum(tasks) / 32
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_empty_texts_and_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 50)
    rows = [(i, None if i % 2 else " ", "a") for i in range(900)] + [(1_000 + i, "the very same words in every row", "a") for i in range(900)] + [(5_000 + i, f"a b c d e{i} f g h i j", "a") for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: (0, i, True) for i in range(900)} | {1_000 + i: (3, 1_000, i == 0) for i in range(900)} | {5_000 + i: (6, 5_000 + i, True) for i in range(30)}


def test_one_document_of_each_brute_group_stays(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    first = neardup.first_documents(docs)
    assert first.columns == docs.columns
    groups = {g for _, n, g in brute_groups(rows) if n and g is not None}
    kept = Counter(r.doc_id for r in first.collect() if words(r.text))
    assert {k for k in kept if k is not None} == groups and max(kept.values()) == 1
    assert neardup.near_duplicates(documents(spark, [])).count() == 0 and neardup.near_duplicates(documents(spark, [(1, None, "a")])).first().kept


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 140)}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_tell_similarity():
    r = np.random.default_rng(3)
    common = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    apart = []
    for similar in (0.9, 0.75, 0.5, 0.1):
        n = int(900 * similar)
        own = int((900 - n) / 2)
        a = np.unique(np.concatenate((common[:n], r.integers(0, 1 << 63, own, dtype=np.uint64))))
        b = np.unique(np.concatenate((common[:n], r.integers(0, 1 << 63, own, dtype=np.uint64))))
        s = neardup.odd_sketches(neardup.samples([a, b]))
        apart.append(sum(int(x & (1 << 64) - 1).bit_count() for x in (s[0] ^ s[1]).tolist()))
    assert apart == sorted(apart) and apart[1] <= neardup.max_distance() < apart[3]
    one = neardup.samples([np.arange(50_000, dtype=np.uint64) << np.uint64(33)])
    assert (one == np.minimum(*(neardup.samples([p << np.uint64(33)]) for p in np.array_split(np.arange(50_000, dtype=np.uint64), 2)))).all()


def test_slices_of_large_buckets_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    sets = []
    for k in range(40):
        own = base.copy()
        change = rng.choice(150, 2 * (k % 9), replace=False)
        own[change] = rng.integers(0, 1 << 63, len(change), dtype=np.uint64)
        sets.append(np.unique(own))
    bands = neardup.band_keys(neardup.samples(sets))
    wide = neardup.odd_sketches(neardup.samples(sets, neardup.WIDE_SAMPLES), neardup.WIDE_BITS)
    limit = neardup.max_distance(neardup.WIDE_SAMPLES, neardup.WIDE_BITS, neardup.WIDE_MARGIN)
    label = [k % 3 for k in range(40)]
    far = lambda a, b: int(np.bitwise_count(wide[a].view(np.uint64) ^ wide[b].view(np.uint64)).sum())
    shared = lambda a, b: (bands[a] == bands[b]).any()
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if label[a] != label[b] and shared(a, b) and far(a, b) <= limit}
    held = defaultdict(list)
    for n in range(40):
        for k in bands[n]:
            held[int(k)].append(n)
    keys = []
    for k, nodes in held.items():
        (major, n_major), *others = Counter(label[n] for n in nodes).most_common()
        if others:
            keys += [(k, n, label[n], len(nodes), major, n_major) for n in nodes]
    opened = spark.createDataFrame(keys, "key long, node long, label long, n long, major long, n_major long")
    payload = spark.createDataFrame([(n, bands[n].tolist(), bytearray(wide[n].tobytes())) for n in range(40)], "node long, bands array<long>, wide binary")
    for size in (2, 7, 2_048):
        monkeypatch.setattr(neardup, "SLICE", size)
        got = [(min(r.a, r.b), max(r.a, r.b)) for r in neardup._open_pairs(opened, payload, nearest=False).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        least = {}
        for r in neardup._open_pairs(opened, payload, nearest=True).collect():
            least[r.a] = min(least.get(r.a, 9_999), r.far)
        assert least == {a: min(far(*p) for p in want if a in p) for a in {x for p in want for x in p}}


def test_one_document_of_each_group_stays(spark):
    text = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcd"]
    near = [f"{t} more" for t in text]
    rows = [(None, text[0], "a"), (None, near[0], "a"), (5, text[1], "a"), (None, near[1], "a"), (6, text[2], "a"), (6, near[2], "a"), (7, text[3], "a"), (8, near[3], "a"), (8, "other words", "a")]
    rows += [(None, "", "a"), (None, "", "a"), (9, " ", "a"), (9, " ", "a"), (9, None, "a")]
    got = [(r.doc_id, r.text) for r in neardup.first_documents(documents(spark, rows)).collect()]
    assert sorted(str(i) for i, t in got if words(t)) == sorted(map(str, [None, 5, 6, 7, 8])) and (8, "other words") in got and (7, text[3]) in got
    assert sorted(((i, t) for i, t in got if not words(t)), key=str) == sorted([(None, ""), (9, " "), (9, None)], key=str)
