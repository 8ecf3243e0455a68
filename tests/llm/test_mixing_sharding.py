from collections import Counter, defaultdict
from zlib import crc32

import pytest
from helpers import LONG, ODD, collected, documents, words
from pyspark.sql import functions as F

from ordkeys.llm import mixing, sharding


def water_fill(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


@pytest.fixture(scope="module")
def rows():
    spread = [(100 + i, "w " * (1 + i * 7 % 50), f"s{i % 7}" if i % 3 else "hot") for i in range(600)]
    return ODD + spread + [(5_000, "again and again", "hot")] * 40


def test_targets_and_cuts(spark, rows):
    docs = documents(spark, rows)
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(words(t))) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = water_fill(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert taken == {s: int(want[s] + 1e-9) for s in sizes}
    again = mixing.mix_sources(docs.repartition(7))
    assert collected(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=str)


def test_nothing_to_mix(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix_sources(documents(spark, [(1, None, None), (2, "", "a")])).collect()] == [(0.0, 0)] * 2


def test_mixed_documents_follow_the_mix(spark, rows):
    docs = documents(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    taken = defaultdict(list)
    for r in mixing.mix_sources(docs).collect():
        taken[(r.doc_id, r.source, r.size)].append(r.taken)
    copies = Counter(rows)
    cut = 0
    for row in set(rows):
        size = len(words(row[1]))
        parts = taken[(row[0], row[2], size)]
        if size == 0:
            assert times[row] == copies[row]
        elif len(set(parts)) == 1 and parts[0] % size == 0:
            assert times[row] == copies[row] * parts[0] // size
        else:
            cut += 1
    assert cut <= 12


def shard_rows(spark, n=3000):
    return documents(spark, ODD + [(100 + i, f"text {i % 40}", "s") for i in range(n)] + [(9_999, "repeated", "s")] * 300)


def test_shards_slots_and_growth(spark):
    docs = shard_rows(spark)
    got = [r.asDict() for r in sharding.assign_shards(docs).collect()]
    want = Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in [r[:3] for r in map(tuple, docs.select("doc_id", "text").collect())])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    assert sorted(by_shard) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({r["doc_id"] for r in got})
    moved = sum(r["grown_shard"] == 8 for r in got if r["doc_id"] and 100 <= r["doc_id"] < 9000)
    assert 0.07 * 3000 < moved < 0.16 * 3000
    assert sharding.assign_shards(documents(spark, [])).count() == 0


def test_shards_follow_weights_and_changes_stay_in_their_subtree(spark):
    tree = (sharding.Shard("r0", "a", 0, 1), sharding.Shard("r0", "a", 1, 3), sharding.Shard("r0", "b", 2, 2), sharding.Shard("r1", "c", 3, 4), sharding.Shard("r1", "d", 4, 2))
    changed = (tree[0], sharding.Shard("r0", "a", 1, 6), *tree[2:])
    key = sharding.key_of(F.col("id"))
    rows = spark.range(20_000).select(sharding.shard_of(key, tree).alias("a"), sharding.shard_of(key, changed).alias("b")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[x.shard] / 20_000 - x.weight / 12) < 0.02 for x in tree)
    region, rack = {x.shard: x.region for x in tree}, {x.shard: x.rack for x in tree}
    for r in rows:
        if r.a != r.b:  # whoever moves, moves into the region, and there into the rack, whose weight grew
            assert region[r.b] == "r0"
            if region[r.a] == "r0":
                assert rack[r.b] == "a" and (rack[r.a] != "a" or r.b == 1)
    assert sum(r.a != r.b for r in rows) > 500
    for n in range(1, 14):
        assert sorted(x.shard for x in sharding.topology(n)) == list(range(n))


def test_long_text_is_sized_whole(spark):
    r = sharding.assign_shards(documents(spark, [(1, LONG, "a")])).first()
    assert (r.size, r.text_crc32) == (len(LONG) + 1, crc32(LONG.encode()))


def test_one_more_shard_takes_and_never_deals(spark):
    docs = documents(spark, [(i, "x", "s") for i in range(400)])
    for n in range(1, 14):
        got = sharding.assign_shards(docs, n_shards=n).collect()
        assert all(r.grown_shard in (r.shard, n) for r in got) and any(r.grown_shard == n for r in got)
        if n in (3, 7):  # what has grown goes on as the tree in use
            grown = sharding.assign_shards(docs, tree=sharding.grow(sharding.topology(n)))
            assert collected(grown, "doc_id", "shard") == sorted(((r.doc_id, r.grown_shard) for r in got), key=str)
            assert all(r.grown_shard in (r.shard, n + 1) for r in grown.collect())
    assert sharding.grow(sharding.topology(8)) == sharding.topology(9)
