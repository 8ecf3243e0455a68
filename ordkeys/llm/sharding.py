"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Each level (region, rack, shard) is drawn by weighted rendezvous: every child of the
node reached so far draws -ln(u) / weight with u from a hash of document and child,
and the smallest draw wins. A child's chance is its weight over its siblings'. If a
weight changes, draws of the other children stay, so documents move only into or out
of the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordkeys.llm.common import materialize, ranged


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n_shards: int) -> tuple[Shard, ...]:
    """Two regions of two racks each share the largest multiple of four shards up to eight; each further one opens a region.

    This is a layout to start with. Layouts of fewer than eight shards aren't parts of
    each other; shards in use grow by grow(), not by the layout of the next number.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    base = min(8, n_shards - n_shards % 4)
    inner = [Shard(f"region{k * 2 // base}", f"rack{k * 4 // base % 2}", k) for k in range(base)]
    return (*inner, *(Shard(f"region+{k}", "rack0", k) for k in range(base, n_shards)))


def grow(tree: tuple[Shard, ...]) -> tuple[Shard, ...]:
    """The tree with one more shard, in a region of its own.

    There it competes at the top level alone, and all else stays, so that documents
    move only into the new shard.
    """
    k = max(x.shard for x in tree) + 1
    return (*tree, Shard(f"region+{k}", "rack0", k))


def key_of(*columns: Column) -> Column:
    """Columns as a string; a null is no part of it."""
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def _draw(key: Column, path: str, weight: float) -> Column:
    """From the first 52 bits of an MD5, so that any system can draw the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{path}:"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """children: path, weight, what to return if that child wins."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, path, weight).alias("draw"), F.lit(i).alias("child")) for i, (path, weight, _) in enumerate(children)]
    won = F.least(*draws)["child"]
    pick = F.when(won == 0, children[0][2])
    for i, (_, _, then) in enumerate(children[1:], 1):
        pick = pick.when(won == i, then)
    return pick


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of a key: one weighted draw a level."""
    def grouped(leaves, name):
        out: dict[str, list[Shard]] = {}
        for leaf in leaves:
            out.setdefault(getattr(leaf, name), []).append(leaf)
        return out

    usable = [leaf for leaf in tree if leaf.weight > 0]
    if not usable:
        raise ValueError("no shard has a weight")
    weight = lambda leaves: sum(x.weight for x in leaves)
    regions = []
    for region, in_region in grouped(usable, "region").items():
        racks = []
        for rack, in_rack in grouped(in_region, "rack").items():
            shards = [(f"{region}/{rack}/{x.shard}", x.weight, F.lit(x.shard)) for x in in_rack]
            racks.append((f"{region}/{rack}", weight(in_rack), _winner(key, shards)))
        regions.append((region, weight(in_region), _winner(key, racks)))
    return _winner(key, regions).cast("int")


def assign_shards(docs: DataFrame, *, n_shards: int = 8, tree: tuple[Shard, ...] | None = None) -> DataFrame:
    """Shard and place in the shard of every document, under the law ``key``.

    docs: doc_id, text; other columns are ignored. tree: the shards in use, by default
    topology(n_shards). doc_id and the tree alone decide the shard; grown_shard is the
    shard under grow(tree), where documents move only into the new shard.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text: no bytes, so size 1 and CRC 0. Null doc_id: a key like any other.
    Equal rows get different slots. Empty table: empty result.

    Scale: text is reduced to size and CRC in the scan; what moves is a row of
    numbers. Rows are dealt into ranges of (shard, hash) and numbered there as they are
    written; a shard's rows in the ranges before are the offset. So neither a large
    shard nor a document repeated endlessly fills one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = key_of(F.col("doc_id"))
    tree = tree or topology(n_shards)
    base = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            shard_of(key, tree).alias("shard"),
            shard_of(key, grow(tree)).alias("grown_shard"),
        ),
        "shards",
    )
    rows = ranged(base.withColumn("hash", F.md5(F.concat(F.lit("slot:"), key))), ["shard", "hash", "doc_id", "size", "text_crc32"], "shard-ranges")
    upto = Window.partitionBy("shard").orderBy("range")
    offsets = (
        rows.groupBy("shard", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .withColumn("offset", F.sum("n").over(upto) - F.col("n")).drop("n")
    )
    return rows.join(offsets, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("row") - F.col("first")).alias("slot"), "grown_shard",
    )


def op4_shard(spark, sf_dir):
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(n_shards: int) -> str:
    now = topology(n_shards)
    return ", ".join(f"({g}, '{x.region}', '{x.region}/{x.rack}', '{x.region}/{x.rack}/{x.shard}', {x.shard}, {x.weight})" for g, tree in ((0, now), (1, grow(now))) for x in tree)


# one level after the other, the least draw wins; CRC-32 by its definition, byte by byte
_DRAW = "-ln((('0x' || substr(md5({path} || ':' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / w"
SQL = f"""
WITH tree(g, region, rack, path, shard, weight) AS (VALUES {_values(8)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
a AS (SELECT r, k, g, arg_min(region, {_DRAW.format(path="region")}) AS region FROM d, (SELECT g, region, sum(weight) AS w FROM tree GROUP BY ALL) GROUP BY r, k, g),
b AS (SELECT r, k, g, arg_min(rack, {_DRAW.format(path="rack")}) AS rack FROM a JOIN (SELECT g, region, rack, sum(weight) AS w FROM tree GROUP BY ALL) USING (g, region) GROUP BY r, k, g),
c AS (SELECT r, g, arg_min(shard, {_DRAW.format(path="path")}) AS shard FROM b JOIN (SELECT g, rack, path, shard, weight AS w FROM tree) USING (g, rack) GROUP BY r, g),
t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
e AS (SELECT r, doc_id, k, (length(h) // 2 + 1)::BIGINT AS size,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda x, y: xor(x >> 8, t[xor(x, y) % 256 + 1])))::BIGINT AS text_crc32
      FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard::INT AS shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY md5('slot:' || k), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, later.shard::INT AS grown_shard
FROM e JOIN c now ON now.r = e.r AND now.g = 0 JOIN c later ON later.r = e.r AND later.g = 1
"""
