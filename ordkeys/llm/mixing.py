"""Mixing sources to target weights.

Documents get hash-random keys, are range-sorted by key within their source, and a
distributed prefix sum of their sizes cuts each source at its exact budget. A budget
above the source's size repeats the source in whole epochs before the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordkeys.llm.common import materialize, n_words, ranged


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Target of each source.

    sizes: source, size, one row per document. Sources in code point order, null
    last, take the weights in turn and share ``share`` times the total size; no
    target exceeds ``cap`` times its source's size, the excess goes to the others
    by weight until none is above.

    The repeated resharing has a closed form: sources ordered by cap/weight are
    capped up to the first whose fair part of what is left fits. It needs one row
    per source, never one per document.

    Returns source, n_rows, source_size (long), target (double).
    """
    everyone = Window.partitionBy()
    by_name = everyone.orderBy(F.col("source").asc_nulls_last())
    by_ratio = everyone.orderBy(F.col("most") / F.col("weight"), "place")
    per_source = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    placed = (
        per_source.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)) + 1))
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("capped_before", F.sum("most").over(by_ratio) - F.col("most"))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("part", (share * F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("step", F.row_number().over(by_ratio))
        .withColumn("fits", F.when(F.col("part") * F.col("weight") <= F.col("most"), F.col("step")))
        .withColumn("first_fit", F.min("fits").over(everyone))
        .withColumn("level", F.max(F.when(F.col("step") == F.col("first_fit"), F.col("part"))).over(everyone))
    )
    most = F.col("most").cast("double")
    target = F.when(F.col("first_fit").isNull() | (F.col("step") < F.col("first_fit")), most).otherwise(F.least(most, F.col("level") * F.col("weight")))
    return placed.select("source", "n_rows", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, source, text; other columns are ignored, whatever their names.
    Returns doc_id, source, size, source_size, target, taken: one row per input row.

    A source with target T and size S gives floor(T) words: floor(T / S) epochs of
    every document, then the documents in key order until the budget is used up;
    the document at the cut gives the words that are left.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null doc_id:
    an id like any other. Equal keys are ordered by doc_id and size; equal rows
    follow each other. Empty table: empty result. All sizes 0: targets 0.

    Scale: one narrow row (doc_id, source, size) per document is written and
    shuffled, never text. All rows are dealt into ranges of (source, key), so that no
    task sorts a whole source, nor all rows of one document; prefix sums of the ranges'
    totals give the offsets. What goes by source alone is one row for each.
    """
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights=weights, share=share, cap=cap), "mix-targets")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = ranged(sizes.withColumn("key", key), ["source", "key", "doc_id", "size"], "mix-ranges")
    own = Window.partitionBy("range", "source").orderBy("row")
    before = rows.withColumn("before", F.sum("size").over(own) - F.col("size"))
    upto = Window.partitionBy("source").orderBy("range")
    offsets = (
        rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
        .select(F.col("source").alias("s"), F.col("range").alias("g"), (F.sum("n").over(upto) - F.col("n")).alias("offset"))
        .join(targets.select(F.col("source").alias("t"), "source_size", "target"), F.col("s").eqNullSafe(F.col("t")))
    )
    size, source_size = F.col("size"), F.col("source_size")
    budget = F.floor("target").cast("long")
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - F.col("epochs") * source_size
    return (
        before.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("offset") + F.col("before")).alias("at"), budget.alias("budget"), epochs.alias("epochs"))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, rest - F.col("at")))).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns of docs.

    A source's budget gives each of its documents whole epochs, and one more to those
    whose keys come before the cut. The document at the cut comes once more if at
    least half of its words are taken; rows that share its key do as it does.
    Documents without words weigh nothing; they stay once.

    Key and cut decide, so the texts are joined with one row per source only and
    aren't shuffled while Spark finds that table small enough to broadcast.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    taken = mix_sources(docs, seed=seed, **options).filter("size > 0")
    epochs = F.floor(F.floor("target") / F.col("source_size")).cast("long")
    more = F.col("taken") - F.col("epochs") * F.col("size")
    cuts = materialize(
        taken.withColumn("epochs", epochs).withColumn("more", more).withColumn("key", key)
        .groupBy("source", "epochs")
        .agg(F.max(F.when(F.col("more") > 0, F.struct("key", (2 * F.col("more") >= F.col("size")).alias("counts")))).alias("cut")),
        "mix-cuts",
    ).withColumnRenamed("source", "__source").withColumnRenamed("epochs", "__epochs").withColumnRenamed("cut", "__cut")
    extra = F.when(key < F.col("__cut.key"), 1).when(key == F.col("__cut.key"), F.col("__cut.counts").cast("int")).otherwise(0)
    times = F.when(n_words(F.col("text")) == 0, 1).otherwise(F.col("__epochs") + extra).cast("int")
    return (
        docs.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left")
        .withColumn("__times", F.coalesce(times, F.lit(1)))
        .filter("__times > 0")
        .withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*docs.columns)
    )


def op1_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
q AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most,
             (sum(source_size) OVER ())::BIGINT AS total FROM p),
r AS (SELECT *, row_number() OVER o AS step, (sum(most) OVER o - most)::BIGINT AS capped_before,
             (sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
      FROM q WINDOW o AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, (1.5::DOUBLE * total - capped_before) / weight_left AS part FROM r),
f AS (SELECT min(step) AS first_fit FROM u WHERE part * weight <= most),
t AS (SELECT u.source, u.source_size,
             CASE WHEN f.first_fit IS NULL OR u.step < f.first_fit THEN u.most::DOUBLE
                  ELSE least(u.most::DOUBLE, (SELECT part FROM u, f WHERE step = first_fit) * u.weight) END AS target
      FROM u, f),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                                ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM k
"""
