"""Quality rules, with DataFrame functions only.

Rule features of every text, and a hashed n-gram log-likelihood ratio between a
multinomial of trusted documents and one of the whole corpus. The ratio, divided by
the number of n-grams, is held against a fixed threshold.

n-grams are words, and pairs of the last three characters of neighbouring words; each
kind is hashed into a range of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordkeys.llm.common import let, materialize, words

#: Hash range of each of the two kinds of n-grams; the model has twice as many weights, whatever the corpus.
BUCKETS = 16_384
#: Added to every count.
SMOOTHING = 1.0
#: Least log-likelihood ratio an n-gram of a document that is kept.
THRESHOLD = -0.5
#: Up to so many different repeated windows are looked up one by one.
FEW = 64

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


def _slice_to(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.lit(0), n))


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Hash buckets of the n-grams of a word array: words in [0, buckets), pairs of endings in [buckets, 2 * buckets)."""
    ending = lambda x: F.substring(x, -3, 3)
    single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pairs = F.transform(
        _slice_to(w, F.size(w) - 1),
        lambda x, i: (F.pmod(F.xxhash64(ending(x), ending(F.get(w, i + 1))), F.lit(buckets)) + buckets).cast("int"),
    )
    return F.concat(single, pairs)


def fit_llr(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with weights: of each bucket the log of its probability among trusted documents over that in the corpus.

    docs: doc_id, text. trusted: doc_id. All documents and all their n-grams count.
    Without any n-gram of a trusted document all weights are 0.

    The join with trusted is by doc_id, always by sort and merge: the labels grow with
    the corpus and are never broadcast. Counts are pre-aggregated in each task to at
    most 2 * buckets rows before they are shuffled.
    """
    marks = trusted.select(F.col("doc_id")).dropna().distinct().withColumn("trusted", F.lit(True))
    grams = (
        docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id", "left")
        .select(F.col("trusted").isNotNull().alias("t"), F.explode(let(words(F.col("text")), lambda w: ngram_buckets(w, buckets))).alias("bucket"))
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count(F.when(F.col("t"), 1)).alias("target"))
    return _weights(counts, buckets, smoothing)


def _weights(counts: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    n = 2 * buckets
    spark = counts.sparkSession
    full = spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    kind = F.when(F.col("bucket") < buckets, 0).otherwise(1)
    rows = full.select(F.struct("bucket", kind.alias("kind"), "raw", "target").alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    total = lambda r, name, k: F.aggregate(F.filter(r, lambda x: x["kind"] == k), F.lit(0).cast("long"), lambda a, x: a + x[name])
    logp = lambda x, name, n: F.log((x[name] + smoothing) / (n + smoothing * buckets))
    r = F.col("r")
    sums = rows.select("r", *[total(r, name, k).alias(f"{name}{k}") for name in ("raw", "target") for k in (0, 1)])
    of = lambda x, name: F.when(x["kind"] == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    weight = lambda x: F.when(of(x, "target") == 0, 0.0).otherwise(logp(x, "target", of(x, "target")) - logp(x, "raw", of(x, "raw")))
    return sums.select(F.transform("r", weight).alias("weights"))


def repeated_words(w: Column) -> Column:
    """Words in windows of three words that occur twice or more, the first included.

    Windows are compared by 64-bit hashes within one text.
    """
    def covered(at: Column) -> Column:
        return let(F.sort_array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x))

    def by_lookup(h: Column, twice: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return covered(F.filter(at, lambda i: i.isNotNull()))

    def by_sort(h: Column) -> Column:
        def run(s: Column) -> Column:
            same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return covered(F.transform(F.filter(s, lambda x, i: F.coalesce(F.when(i == 0, F.get(s, i + 1)["h"] == x["h"]).when(i == F.size(s) - 1, F.get(s, i - 1)["h"] == x["h"]).otherwise(same(x, i)), F.lit(False))), lambda x: x["at"]))
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), run)

    def of_hashes(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, F.greatest(F.lit(0), i - 1)) == x))))
        some = let(twice, lambda t: F.when(F.size(t) <= FEW, by_lookup(h, t)).otherwise(by_sort(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    hashes = F.transform(_slice_to(w, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, of_hashes).cast("long")


def score_documents(docs: DataFrame, model: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Rule features and verdict of every document.

    docs: doc_id, text; other columns are ignored. model: of fit_llr.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr (log-likelihood ratio an n-gram, 0 without n-grams), kept.

    Null or empty text: no words, base_failed. One narrow pass without a shuffle;
    the model is a constant of fixed size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(w: Column) -> Column:
        grams = ngram_buckets(w, buckets)
        total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(F.col("__weights"), b))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            (total / F.greatest(F.lit(1), 2 * F.size(w) - 1)).alias("llr"),
        )

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        docs.select("doc_id", "text", model.scalar().alias("__weights"))
        .select(
            "doc_id",
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            let(words(text), of_words).alias("w"),
        )
        .select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.llr")
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr",
            (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"),
        )
    )


def op8_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = materialize(fit_llr(docs, labels.filter("quality = 1")), "llr")
    return score_documents(docs, model)
