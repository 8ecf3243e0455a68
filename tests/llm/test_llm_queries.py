"""Queries against their SQL, and the pipeline against what its stages must do."""

import brute
import duckdb
import pytest
from helpers import collected, documents, words
from test_mixing_sharding import water_fill

import corpus_pipeline
from ordkeys.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, DATA)
    want = db.sql(registry.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    show = lambda row: str(tuple(round(v, 6) if isinstance(v, float) else v for v in row))
    assert sorted(map(show, got.select(*names).collect())) == sorted(map(show, want.project(", ".join(f'"{n}"' for n in names)).fetchall()))


def test_pipeline_by_brute_force(spark):
    """Each stage on what the one before kept, against its definition; of the classifier, the fitted weights are given."""
    from ordkeys.llm import quality, sharding

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(r.item_id, r.text) for r in items.collect()]
    model = quality.fit(docs, quality.training_labels(labels))
    text = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    at = stages["quality_classifier"](spark, docs, DATA).cache()
    scores = {i: brute.quality_score(t, model.vectors, model.network) for i, t in text.items()}
    assert all(abs(s - 0.7) > 1e-4 for s in scores.values())
    kept = [i for i, s in sorted(scores.items()) if s >= 0.7]
    assert ids(at) == kept and at.columns == docs.columns and 0 < len(kept) < len(text)
    at = stages["near_duplicates"](spark, at, DATA).cache()
    kept = sorted(brute.near_duplicate_ids([(i, text[i]) for i in kept]))
    assert ids(at) == kept and at.columns == docs.columns
    at = stages["decontamination"](spark, at, DATA).cache()
    clean = [i for i in kept if brute.benchmark_free(text[i], items)]
    assert ids(at) == clean and len(clean) < len(kept) and at.columns == docs.columns
    mixed = stages["mixing"](spark, at, DATA).cache()
    sizes = {}
    for i in clean:
        sizes[source[i]] = sizes.get(source[i], 0) + len(words(text[i]))
    times = brute.mixed_times([(i, text[i], source[i]) for i in clean], water_fill(sizes))
    assert ids(mixed) == sorted(i for i, n in times.items() for _ in range(n)) and mixed.columns == docs.columns
    last = stages["sharding"](spark, mixed, DATA)
    tree = sharding.topology(8)
    got = [(r.doc_id, r.shard, r.grown_shard) for r in last.collect()]
    assert sorted(got) == sorted((i, brute.shard(i, tree), brute.shard(i, sharding.grow(tree))) for i, n in times.items() for _ in range(n))
    slots = {}
    for r in last.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert collected(corpus_pipeline.run(spark, DATA), "doc_id", "shard", "slot") == collected(last, "doc_id", "shard", "slot")


def test_pipeline_on_odd_rows(spark, tmp_path):
    from helpers import ODD

    documents(spark, ODD, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no id here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # nothing is known to be good
    corpus_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        corpus_docs = stage(spark, corpus_docs, str(tmp_path)).cache()
        assert corpus_docs.count() > 0
