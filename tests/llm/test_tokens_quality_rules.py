import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import brute
import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, ODD, collected, documents, words

from ordkeys.llm import quality, rules, tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts(n=1500):
    r = random.Random(4)
    parts = ["the", "ing", " ", "\n", "'s", "1", "²", "é", "́", "ß", "Σ", "\x1c", "!", "<|endoftext|>", "<|", "İ", "tion", "　", "가", "ᄀ", "ᅡ", "₟", "Ɤ", "\U0001f600", "\x00"]
    return ["".join(r.choice([*parts, chr(r.randrange(1, 0x3000)), chr(r.randrange(97, 123))]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_counts_are_the_librarys(library, monkeypatch):
    counter = tokens.Counter(PATH)
    r = random.Random(8)
    unbroken = ["x" * 300, "ab" * 2_000, "aaab" * 777, "a" * 20_000 + " b", "".join(r.choice("abcdet") for _ in range(5_000)), "1" * 700, "é" * 999]
    texts = ["", " ", "<|startoftext|>a<|endoftext|>", "don't we'll 'tis ''s's x're1's!", LONG, *unbroken, *odd_texts()]
    want = library(texts)
    assert counter.counts(pa.array([None, *texts])).tolist() == [0, *want]
    # blocks, chunks and steps of any size, and states that are dropped, change nothing
    monkeypatch.setattr(tokens, "CHUNK", 5)
    monkeypatch.setattr(tokens, "_STEP", 37)
    small = tokens.Counter(PATH, block=23)
    small.words.max_states = 300
    some = [i for i, t in enumerate(texts) if len(t) < 3_000][:400]
    assert small.counts(pa.array([texts[i] for i in some])).tolist() == [want[i] for i in some]
    assert len(small.words.keys) < 2_000


def test_pairs_of_tokens_are_told_by_their_merges():
    words = tokens.Counter(PATH).words
    r = random.Random(3)
    for _ in range(400):
        words.count("".join(r.choice("abdehilnorst") for _ in range(r.randrange(2, 14))).encode())
    held = [(divmod(k, len(words.tokens)), fits) for k, fits in words.fits.items() if k >= 0]
    assert {fits for _, fits in held} == {True, False}
    for (a, b), fits in held:
        left, right = words.tokens[a], words.tokens[b]
        ends = right.endswith("</w>")
        assert fits == (words.encode(left + right.removesuffix("</w>"), ends) == [left, right])


def test_maps_of_blocks_compose_in_any_grouping():
    c = tokens.Counter(PATH)
    text = "One two　three  fourfivesix " * 3 + "end"
    counted = lambda pieces: int(c.piece_counts(pa.array(pieces, pa.string())).sum())
    for seed in range(20):
        r = random.Random(seed)
        cuts = sorted(r.sample(range(1, len(text)), 5))
        maps = [c.map_of(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        left = maps[0]
        for m in maps[1:]:
            left = tokens.compose_blocks(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = tokens.compose_blocks(m, right)
        assert left == right
        assert left.whole + counted([left.head, left.tail, *left.pieces]) == c.counts(pa.array([text]))[0]


def test_token_counts_of_documents(spark, library):
    rows = ODD + [(50, " ".join(["word"] * 2048), "a"), (51, " ".join(["word"] * 2049), "a")]
    got = tokens.count_tokens(documents(spark, rows), PATH)
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, library([t for _, t, _ in rows]), strict=True)]
    assert collected(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert tokens.count_tokens(documents(spark, []), PATH).count() == 0


def junk(i):
    r = random.Random(i)
    w = [f"{r.choice('abcdefg')}{r.choice('stuvwxyz')}{r.randrange(60)}" for _ in range(r.randrange(20, 120))]
    kind = i % 5
    return (" ".join(w), 1) if kind < 3 else (" ".join(x + "***" for x in w), 0) if kind == 3 else (" ".join(x for x in w for _ in range(9)), 0)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, junk(i)[0], "s") for i in range(600)]
    labels = spark.createDataFrame([(i, junk(i)[1], "x") for i in range(600)] + [(None, 1, "x"), (3, None, "x"), (7, 1, "x")], "doc_id long, quality int, text string")
    return documents(spark, rows + ODD), labels


def test_classifier_learns_what_it_may(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, quality.training_labels(labels))
    scored = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    held = [i for i in range(600) if crc32(str(i).encode()) % 4 == 2]
    right = sum(scored[i].predicted == junk(i)[1] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())
    assert quality.score_documents(docs, model).count() == 600 + len(ODD)
    again = quality.fit(docs.repartition(3), quality.training_labels(labels))
    assert np.allclose(model.scores([t for _, t, _ in ODD]), again.scores([t for _, t, _ in ODD]), atol=1e-6)
    good = quality.good_documents(docs, model)
    assert good.columns == docs.columns and good.count() == sum(r.predicted for r in quality.score_documents(docs, model).collect())


def test_scores_by_brute_force(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, quality.training_labels(labels))
    texts = [None, "", "one", "a b a b c", "é ß 日本語", junk(3)[0], junk(5)[0], " ".join(f"w{i % 5}x{i % 3}" for i in range(300))]
    got = {r.doc_id: r.score for r in quality.score_documents(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute.quality_score(t, model.vectors, model.network), abs=1e-4)


def test_held_out_labels_are_not_learnt_from(spark, labelled):
    docs, labels = labelled
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (quality.fit(docs, quality.training_labels(x)) for x in (labels, turned))
    assert np.allclose(a.scores(["some words", None]), b.scores(["some words", None]))


def test_classifier_without_labels(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert {round(r.score, 6) for r in quality.score_documents(docs, model).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_context_sums_by_brute_force():
    index = quality.index_vectors()
    texts = ["a b c a b", None, "", "z", LONG]
    want = np.zeros_like(index)
    for t in texts[:4]:
        w, e = quality.word_rows(t)
        for i in range(len(w)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    want[w[i]] += index[w[j]]
                    want[e[i]] += index[w[j]]
    assert (quality.context_sums(texts[:4], index) == want).all() and not quality.context_sums([None], index).any()
    whole = quality.context_sums([LONG], index)
    old = quality._CHUNK
    quality._CHUNK = 1_000
    try:
        assert (quality.context_sums([LONG], index) == whole).all()
        part = quality.pooled(LONG, quality.word_vectors(whole, index))
    finally:
        quality._CHUNK = old
    assert np.allclose(part, quality.pooled(LONG, quality.word_vectors(whole, index)), atol=1e-5)


def test_word_vectors_take_all_documents_and_samples_are_bounded(spark):
    rows = [(i, f"alpha beta w{i % 7} gamma", "s") for i in range(50)] + [(1, "alpha again", "s")] * 300
    docs = documents(spark, rows)
    index = quality.index_vectors()
    want = quality.word_vectors(quality.context_sums([t for _, t, _ in rows], index), index)
    assert np.array_equal(quality.corpus_vectors(docs.repartition(5)), want)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    for most in (2, 1_000):
        got = quality.sample_of(docs, labels, max_sample=most).collect()
        assert len(got) == min(most, 50) and len({r.doc_id for r in got}) == len(got)


def test_the_driver_gets_one_table_of_sums(spark, monkeypatch):
    rows = [(i, f"alpha beta w{i} gamma w{i + 1}", "s") for i in range(60)]
    index, got, frame = quality.index_vectors(), [], type(spark.range(0))

    def noted(of):
        def run(df, *a, **b):
            for row in of(df, *a, **b):
                if "sums" in df.columns:
                    got.append(len(row.sums))
                yield row
        return run

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(frame, name, noted(getattr(frame, name)))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        vectors = quality.corpus_vectors(documents(spark, rows).repartition(12))
    finally:
        spark.conf.unset(coalesce)
    want = quality.word_vectors(quality.context_sums([t for _, t, _ in rows], index), index)
    assert np.array_equal(vectors, want)
    table = index.size * np.dtype(np.int64).itemsize
    assert got and sum(got) <= table and max(got) <= table // 100


def brute_rules(text):
    text = text or ""
    w = words(text)
    found = defaultdict(list)
    for i in range(len(w) - 2):
        found[tuple(w[i : i + 3])].append(i)
    inside = {k for at in found.values() if len(at) > 1 for i in at for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def rule_rows():
    r = random.Random(8)
    out = list(ODD)
    for i in range(80):
        out.append((100 + i, "".join(r.choice(["a", "b", "cc", "é"]) + r.choice([" ", " ", "\n", "\t", "# "]) for _ in range(r.randrange(0, 160))), "s"))
    out.append((300, "\n".join(" ".join(f"l{k}w{j}" for j in range(9)) for k in range(300) for _ in (0, 1)), "s"))
    out.append((301, " \n a\r\n a\r\n\n\x0b\n b", "s"))
    return out


def test_rules_by_brute_force(spark):
    rows = rule_rows()
    docs = documents(spark, rows)
    model = rules.fit_llr(docs, spark.createDataFrame([(101,), (102,), (102,), (None,)], "doc_id long")).cache()
    got = collected(rules.score_documents(docs, model), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute_rules(t)) for i, t, _ in rows), key=str)


def test_ratio_by_brute_force(spark):
    xxhash = pytest.importorskip("xxhash")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = [r for r in rule_rows() if r[0] is not None]
    docs, trusted, m = documents(spark, rows), {101, 102, 300}, rules.BUCKETS

    def grams(text):
        w = [x.encode() for x in words(text)]
        ends = [x[-3:].encode() for x in words(text)]
        pair = lambda a, b: signed(xxhash.xxh64(b, seed=xxhash.xxh64(a, seed=42).intdigest()).intdigest())
        return [signed(xxhash.xxh64(x, seed=42).intdigest()) % m for x in w] + [m + pair(a, b) % m for a, b in zip(ends, ends[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        g = grams(t)
        raw.update(g)
        if i in trusted:
            target.update(g)
    total = lambda c, k: sum(n for b, n in c.items() if (b >= m) == k)
    weight = lambda b: math.log((target[b] + 1) / (total(target, b >= m) + m)) - math.log((raw[b] + 1) / (total(raw, b >= m) + m))
    model = rules.fit_llr(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).cache()
    seen = {}
    for r in rules.score_documents(docs, model).collect():
        seen.setdefault((r.doc_id, r.n_words), (r.llr, r.kept, r.base_failed))
    for i, t, _ in rows:
        if len(words(t)) > 3000:
            continue
        g = grams(t)
        want = sum(weight(b) for b in g) / max(1, 2 * len(words(t)) - 1)
        llr, kept, failed = seen[i, len(words(t))]
        assert llr == pytest.approx(want, abs=1e-9) and kept == (not failed and llr >= rules.THRESHOLD)


def test_rules_without_trusted_or_documents(spark):
    docs = documents(spark, ODD)
    model = rules.fit_llr(docs, spark.createDataFrame([], "doc_id long")).cache()
    assert {r.llr for r in rules.score_documents(docs, model).collect()} == {0.0}
    assert rules.score_documents(docs.limit(0), rules.fit_llr(docs.limit(0), spark.createDataFrame([], "doc_id long")).cache()).count() == 0
