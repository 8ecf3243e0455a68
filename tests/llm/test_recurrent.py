import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from helpers import ODD, documents

from ordkeys.llm import recurrent as R


def random_sequences(rng, lengths):
    """Symbols of documents; each ends, and only ends, with END."""
    return [np.array([*rng.choice([1, 2, 63, 64, 700, R.PLACES - 1, R.PLACES, R.SYMBOLS - 1], n - 1), R.END], np.int16) for n in lengths]


def test_gradients_against_differences(monkeypatch):
    rng = np.random.default_rng(0)
    model = R.Gru.new(rng.integers(1, 50, R.SYMBOLS).astype(float))
    for p in model.parts():
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    wide = R.Gru(*[p.astype(np.float64) for p in model.parts()])
    sequences = random_sequences(rng, (7, 5, 2))
    total = sum(map(len, sequences))
    found = []
    trainer = R.Trainer(wide)
    trainer.update = found.extend
    trainer.fit(sequences)  # one stream of one window, which holds three documents
    loss = lambda: -R.log_likelihoods(wide, sequences).sum() * math.log(10) / total
    read = sorted({R.START, *np.concatenate(sequences).tolist()} - {R.END})
    groups = sorted({int(t) // R.GROUP for t in np.concatenate(sequences) if t < R.PLACES})
    for part, gradient in zip(wide.parts(), found, strict=True):
        for at in rng.choice(part.size, 12, replace=False):
            where = list(np.unravel_index(at, part.shape))
            if part is wide.x:
                where[0] = rng.choice(read)
            elif part is wide.v or part is wide.c:
                where[0] = rng.choice(groups)
            where = tuple(where)
            old = part[where]
            part[where] = old + 1e-3
            up = loss()
            part[where] = old - 1e-3
            down = loss()
            part[where] = old
            assert gradient[where] == pytest.approx((up - down) / 2e-3, abs=2e-5)


def test_every_symbol_is_a_target_once(monkeypatch):
    rng = np.random.default_rng(2)
    sequences = random_sequences(rng, (3000, 1, 2, 555, 40))
    trainer, seen = R.Trainer(R.Gru.new(np.ones(R.SYMBOLS))), Counter()
    whole = trainer.window

    def noted(reads, targets, h, real):
        seen.update(zip(reads[real].tolist(), targets[real].tolist(), strict=True))
        return whole(reads, targets, h, real)

    monkeypatch.setattr(trainer, "window", noted)
    monkeypatch.setattr(R, "STEPS", 3)
    trainer.fit(sequences)
    assert seen == Counter(pair for s in sequences for pair in zip([R.START, *s[:-1].tolist()], s.tolist(), strict=True))


def test_state_is_carried_over_windows(monkeypatch):
    rng = np.random.default_rng(1)
    model = R.Gru.new(np.ones(R.SYMBOLS))
    sequences = random_sequences(rng, (100, 1, 47, 24, 25))
    whole = R.log_likelihoods(model, sequences)
    # one step after the other, by the definition
    for s, found in zip(sequences, whole, strict=True):
        h, before, total = np.zeros((1, R.UNITS), np.float32), R.START, 0.0
        for symbol in s.tolist():
            z, r = np.split(1 / (1 + np.exp(-(model.x[before, : 2 * R.UNITS] + h @ model.zr))), 2, axis=1)
            n = np.tanh(model.x[before, 2 * R.UNITS :] + (r * h) @ model.n)
            h = (1 - z) * n + z * h
            y = (h @ model.o + model.b)[0]
            total += y[R.classes_of(np.array(symbol))] - np.log(np.exp(y).sum())
            if symbol < R.PLACES:
                group, word = divmod(symbol, R.GROUP)
                y = (h @ model.v[group] + model.c[group])[0]
                total += y[word] - np.log(np.exp(y).sum())
            before = symbol
        assert found == pytest.approx(total / math.log(10), rel=1e-4)
    monkeypatch.setattr(R, "WINDOW", 7)
    monkeypatch.setattr(R, "SCORE_DOCS", 2)
    assert np.allclose(whole, R.log_likelihoods(model, sequences), rtol=1e-5)


def test_chances_add_up():
    vocabulary = {b"the": 5, b"cat,": 2, b"\xc3\xa9t\xc3\xa9": 1}
    counts = R.Counts([], np.zeros(R.SYMBOLS), np.zeros(R.TAIL), 3, {}, np.zeros(0), np.zeros(0, int))
    for w, n in vocabulary.items():
        counts.symbols[R.PLACES + R.spelling(w)] += n
        counts.kinds[R.spelling(w)] += 1
    for c in range(R.TAIL):
        own = [n for w, n in vocabulary.items() if R.spelling(w) == c]
        assert sum(10 ** counts.within(n, np.int64(R.PLACES + c)) for n in own) + 10 ** counts.within(0, np.int64(R.PLACES + c)) == pytest.approx(1)
    assert sum(10 ** counts.base(n) for n in vocabulary.values()) + 10 ** counts.base(0) == pytest.approx(1)
    model, h = R.Gru.new(np.arange(R.SYMBOLS) + 1.0), np.full((R.SYMBOLS, R.UNITS), 0.3, np.float32)
    assert np.exp(model.log_chances(h, np.arange(R.SYMBOLS))).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("most", [3, 10_000])
def test_scores_by_brute_force(spark, most, monkeypatch):
    long = "long" * 40
    rows = ODD + [(100 + i, " ".join(f"{'the' if j % 3 else 'Cat,'} w{i * j % 23}." for j in range(30)) + f" {long} only{i}", "s") for i in range(60)]
    if most == 3:
        rows = [*rows, (200, " ".join(f"{a}{b}" for a in range(40) for b in "abcdefghijklmnopqrstuvwxyz") + " ", "s"), *((300 + i, f"often{i} " * 9, "s") for i in range(200))]
    docs = documents(spark, rows)
    counts_of: Counter = Counter()
    tokens = [[*(w.translate(R._LOWER) for w in (t or "").encode().split()), None] for _, t, _ in rows]
    for t in tokens:
        counts_of.update(t)
    total, kinds = sum(counts_of.values()), len(counts_of)
    vocabulary = R.with_spellings(R.count_words(docs)).cache()
    counts = R.gather(vocabulary, most)
    assert (counts.total, counts.distinct) == (total, kinds) and len(counts.words) <= max(most, R.PLACES - 1)
    encoded = R.encode_documents(docs, counts)
    model = R.train(encoded, counts, rounds=1, share=1)
    got = sorted((tuple(r) for r in R.score_documents(encoded, model, counts, vocabulary).collect()), key=str)
    frequent = {w: i for i, w in enumerate(counts.frequent, 1)} | {None: R.END}
    assert len(set(counts.frequent)) == min(R.PLACES, kinds) - 1
    by_hash = lambda w: R.tokens_of(w.decode())[0] if w and len(w) > R.WORD_BYTES else w
    symbol = lambda w: frequent.get(by_hash(w), -1) if by_hash(w) in frequent else R.PLACES + R.spelling(by_hash(w))
    per, n_of = Counter(), Counter()
    for w, n in counts_of.items():
        per[symbol(w)] += n
        n_of[symbol(w)] += 1
    want = []
    for (i, _, _), t in zip(rows, tokens, strict=True):
        base = sum(math.log10((counts_of[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        inside = sum(math.log10((counts_of[w] + 0.1) / (per[symbol(w)] + 0.1 * (n_of[symbol(w)] + 1))) for w in t if symbol(w) >= R.PLACES)
        want.append((i, len(t), len(t), base, inside + R.log_likelihoods(model, [np.array([symbol(w) for w in t])])[0]))
    order = lambda g: (str(g[0]), round(g[3], 3))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-4)


def test_held_out_documents_are_likelier_than_by_counts(spark):
    out = R.op5_recurrent_lm(spark, "/root/testdata/sf0.01").toPandas()
    held = out[out.held_out]
    assert (out.held_out == [crc32(str(i).encode()) % 10 == 0 for i in out.doc_id]).all()
    gain = (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum()
    assert gain > 0.2 and len(held) > 50  # log10 a token


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "unseen words", "a")])
    vocabulary = R.with_spellings(R.count_words(docs.limit(0))).cache()
    counts = R.gather(vocabulary)
    encoded = R.encode_documents(docs, counts)
    r = R.score_documents(encoded, R.train(encoded.limit(0), counts), counts, vocabulary).first()
    assert (r.n_tokens, r.n_known) == (3, 0) and math.isfinite(r.score) and r.base_score == pytest.approx(0.0)


def test_training_takes_every_document(spark, monkeypatch):
    docs = documents(spark, [(i, f"w{i} and more", "a") for i in range(200)] + [(None, "w200 and more", "a")])
    counts = R.gather(R.with_spellings(R.count_words(docs)).cache())
    encoded = R.encode_documents(docs, counts)
    read, whole = Counter(), type(docs).mapInArrow

    def noted(self, f, schema, *more, **named):
        if self.columns == ["symbols"]:
            read.update(bytes(r.symbols) for r in self.collect())
        return whole(self, f, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    R.train(encoded, counts)
    assert read == Counter(bytes(r.symbols) for r in encoded.collect()) and len(read) == 201
    with pytest.raises(ValueError):
        R.train(encoded, counts, rounds=2, share=8)
