"""Gated recurrent language model: numpy, truncated backpropagation, class-factored softmax.

The most frequent words, and the end of a document, have a symbol each; every other
word has the symbol of its spelling (capital, punctuation, ending), so that any word,
known or not, has one. The network reads symbols. Its output is factored twice: a
softmax over classes, and for the frequent words, which share classes of equal rank, a
softmax over the words of the class; both depend on the recurrent state. Of a word in a
class of spellings, the chance comes from counts over all training tokens. The state is
carried from window to window, so a document of any length is scored whole.

Training: in each round every task trains a copy of the network on its documents of
the round's part; the copies are averaged by the number of their tokens. The rounds
together take every training document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordkeys.llm.common import materialize

#: Classes of frequent words, and words of each: their symbols come first, and the first of all is the end of a document.
GROUPS, GROUP = 16, 64
PLACES, END = GROUPS * GROUP, 0
#: Groups of endings; spellings: capital or not, three kinds of last character, ending. Their symbols follow, and a last one is read at the start.
ENDINGS = 8
TAIL = 2 * 3 * ENDINGS
SYMBOLS, START = PLACES + TAIL, PLACES + TAIL
CLASSES = GROUPS + TAIL
#: Added to every count.
ADD = 0.1
#: Units; steps of a window; documents side by side in scoring.
UNITS, WINDOW, SCORE_DOCS = 16, 24, 8192
#: Streams that training reads side by side at most; fewer where there are less than so many windows.
STREAMS, STEPS = 256, 240
#: States whose softmax is taken at a time.
_STATES = 24_000
#: Documents whose other words are held as Python objects.
_HELD = 512
#: Rounds of training. Each takes one of as many parts, so that together they take every training document.
ROUNDS = 2
#: Most words in the table of frequent words that all tasks hold. All other words meet their counts in a join.
FREQUENT = 300_000
#: A word of more bytes goes by a hash, so that a word of any length can be in the table.
WORD_BYTES = 48
_RATE = 0.015
#: Entries of a task's table of counts before it is handed on.
_COUNTS = 250_000


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered; long ones by a hash behind a byte that no text has."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if w and max(map(len, w)) > WORD_BYTES:
        w = [x if len(x) <= WORD_BYTES else b"\xff" + blake2b(x, digest_size=16).digest() for x in w]
    return w


def spelling(word: bytes) -> int:
    """Which spelling a word has, from itself alone."""
    last = word[-1]
    kind = 0 if last >= 128 or 97 <= last <= 122 or 48 <= last <= 57 else 1 if last == 46 else 2
    core = word if kind == 0 else word.rstrip(b".,;:!?#*$%&|<>\"')") or word
    other = core[0] < 97  # a digit or sign
    return ((1 if other else 0) * 3 + kind) * ENDINGS + crc32(core[-2:]) % ENDINGS


def classes_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < PLACES, symbols // GROUP, symbols - (PLACES - GROUPS))


def _by_group(targets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places in targets of the words of each group that occurs."""
    own = np.flatnonzero(targets < PLACES)
    groups = targets[own] // GROUP
    order = np.argsort(groups, kind="stable")
    own, bounds = own[order], np.searchsorted(groups[order], np.arange(GROUPS + 1)).tolist()
    for g in range(GROUPS):
        if bounds[g] < bounds[g + 1]:
            yield g, own[bounds[g] : bounds[g + 1]]


SHAPES = ((SYMBOLS + 1, 3 * UNITS), (UNITS, 2 * UNITS), (UNITS, UNITS), (UNITS, CLASSES), (CLASSES,), (GROUPS, UNITS, GROUP), (GROUPS, GROUP))


@dataclass
class Gru:
    """Input rows by symbol, recurrent weights, and output weights of the classes and of the words of each group."""

    x: np.ndarray  # update, reset, candidate
    zr: np.ndarray
    n: np.ndarray
    o: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def new(counts: np.ndarray) -> Gru:
        """Starts from the symbols' shares."""
        rng = np.random.default_rng(5)
        draw = lambda size, shape: (size * rng.normal(0, 1, shape)).astype(np.float32)
        classes = np.bincount(classes_of(np.arange(SYMBOLS)), counts, CLASSES) + ADD
        words = counts[:PLACES].reshape(GROUPS, GROUP) + ADD
        share = lambda a: np.log(a / a.sum(axis=-1, keepdims=True)).astype(np.float32)
        return Gru(*(draw(size, shape) for size, shape in zip((0.3, 0.3, 0.3, 0.03), SHAPES[:4], strict=True)), share(classes), draw(0.03, SHAPES[5]), share(words))

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.zr, self.n, self.o, self.b, self.v, self.c]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def of(flat: np.ndarray) -> Gru:
        out, at = [], 0
        for shape in SHAPES:
            n = math.prod(shape)
            out.append(flat[at : at + n].astype(np.float32).reshape(shape))
            at += n
        return Gru(*out)

    def step(self, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """before: symbols read; h: states. Returns update, reset, candidate and new state."""
        return self.advance(self.x[before], h)

    def advance(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """row: input rows of the symbols read. Returns what step() does."""
        zr = row[:, : 2 * UNITS] + h @ self.zr
        np.tanh(0.5 * zr, out=zr)
        zr = 0.5 * zr + 0.5
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        n = np.tanh(row[:, 2 * UNITS :] + (r * h) @ self.n)
        return z, r, n, n + z * (h - n)

    def log_chances(self, states: np.ndarray, targets: np.ndarray, gradients: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural logs of the targets' chances. gradients: gets those of the states, o, b, v and c of the mean loss, if given."""
        rows, classes = np.arange(len(targets)), classes_of(targets)
        y = states @ self.o
        y += self.b
        out, total = _log_softmax(y, rows, classes)
        if gradients is not None:
            scale = np.float32(1 / len(targets))
            y *= (scale / total)[:, None]
            y[rows, classes] -= scale
            d_states, d_v, d_c = y @ self.o.T, np.zeros_like(self.v), np.zeros_like(self.c)
            d_o, d_b = states.T @ y, y.sum(0)
        for g, own in _by_group(targets):
            h, word = states[own], targets[own] - g * GROUP
            y = h @ self.v[g]
            y += self.c[g]
            more, total = _log_softmax(y, rows[: len(own)], word)
            out[own] += more
            if gradients is not None:
                y *= (scale / total)[:, None]
                y[rows[: len(own)], word] -= scale
                d_v[g], d_c[g] = h.T @ y, y.sum(0)
                d_states[own] += y @ self.v[g].T
        if gradients is not None:
            gradients += [d_states, d_o, d_b, d_v, d_c]
        return out


def _log_softmax(y: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the targets' chances; y becomes all chances times the totals, which come second."""
    if max(y.max(), -y.min()) > 60:  # else no exponential can overflow, nor all of them vanish
        y -= y.max(axis=1, keepdims=True)
    own = y[rows, targets]
    np.exp(y, out=y)
    total = y @ np.ones(y.shape[1], y.dtype)
    return own - np.log(total), total


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, the longest first, as columns; and their lengths."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((lengths[0], len(sequences)), np.int32)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, lengths


def log_likelihoods(model: Gru, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 chances of whole symbol sequences, each of at least one symbol."""
    out = np.zeros(len(sequences))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), SCORE_DOCS):
        chosen = order[at : at + SCORE_DOCS]
        lengths = np.array([len(sequences[i]) for i in chosen])
        h = np.zeros((len(chosen), UNITS), np.float32)
        before = np.full(len(chosen), START)
        total = np.zeros(len(chosen))
        states, targets, held = [], [], 0

        def flush() -> None:
            if states:
                logs = model.log_chances(np.concatenate(states), np.concatenate(targets))
                ends = np.cumsum([len(s) for s in states])
                for s, end in zip(states, ends, strict=True):
                    total[: len(s)] += logs[end - len(s) : end]
                states.clear()
                targets.clear()

        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()  # sequences longer than t
        for start in range(0, lengths[0], WINDOW):
            window, _ = _padded([sequences[i][start : start + WINDOW] for i in chosen[: alive[start]]])
            for t, n in enumerate(alive[start : start + WINDOW]):
                h = model.step(before[:n], h[:n])[3]
                before = window[t, :n]
                states.append(h)
                targets.append(before)
                held += n
                if held >= _STATES:
                    flush()
                    held = 0
        flush()
        out[chosen] = total / math.log(10)
    return out


class Trainer:
    """Adam over windows; gradients stop at a window's start, states don't."""

    def __init__(self, model: Gru, rate: float = _RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.m = [np.zeros_like(p) for p in model.parts()]
        self.v = [np.zeros_like(p) for p in model.parts()]

    def fit(self, sequences: list[np.ndarray]) -> None:
        """One pass. The documents, one after the other, are cut into streams of equal length that are read side by side.

        A document starts without a state; so does, in its midst, the one that a stream
        begins in. Every symbol is a target once.
        """
        if not sequences:
            return
        whole = np.concatenate(sequences)
        reads = np.concatenate((np.full(1, START), whole[:-1]))
        reads[reads == END] = START
        streams = int(np.clip(len(whole) // (WINDOW * STEPS), 1, STREAMS))
        length = -(-len(whole) // streams)
        at = np.minimum(np.arange(length)[:, None] + length * np.arange(streams)[None, :], len(whole) - 1)
        real = np.arange(length)[:, None] + length * np.arange(streams)[None, :] < len(whole)
        h = np.zeros((streams, UNITS), np.float32)
        for start in range(0, length, WINDOW):
            own = slice(start, start + WINDOW)
            h = self.window(reads[at[own]], whole[at[own]], h, real[own])

    def window(self, reads: np.ndarray, targets: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """reads, targets: a row a step, a column a stream; h: states before; real: where there is a target. Returns the states after."""
        model, (steps, streams) = self.model, reads.shape
        rows = model.x[reads]
        keep = (reads != START).astype(rows.dtype)[:, :, None]
        z, r, c, old, states = (np.empty((steps, streams, UNITS), rows.dtype) for _ in range(5))
        for t in range(steps):
            old[t] = h * keep[t]
            z[t], r[t], c[t], h = model.advance(rows[t], old[t])
            states[t] = h
        chosen = np.arange(reads.size) if real is None else np.flatnonzero(real.ravel())
        flat = states.reshape(-1, UNITS)
        whole = len(chosen) == len(flat)
        gradients: list[np.ndarray] = []
        model.log_chances(flat if whole else flat[chosen], targets.ravel()[chosen], gradients)
        d, *d_out = gradients
        if not whole:
            d_all = np.zeros_like(flat)
            d_all[chosen] = d
            d = d_all
        d = d.reshape(states.shape)
        of_c, of_z, of_r = (1 - z) * (1 - c * c), (old - c) * z * (1 - z), old * r * (1 - r)
        carry = z * keep
        through = r * keep
        d_rows = np.empty_like(rows)  # of update, reset and candidate, as in x
        n_back, zr_back, d_h = np.ascontiguousarray(model.n.T), np.ascontiguousarray(model.zr.T), np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            now, d_row = d[t] + d_h, d_rows[t]
            d_c = np.multiply(now, of_c[t], out=d_row[:, 2 * UNITS :])
            d_rh = d_c @ n_back
            np.multiply(now, of_z[t], out=d_row[:, :UNITS])
            np.multiply(d_rh, of_r[t], out=d_row[:, UNITS : 2 * UNITS])
            d_h = now * carry[t] + d_rh * through[t] + (d_row[:, : 2 * UNITS] @ zr_back) * keep[t]
        d_flat, old_flat = d_rows.reshape(-1, 3 * UNITS), old.reshape(-1, UNITS)
        d_n, d_zr = (r * old).reshape(-1, UNITS).T @ d_flat[:, 2 * UNITS :], old_flat.T @ d_flat[:, : 2 * UNITS]
        d_x = np.zeros_like(model.x)
        order = np.argsort(reads, axis=None, kind="stable")
        found, first = np.unique(reads.ravel()[order], return_index=True)
        d_x[found] = np.add.reduceat(d_flat[order], first)
        self.update([d_x, d_zr, d_n, *d_out])
        return h

    def update(self, gradients: list[np.ndarray]) -> None:
        self.steps += 1
        size = math.sqrt(sum(float((g * g).sum()) for g in gradients))
        for p, m, v, g in zip(self.model.parts(), self.m, self.v, gradients, strict=True):
            g = g * np.float32(min(1, 1 / max(size, 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(self.rate) * (m / np.float32(1 - 0.9**self.steps)) / (np.sqrt(v / np.float32(1 - 0.99**self.steps)) + np.float32(1e-6))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts; a null word for the ends. Each task hands on partial counts, its table bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0
        kinds = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for text in batch.column("text"):
                counts.update(tokens_of(text.as_py()))
                if len(counts) > _COUNTS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=kinds)
                    counts.clear()
            ends += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), ends], pa.int64())], schema=kinds)

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def with_spellings(counts: DataFrame) -> DataFrame:
    """spelling of each word; null for the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([None if w is None else spelling(w) for w in batch.column("word").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["word", "n", "spelling"])

    return counts.mapInArrow(run, "word binary, n bigint, spelling int")


@dataclass
class Counts:
    """Frequent words in order, with the counts of all symbols; kinds of each spelling; the bounded table of words."""

    frequent: list[bytes]
    symbols: np.ndarray
    kinds: np.ndarray
    distinct: int
    words: dict[bytes, int]
    n: np.ndarray
    of: np.ndarray  # symbols of the words in the table

    @property
    def total(self) -> int:
        return int(self.symbols.sum())

    @property
    def tail(self) -> np.ndarray:
        """What counts in a spelling are divided by: all unseen words of it are one."""
        return self.symbols[PLACES:] + ADD * (self.kinds + 1)

    def base(self, n):
        """log10 of the unigram chance of tokens seen n times."""
        return np.log10((n + ADD) / (self.total + ADD * (self.distinct + 1)))

    def within(self, n, symbols):
        """log10 of the chance, given its symbol, of a token seen n times. Frequent words are their symbols."""
        return np.where(symbols < PLACES, 0.0, np.log10((n + ADD) / self.tail[np.maximum(0, symbols - PLACES)]))


def frequent_from(vocabulary: DataFrame, most: int) -> int:
    """The least count from which at most ``most`` words reach it. It takes the counts of counts, not a sort of words."""
    by_count = vocabulary.filter("word is not null").groupBy("n").agg(F.count("*").alias("k"))
    above = by_count.withColumn("upto", F.sum("k").over(Window.partitionBy().orderBy(F.desc("n"))))
    return above.filter(F.col("upto") <= most).agg(F.coalesce(F.min("n"), F.lit(1 << 62))).first()[0]


def gather(vocabulary: DataFrame, most: int = FREQUENT) -> Counts:
    """What comes to the driver is bounded by the number of symbols and of words in the table."""
    words = vocabulary.filter("word is not null")
    per = vocabulary.groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    top = words.orderBy(F.desc("n"), "word").limit(PLACES - 1).collect()
    symbols, kinds = np.zeros(SYMBOLS), np.zeros(TAIL)
    for r in per:
        if r.spelling is None:
            symbols[END] = r.n
        else:
            symbols[PLACES + r.spelling], kinds[r.spelling] = r.n, r.kinds
    distinct = int(kinds.sum()) + int(symbols[END] > 0)
    for i, r in enumerate(top, END + 1):
        symbols[i] = r.n
        symbols[PLACES + r.spelling] -= r.n
        kinds[r.spelling] -= 1
    frequent = [bytes(r.word) for r in top]
    known = set(frequent)
    table = words.filter(F.col("n") >= frequent_from(vocabulary, most)).toArrow()
    rest = [(w, n, PLACES + s) for w, n, s in zip(*(table.column(c).to_pylist() for c in ("word", "n", "spelling")), strict=True) if w not in known]
    rows = [(w, r.n, i) for i, (w, r) in enumerate(zip(frequent, top, strict=True), END + 1)] + rest
    return Counts(frequent, symbols, kinds, distinct, {w: i for i, (w, _, _) in enumerate(rows)}, np.array([n for _, n, _ in rows], np.int64), np.array([s for *_, s in rows], np.int64))


def encode_documents(docs: DataFrame, counts: Counts, keep: dict[str, Column] | None = None) -> DataFrame:
    """Every document as the network reads it, written.

    docs: doc_id, text. keep: further columns, by name. Returns row (a number of its
    own), doc_id, those columns, n_tokens, symbols (16-bit numbers), and for the words
    in the table n_known, base, within (sums of log10 chances by counts, over all words
    and given the symbols); others: the other words, with their spelling and times.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    chosen = docs.select(*[c.alias(f"__{k}") for k, c in (keep or {}).items()], "doc_id", "text")
    kept = [f for f in chosen.schema.fields if f.name != "text"]
    other = "array<struct<word:binary,spelling:int,times:int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", n_tokens bigint, n_known bigint, base double, within double, others {other}, symbols binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        get, base, within = c.words.get, c.base(c.n), c.within(c.n, c.of)
        of = c.of.astype(np.int16)
        end_n = c.symbols[END]
        end = float(c.base(end_n))
        kinds = [
            ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()),
            ("others", pa.list_(pa.struct([("word", pa.binary()), ("spelling", pa.int32()), ("times", pa.int32())]))), ("symbols", pa.binary()),
        ]
        for whole in batches:
            for at in range(0, whole.num_rows, _HELD):
                batch = whole.slice(at, _HELD)
                rows: dict[str, list] = {k: [] for k, _ in kinds}
                for text in batch.column("text"):
                    w = tokens_of(text.as_py())
                    ids = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                    seen = ids >= 0
                    known = ids[seen]
                    symbols = np.full(len(w) + 1, END, np.int16)
                    symbols[:-1][seen] = of[known]
                    found: dict[bytes, list[int]] = {}
                    for i in np.flatnonzero(~seen).tolist():
                        if (entry := found.get(w[i])) is None:
                            entry = found[w[i]] = [spelling(w[i]), 0]
                        entry[1] += 1
                        symbols[i] = PLACES + entry[0]
                    others = [{"word": x, "spelling": k, "times": n} for x, (k, n) in found.items()]
                    own = (len(w) + 1, len(known) + int(end_n > 0), float(base[known].sum()) + end, float(within[known].sum()), others, symbols.tobytes())
                    for (k, _), v in zip(kinds, own, strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *[pa.array(rows[k], kind) for k, kind in kinds]], [*[f.name for f in kept], *rows])

    encoded = chosen.mapInArrow(run, schema).withColumnsRenamed({f"__{k}": k for k in keep or {}})
    return materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int16) for x in batch.column("symbols")]


def train(encoded: DataFrame, counts: Counts, *, rounds: int = ROUNDS, share: int = ROUNDS) -> Gru:
    """Rounds of local training and averaging. Documents are dealt into ``share`` parts by a hash of their row; each round takes the next part.

    encoded: of encode_documents. There are no more parts than rounds, so no document
    is left out.
    """
    if not 1 <= share <= rounds:
        raise ValueError("as many rounds as parts are needed, or documents are left out")
    context = encoded.sparkSession.sparkContext
    model = Gru.new(counts.symbols)
    size = len(model.flat())
    picked = F.pmod(F.xxhash64("row"), F.lit(share))
    for k in range(rounds):
        shared = context.broadcast(model.flat())

        def local(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trainer, seen = Trainer(Gru.of(shared.value)), 0
            for batch in batches:
                sequences = _sequences(batch)
                trainer.fit(sequences)
                seen += sum(map(len, sequences))
            if seen:
                flat = trainer.model.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["seen", "flat"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, flat = 0, np.zeros(size)
            for batch in batches:
                for n, f in zip(batch.column("seen").to_pylist(), batch.column("flat").to_pylist(), strict=True):
                    seen += n
                    flat += np.frombuffer(f)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["seen", "flat"])

        kinds = "seen bigint, flat binary"
        own = encoded.filter(picked == k % share).select("symbols").mapInArrow(local, kinds)
        sums = own.repartition(8).mapInArrow(summed, kinds).collect()  # at most eight rows of the network's size
        if seen := sum(r.seen for r in sums):
            model = Gru.of(sum(np.frombuffer(r.flat) for r in sums) / seen)
    return model


def score_documents(encoded: DataFrame, model: Gru, counts: Counts, vocabulary: DataFrame) -> DataFrame:
    """Whole-document log10 likelihoods.

    encoded: of encode_documents; vocabulary: word, n. Adds n_known, base_score and
    score to its columns, for all words. Null and empty texts have one token, the end.

    Words in the table, which are the most frequent ones of any length, are counted
    already. Other words meet their counts in a join by word, which Spark may split,
    as (row, word, times).
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model.flat())
    known = [c for c in encoded.columns if c not in ("others", "symbols", "within")]
    kept = encoded.select(*known, "within", "symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru = Gru.of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SCORE_DOCS):
                batch = whole.slice(at, SCORE_DOCS)
                score = log_likelihoods(gru, _sequences(batch)) + batch.column("within").to_numpy()
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in known], pa.array(score, pa.float64())], [*known, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*known).schema.fields)
    scored = kept.mapInArrow(run, f"{fields}, score double")
    others = encoded.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.spelling", "o.times")
    n = F.coalesce("n", F.lit(0))
    constants = lambda a: F.get(F.from_json(F.lit(str(a.tolist())), "array<double>"), F.col("spelling"))
    base = F.log10((n + ADD) / (counts.total + ADD * (counts.distinct + 1)))
    within = F.log10((n + ADD) / constants(counts.tail))
    joined = others.join(vocabulary.select("word", "n").hint("merge"), "word", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * base).alias("base2"), F.sum(F.col("times") * within).alias("score2")
    )
    more = lambda name: F.coalesce(name, F.lit(0))
    own = [c for c in known if c not in ("row", "n_tokens", "n_known", "base")]
    return scored.join(sums.hint("merge"), "row", "left").select(
        *own, "n_tokens", (F.col("n_known") + more("known2")).alias("n_known"), (F.col("base") + more("base2")).alias("base_score"), (F.col("score") + more("score2")).alias("score")
    )


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op5_recurrent_lm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    vocabulary = materialize(with_spellings(count_words(docs.filter(~held_out))), "vocabulary")
    counts = gather(vocabulary)
    encoded = encode_documents(docs, counts, {"held_out": held_out})
    model = train(encoded.filter("not held_out"), counts)
    return score_documents(encoded, model, counts, vocabulary).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
