"""Token counts by a compiled deterministic transducer.

Byte-pair encoding with word ends, as in ``word_bpe_49k.json``. The transducer reads
the bytes of one pre-token and adds, on each transition, by how much the number of
tokens of what was read so far changes. It rests on a property of such encodings: a
token sequence is the encoding of its text exactly if every two neighbours are the
encoding of their own concatenation. So the last token of a prefix follows from the
last tokens of shorter prefixes, no further back than the longest token, and a state
needs to hold those only. Transitions are compiled when first needed into sorted
arrays, in which all words of a batch advance side by side, a byte at a time.

Every text is cut into blocks. White space puts the transducer into its first state,
so the map of a block, from the state it is entered in to the state it is left in and
the tokens between, needs the block's first and last pieces and one number, which is a
difference of prefix sums over the batch's pieces. Inside long pieces the maps are of
chunks: from each state that a chunk can be entered in to the state it is left in.
Both kinds compose associatively and are composed by a tree.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block of a text; bytes of a chunk of a piece without white space.
BLOCK, CHUNK = 65_536, 128
#: Compiled states that a worker keeps; beyond, the half that was not used longest goes.
MAX_STATES = 250_000
#: The pre-tokenizer's pattern, and the endings in it that an apostrophe takes with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of texts that are counted side by side.
_SLICE = 16_000_000
#: Words of a step of compilation; states are dropped between steps only.
_STEP = 50_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordTransducer:
    """Counts the tokens of pre-tokens.

    A state is a pair: the longest suffix read that begins a longer token; and for each
    position in it where a token could still begin, the last token before it (by
    number) and the tokens up to it, less those up to now.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, max_states: int = MAX_STATES):
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.suffix, self.max_states = suffix, max_states
        self.letters = byte_letters()
        bases = [*self.letters, *(x + suffix for x in self.letters)]
        if missing := [x for x in bases if x not in vocab]:
            raise ValueError(f"the vocabulary has no {missing[0]!r}")
        # a token's parts and when it is made: a single symbol is there from the start
        self.parts: dict[str, tuple[str, str]] = {}
        self.made = dict.fromkeys(bases, -1)
        for (a, b), i in self.rank.items():
            if a + b in self.made or max(self.made[a], self.made[b]) >= i:
                raise ValueError("only vocabularies whose tokens have one merge each, after those of their parts, are compiled")
            self.parts[a + b] = (a, b)
            self.made[a + b] = i
        self.tokens = list(self.made)
        self.number = {t: i for i, t in enumerate(self.tokens)}
        bare = [t.removesuffix(suffix) for t in self.tokens]
        self.heads = {t[:i] for t in bare for i in range(len(t))}
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.endings: dict[tuple[str, bool], tuple[tuple[int, int], ...]] = {}
        self.kept: dict[str, tuple[str, int, tuple[bool, ...]]] = {}
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.used = np.zeros(1024, np.int64)
        self.tick = 0
        self.at = np.zeros(0, np.int64)  # state, byte and whether the word ends, as one number; sorted
        self.to = np.zeros(0, np.int64)
        self.more = np.zeros(0, np.int64)
        self._state("", ((-1, 0),))

    def _state(self, read: str, behind: tuple) -> int:
        if (found := self.ids.get((read, behind))) is None:
            found = self.ids[read, behind] = len(self.keys)
            self.keys.append((read, behind))
            if found >= len(self.used):
                self.used = np.concatenate((self.used, np.zeros_like(self.used)))
            self.used[found] = self.tick
        return found

    def encode(self, word: str, ends: bool = True) -> list[str]:
        """Merges by rank, one after the other: what the transducer is held against."""
        parts = [*word[:-1], word[-1] + self.suffix] if ends else [*word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                joined = tuple(parts[i : i + 2]) == pair
                out.append(parts[i] + parts[i + 1] if joined else parts[i])
                i += 1 + joined
            parts = out
        return parts

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of a token while it is being made, from its first symbol on; and until when."""
        if (known := self.spines.get((token, side))) is None:
            known, part, until = [], token, len(self.rank)
            while True:
                known.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.made[part], self.parts[part][side]
            known.reverse()
            self.spines[token, side] = known
        return known

    def pair_stays(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their concatenation; left is -1 for none.

        They are if no merge joins what stands on both sides of the border while both
        stand there. Equal merges go from left to right, so one that is due at the same
        time wins over one inside the right token and loses to one inside the left.
        """
        key = left * len(self.tokens) + right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 4 * self.max_states:
                self.fits = dict(list(self.fits.items())[len(self.fits) // 2 :])
            token = self.tokens[right]
            if left < 0:
                ends = token.endswith(self.suffix) and token != self.suffix
                known = self.encode(token.removesuffix(self.suffix) if ends else token, ends) == [token]
            else:
                known = self._apart(self._spine(self.tokens[left], 1), self._spine(token, 0))
            self.fits[key] = known
        return known

    def _apart(self, left: list[tuple[str, int]], right: list[tuple[str, int]]) -> bool:
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            when = self.rank.get((a, b))
            if when is not None and when < a_until and when <= b_until:
                return False
            if a_until <= b_until and i + 1 < len(left):
                i += 1
            elif j + 1 < len(right):
                j += 1
            else:
                return True

    def _endings(self, now: str, ends: bool) -> tuple[tuple[int, int], ...]:
        """Tokens that what was read ends with, the longest first: number, position they begin at."""
        if (known := self.endings.get((now, ends))) is None:
            more = self.suffix if ends else ""
            known = tuple((n, i) for i in range(len(now)) if (n := self.number.get(now[i:] + more)) is not None)
            self.endings[now, ends] = known
        return known

    def _kept(self, now: str) -> tuple[str, int, tuple[bool, ...]]:
        """Longest suffix that begins a longer token, the letters before it, and the positions in it where a token could begin."""
        if (known := self.kept.get(now)) is None:
            drop = next(i for i in range(len(now) + 1) if now[i:] in self.heads)
            known = self.kept[now] = (now[drop:], drop, tuple(now[i:] in self.heads for i in range(drop, len(now))))
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        """State after one more byte, and the tokens more."""
        state, byte, ends = key >> 9, key >> 1 & 255, bool(key & 1)
        read, behind = self.keys[state]
        now = read + self.letters[byte]
        for token, begins in self._endings(now, ends):  # the longest that fits is the one
            last, count = behind[begins]
            if self.pair_stays(last, token):
                break
        else:
            raise AssertionError("a single letter always fits")
        if ends:
            return 0, count + 1
        count += 1
        read, drop, open_at = self._kept(now)
        left = tuple((t, c - count) if here else (0, 0) for (t, c), here in zip(behind[drop:], open_at, strict=True))
        return self._state(read, (*left, (token, 0))), count

    def _go(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and tokens more of transitions; those that are missing are compiled."""
        at = np.searchsorted(self.at, keys)
        at[at == len(self.at)] = 0
        missing = self.at[at] != keys if len(self.at) else np.ones(len(keys), bool)
        if missing.any():
            new = np.unique(keys[missing])
            made = np.array([self._compile(int(k)) for k in new], np.int64)
            place = np.searchsorted(self.at, new)
            self.to, self.more = np.insert(self.to, place, made[:, 0]), np.insert(self.more, place, made[:, 1])
            self.at = np.insert(self.at, place, new)
            at = np.searchsorted(self.at, keys)
        return self.to[at], self.more[at]

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of data, side by side, each from a state: the states they leave in, and their tokens. ends: whether the row's last byte ends a word."""
        self.tick += 1
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, ends, state = starts[order], lengths[order], ends[order], entry[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for i, n in enumerate(alive.tolist()):
            own = state[:n]
            self.used[own] = self.tick
            key = own << 9 | data[starts[:n] + i].astype(np.int64) << 1 | (ends[:n] & (lengths[:n] == i + 1))
            state[:n], more = self._go(key)
            total[:n] += more
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def _forget(self) -> None:
        """Keep the half of the states that was used last, and the transitions between them."""
        n = len(self.keys)
        self.used[0] = self.tick + 1
        keep = np.sort(np.argsort(-self.used[:n], kind="stable")[: max(1, self.max_states // 2)])
        new = np.full(n, -1, np.int64)
        new[keep] = np.arange(len(keep))
        self.keys = [self.keys[i] for i in keep.tolist()]
        self.ids = {k: i for i, k in enumerate(self.keys)}
        self.used = np.concatenate((self.used[keep], np.zeros(1024, np.int64)))
        source = new[self.at >> 9]
        stay = (source >= 0) & ((new[self.to] >= 0) | (self.at & 1 > 0))
        self.at = source[stay] << 9 | self.at[stay] & 511
        self.to, self.more = np.maximum(new[self.to[stay]], 0), self.more[stay]
        self.endings.clear()
        self.kept.clear()

    def count_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each of the non-empty words that lie in data."""
        out = np.zeros(len(starts), np.int64)
        for i in range(0, len(starts), _STEP):
            if len(self.keys) > self.max_states:
                self._forget()
            at, n = starts[i : i + _STEP], lengths[i : i + _STEP]
            short = np.flatnonzero(n <= CHUNK)
            first = np.zeros(len(short), np.int64)
            out[i + short] = self.run(data, at[short], n[short], first, first == 0)[1]
            for k in np.flatnonzero(n > CHUNK).tolist():
                out[i + k] = self._count_long(data[at[k] : at[k] + n[k]].tobytes())
        return out

    def count(self, word: bytes) -> int:
        return int(self.count_rows(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])

    def _count_long(self, word: bytes) -> int:
        """By maps of chunks. A chunk's map is taken for the first state and for all states that the chunk before is left in by its own map."""
        chunks = [(word[i : i + CHUNK], i + CHUNK >= len(word)) for i in range(0, len(word), CHUNK)]
        kinds = list(dict.fromkeys(chunks))
        place = {k: i for i, k in enumerate(kinds)}
        follow = {(place[a], place[b]) for a, b in zip(chunks, chunks[1:], strict=False)}
        data = np.frombuffer(b"".join(c for c, _ in kinds), np.uint8)
        lengths = np.array([len(c) for c, _ in kinds])
        starts, ends = np.cumsum(lengths) - lengths, np.array([e for _, e in kinds])
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in kinds]
        wanted = [(k, 0) for k in range(len(kinds))]
        while wanted:
            k, entry = (np.array(x, np.int64) for x in zip(*wanted, strict=True))
            left, count = self.run(data, starts[k], lengths[k], entry, ends[k])
            for (kind, state), to, n in zip(wanted, left.tolist(), count.tolist(), strict=True):
                maps[kind][state] = (to, n)
            wanted = list({(b, to) for a, b in follow for to, _ in maps[a].values() if to not in maps[b]})
        return _tree([maps[place[c]] for c in chunks], compose_chunks)[0][1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def compose_chunks(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """a and then b, for the states that a is known for."""
    return {entry: (b[mid][0], n + b[mid][1]) for entry, (mid, n) in a.items()}


def _tree(maps: list, compose):
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class BlockMap(NamedTuple):
    """What a block of text does to the counter.

    head: characters before its first white space, which finish the piece that the
    block is entered with; whole: tokens of the pieces between; tail: characters
    after the last white space, the piece that it is left with. A block without white
    space has only a head, and open is True. pieces: pieces that composition has
    closed, yet to be counted.
    """

    head: str
    whole: int
    tail: str
    open: bool
    pieces: tuple[str, ...] = ()


def compose_blocks(a: BlockMap, b: BlockMap) -> BlockMap:
    if a.open:
        return BlockMap(a.head + b.head, b.whole, b.tail, b.open, b.pieces)
    if b.open:
        return BlockMap(a.head, a.whole, a.tail + b.head, False, a.pieces)
    return BlockMap(a.head, a.whole + b.whole, b.tail, False, (*a.pieces, a.tail + b.head, *b.pieces))


#: Kinds of characters in the pre-tokenizer's pattern.
_BLANK, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4


class Counter:
    """Counts tokens of texts as the tokenizer file at path does, without added special tokens."""

    def __init__(self, path: str, block: int = BLOCK):
        import regex

        spec = json.loads(Path(path).read_text())
        model, before = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if (
            model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in before] != ["Split", "ByteLevel"]
            or before[0]["pattern"]["Regex"] != PATTERN
        ):
            raise ValueError("only lower-casing byte-level BPE with word ends is compiled")
        self.kind_of = [(k, regex.compile(p).match) for k, p in ((_BLANK, r"\p{White_Space}"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"))]
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.special = regex.compile("|".join(map(regex.escape, sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True))))
        self.words = WordTransducer(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.block = block
        self.path, self.loaded = path, None
        self.kinds = np.zeros(0x110000, np.uint8)  # of the characters met so far
        self.assigned = np.zeros(0x110000, bool)

    def library(self):
        """The tokenizer library, whose Unicode tables are newer than Python's: for pieces with characters unassigned in the latter."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        out = self.kinds[codes]
        if not out.all():
            for c in np.unique(codes[out == 0]).tolist():
                self.kinds[c] = next((k for k, match in self.kind_of if match(chr(c))), _OTHER)
                self.assigned[c] = unicodedata.category(chr(c)) != "Cn"
            out = self.kinds[codes]
        return out

    def piece_counts(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of pieces without white space; none of an empty one."""
        if not len(pieces):
            return np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        library = None
        if not joined.isascii():
            codes = _codes(joined)
            blank = self._kinds(codes) == _BLANK
            if not (known := self.assigned[codes]).all():
                odd = np.unique(np.cumsum(blank)[~known])
                library = odd, [len(e.ids) for e in self.library().encode_batch(pieces.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")  # characters are lowered one by one: no final sigma
        joined = joined.lower()
        data = np.frombuffer(joined.encode(), np.uint8)
        starts, ends, piece = self._pre_tokens(data if len(data) == len(joined) else _codes(joined))
        out = np.bincount(piece, self.words.count_rows(data, starts, ends - starts), len(pieces)).astype(np.int64)
        if library:
            out[library[0]] = library[1]
        return out

    def _pre_tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where matches of PATTERN start and end, in UTF-8, and how many blanks stand before them.

        Runs of letters and of other characters, and single numbers; an apostrophe that
        begins a run takes one of a few endings with it.
        """
        kind = self._kinds(codes)
        before = np.concatenate((np.full(1, _BLANK, np.uint8), kind[:-1]))
        begins = (kind != _BLANK) & ((kind != before) | (kind == _NUMBER))
        quotes = np.flatnonzero(begins & (codes == 39))
        if len(quotes):
            ahead = np.concatenate((codes, np.zeros(3, codes.dtype)))
            for ending in ENDINGS:
                own = quotes[np.logical_and.reduce([ahead[quotes + 1 + i] == ord(c) for i, c in enumerate(ending)])]
                begins[own + 1] = False
                after = own[own + 1 + len(ending) < len(codes)] + 1 + len(ending)
                begins[after] = kind[after] != _BLANK
        starts = np.flatnonzero(begins)
        stops = np.flatnonzero(begins | (kind == _BLANK))
        stops = np.concatenate((stops, [len(codes)]))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        piece = np.cumsum(kind == _BLANK)[starts]
        if codes.dtype != np.uint8:
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)))
            starts, ends = upto[starts], upto[ends]
        return starts, ends, piece

    def split(self, text: str) -> list[str]:
        """Pieces between white space."""
        return [x for x in self.spaces.split(text) if x]

    def map_of(self, block: str, whole: int | None = None) -> BlockMap:
        """whole: tokens of all pieces, the first and last included, if known."""
        first = self.spaces.search(block)
        if not first:
            return BlockMap(block, 0, "", True)
        head, tail = block[: first.start()], self.spaces.split(block[max(first.start(), len(block) - 256) :])[-1]
        if len(tail) >= 256 - 1:
            tail = self.spaces.split(block[first.start() :])[-1]
        if whole is None:
            whole = int(self.piece_counts(pa.array(self.split(block), pa.string())).sum())
        return BlockMap(head, whole - int(self.piece_counts(pa.array([head, tail])).sum()), tail, False)

    def _split_all(self, blocks: pa.Array) -> pa.ListArray:
        """Pieces of blocks, and empty strings. Arrow takes for white space what Unicode does, and four separators more; blocks with those are split apart."""
        odd = pc.match_substring_regex(blocks, "[\x1c-\x1f]")
        if not pc.any(odd).as_py():
            return pc.utf8_split_whitespace(blocks)
        own = pc.if_else(odd, "", blocks)
        places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(own).to_pylist()
        for i in places.tolist():
            lists[i] = self.split(blocks[i].as_py())
        return pa.array(lists, pa.list_(pa.string()))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of whole texts, side by side."""
        out = np.zeros(len(texts), np.int64)
        texts = pc.fill_null(texts, "")
        cut = pc.or_(pc.match_substring(texts, "<|"), pc.greater(pc.utf8_length(texts), self.block)).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~cut)
        whole = texts.filter(pa.array(~cut))
        # parts between special strings, in blocks; a part's blocks are composed
        more, parts = [], []
        for i in np.flatnonzero(cut).tolist():
            text = texts[i].as_py()
            found = self.special.findall(text) if "<|" in text else []
            out[i] += len(found)
            for part in self.special.split(text) if found else [text]:
                parts.append((i, len(more), len(more) - (-len(part) // self.block)))
                more.extend(part[k : k + self.block] for k in range(0, len(part), self.block))
        blocks = pa.concat_arrays([whole, pa.array(more, pa.string())])
        pieces = self._split_all(blocks)
        kinds = pieces.values.dictionary_encode()
        counted = self.piece_counts(kinds.dictionary)
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(counted[kinds.indices.to_numpy()], dtype=np.int64)))
        ends = upto[pieces.offsets.to_numpy()]
        own = ends[1:] - ends[:-1]
        out[rows] = own[: len(rows)]
        own, left = own[len(rows) :].tolist(), []
        for row, start, end in parts:
            if end - start == 1:
                out[row] += own[start]
            elif end > start:
                m = _tree([self.map_of(more[k], own[k]) for k in range(start, end)], compose_blocks)
                out[row] += m.whole
                left.extend((row, p) for p in (m.head, m.tail, *m.pieces))
        if left:
            np.add.at(out, [row for row, _ in left], self.piece_counts(pa.array([p for _, p in left])))
        return out


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, *, max_tokens: int = 2048) -> DataFrame:
    """Tokens of every whole text.

    docs: doc_id, text; other columns are ignored. path: of the tokenizer file, the
    same on all executors. Returns doc_id, n_bytes, n_tokens, over_limit.

    Null or empty text: 0 bytes, 0 tokens. One pass, no shuffle; a worker holds one
    Arrow batch of texts and tables of bounded size. A lost executor's partition is
    just counted again.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path).counts
        for batch in batches:
            text = batch.column("text")
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            upto = np.cumsum(n_bytes.to_numpy())
            cuts = [0, *np.searchsorted(upto, np.arange(_SLICE, upto[-1], _SLICE)).tolist(), len(text)] if len(text) else [0]
            tokens = [counts(text.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(np.concatenate(tokens) if tokens else [], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
