"""The pipeline's stages by their definitions, row by row, without the operators."""

import hashlib
import math
import re
from zlib import crc32

from helpers import lower, words

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def quality_score(text, vectors, net):
    """From word vectors and network weights: means of the words' and endings' vectors, and the shape of the text."""
    w = [x.encode() for x in words(text)]
    at = [crc32(x) % 8_192 for x in w]
    ends = [crc32(x[-2:]) % 8_192 + 8_192 for x in w]
    mean = [sum(float(vectors[i][k]) for i in rows) / max(1, len(w)) for rows in (at, ends) for k in range(64)]
    again = [sum(a == b for a, b in zip(at, at[k:], strict=False)) / max(1, len(w) - k) for k in range(1, 5)]
    x = [*mean, math.log(1e-3 + math.sqrt(sum(m * m for m in mean))), math.log(1 + len(w)), *again]
    z = [(a - float(c)) / float(s) for a, c, s in zip(x, net.center, net.scale, strict=True)]
    hidden = [math.tanh(sum(a * float(b) for a, b in zip(z, column, strict=True)) + float(bias)) for column, bias in zip(net.w1.T, net.b1, strict=True)]
    logit = sum(h * float(o) for h, o in zip(hidden, net.w2, strict=True)) + float(net.b2)
    return 1 / (1 + math.exp(-logit / net.temperature))


def near_duplicate_ids(rows):
    """The least id of each group. rows: id, text."""
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in ids if root(i) == i}


def benchmark_free(text, items):
    """No eight words of an item in a row, and fewer than two items of less than eight words as a whole."""
    w = ITEM_WORD.findall(lower(text or ""))
    runs = lambda n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    eights, short = runs(8), 0
    for _, t in items:
        own = ITEM_WORD.findall(lower(t or ""))
        if any(tuple(own[i : i + 8]) in eights for i in range(len(own) - 7)):
            return False
        short += 0 < len(own) < 8 and tuple(own) in runs(len(own))
    return short < 2


def mixed_times(rows, targets):
    """How often each row (id, text, source) is in the mix: whole epochs, one more before the cut, and at the cut if half of the row is taken."""
    out = {}
    for source in {s for *_, s in rows}:
        own = [(hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, len(words(t))) for i, t, s in rows if s == source]
        size = sum(n for *_, n in own)
        budget = math.floor(targets[source] + 1e-9)
        epochs, rest = divmod(budget, size) if size else (0, 0)
        for _, i, n in sorted(own):
            more = max(0, min(n, rest))
            rest -= n
            out[i] = 1 if n == 0 else epochs + (more > 0 and 2 * more >= n)
    return out


def draw(path, key, weight):
    bits = int(hashlib.md5(f"{path}:{key}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / 2**52) / weight


def shard(key, tree):
    """One weighted draw among regions, racks and shards."""
    for depth in (1, 2, 3):
        groups = {}
        for x in tree:
            path = "/".join(map(str, (x.region, x.rack, x.shard)[:depth]))
            groups.setdefault(path, []).append(x)
        tree = groups[min(groups, key=lambda p: draw(p, key, sum(x.weight for x in groups[p])))]
    return tree[0].shard
