"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items, span=13):
    out = {}
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, t in items:
            w = ALNUM.findall((t or "").translate(LOWER))
            k = min(span, len(w))
            windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        out[doc] = (len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words))
    return out


def links(docs, k=5):
    sets = {}
    for doc, text in docs:
        w = SPACE.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def substrings(docs, span=13):
    first = {}
    words = {d: SPACE.findall(t or "") for d, t in docs}
    for d, w in words.items():
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def kneser_ney(texts):
    """p(word, context) of an interpolated modified Kneser-Ney model of order 2, straight from its definition."""
    counts = defaultdict(int)
    for t in texts:
        words = ["<s>", *words_of(t), "</s>"]
        for pair in zip(words, words[1:]) if len(words) > 2 else ():
            counts[pair] += 1
    follows = defaultdict(int)
    for _, w in counts:
        follows[w] += 1

    def discounts(values):
        n1, n2, n3, n4 = (max(sum(v == k for v in values), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return lambda v: d[min(v, 3) - 1]

    pair_cut, word_cut = discounts(counts.values()), discounts(follows.values())
    every = sum(follows.values())
    freed = sum(word_cut(v) for v in follows.values())

    def low(w):
        own = follows.get(w, 0)
        return (own - word_cut(own) if own else 0) / every + freed / every / (len(follows) + 1)

    def p(w, v):
        same = {b: n for (a, b), n in counts.items() if a == v}
        if not same:
            return low(w)
        total = sum(same.values())
        return (same[w] - pair_cut(same[w]) if w in same else 0) / total + sum(map(pair_cut, same.values())) / total * low(w)

    return p


def words_of(text):
    return SPACE.findall((text or "").translate(LOWER))


def log_probability(p, text):
    words = ["<s>", *words_of(text), "</s>"]
    return (sum(math.log(p(w, v)) for v, w in zip(words, words[1:])), len(words) - 1) if len(words) > 2 else (0.0, 0)
