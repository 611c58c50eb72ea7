"""Brute-force versions of the operators, in plain Python over whole lists."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def remove_repeats(docs, window=20):
    """(id, text) -> {id: kept words}; ids are unique."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: -(1 << 63) if d[0] is None else d[0]):
        w = words(text)
        stays = [True] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s: s + window])
            if k in seen:
                stays[s: s + window] = [False] * window
            seen.add(k)
        out[i] = [x for x, y in zip(w, stays, strict=True) if y]
    return out


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(docs):
    """(id, text) -> {id: (shingles, component)}; ids are unique."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def uniform(seed, *parts):
    return int(hashlib.md5("|".join([str(seed), *map(str, parts)]).encode()).hexdigest()[:13], 16) / 16 ** 13


def poisson(mean, seed, key):
    parts = max(1, math.ceil(mean / 16))
    n = 0
    for part in range(1, parts + 1):
        u, p, total, k = uniform(seed, key, part), math.exp(-mean / parts), 0.0, 0
        total = p
        while total <= u and k < 96:
            k += 1
            p *= mean / parts / k
            total += p
        n += k
    return n


def mixed(docs, seed=42, temperature=0.5):
    """(id, source, text) -> {id: copies}."""
    size = {}
    for _, s, t in docs:
        size[s] = size.get(s, 0) + len(t or "")
    raw = {s: n ** temperature for s, n in size.items() if n}
    whole, total = sum(raw.values()), sum(size.values())
    return {i: poisson(raw[s] / whole * total / size[s], seed, i) if size[s] else 0 for i, s, _ in docs}
